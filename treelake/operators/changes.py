"""Inserts, updates, deletes and version operations as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.functions.paths import ancestors, below
from treelake.operators.entries import has


def inserted(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key is taken are refused."""
    return table.unionByName(new.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def updated(table: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The named columns replaced by those of new where the key matches."""
    fresh = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("hit_"))
    out = table.join(fresh, key, "left")
    return out.select(*[F.when(F.col("hit_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def deleted(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key), key, "left_anti")


def replaced(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: rows of new win over those of table."""
    return new.unionByName(table.join(new.select(*key), key, "left_anti"))


def counted(counters: DataFrame, deltas: DataFrame) -> DataFrame:
    return counters.unionByName(deltas).groupBy("counter").agg(F.sum("value").alias("value"))


def broken_hardlinks(dirents: DataFrame) -> DataFrame:
    return dirents.withColumn("hardlinks", F.when(has(4) & (F.col("hardlinks") > 1), F.lit(1).cast("long")).otherwise(F.col("hardlinks")))


def without_bulk_hash(dirents: DataFrame) -> DataFrame:
    return dirents.withColumn("hash", F.when(has(64), None).otherwise(F.col("hash")))


def fixed_start(stats: DataFrame) -> DataFrame:
    return stats.withColumn("start_time", F.when(F.col("start_time") == "", F.col("finish_time")).otherwise(F.col("start_time")))


def retained(stats: DataFrame, now: str, days: int) -> DataFrame:
    """Statistics not older than so many days before the start of now's day; 0 keeps all."""
    if not days:
        return stats
    edge = F.date_trunc("day", F.lit(now).cast("timestamp")) - F.make_dt_interval(F.lit(days))
    return stats.filter(~(F.col("start_time").cast("timestamp") < edge))


def rolled_back(tags: DataFrame, name: str, new_hash: str, new_revision: int) -> DataFrame:
    """Trunk tags after the named one go, and it comes back with a new hash and revision; an unknown name changes nothing."""
    target = tags.filter(F.col("name") == name).agg(F.max("revision").alias("target"))
    both = tags.crossJoin(F.broadcast(target))
    later = (F.col("branch") == "") & ((F.col("revision") > F.col("target")) | (F.col("name") == name))
    kept = both.filter(F.col("target").isNull() | ~later).drop("target")
    back = tags.filter(F.col("name") == name).withColumns({"hash": F.lit(new_hash), "revision": F.lit(new_revision)})
    return kept.unionByName(back)


def undo_tags(tags: DataFrame, new_hash: str, new_revision: int) -> DataFrame:
    """trunk becomes trunk-previous, and a new trunk is made."""
    kept = tags.filter("name <> 'trunk-previous'")
    moved = kept.withColumn("name", F.when(F.col("name") == "trunk", "trunk-previous").otherwise(F.col("name")))
    return moved.unionByName(kept.filter("name = 'trunk'").withColumns({"hash": F.lit(new_hash), "revision": F.lit(new_revision)}))


def moved_tag(tags: DataFrame, name: str, new_hash: str) -> DataFrame:
    return tags.withColumn("hash", F.when(F.col("name") == name, F.lit(new_hash)).otherwise(F.col("hash")))


def stale_auto_tags(tags: DataFrame, threshold: int) -> DataFrame:
    """Automatic tags older than an epoch; 0 keeps all."""
    return tags.filter(F.col("name").rlike(r"^generic(_\d+)?-\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?$") & (F.col("timestamp") < threshold))


def partitioned(dirents: DataFrame, mount: str) -> DataFrame:
    """Entries at and below mount move from the nearest partition above to one of their own, mount points of nested
    partitions too; the mount point stays in its parent as well. A mount that is no plain directory changes nothing."""
    above = dirents.filter(has(32) & below(F.lit(mount), F.col("catalog"))).agg(F.max_by("catalog", F.length("catalog")).alias("above_"))
    plain = dirents.filter((F.col("path") == mount) & has(1) & ~has(2) & ~has(32)).agg((F.count("*") > 0).alias("plain_"))
    moves = below(F.col("path"), F.lit(mount)) & (F.col("catalog") == F.col("above_")) & F.col("plain_")
    both = dirents.crossJoin(F.broadcast(above)).crossJoin(F.broadcast(plain)).withColumn("moves_", F.coalesce(moves, F.lit(False)))
    moved, rest = both.filter("moves_").select(dirents.columns), both.filter("not moves_").select(dirents.columns)
    point = moved.filter(F.col("path") == mount).withColumn("flags", F.col("flags").bitwiseOR(2))
    root = moved.withColumns({"catalog": F.lit(mount), "flags": F.when(F.col("path") == mount, F.col("flags").bitwiseOR(32)).otherwise(F.col("flags"))})
    return rest.unionByName(point).unionByName(root)


def grouped_hardlinks(dirents: DataFrame, new: DataFrame) -> DataFrame:
    """New entries (catalog, inode and more) with hardlinks: each inode of several entries is a group of its partition,
    numbered after the partition's largest, with its size as link count; single entries count one link."""
    top = dirents.groupBy("catalog").agg(F.max(F.shiftright("hardlinks", 32)).alias("top"))
    groups = new.groupBy("catalog", "inode").agg(F.count("*").alias("links"))
    number = F.row_number().over(Window.partitionBy("catalog").orderBy("inode"))
    many = groups.filter("links > 1").withColumn("number", number).join(top, "catalog", "left")
    many = many.select("catalog", "inode", (F.shiftleft((F.coalesce("top", F.lit(0)) + F.col("number")).cast("long"), 32) + F.col("links")).alias("hardlinks"))
    return new.drop("hardlinks").join(many, ["catalog", "inode"], "left").withColumn("hardlinks", F.coalesce("hardlinks", F.lit(1).cast("long")))


def shrunk_hardlinks(dirents: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries without those removed (catalog, path); what stays of their link groups counts so many links less."""
    group = F.shiftright("hardlinks", 32).alias("group_")
    gone = removed.select("catalog", "path").distinct()
    less = dirents.join(gone, ["catalog", "path"], "left_semi").select("catalog", group).filter("group_ > 0").groupBy("catalog", "group_").agg(F.count("*").alias("less_"))
    rest = dirents.join(gone, ["catalog", "path"], "left_anti").withColumn("group_", F.shiftright("hardlinks", 32)).join(less, ["catalog", "group_"], "left")
    return rest.withColumn("hardlinks", F.col("hardlinks") - F.coalesce("less_", F.lit(0))).select(dirents.columns)


def merged_into_parent(dirents: DataFrame, catalog: str, parent: str) -> DataFrame:
    """A partition's entries join its parent's: link groups move after the parent's, the doubled root goes."""
    top = dirents.filter(F.col("catalog") == parent).agg(F.coalesce(F.max(F.shiftright("hardlinks", 32)), F.lit(0)).alias("top"))
    mine = dirents.filter((F.col("catalog") == catalog) & (F.col("path") != catalog)).crossJoin(F.broadcast(top))
    shift = F.col("hardlinks") + F.col("top") * F.lit(4294967296)
    mine = mine.withColumns({"hardlinks": F.when(F.col("hardlinks") > 4294967296, shift).otherwise(F.col("hardlinks")), "catalog": F.lit(parent)}).drop("top")
    rest = dirents.filter(F.col("catalog") != catalog)
    point = (F.col("catalog") == parent) & (F.col("path") == catalog)
    return rest.withColumn("flags", F.when(point, F.col("flags").bitwiseAND(~2)).otherwise(F.col("flags"))).unionByName(mine)


def cloned(dirents: DataFrame, source: str, target: str) -> DataFrame:
    """Entries of the tree at source under target, as plain entries: path and its digest new, markers reset, no root doubles."""
    part = dirents.filter(below(F.col("path"), F.lit(source)) & ~has(32))
    path = F.concat(F.lit(target), F.substr(F.col("path"), F.lit(len(source) + 1)))
    out = part.withColumn("flags", F.col("flags").bitwiseAND(~(2 | 32))).withColumn("path", path)
    return out.withColumns({"parent": F.regexp_replace("path", "/[^/]*$", ""), "name": F.regexp_extract("path", "([^/]*)$", 1), "md5path": F.md5("path")})


def defragmented(dirents: DataFrame) -> DataFrame:
    return dirents.withColumn("rowid", F.row_number().over(Window.partitionBy("catalog").orderBy("rowid")))


def touched(cache: DataFrame, commands: DataFrame) -> DataFrame:
    """Cache entries after a batch of commands (seq, sha1, command): touch renews acseq, pin and unpin set pinned."""
    last = commands.groupBy("sha1").agg(F.max(F.when(F.col("command") == "touch", F.col("seq"))).alias("touch"), F.max_by("command", F.when(F.col("command") != "touch", F.col("seq"))).alias("pin"))
    out = cache.join(last, "sha1", "left")
    acseq = F.coalesce("touch", "acseq")
    pinned = F.when(F.col("pin") == "pin", 1).when(F.col("pin") == "unpin", 0).otherwise(F.col("pinned"))
    return out.select("sha1", "size", acseq.alias("acseq"), pinned.alias("pinned"))


# versions


DIFFERENCES = (("name", 0x1), ("linkcount", 0x2), ("size", 0x4), ("mode", 0x8), ("mtime", 0x10), ("symlink", 0x20), ("hash", 0x40), ("group", 0x80), ("transition", 0x100), ("chunked", 0x200), ("external", 0x800), ("hidden", 0x2000))


def compared(dirents: DataFrame) -> DataFrame:
    """The columns that a comparison looks at; mount points are left to their child's root."""
    bits = lambda mask: F.col("flags").bitwiseAND(mask)
    return dirents.filter(~has(2) & ~has(0x8000)).select(
        "path", "name", F.col("hardlinks").bitwiseAND(F.lit(4294967295)).alias("linkcount"), "size", "mode", F.struct("mtime", F.coalesce("mtimens", F.lit(-1))).alias("mtime"), "symlink", "hash",
        F.shiftright("hardlinks", 32).alias("group"), bits(2 | 32).alias("transition"), bits(64).alias("chunked"), bits(128).alias("external"), bits(0x8000).alias("hidden"), bits(1 | 4 | 8).alias("kind"),
    )


def tree_diff(old: DataFrame, new: DataFrame, equal_parts: DataFrame | None = None) -> DataFrame:
    """path, change (A, R, M), mask of added, removed and modified paths. equal_parts (path) are partitions with equal digests, those nested
    in them included, as equal digests imply: their entries are skipped before the join, by the partition that they are in."""
    if equal_parts is not None:
        skipped = equal_parts.select(F.col("path").alias("catalog"))
        old, new = old.join(skipped, "catalog", "left_anti"), new.join(skipped, "catalog", "left_anti")
    a, b = compared(old), compared(new)
    renamed = b.select("path", *[F.col(c).alias(f"new_{c}") for c in b.columns if c != "path"], F.lit(True).alias("in_new"))
    both = a.withColumn("in_old", F.lit(True)).join(renamed, "path", "full_outer")
    mask = F.lit(0)
    for column, bit in DIFFERENCES:
        mask = mask + F.when(F.col(column).eqNullSafe(F.col(f"new_{column}")), 0).otherwise(bit)
    both = both.withColumn("mask", F.when(F.col("in_old") & F.col("in_new"), mask))
    change = F.when(F.col("in_old").isNull(), "A").when(F.col("in_new").isNull(), "R").when(F.col("mask") != 0, "M")
    return both.select("path", change.alias("change"), "mask", "kind", "new_kind", "size", "new_size").filter("change is not null")


def scoped_merge(head: DataFrame, old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """The head with old-to-new changes at or below scope applied: the filter stands before the join on both sides.

    Paths that were added, removed or modified are taken from new, whatever the head has there; what the head has below a
    removed directory goes with it.
    """
    within = below(F.col("path"), F.lit(scope))
    changes = tree_diff(old.filter(within), new.filter(within)).select("path", "change", "kind", "new_kind")
    directory = lambda c: F.coalesce(F.col(c), F.lit(0)).bitwiseAND(1) != 0
    emptied = changes.filter("change <> 'A'").filter(directory("kind") & ~directory("new_kind")).select(F.col("path").alias("above_"))
    inside = head.filter(within).join(changes.select("path"), "path", "left_anti")
    lost = inside.select("path", F.explode(ancestors(F.col("path"))).alias("above_")).join(emptied, "above_", "left_semi").select("path").distinct()
    fresh = new.filter(within & ~has(2)).join(changes.filter("change in ('A', 'M')"), "path", "left_semi")
    kept = head.filter(~within).unionByName(inside.join(lost, "path", "left_anti").select(head.columns))
    return kept.unionByName(fresh.select(head.columns))


def merge_counts(changes: DataFrame) -> DataFrame:
    """change, kind, count of a diff: directories, links and files that are added, removed and modified."""
    kind = F.coalesce("new_kind", "kind")
    said = F.when(kind.bitwiseAND(8) != 0, "symlink").when(kind.bitwiseAND(1) != 0, "directory").otherwise("file")
    return changes.groupBy("change", said.alias("kind")).agg(F.count("*").alias("count"))


def diff_report(diff: DataFrame) -> DataFrame:
    """line of each change: letter, kind, and letters of what changed."""
    kind = F.coalesce("new_kind", "kind")
    letter = F.when(kind.bitwiseAND(8) != 0, "S").when(kind.bitwiseAND(1) != 0, "D").otherwise("F")
    what = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(bit) != 0, said) for bit, said in ((4, "S"), (8, "M"), (16, "T"), (64, "C"), (32, "L"), (256, "N"))]))
    return diff.select("path", F.concat_ws(" ", "change", letter, F.array_join(F.coalesce(what, F.array().cast("array<string>")), ""), "path").alias("line"))
