"""Projections, point and prefix lookups, filters and ranges over directory entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelake.functions.paths import ancestors, below, depth, glob_regex

#: Bits of an entry's flags.
BITS = {"is_dir": 1, "is_mount": 2, "is_file": 4, "is_link": 8, "is_special": 16, "is_root": 32, "is_chunked": 64, "is_external": 128, "is_bind": 0x4000, "is_hidden": 0x8000}


def has(bit: int, flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(bit) != 0


def decode(dirents: DataFrame, world_readable: bool = False) -> DataFrame:
    """Packed columns as booleans and numbers; missing nanoseconds become -1."""
    kinds = [has(bit).alias(name) for name, bit in BITS.items()]
    readable = F.col("mode").bitwiseOR(F.when(has(1), 0o555).otherwise(0o444)) if world_readable else F.col("mode")
    return dirents.select(
        "path", "catalog", *kinds,
        (F.shiftright("flags", 8).bitwiseAND(7) + 1).alias("hash_algorithm"),
        F.shiftright("flags", 11).bitwiseAND(7).alias("compression"),
        F.col("hardlinks").bitwiseAND(F.lit(4294967295)).alias("linkcount"),
        F.shiftright("hardlinks", 32).alias("hardlink_group"),
        F.coalesce("mtimens", F.lit(-1)).alias("mtimens"),
        readable.alias("mode"),
    )


def encode_flags(decoded: DataFrame) -> DataFrame:
    """path, catalog and the flags of decoded columns."""
    total = F.lit(0)
    for name, bit in BITS.items():
        total = total.bitwiseOR(F.when(F.col(name), bit).otherwise(0))
    total = total.bitwiseOR(F.shiftleft(F.col("hash_algorithm") - 1, 8)).bitwiseOR(F.shiftleft("compression", 11))
    return decoded.select("path", "catalog", total.alias("flags"))


def at_paths(dirents: DataFrame, paths: list[str]) -> DataFrame:
    return dirents.filter(F.col("md5path").isin([F.md5(F.lit(p)) for p in paths]) if len(paths) > 1 else F.col("md5path") == F.md5(F.lit(paths[0])))


def children(dirents: DataFrame, path: str) -> DataFrame:
    return dirents.filter(F.col("parent") == path)


def longest_prefix(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Every path with the longest mount that is a prefix on component boundaries, '' if none: an equi-join on ancestors."""
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("mount"))
    found = up.join(mounts.select(F.col("path").alias("mount")), "mount").groupBy("path").agg(F.max_by("mount", F.length("mount")).alias("mount"))
    return paths.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("mount", F.lit("")).alias("mount"))


def resolve(paths: DataFrame, mounts: DataFrame, dirents: DataFrame) -> DataFrame:
    """path, catalog, found, flags: each path looked up in the partition that holds it; not found is a negative entry."""
    where = longest_prefix(paths, mounts).withColumnRenamed("mount", "catalog")
    hit = dirents.select("path", "catalog", "flags")
    return where.join(hit, ["path", "catalog"], "left").select("path", "catalog", F.col("flags").isNotNull().alias("found"), "flags")


def skein(path: str, mounts: DataFrame) -> DataFrame:
    """Partitions a path's handling touches: those above it, its own, and the direct children of its own."""
    up = mounts.filter(below(F.lit(path), F.col("path"))).select("path")
    top = up.agg(F.max_by("path", F.length("path")).alias("own"))
    lower = mounts.crossJoin(F.broadcast(top)).filter(below(F.col("path"), F.coalesce("own", F.lit(""))) & (F.col("path") != F.coalesce("own", F.lit("")))).select("path")
    return up.union(lower).distinct().withColumn("level", depth(F.col("path")))


def of_kind(dirents: DataFrame, bit: int) -> DataFrame:
    return dirents.filter(has(bit))


def matching_globs(paths: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """Paths that a positive rule matches strictly and no negative rule matches loosely."""
    any_of = lambda rules, relaxed: F.lit(False) if not rules else F.col("path").rlike("|".join(f"(?:{glob_regex(r, relaxed)})" for r in rules))
    return paths.filter(any_of(positive, False) & ~any_of(negative, True))


def matching_relaxed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths above, at or below a positive rule, with no negative rule at or above them; rules (rule, negated) are plain paths."""
    positive, negative = rules.filter("not negated").select("rule"), rules.filter("negated").select("rule")
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("rule"))
    parents = positive.select(F.explode(ancestors(F.col("rule"))).alias("path"))
    hit = up.join(positive, "rule", "left_semi").select("path").union(paths.join(parents, "path", "left_semi").select("path")).distinct()
    return hit.join(up.join(negative, "rule", "left_semi").select("path"), "path", "left_anti")


def contradictions(rules: DataFrame) -> DataFrame:
    """Rules that stand both plain and negated."""
    return rules.filter("not negated").select("rule").distinct().join(rules.filter("negated").select("rule"), "rule", "left_semi")


def matching_tree(paths: DataFrame, rules: list[str]) -> DataFrame:
    """Paths of a rule tree: 'p/*' includes all below p, '^p/*' its direct children, '!p' excludes below, 'p' itself; exclusion wins."""
    keep, drop = F.lit(False), F.lit(False)
    path = F.col("path")
    for rule in rules:
        plain = rule.lstrip("^!").removesuffix("/*").removesuffix("*").rstrip("/")
        inner = below(F.lit(plain), path)
        if rule.startswith("!"):
            drop = drop | below(path, F.lit(plain))
        elif rule.startswith("^"):
            keep = keep | inner | path.rlike(glob_regex(plain.replace("*", "\\*") + "/*")[:-3] + "$")
        elif rule.endswith("*"):
            keep = keep | inner | below(path, F.lit(plain))
        else:
            keep = keep | inner
    return paths.filter(keep & ~drop)


def reportable(paths: DataFrame, lease: str) -> DataFrame:
    """path, within (in the lease), ignored (neither above nor below it)."""
    within = below(F.col("path"), F.lit(lease))
    return paths.select("path", within.alias("within"), (~within & ~below(F.lit(lease), F.col("path"))).alias("ignored"))


def chunk_at(chunks: DataFrame, offsets: DataFrame) -> DataFrame:
    """path, pos, off: the last chunk that begins at or before each offset; an equi-join on the file, then a maximum."""
    near = offsets.join(chunks.select("path", "off"), "path").filter("off <= pos")
    return near.groupBy("path", "pos").agg(F.max("off").alias("off"))


def chunks_in(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks that overlap [at, at + len) of their file."""
    return ranges.join(chunks, "path").filter((F.col("off") < F.col("at") + F.col("len")) & (F.col("off") + F.col("size") > F.col("at")))
