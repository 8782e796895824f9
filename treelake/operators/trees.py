"""Traversal, garbage collection, replication, consistency checks and balancing of partition trees and revision chains."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelake.functions.paths import ancestors
from treelake.operators.entries import has


def walk(roots: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, level of what is reached from roots (node) over edges (parent, child): level by level, each node once."""
    front = roots.select("node").distinct().withColumn("level", F.lit(0)).checkpoint()
    seen, level = front, 0
    while not front.isEmpty() and (most is None or level < most):
        level += 1
        step = front.join(edges.select(F.col("parent").alias("node"), "child"), "node").select(F.col("child").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)).checkpoint()
        seen = seen.union(front)
    return seen


def history(heads: DataFrame, revisions: DataFrame, most: int, oldest: int) -> DataFrame:
    """hash, age of revisions reached from heads (hash): a predecessor is followed while age < most and mtime >= oldest.

    The first revision below the time limit is itself visited. Revisions are dealt out and sorted by hash once; a step
    shuffles only what it reached.
    """
    parts = int(revisions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    revisions = revisions.select("hash", "previous", "mtime").repartition(parts, "hash").sortWithinPartitions("hash").persist(StorageLevel.DISK_ONLY)
    front = heads.select("hash").join(revisions, "hash").select("hash", "previous", "mtime", F.lit(0).alias("age")).checkpoint()
    seen, age = front.select("hash", "age"), 0
    while age < most and not front.isEmpty():
        age += 1
        step = front.filter((F.col("mtime") >= oldest) & F.col("previous").isNotNull()).select(F.col("previous").alias("hash")).distinct()
        step = step.join(seen.select("hash"), "hash", "left_anti")
        front = step.join(revisions, "hash").select("hash", "previous", "mtime", F.lit(age).alias("age")).checkpoint()
        seen = seen.union(front.select("hash", "age"))
    revisions.unpersist()
    return seen


def chain(heads: DataFrame, revisions: DataFrame) -> DataFrame:
    """hash of all revisions reached from heads (hash) over predecessors, however long the chains.

    Reach and pointers double: after k rounds all that is fewer than 2^k steps from a head is reached, and pointers go 2^k
    steps. A chain ends at null, at a missing revision and where it meets what is reached; the last round is one that
    reaches nothing new or leaves no pointers. What a round adds is checkpointed, and stays dealt out by hash for the next.
    """
    parts = int(revisions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    revisions = revisions.select("hash", "previous").repartition(parts, "hash").persist(StorageLevel.DISK_ONLY)
    pointers = revisions.filter("previous <> hash").select("hash", F.col("previous").alias("to")).distinct().persist(StorageLevel.DISK_ONLY)
    seen = heads.select("hash").distinct().repartition(parts, "hash").persist(StorageLevel.DISK_ONLY)
    before, reached = -1, seen.count()
    while reached > before:
        step = seen.join(pointers, "hash").select(F.col("to").alias("hash")).checkpoint()
        narrower, seen = seen, seen.union(step).distinct().repartition(parts, "hash").persist(StorageLevel.DISK_ONLY)
        before, reached = reached, seen.count()
        narrower.unpersist()
        onward = pointers.select(F.col("hash").alias("to"), F.col("to").alias("end"))
        further = pointers.join(onward, "to").filter("hash <> end").select("hash", F.col("end").alias("to")).checkpoint()
        pointers.unpersist()
        if further.isEmpty():
            break
        pointers = further.repartition(parts, "hash").distinct().persist(StorageLevel.DISK_ONLY)
    found = revisions.join(seen, "hash", "left_semi").select("hash").checkpoint()
    for rows in (revisions, pointers, seen):
        rows.unpersist()
    return found


def swept(referenced: DataFrame, preserved: DataFrame) -> DataFrame:
    """hash, requests: objects that only condemned partitions refer to, and how often they were asked to go.

    referenced has part, hash, preserved has the parts to keep; references are read and shuffled by hash once.
    """
    rows = referenced.join(preserved.select("part", F.lit(True).alias("kept")).distinct(), "part", "left")
    sums = rows.groupBy("hash").agg(F.count_if(F.col("kept").isNull()).alias("requests"), F.bool_or("kept").alias("kept"))
    return sums.filter("kept is null").select("hash", "requests")


def entry_violations(dirents: DataFrame) -> DataFrame:
    """path, rule of every broken rule of an entry."""
    link, directory, file = has(8), has(1), has(4) & ~has(8)
    rules = {
        "empty name": (F.col("name") == "") & (F.col("path") != ""),
        "no kind": ~(has(1) | has(4) | has(16)),
        "two kinds": has(1) & has(4),
        "linkcount zero": F.col("hardlinks").bitwiseAND(F.lit(4294967295)) == 0,
        "directory in a link group": directory & (F.shiftright("hardlinks", 32) != 0),
        "file without content": file & ~has(64) & F.col("hash").isNull(),
        "symlink with content": link & F.col("hash").isNotNull(),
        "symlink size": link & (F.col("size") != F.length("symlink")),
        "empty symlink": link & (F.col("symlink") == ""),
        "target without symlink": ~link & (F.col("symlink") != ""),
        "external directory": has(128) & directory,
        "chunked directory": has(64) & directory,
        "root and mount point": has(2) & has(32),
        "negative size": F.col("size") < 0,
        "nanoseconds": ~F.coalesce("mtimens", F.lit(0)).between(0, 999_999_999),
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return dirents.select("path", "catalog", F.explode(broken).alias("rule"))


def chunk_violations(dirents: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, n_chunks, gaps, total, size, ok of every chunked file: chunks follow each other and add up to its size."""
    order = Window.partitionBy("path").orderBy("off")
    gap = F.col("off") != F.coalesce(F.lag(F.col("off") + F.col("size")).over(order), F.lit(0))
    sums = chunks.withColumn("gap", gap).groupBy("path").agg(F.count("*").alias("n_chunks"), F.count_if("gap").alias("gaps"), F.sum("size").cast("long").alias("total"))
    out = dirents.filter(has(64)).select("path", "size").join(sums, "path", "left")
    ok = (F.col("n_chunks") > 0) & (F.col("gaps") == 0) & (F.col("total") == F.col("size"))
    return out.select("path", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("total", F.lit(0)).alias("total"), "size", F.coalesce(ok, F.lit(False)).alias("ok"))


def group_violations(dirents: DataFrame) -> DataFrame:
    """parent, group of link groups whose members differ from their link count in number or from each other."""
    grouped = dirents.withColumn("grp", F.shiftright("hardlinks", 32)).filter("grp > 0").groupBy("catalog", "parent", "grp")
    checked = grouped.agg(F.count("*").alias("members"), F.max(F.col("hardlinks").bitwiseAND(F.lit(4294967295))).alias("linkcount"), (F.min("size") == F.max("size")).alias("equal"))
    return checked.filter("members <> linkcount or not equal")


def transition_violations(dirents: DataFrame) -> DataFrame:
    """path of nested roots without an equal mount point (but for the marks), and the other way round."""
    mounts = dirents.filter(has(2)).select("path", F.struct("mode", "uid", "gid", "size").alias("a"))
    roots = dirents.filter(has(32) & (F.col("path") != "")).select("path", F.struct("mode", "uid", "gid", "size").alias("b"))
    return mounts.join(roots, "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def dirty_partitions(changed: DataFrame) -> DataFrame:
    """Partitions with changes (catalog) and all above them, deepest first by level."""
    return changed.select(F.explode(ancestors(F.col("catalog"))).alias("catalog")).distinct()


def balanced(children: DataFrame, limit: int, least: int) -> DataFrame:
    """group, name, weight of the children to nest: the heaviest first, while the group's weight is above the limit.

    children are (group, name, weight); a nested child weighs one in its parent. A running sum over the children in
    descending order gives the weight that is left before each choice.
    """
    return balanced_from(children.withColumn("total", F.sum("weight").over(Window.partitionBy("group")) + 1), limit, least)


def balanced_from(children: DataFrame, limit: int, least: int) -> DataFrame:
    """The same for children with the group's weight as total."""
    order = Window.partitionBy("group").orderBy(F.desc("weight"), "name")
    before = F.coalesce(F.sum(F.col("weight") - 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = children.withColumn("left", F.col("total") - before)
    return rows.filter((F.col("left") > limit) & (F.col("weight") >= least)).select("group", "name", "weight")


def balanced_tree(dirs: DataFrame, limit: int, least: int) -> DataFrame:
    """path, weight of the directories to nest, from the deepest level up.

    dirs are the directories of one partition (path, parent, entries: one and the children that are no directories; mount:
    a mount point, which weighs one and is never chosen). A directory weighs its entries and its children's weights, each
    nested child one, so a level is chosen with the weights that the level below left. One round a level of depth; dirs
    are derived once, for all rounds.
    """
    rows = dirs.select("path", "parent", F.when(F.col("mount"), F.lit(1)).otherwise(F.col("entries")).cast("long").alias("entries"), "mount", (F.size(F.split("path", "/")) - 1).alias("depth")).checkpoint()
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return rows.select("path", F.col("entries").alias("weight"))
    chosen, below_ = None, None
    for depth in range(deepest, -1, -1):
        level = rows.filter(F.col("depth") == depth)
        level = level.withColumn("weight", F.col("entries")) if below_ is None else level.join(below_, "path", "left").withColumn("weight", F.col("entries") + F.coalesce("kids", F.lit(0)))
        siblings = level.filter("not mount").select(F.col("parent").alias("group"), F.col("path").alias("name"), "weight")
        level = level.select("path", "parent", "mount", "weight").checkpoint()
        groups = level.groupBy(F.col("parent").alias("group")).agg(F.sum("weight").alias("kids_"))
        rest = groups.join(rows.select(F.col("path").alias("group"), "entries"), "group").select("group", (F.col("kids_") + F.col("entries")).alias("total"))
        picked = balanced_from(siblings.join(rest, "group"), limit, least).select("name", "weight").checkpoint()
        chosen = picked if chosen is None else chosen.union(picked)
        left = level.join(picked.select(F.col("name").alias("path"), F.lit(True).alias("nested")), "path", "left")
        below_ = left.groupBy(F.col("parent").alias("path")).agg(F.sum(F.when(F.col("nested"), 1).otherwise(F.col("weight"))).cast("long").alias("kids"))
    return chosen.select(F.col("name").alias("path"), "weight")


#: Bytes of a file whose cut points are looked for at once.
SLICE = 1 << 20


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks: a rolling 32-bit exclusive or, tested from the least size on, in wrapping arithmetic.

    With a least size of 32 or more the rolling value depends on the last 32 bytes alone, so all places of a slice are
    tested at once.
    """
    if least < 32:
        raise ValueError("the least size of a chunk is 32 bytes or more")
    n, found = len(data), [np.zeros(0, np.int64)]
    for start in range(0, n, SLICE):
        first = max(0, start - 31)
        values = np.frombuffer(data, np.uint8, min(n, start + SLICE) - first, first).astype(np.uint32)
        rolling = np.zeros(len(values), np.uint32)
        for k in range(min(32, len(values))):
            rolling[k:] ^= values[: len(values) - k] << np.uint32(k)
        difference = rolling.view(np.int32) - np.int32(2**31 - 1)
        hits = np.flatnonzero(np.abs(difference.astype(np.int64)) < (2**32 - 1) // average) + first + 1
        found.append(hits[hits > start])
    ends, cuts, last = np.concatenate(found), [], 0
    while last < n:
        at = int(np.searchsorted(ends, last + least))
        last = min(int(ends[at]) if at < len(ends) else n, last + most, n)
        cuts.append(last)
    return cuts


def content_chunks(files: DataFrame, least: int, average: int, most: int) -> DataFrame:
    """path, off, size, hash of content-defined chunks of files (path, content binary): one narrow stage.

    Files go to Python a hundred at a time, not in Arrow's batches of thousands; a file of null has no chunks.
    """
    import hashlib

    def cut(content: bytes | None) -> list[tuple]:
        ends = cut_points(content or b"", least, average, most)
        return [(start, end - start, hashlib.sha1(content[start:end]).hexdigest()) for start, end in zip([0, *ends], ends)]

    # inline would first ask for the number of chunks, and so cut every file twice
    chunks = F.udf(cut, "array<struct<off:bigint,size:bigint,hash:string>>", useArrow=False)
    return files.select("path", chunks("content").alias("cut")).select("path", F.inline_outer("cut")).filter("off is not null")


def static_chunks(files: DataFrame, size: int) -> DataFrame:
    """path, off, size, hash of chunks of a fixed size; a file's content is in no row but its own."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("content") - 1, F.lit(0)), F.lit(size))
    piece = lambda off: F.substring(F.col("content"), off + 1, F.lit(size))
    cut = F.transform(starts, lambda off: F.struct(off.cast("long").alias("off"), F.length(piece(off)).cast("long").alias("size"), F.sha1(piece(off)).alias("hash")))
    return files.select("path", cut.alias("cut")).select("path", F.inline("cut"))
