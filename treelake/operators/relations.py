"""Joins, aggregates, orderings and set operations over the metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.functions.paths import ancestors, below, parts
from treelake.operators.entries import has

COUNTERS = ("regular", "symlink", "special", "dir", "nested", "chunked", "file_size", "chunked_size", "external", "external_file_size")


# joins


def dangling_mounts(dirents: DataFrame) -> DataFrame:
    """Mount points that still have children in their own partition."""
    kids = dirents.select("catalog", F.col("parent").alias("path"))
    return dirents.filter(has(2)).join(kids, ["catalog", "path"], "left_semi")


def content_hashes(dirents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct (hash, is_chunk) of non-external entries and their chunks; entries without hash give none."""
    own = dirents.filter(~has(128))
    parts_ = own.select("path").join(chunks.select("path", "hash"), "path").select("hash", F.lit(1).alias("is_chunk"))
    return own.filter("hash is not null").select("hash", F.lit(0).alias("is_chunk")).union(parts_).distinct()


def all_chunks(dirents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct (hash, kind, algorithm, compression) of all non-external objects: C partition roots, P chunks, else none."""
    packed = [(F.shiftright("flags", 8).bitwiseAND(7) + 1).alias("algorithm"), F.shiftright("flags", 11).bitwiseAND(7).alias("compression")]
    own = dirents.filter(~has(128))
    whole = own.filter("hash is not null").select("hash", F.when(has(1), "L").otherwise("").alias("kind"), *packed)
    pieces = own.filter(has(64)).select("path", "flags").join(chunks.select("path", "hash"), "path").select("hash", F.lit("P").alias("kind"), *packed)
    return whole.union(pieces).distinct()


def directory_links(dirents: DataFrame) -> DataFrame:
    """path, linkcount of every directory: its subdirectories plus two."""
    kids = dirents.filter(has(1)).select("catalog", F.col("parent").alias("path"), F.lit(1).alias("kid"))
    return dirents.filter(has(1)).select("catalog", "path").join(kids, ["catalog", "path"], "left").groupBy("catalog", "path").agg((F.count("kid") + 2).alias("linkcount"))


def hardlink_groups(entries: DataFrame) -> DataFrame:
    """inode, members, supported: groups of one inode whose links all lie in one directory are supported."""
    by = entries.groupBy("inode").agg(F.count("*").alias("members"), F.countDistinct("parent").alias("parents"))
    return by.filter("members > 1").select("inode", "members", (F.col("parents") == 1).alias("supported"))


def hardlink_candidates(entries: DataFrame) -> DataFrame:
    """Distinct entries that share their inode with another path; aggregated, so no pairs are made."""
    shared = entries.groupBy("inode").agg(F.min("path").alias("low"), F.max("path").alias("high")).filter("low <> high").select("inode")
    return entries.join(shared, "inode", "left_semi").select("inode", "path").distinct()


def prune_branches(branches: DataFrame, used: DataFrame) -> DataFrame:
    """Branches that are the root or hold tags, each with its nearest such ancestor as parent: repeated to a fixed point."""
    kept = branches.filter("parent is null").select("branch").union(used.select("branch")).distinct()
    links = branches.select("branch", "parent")
    now = branches.join(kept, "branch", "left_semi").select("branch", "parent", "initial_revision")
    while True:
        gone = now.filter("parent is not null").join(kept.select(F.col("branch").alias("parent")), "parent", "left_anti")
        if gone.isEmpty():
            return now
        up = links.select(F.col("branch").alias("p"), F.col("parent").alias("next"))
        stays = kept.select(F.col("branch").alias("k"))
        now = now.join(up, now["parent"] == up["p"], "left").join(stays, F.col("parent") == F.col("k"), "left")
        now = now.select("branch", F.when(F.col("parent").isNull() | F.col("k").isNotNull(), F.col("parent")).otherwise(F.col("next")).alias("parent"), "initial_revision").checkpoint()


def overlapping_text(leases: DataFrame, asked: DataFrame) -> DataFrame:
    """Leases of a repository whose path text is a prefix of the asked one or the other way round: equi-joins on prefixes."""
    prefixes = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n))
    a = asked.select("repository", F.col("path").alias("asked"))
    above = leases.join(a.withColumn("path", F.explode(prefixes("asked"))), ["repository", "path"])
    down = leases.withColumn("asked", F.explode(prefixes("path"))).filter("asked <> path")
    return above.unionByName(down.join(a, ["repository", "asked"]))


def overlapping_paths(leases: DataFrame, asked: DataFrame) -> DataFrame:
    """The same by whole components: equi-joins on ancestors in both directions."""
    a = asked.select("repository", F.col("path").alias("asked"))
    up = a.select("repository", "asked", F.explode(ancestors(F.col("asked"))).alias("path"))
    above = leases.join(up, ["repository", "path"])
    down = leases.withColumn("asked", F.explode(ancestors(F.col("path"))))
    return above.unionByName(down.join(a, ["repository", "asked"])).distinct()


def synchronised(tags: DataFrame, listed: DataFrame) -> DataFrame:
    """name, action: what makes the listed snapshots equal to the tags."""
    a, b = tags.select("name", F.col("hash").alias("new")), listed.select("name", F.col("hash").alias("old"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "remove").when(F.col("old") != F.col("new"), "replace")
    return a.join(b, "name", "full_outer").select("name", action.alias("action")).filter("action is not null")


def missing(wanted: DataFrame, present: DataFrame, key: str = "hash") -> DataFrame:
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def unused_layers(manifests: DataFrame, layers: DataFrame) -> DataFrame:
    """Layers that no manifest (image, layers) names."""
    return layers.join(manifests.select(F.explode("layers").alias("layer")), "layer", "left_anti")


def backlink_counts(manifests: DataFrame) -> DataFrame:
    """layer, number of images that hold it, and the smallest of them; no list of images is made."""
    rows = manifests.select("image", F.explode("layers").alias("layer"))
    return rows.groupBy("layer").agg(F.count_distinct("image").alias("images"), F.min("image").alias("first"))


def backlinks(manifests: DataFrame) -> DataFrame:
    """layer and the sorted images that hold it."""
    return manifests.select("image", F.explode("layers").alias("layer")).groupBy("layer").agg(F.array_sort(F.collect_set("image")).alias("images"))


def mapped_ids(entries: DataFrame, mapping: DataFrame, default: int | None = None) -> DataFrame:
    """path, uid replaced by mapping (old, new), else by the default, else unchanged; the mapping joins by its size."""
    other = F.lit(default) if default is not None else F.col("uid")
    return entries.join(mapping, entries["uid"] == mapping["old"], "left").select("path", F.coalesce("new", other).alias("uid"))


# aggregates


def self_counters(dirents: DataFrame) -> DataFrame:
    """Counters of each partition's own entries; a mount point belongs to its child's root."""
    file = has(4) & ~has(8) & ~has(16)
    add = lambda cond, value=F.lit(1): F.sum(F.when(cond, value).otherwise(0)).cast("long")
    return dirents.groupBy("catalog").agg(
        add(file).alias("regular"), add(has(8)).alias("symlink"), add(has(16)).alias("special"), add(has(1) & ~has(2)).alias("dir"), add(has(2)).alias("nested"),
        add(has(64)).alias("chunked"), add(file, F.col("size")).alias("file_size"), add(has(64), F.col("size")).alias("chunked_size"),
        add(has(128)).alias("external"), add(has(128), F.col("size")).alias("external_file_size"),
    )


def subtree_counters(own: DataFrame) -> DataFrame:
    """Counters of each partition's descendants, without itself: every partition adds itself to those above it."""
    up = own.withColumn("above", F.explode(ancestors(F.col("catalog")))).filter("above <> catalog")
    sums = up.groupBy("above").agg(*[F.sum(c).alias(f"sub_{c}") for c in COUNTERS])
    out = own.select("catalog").join(sums, own["catalog"] == sums["above"], "left")
    return out.select("catalog", *[F.coalesce(f"sub_{c}", F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def unpivoted(counters: DataFrame) -> DataFrame:
    return counters.unpivot("catalog", list(COUNTERS), "counter", "value")


def total_counters(own: DataFrame, subtree: DataFrame) -> DataFrame:
    return unpivoted(own).union(unpivoted(subtree)).groupBy("catalog", "counter").agg(F.sum("value").alias("value"))


def kinds(dirents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts and sizes per kind of entry."""
    count = lambda cond: F.count_if(cond)
    size = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0)).cast("long")
    file = has(4) & ~has(8) & ~has(16)
    one = dirents.agg(count(file).alias("regular"), size(file).alias("regular_size"), count(has(128)).alias("external"), size(has(128)).alias("external_size"),
                      count(has(8)).alias("symlink"), count(has(16)).alias("special"), count(has(64)).alias("chunked"), size(has(64)).alias("chunked_size"), count(has(1)).alias("dir"))
    return one.crossJoin(chunks.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("blob_size")))


def subtree_weights(dirents: DataFrame) -> DataFrame:
    """catalog, path, weight of directories: one and the weights of the children; a mount point weighs one."""
    up = dirents.select("catalog", F.explode(ancestors(F.col("path"))).alias("above"))
    dirs = dirents.filter(has(1)).select("catalog", F.col("path").alias("above"), has(2).alias("mount"))
    sums = dirs.join(up.groupBy("catalog", "above").count(), ["catalog", "above"])
    return sums.select("catalog", F.col("above").alias("path"), F.when(F.col("mount"), 1).otherwise(F.col("count")).cast("long").alias("weight"))


def chunk_list_hash(chunks: DataFrame) -> DataFrame:
    """path, digest over the digests of its chunks in order of offset."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "hash"))), lambda c: c["hash"]), "")
    return chunks.groupBy("path").agg(F.sha1(F.unhex(joined)).alias("digest"))


def text_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, median (the middle value in order of text, the later of two), maximum: from counts of equal values."""
    counts = rows.groupBy(key, F.col(value).cast("string").alias("text")).agg(F.count("*").alias("n"), F.max(value).alias("top"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("text"))
    counts = counts.withColumns({"upto": upto, "all": F.sum("n").over(Window.partitionBy(key))})
    return counts.groupBy(key).agg(F.min(F.when(F.expr("upto > all div 2"), F.col("text"))).alias("median"), F.max("top").alias("maximum"))


def file_statistics(dirents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The tables catalogs, objects, files, files_objects and symlinks of file statistics; digests and paths are the keys."""
    regular = dirents.filter(has(4) & ~has(8) & ~has(16))
    whole = regular.filter(~has(64) & F.col("hash").isNotNull()).select("path", "hash", "size")
    pieces = regular.filter(has(64)).select("path").join(chunks.select("path", "hash", "size"), "path")
    objects = whole.unionByName(pieces)
    return {
        "catalogs": dirents.groupBy("catalog").agg(F.count("*").alias("num_entries"), F.sum("size").alias("file_size")),
        "objects": objects.groupBy("hash").agg(F.max("size").alias("size")),
        "files": regular.select("path", "catalog"),
        "files_objects": objects.select("path", "hash"),
        "symlinks": dirents.filter(has(8)).select(F.length("symlink").alias("length")),
    }


# orderings


def top_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rank_ = 1").drop("rank_")


def ordered_hashes(tags: DataFrame) -> DataFrame:
    """hash, place of distinct hashes by their first (timestamp, revision); range-sorted, with places counted per range."""
    first = tags.groupBy("hash").agg(F.min(F.struct("timestamp", "revision")).alias("at"))
    return first.orderBy("at").select("hash", F.col("at.timestamp").alias("timestamp"), F.col("at.revision").alias("revision"))


def tags_as_of(tags: DataFrame, asked: DataFrame, width: int = 30 * 86400) -> DataFrame:
    """at and the trunk tag of highest revision among those with a timestamp not after it.

    The best tag up to the end of each time slice comes from one running maximum over slices; the slice of the question
    itself is an equi-join. So neither side is paired with all earlier rows.
    """
    trunk = tags.filter("branch = ''").select("name", "revision", "timestamp", F.floor(F.col("timestamp") / width).alias("slice"))
    best = F.max(F.struct("revision", "name"))
    asked = asked.select("t").distinct().withColumn("slice", F.floor(F.col("t") / width))
    per = trunk.groupBy("slice").agg(best.alias("best")).select("slice", "best", F.lit(False).alias("question"))
    both = per.unionByName(asked.select("slice").distinct().select("slice", F.lit(None).cast(per.schema["best"].dataType).alias("best"), F.lit(True).alias("question")))
    before = Window.orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)  # one row per slice of time
    carried = both.select("slice", F.max("best").over(before).alias("carried"), "question").filter("question").select("slice", "carried")
    within = asked.join(trunk, "slice", "left").filter("timestamp is null or timestamp <= t")
    within = within.groupBy("t").agg(F.max(F.when(F.col("timestamp").isNotNull(), F.struct("revision", "name"))).alias("inside"))
    out = asked.join(carried, "slice").join(within, "t", "left").select("t", F.greatest("carried", "inside").alias("best"))
    return out.select("t", F.col("best.name").alias("name"), F.col("best.revision").alias("revision")).filter("name is not null")


def arc(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle arc; 0 for equal points, the cosine clamped to its domain."""
    r = F.radians
    cosine = F.sin(r(lat1)) * F.sin(r(lat2)) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.cos(r(lon1) - r(lon2))
    return F.when((lat1 == lat2) & (lon1 == lon2), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def branch_order(branches: DataFrame) -> DataFrame:
    """branch, level, key: sorting by key gives the pre-order of the branch tree; levels are walked from the root."""
    level = branches.filter("parent is null").select("branch", F.lit(0).alias("level"), F.array("branch").alias("key"))
    out = level
    while not level.isEmpty():
        up = level.select(F.col("branch").alias("parent"), "level", "key")
        level = branches.join(up, "parent").select("branch", (F.col("level") + 1).alias("level"), F.concat("key", F.array("branch")).alias("key")).checkpoint()
        out = out.union(level)
    return out


def tail(text: Column, n: int) -> Column:
    """Last n lines that end in a newline, and an unfinished line after them."""
    lines = F.split(text, "\n")
    finished, rest = F.slice(lines, F.lit(1), F.size(lines) - 1), F.element_at(lines, -1)
    start = F.greatest(F.size(finished) - n + 1, F.lit(1))
    last = F.slice(finished, start, F.lit(n))
    return F.concat(F.array_join(last, "\n"), F.when(F.size(last) > 0, "\n").otherwise(""), rest)


# sets


def merged_statistics(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both tables; those of the second get ids after the first's largest, in their order."""
    top = first.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    low = second.agg(F.min(key).alias("low"))
    moved = second.crossJoin(top).crossJoin(low).withColumn(key, F.col(key) - F.col("low") + F.col("top") + 1).drop("top", "low")
    return first.unionByName(moved)
