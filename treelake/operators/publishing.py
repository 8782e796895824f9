"""Publishing: overlay changes, partition headers and their tables, migration, leases in time order, verified objects."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.functions.paths import ancestors
from treelake.operators.changes import broken_hardlinks, without_bulk_hash
from treelake.operators.entries import has
from treelake.operators.relations import self_counters, subtree_counters, total_counters


# overlay


def worktree_changes(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """path, action, links of what an overlay does to a tree.

    base has path, flags; overlay has path, parent, flags, inode, linkcount, whiteout, opaque, one row a path. A whiteout
    removes; a directory on a directory is touched, any other entry on an entry replaces it; new paths are added. What the
    base has below a directory that is removed, opaque or no directory any more goes, or is replaced where the overlay has
    it again. links counts the added and replaced non-directories of one directory that share an inode, one without.
    """
    a = base.select("path", F.col("flags").alias("old_flags"))
    b = overlay.select("path", "parent", "flags", "inode", "linkcount", "whiteout", "opaque")
    both = a.join(b, "path", "full_outer")
    directory = lambda c: F.coalesce(F.col(c).bitwiseAND(1) != 0, F.lit(False))
    emptied = both.filter(directory("old_flags") & (F.col("whiteout") | F.col("opaque") | ~directory("flags"))).filter("flags is not null")
    above = a.select("path", F.explode(ancestors(F.col("path"))).alias("above_")).filter("above_ <> path")
    lost = above.join(emptied.select(F.col("path").alias("above_")), "above_", "left_semi").select("path").distinct().withColumn("lost_", F.lit(True))
    there = F.col("flags").isNotNull() & ~F.col("whiteout")
    was = F.col("old_flags").isNotNull()
    touched = directory("flags") & directory("old_flags") & ~F.col("opaque") & F.col("lost_").isNull()
    action = (
        F.when(was & there & touched, "touch").when(was & there, "replace").when(there, "add")
        .when(was & (F.col("whiteout") | F.col("lost_")), "remove")
    )
    rows = both.join(lost, "path", "left").withColumn("action", action).filter("action is not null")
    linked = F.col("action").isin("add", "replace") & ~directory("flags") & (F.col("linkcount") > 1)
    rows = rows.withColumn("linked_", linked)
    groups = rows.filter("linked_").groupBy("parent", "inode").agg(F.count("*").alias("links")).withColumn("linked_", F.lit(True))
    return rows.join(groups, ["parent", "inode", "linked_"], "left").select("path", "action", F.coalesce("links", F.lit(1).cast("long")).alias("links"))


# partition tables


def entry_digest() -> Column:
    """60 bits of an entry, to be combined by exclusive or."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("path", "flags", "mode", "size", "mtime", "hash", "symlink", "uid", "gid", "hardlinks")]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *fields)), 1, 15), 16, 10).cast("long")


def catalog_headers(dirents: DataFrame, earlier: DataFrame) -> DataFrame:
    """catalog, digest, revision, previous, last_modified, entries, file_size of each partition.

    The digest is of the count and of all entries, in no order; earlier (catalog, digest, revision) gives the previous
    digest, and the revision counts up from there, from 1 for a new partition.
    """
    own = dirents.groupBy("catalog").agg(F.bit_xor(entry_digest()).alias("bits"), F.count("*").alias("entries"), F.max("mtime").alias("last_modified"),
                                         F.sum(F.when(has(4) & ~has(8), F.col("size")).otherwise(0)).cast("long").alias("file_size"))
    past = earlier.select("catalog", F.col("digest").alias("previous"), F.col("revision").alias("before_"))
    digest = F.md5(F.concat_ws("|", "catalog", F.col("entries").cast("string"), F.col("bits").cast("string")))
    return own.join(past, "catalog", "left").select(
        "catalog", digest.alias("digest"), (F.coalesce("before_", F.lit(0)) + 1).cast("long").alias("revision"), "previous", "last_modified", "entries", "file_size"
    )


def write_catalogs(dirents: DataFrame, headers: DataFrame, folder: str) -> None:
    """Each partition's entries as a folder named by its digest with the suffix C, and the headers beside them."""
    named = dirents.join(headers.select("catalog", F.concat("digest", F.lit("C")).alias("object")), "catalog")
    named.repartition("object").write.partitionBy("object").mode("append").parquet(f"{folder}/entries")
    headers.write.mode("append").parquet(f"{folder}/headers")


def read_catalog(spark: SparkSession, folder: str, digest: str) -> DataFrame:
    """The entries of the partition with a digest; an error if it has not exactly one root, or not that digest."""
    rows = spark.read.parquet(f"{folder}/entries").filter(F.col("object") == digest + "C").drop("object")
    found = rows.agg(F.count_if(has(32)).alias("roots")).first()["roots"]
    said = catalog_headers(rows, rows.sparkSession.createDataFrame([], "catalog string, digest string, revision long")).filter(F.col("digest") == digest)
    if found != 1 or said.isEmpty():
        raise ValueError(f"partition {digest} is damaged: {found} root entries")
    return rows


def migrated(dirents: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries without link groups and bulk digests of chunked files, with owners mapped (old, new); and the counters
    (catalog, counter, value) of each partition with all below it, made anew."""
    rows = without_bulk_hash(broken_hardlinks(dirents)).join(owners.select(F.col("old").alias("uid"), "new"), "uid", "left")
    rows = rows.withColumn("uid", F.coalesce("new", "uid")).select(dirents.columns)
    own = self_counters(rows)
    return rows, total_counters(own, subtree_counters(own))


def verified(objects: DataFrame) -> DataFrame:
    """Objects (hash, content) with ok: whether the content has the digest that names it."""
    return objects.withColumn("ok", F.coalesce(F.sha1("content") == F.substring("hash", 1, 40), F.lit(False)))


def fetched(spark: SparkSession, folder: str) -> DataFrame:
    """hash, content, ok of the files of a folder of objects, named by two digits, a slash and the rest of the digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.concat(F.regexp_extract("path", "([^/]*)/([^/]*)$", 1), F.regexp_extract("path", "([^/]*)/([^/]*)$", 2))
    return verified(files.select(name.alias("hash"), "content"))


# leases


def lease_roots(requests: DataFrame) -> DataFrame:
    """repository, path, root: the shortest requested path whose text begins the path. Overlapping paths have one root."""
    paths = requests.select("repository", "path").distinct()
    prefix = paths.select("repository", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("root"))
    hits = prefix.join(paths.select("repository", F.col("path").alias("root")), ["repository", "root"], "left_semi")
    return hits.groupBy("repository", "path").agg(F.min_by("root", F.length("root")).alias("root"))


def replayed_leases(requests: DataFrame, lifetime: int) -> DataFrame:
    """seq, outcome, left of lease requests (seq, t, repository, path, action, token) in order of (t, seq).

    new asks for a path: granted, or busy with the longest time left of the unexpired leases whose path begins the asked one or the
    other way round. commit and cancel name the token of a new request, of any path: done, or invalid if that lease is not
    held or, for commit, ended before now. An expired lease is gone for cancel too. Only paths with a common root depend on
    each other; each root is replayed in one pass that keeps the leases held, of which none begins another.
    """
    asked = requests.filter("action = 'new'").select("token", F.col("repository").alias("repository_"), F.col("path").alias("path_"))
    rows = requests.join(asked.dropDuplicates(["token"]), "token", "left")
    rows = rows.select("seq", "t", "action", "token", *[F.when(F.col("action") == "new", F.col(c)).otherwise(F.col(f"{c}_")).alias(c) for c in ("repository", "path")])
    known = rows.filter("path is not null and repository is not null")
    stray = rows.filter("path is null or repository is null").select("seq", F.lit("invalid").alias("outcome"), F.lit(None).cast("long").alias("left"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, paths, held = None, [], {}

        def blocking(path: str, now: int) -> int | None:
            """Time left of a lease in the way; expired ones that would be are dropped."""
            i = end = bisect_left(paths, path)
            while end < len(paths) and paths[end].startswith(path):
                end += 1
            if i and path.startswith(paths[i - 1]):
                i -= 1
            left = max([held[p][1] - now for p in paths[i:end]], default=0)
            if left > 0:
                return left
            for p in paths[i:end]:
                del held[p]
            del paths[i:end]
            return None

        for batch in batches:
            out = []
            for seq, t, action, token, repository, path, own in batch.itertuples(index=False):
                if (repository, own) != root:
                    root, paths, held = (repository, own), [], {}
                if action == "new":
                    left = blocking(path, t)
                    out.append((seq, "busy" if left else "granted", left))
                    if not left:
                        insort(paths, path)
                        held[path] = (token, t + lifetime)
                else:
                    mine = path in held and held[path][0] == token and held[path][1] >= t
                    out.append((seq, "done" if mine else "invalid", None))
                    if mine:
                        paths.remove(path)
                        del held[path]
            yield pd.DataFrame(out, columns=["seq", "outcome", "left"]).astype({"left": "Int64"})

    known = known.join(lease_roots(known), ["repository", "path"]).select("seq", "t", "action", "token", "repository", "path", "root")
    known = known.repartition("repository", "root").sortWithinPartitions("repository", "root", "t", "seq")
    return known.mapInPandas(task, "seq long, outcome string, left long").unionByName(stray)
