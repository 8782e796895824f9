"""Exact dedup with a log-structured merge index of text digests.

Memtables (one hash table per task, flushed at ``memtable_rows`` digests) become sorted digest runs, stored as
Parquet with a Bloom filter per column chunk. Compaction merges the runs of a level and keeps the smallest
identifier and the number of rows of each digest. Digests with more than one row are hits; their texts are
compared byte for byte, and digests shared by different texts are split by the text itself.

Defined results: a null text counts as empty; empty texts equal each other; a null doc_id loses against any other,
and a group of null ids alone keeps null; rows that repeat one doc_id with one text are all marked like that id;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm.common import fresh, normalised, stored, table

#: Bits of the fixed-size filter in front of byte verification: 1024 rows of 4 KiB, whatever the input.
FILTER_BITS = 25
RUN = "digest string, keep_id long, group_size long"


def flush_memtables(memtable_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: rows (digest, keep_id, group_size) to sorted runs with one row per digest."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        by = pa.concat_tables(parts).group_by("digest").aggregate([("keep_id", "min"), ("group_size", "sum")])
        return by.select(["digest", "keep_id_min", "group_size_sum"]).rename_columns(["digest", "keep_id", "group_size"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held = [merged([*held, pa.Table.from_arrays(batch.columns, ["digest", "keep_id", "group_size"])])]
            if held[0].num_rows >= memtable_rows:
                yield from held[0].sort_by("digest").to_batches()
                held = []
        for last in held:
            yield from last.sort_by("digest").to_batches()

    return task


def build_index(digests: DataFrame, memtable_rows: int = 200_000) -> DataFrame:
    """Index of (doc_id, digest) rows: flushed level-0 runs, merged by one compaction into level 1."""
    entries = digests.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    level0 = stored(entries.mapInArrow(flush_memtables(memtable_rows), RUN), "dedup-level0", parquet__bloom__filter__enabled="true")
    return compact([level0])


def compact(runs: list[DataFrame]) -> DataFrame:
    """Merge runs into one stored run: smallest identifier, summed rows. Also merges indexes of separate batches."""
    rows = runs[0]
    for run in runs[1:]:
        rows = rows.unionByName(run)
    merged = rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return stored(merged.sortWithinPartitions("digest"), "dedup-run", parquet__bloom__filter__enabled="true")


def in_filter(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows of docs whose digest may be among hits, by a bitmap of FILTER_BITS bits; it may let others through."""

    def place(digest: Column) -> Column:
        return F.conv(F.substring(F.sha1(digest), 1, 7), 16, 10).cast("long").bitwiseAND((1 << FILTER_BITS) - 1)

    bits = hits.select(place(F.col("digest")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    at = docs.withColumn("p", place(F.col("digest")))
    at = at.withColumn("bucket", F.bitmap_bucket_number("p")).join(F.broadcast(bits), "bucket")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(p) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("shiftright(byte, cast(bitmap_bit_position(p) % 8 as int))").bitwiseAND(1) == 1
    return at.withColumn("byte", byte).filter(is_set).select(*docs.columns)


def exact_dedup(docs: DataFrame, digest_chars: int = 64, memtable_rows: int = 200_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; digest_chars shortens the index's digest."""
    text = normalised(F.col("text"))
    whole = docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), text.alias("norm"))
    whole = whole.withColumn("digest", F.substring("text_sha256", 1, digest_chars))
    digests = stored(whole.select("doc_id", "digest", "text_sha256"), "dedup-digests")
    index = build_index(digests, memtable_rows)
    hits = index.filter("group_size > 1").select("digest")
    checked = in_filter(whole.select("digest", "norm"), hits).groupBy("digest")
    checked = checked.agg((F.min("norm") == F.max("norm")).alias("equal"))
    collided = stored(checked.filter("not equal").select("digest"), "dedup-collided")
    found = digests.join(index, "digest")
    if not collided.isEmpty():
        found = found.join(collided, "digest", "left_anti")
        split = whole.join(collided, "digest", "left_semi")
        groups = split.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.unionByName(split.join(groups, ["digest", "norm"]).drop("norm"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs: that with the smallest doc_id."""
    kept = stored(exact_dedup(docs).filter("kept").groupBy("doc_id", "text_sha256").count(), "dedup-kept")
    chosen = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    sha = F.sha2(normalised(docs["text"]), 256)
    rows = docs.join(chosen, (sha == chosen["kept_sha"]) & docs["doc_id"].eqNullSafe(chosen["kept_id"]), "left_semi")
    if kept.filter("count > 1").isEmpty():
        return rows
    name = fresh(docs, "kept_sha")
    return rows.withColumn(name, F.sha2(normalised(F.col("text")), 256)).dropDuplicates(["doc_id", name]).drop(name)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""

QUERIES = {"op9_exact_dedup": op9}
SQL = {"op9_exact_dedup": OP9_SQL}
