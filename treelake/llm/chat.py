"""Chat formatting by cumulative-snapshot collapse.

Logs hold a conversation again at each of its turns. A rolling digest of every turn prefix identifies such snapshots: a
conversation is dropped where its whole digest is also the digest of a proper prefix of a longer one (an anti-join);
of equal conversations the smallest id stays. What stays is rendered, in parts of PART turns.

The digest of a prefix is the sum over its turns of a digest of (place, role, text), so it can be added up over the
pieces of a range-partitioned sort: one conversation of any length is spread over many tasks.

Defined results: rows that repeat (conv_id, turn, role, text) count once; turns with one number are ordered by role, then
by digest of the text; a null turn comes first; null roles and texts count as empty; rows with a null conv_id form one
conversation, which counts as the smallest id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelake.llm.common import rows_about, stored, table

#: Turns of a rendered part.
PART = 64
#: Rows of a piece of the sort.
PIECE = 50_000
#: Stands for a null conv_id inside the operator.
NULL_ID = -(1 << 63)


def placed(conversations: DataFrame) -> DataFrame:
    """conv, place (from 1), n_turns, role, text, s1, s2 (digest sums of the prefix that ends here) of every turn."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv")
    turns = conversations.select(conv, F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    turns = stored(turns.withColumn("digest", F.md5("text")).dropDuplicates(["conv", "turn", "role", "digest"]), "chat-turns")
    order = ["conv", "turn", "role", "digest"]
    pieces = turns.repartitionByRange(rows_about(turns, PIECE), *order).withColumn("piece", F.spark_partition_id())
    pieces = stored(pieces, "chat-pieces")
    inside = Window.partitionBy("conv", "piece")
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)

    counts = pieces.groupBy("conv", "piece").count()
    starts = counts.select("conv", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"), F.sum("count").over(Window.partitionBy("conv")).alias("n_turns"))
    at = pieces.withColumn("within", F.row_number().over(inside.orderBy("turn", "role", "digest")))
    at = at.join(starts, ["conv", "piece"]).withColumn("place", F.col("start") + F.col("within"))
    for seed in (1, 2):
        at = at.withColumn(f"h{seed}", F.xxhash64(F.lit(seed), "place", "role", "digest").cast("decimal(38,0)"))
    at = stored(at.select("conv", "piece", "place", "n_turns", "role", "text", "h1", "h2"), "chat-places")
    totals = at.groupBy("conv", "piece").agg(F.sum("h1").alias("t1"), F.sum("h2").alias("t2"))
    sums = lambda t: F.coalesce(F.sum(t).over(before), F.lit(0).cast("decimal(38,0)"))
    offsets = totals.select("conv", "piece", sums("t1").alias("o1"), sums("t2").alias("o2"))
    upto = inside.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = at.withColumns({"r1": F.sum("h1").over(upto), "r2": F.sum("h2").over(upto)}).join(offsets, ["conv", "piece"])
    return stored(out.select("conv", "place", "n_turns", "role", "text", (F.col("r1") + F.col("o1")).alias("s1"), (F.col("r2") + F.col("o2")).alias("s2")), "chat-prefixes")


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv, n_copies of the conversations that are no proper prefix of another; of equal ones the smallest."""
    whole = prefixes.filter("place = n_turns").groupBy("place", "s1", "s2").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    longer = prefixes.filter("place < n_turns").groupBy("place", "s1", "s2").agg(F.lit(1).alias("one"))
    return whole.join(longer, ["place", "s1", "s2"], "left_anti").select("conv", "n_copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """conv_id, part (from 0), n_turns, n_copies, text of every maximal conversation; its parts in order are its whole text."""
    prefixes = placed(conversations)
    kept = stored(maximal(prefixes), "chat-maximal")
    turns = prefixes.join(kept, "conv")
    parts = turns.groupBy("conv", F.floor((F.col("place") - 1) / PART).alias("part"), "n_turns", "n_copies")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("said")))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("text")
    return parts.select(F.nullif("conv", F.lit(NULL_ID)).alias("conv_id"), "part", "n_turns", "n_copies", text)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


OP1_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS place,
             count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
q AS (SELECT *, string_agg(md5(role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM p),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, prefix FROM q WHERE place = n_turns GROUP BY prefix),
m AS (SELECT conv_id, n_copies FROM w WHERE prefix NOT IN (SELECT prefix FROM q WHERE place < n_turns))
SELECT q.conv_id, (place - 1) // {PART} AS part, n_turns, n_copies,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM q JOIN m ON q.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY ALL
"""

QUERIES = {"op1_chat": op1}
SQL = {"op1_chat": OP1_SQL}
