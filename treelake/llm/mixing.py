"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a seeded hash of its documents, so that blocks in order of their number are a
random permutation. A source whose target is q whole times its size plus a rest takes all its blocks in each of q
rounds and, in one more round, documents along the permutation up to the rest: a document that does not fit is left out and
the next ones that do are taken, until none fits. Where one more document brings the words nearer to the rest, it closes the
gap. The block draws of all sources are then split among the output shards by a binary tree: each node hands its left half a
multivariate-hypergeometric share of the remaining draws of every source. A shard takes the next draws of each source, and
shuffles them locally; a document is taken once for each shard that it gets.

One row of each source reaches the driver.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; equal rows are
taken equally often; ties in the permutation go to the smaller doc_id, null first; a source of size 0 has target 0; very long
texts are measured whole; an empty table gives no rows; other columns of the input are ignored (mixed keeps them).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelake.llm.common import WORD, fresh, stored, table

#: Blocks of a source, and sub-blocks of a block.
BLOCKS = 256
#: Most times that a document is taken.
MOST = 3
#: Output shards.
SHARDS = 64
#: Share of the target below which what is missing is left.
NEAR = 0.001


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Share the sum of sizes by weight, no target above most times its size; excess is shared again by weight."""
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def split_draws(draws: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws of each source in each shard, by a binary tree of multivariate-hypergeometric splits."""
    random, out = np.random.default_rng(seed), np.zeros((shards, len(draws)), dtype=np.int64)

    def node(low: int, high: int, here: np.ndarray) -> None:
        if high - low == 1:
            out[low] = here
            return
        middle = (low + high) // 2
        share = int(here.sum()) * (middle - low) // (high - low)
        left = np.array(random.multivariate_hypergeometric(here, share, method="marginals")) if share else here * 0
        node(low, middle, left)
        node(middle, high, here - left)

    node(0, shards, np.array(draws, dtype=np.int64))
    return out


def permuted(seed: int) -> Column:
    """The place of a row in the random permutation."""
    return F.xxhash64(F.lit(seed), "doc_id", F.length("text"), F.crc32(F.coalesce("text", F.lit(""))))


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, place in the permutation (block, sub, at), number (n) and words of equal rows."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), permuted(seed).alias("at"))
    rows = rows.groupBy("doc_id", "source", "size", "at").agg(F.count("*").alias("n")).withColumn("words", F.col("size") * F.col("n"))
    return rows.withColumns({"block": F.pmod("at", F.lit(BLOCKS)).cast("int"), "sub": F.pmod(F.shiftright("at", 8), F.lit(BLOCKS)).cast("int")})


def joined(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Join decisions of each source to rows; a null source equals itself."""
    small = small.withColumnRenamed("source", "its_source")
    return rows.join(small, rows["source"].eqNullSafe(F.col("its_source")), how).drop("its_source")


def prefix(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """source, cut, cut_sub, last: where the permutation of each source's rows reaches its limit (source, limit) in words.

    Blocks below cut fit whole, in the cut block sub-blocks below cut_sub, and there documents up to last (at, doc_id).
    """
    before = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda df, by: df.groupBy("source", by).agg(F.sum("words").alias("words"))

    def reached(words: DataFrame, start: DataFrame, by: str) -> DataFrame:
        """The first of the source's parts that does not fit whole, and the words before it."""
        words = words.withColumn("upto", F.coalesce(F.sum("words").over(before.orderBy(by)), F.lit(0)))
        words = joined(words, start).withColumn("upto", F.col("upto") + F.col("begun")).filter("upto + words > limit")
        return words.groupBy("source").agg(F.min(F.struct(by, "upto", "limit")).alias("e")).select("source", f"e.{by}", F.col("e.upto").alias("begun"), "e.limit")

    cut = stored(reached(sums(rows, "block"), limits.withColumn("begun", F.lit(0).cast("long")), "block").withColumnRenamed("block", "cut"), "mix-cut")
    edge = joined(rows, cut).filter("block = cut")
    sub = stored(reached(sums(edge, "sub"), cut.select("source", "begun", "limit"), "sub").withColumnRenamed("sub", "cut_sub"), "mix-cut-sub")
    inside = joined(edge.select("source", "sub", "at", "doc_id", "words"), sub).filter("sub = cut_sub")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("at", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("upto", F.col("begun") + upto).filter("upto <= limit").groupBy("source").agg(F.max(F.struct("at", "doc_id")).alias("last"))
    return stored(joined(joined(cut.select("source", "cut"), sub.select("source", "cut_sub"), "left"), last, "left"), "mix-prefix")


def within(cuts: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with in_prefix: whether they lie before the cuts; sources without a cut fit whole."""
    place = F.struct("at", "doc_id")
    inside = F.when(F.col("cut").isNull(), True).when(F.col("block") != F.col("cut"), F.col("block") < F.col("cut"))
    inside = inside.when(F.col("cut_sub").isNull(), True).when(F.col("sub") != F.col("cut_sub"), F.col("sub") < F.col("cut_sub"))
    inside = inside.otherwise(F.coalesce(place <= F.col("last"), F.lit(False)))
    return joined(rows, cuts, "left").withColumn("in_prefix", inside).drop("cut", "cut_sub", "last")


def mix(docs: DataFrame, seed: int = 7, shards: int = SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken, shards, at of every row.

    at is the row's place in the permutation, shards the output shard of each copy, times their number, taken their words.
    """
    spark = docs.sparkSession
    rows = stored(measured(docs, seed), "mix-sizes")
    found = [(r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("words").alias("size")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    target = targets([n for _, n in found], [1 + i % 3 for i in range(len(found))])
    rounds = [min(MOST, int(t // n)) if n else 0 for t, (_, n) in zip(target, found)]
    plan = [(s, n, t, q, int(t - q * n)) for (s, n), t, q in zip(found, target, rounds)]
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, rounds int, rest long")
    plan = stored(plan, "mix-plan")  # so that Spark knows its size and picks the join

    # Documents along the permutation, then those that still fit, until none does.
    state = stored(rows.withColumn("in_rest", F.lit(False)), "mix-state")
    while True:
        gaps = missing(state, plan)
        free = ~F.col("in_rest") & (F.col("words") > 0) & F.coalesce(F.col("words") <= F.col("limit"), F.lit(False))
        left = joined(state, gaps, "left").withColumn("free", free)
        if left.filter("free").isEmpty():
            break
        cuts = prefix(left.filter("free").drop("limit", "free"), gaps)
        state = within(cuts, left).withColumn("in_rest", F.col("in_rest") | (F.col("free") & F.col("in_prefix"))).drop("limit", "free", "in_prefix")
        state = stored(state, "mix-state")

    # Of the documents left out, all too large by now, one closes the gap if that is nearer than none.
    close = joined(state.filter("not in_rest and words > 0"), gaps).filter("words < 2 * limit")
    close = close.groupBy("source").agg(F.min(F.struct("words", "at", "doc_id")).alias("c")).select("source", F.struct("c.at", "c.doc_id").alias("last"))
    state = joined(state, stored(close, "mix-close"), "left")
    state = state.withColumn("in_rest", F.col("in_rest") | F.coalesce(F.struct("at", "doc_id").eqNullSafe(F.col("last")) & F.col("last").isNotNull(), F.lit(False))).drop("last")
    state = stored(state, "mix-state")

    # The tree deals each source's block draws to the shards.
    ends = {r["source"]: r["blocks"] for r in state.filter("in_rest").groupBy("source").agg((F.max("block") + 1).alias("blocks")).collect()}
    draws = [q * BLOCKS + ends.get(s, 0) for (s, _), q in zip(found, rounds)]
    upto = np.cumsum(split_draws(draws, shards, seed), axis=0)
    dealt = spark.createDataFrame([(s, upto[:, i].tolist()) for i, (s, _) in enumerate(found)], "source string, ends array<long>")
    dealt = stored(dealt, "mix-dealt")
    out = joined(joined(state, plan.drop("rest")), dealt)
    times = F.least(F.col("rounds") + F.col("in_rest").cast("int"), F.lit(MOST))
    draw = lambda k: k * BLOCKS + F.col("block")
    shard = F.transform(F.sequence(F.lit(0), times - 1), lambda k: F.size(F.filter("ends", lambda e: e <= draw(k))))
    out = out.withColumn("shards", F.when(times > 0, shard).otherwise(F.array().cast("array<int>")))
    out = out.withColumns({"times": F.size("shards"), "taken": F.col("size") * F.size("shards")})
    out = out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", "taken", "shards", "at")


def missing(state: DataFrame, plan: DataFrame) -> DataFrame:
    """source, limit: the words that the rest of each source lacks, where that is more than NEAR of its target."""
    used = state.groupBy("source").agg(F.sum(F.when(F.col("in_rest"), F.col("words")).otherwise(0)).alias("used"))
    gaps = joined(used, plan.select("source", "rest", "target")).select("source", (F.col("rest") - F.col("used")).alias("limit"), "target")
    return stored(gaps.filter((F.col("limit") > 0) & (F.col("limit") > F.col("target") * NEAR)).select("source", "limit"), "mix-gaps")


def mixed(docs: DataFrame, seed: int = 7, shards: int = SHARDS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with shard and place: order by them within a shard.

    Where docs has a shard or place of its own, that stays and ours gets underscores behind its name.
    """
    plan = mix(docs, seed, shards).filter("times > 0").select("doc_id", "at", F.posexplode("shards").alias("copy", "shard"))
    plan = plan.dropDuplicates(["doc_id", "at", "copy"]).withColumn("place", F.xxhash64(F.lit(seed), "at"))
    names = {c: fresh(docs, n) for c, n in {"doc_id": "its_id", "at": "its_place", "shard": "shard", "place": "place"}.items()}
    plan = plan.drop("copy").withColumnsRenamed(names)
    same = (permuted(seed) == F.col(names["at"])) & docs["doc_id"].eqNullSafe(F.col(names["doc_id"]))
    return docs.join(plan, same).drop(names["doc_id"], names["at"])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards", F.xxhash64(F.lit(7), "at").alias("place"))


QUERIES = {"op5_mixing": op5}
SQL: dict[str, str] = {}
