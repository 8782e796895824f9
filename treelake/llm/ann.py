"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more component that makes the largest inner product the smallest distance. k-means centres and the
number of lists that a query probes are fitted to a bounded sample (SAMPLE vectors with the smallest hash), the lists
hold every vector. A query's lists are scanned in turns, the nearest first: its k-th best score so far bounds the next turn,
which gives only what is no worse. Vectors and queries of a list meet in groups of bounded size. There both are rotated at
random and read in blocks of columns; after each block a hypothesis test drops, for each query by itself, the candidates
whose partial distance already says that they lie beyond its bound. What remains is scored in double precision on the
original vectors. Of equal vectors only the k + 1 smallest ids can be among k neighbours, so only they are scanned.

Defined results: null vec_ids and vectors that are null, empty, zero, hold null or non-finite components, or have another
length than most take no part; rows that share the query's vec_id are its own row; repeated rows count once; ties go to
the smaller vec_id; fewer candidates than k give all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treelake.llm.common import stored, table

SAMPLE, MOST_LISTS = 20_000, 1024
#: Recall on the sample that the number of probes is fitted to.
RECALL = 0.98
#: Most vectors and queries of a group.
GROUP = 2048
#: Lists that a query has scanned after each turn but the last.
TURNS = (1, 4, 12)
#: Pairs whose next columns are read at once.
PAIRS = 100_000
#: Columns read before each test.
STOPS = (24, 40, 52)
#: Deviations of the hypothesis test: larger drops fewer candidates.
DEVIATIONS = 1.2


@dataclass
class Lists:
    """Centres, rotation and number of probes; longest is the largest norm of all vectors."""

    centres: np.ndarray
    rotation: np.ndarray
    longest: float
    probes: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that turns inner product into distance."""
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)

    def nearest(self, x: np.ndarray, n: int, query: bool = False) -> np.ndarray:
        lifted = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self.lifted(x)
        far = (self.centres**2).sum(axis=1) - 2 * lifted @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n] if n > 1 else far.argmin(axis=1)[:, None]


def k_means(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=lists)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def fit(sample: np.ndarray, rows: int, longest: float, k: int, recall: float = RECALL, seed: int = 5) -> Lists:
    """Centres for so many rows, and the fewest probes that reach the recall among the sample's own vectors."""
    size = sample.shape[1] + 1
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
    lists = 1 if rows <= 2000 else int(min(MOST_LISTS, len(sample) // 20, rows**0.5 / 2))
    model = Lists(np.zeros((1, size)), rotation, longest, 1)
    if lists <= 1:
        return model
    lifted = model.lifted(sample)
    model.centres = k_means(lifted, lists)
    own = model.nearest(sample, 1)[:, 0]
    queries = sample[:: max(1, len(sample) // 300)]
    top = np.argsort(-(queries @ sample.T), axis=1)[:, : k + 1]
    order = model.nearest(queries, lists, query=True)
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    model.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return model


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def assigned(load: Callable[[], Lists]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = load().nearest(matrix(batch["embedding"]), 1)[:, 0] if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(own.astype("i4"))], ["vec_id", "embedding", "list"])

    return task


def probing(load: Callable[[], Lists], sizes: dict[int, int], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries to the lists they probe and the turn of each: the fitted number, and on until the lists hold k + 1 vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        count = np.array([sizes.get(i, 0) for i in range(len(model.centres))])
        for batch in batches:
            for start in range(0, len(batch), 1000):
                some = batch.slice(start, 1000)
                order = model.nearest(matrix(some["embedding"]), len(count), query=True)
                held = np.cumsum(count[order], axis=1) - count[order]
                probe = (np.arange(len(count)) < model.probes) | (held <= k)
                rows, columns = np.nonzero(probe & (count[order] > 0))
                taken, turn = some.take(pa.array(rows)), np.searchsorted(TURNS, columns, side="right")
                yield pa.RecordBatch.from_arrays([taken["vec_id"], taken["embedding"], pa.array(order[rows, columns].astype("i4")), pa.array(turn.astype("i4"))], ["vec_id", "embedding", "list", "turn"])

    return task


def scan(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, model: Lists, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that the adaptive scan keeps: k best with at least each query's score, save for the tests' errors."""
    q = (np.concatenate([queries, np.zeros((len(queries), 1))], axis=1) @ model.rotation).astype(np.float32)
    v = (model.lifted(vectors) @ model.rotation).astype(np.float32)
    n = q.shape[1]
    stops = [x for x in STOPS if x < n] + [n]
    a, b = q[:, : stops[0]], v[:, : stops[0]]
    partial = (a**2).sum(axis=1)[:, None] + ((b**2).sum(axis=1) - 2 * (a @ b.T))
    limit = ((queries**2).sum(axis=1) + model.longest**2 - 2 * least).astype(np.float32)
    if len(free := np.flatnonzero(np.isinf(limit))):  # without a bound: the k-th of the candidates that look nearest so far
        pilot = min(len(v), 2 * k)
        near = np.argpartition(partial[free], pilot - 1, axis=1)[:, :pilot]
        far = np.stack([((v[near[i]] - q[f]) ** 2).sum(axis=1) for i, f in enumerate(free)])
        limit[free] = np.partition(far, min(k, pilot) - 1, axis=1)[:, min(k, pilot) - 1]
    limit += np.float32(1e-5) * (np.abs(limit) + np.float32(model.longest**2)) + np.float32(1e-30)
    test = [np.float32((1 + DEVIATIONS / at**0.5) ** 2 * at / n if at < n else 1.0) for at in stops]
    rows, columns = np.nonzero(partial <= (limit * test[0])[:, None])
    kept = []
    for start in range(0, len(rows), PAIRS):
        r, c = rows[start : start + PAIRS], columns[start : start + PAIRS]
        far = partial[r, c]
        for low, high, share in zip(stops, stops[1:], test[1:]):
            far = far + ((q[r, low:high] - v[c, low:high]) ** 2).sum(axis=1)
            near = far <= limit[r] * share
            r, c, far = r[near], c[near], far[near]
        kept.append((r, c))
    return tuple(np.concatenate(x) for x in zip(*kept)) if kept else (rows, columns)


def best_of_all(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) of the k largest products of each query among all vectors but its own, and what rounding may have moved."""
    product = queries @ vectors.T
    slack = 1e-9 * (1 + np.abs(product).max())
    product[own] = -np.inf
    least = -np.partition(-product, min(k, len(vectors)) - 1, axis=1)[:, min(k, len(vectors)) - 1]
    return np.nonzero((product >= least[:, None] - slack) & ~own)


def met(load: Callable[[], Lists], k: int, whole: bool = False) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A group's vectors and queries to the k best of each query in it that its bound lets in, whole: without the scan's tests."""

    def group(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        own, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(vectors) and len(queries):
            v, q = np.stack(vectors["embedding"].to_numpy()).astype(np.float64), np.stack(queries["embedding"].to_numpy()).astype(np.float64)
            least = queries["least"].to_numpy()
            if whole:
                rows, columns = best_of_all(q, v, queries["vec_id"].to_numpy()[:, None] == vectors["vec_id"].to_numpy(), k)
            else:
                rows, columns = scan(q, v, least, load(), k + 1)
            own, found = queries["vec_id"].to_numpy()[rows], vectors["vec_id"].to_numpy()[columns]
            score = (q[rows] * v[columns]).sum(axis=1)
            order = np.lexsort((found, -score, rows))
            order = order[((own != found) & (score >= least[rows]))[order]]
            rows = rows[order]
            starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) if len(rows) else rows
            order = order[place < k]
            own, found, score = own[order], found[order], score[order]
        return pd.DataFrame({"query_id": own, "vec_id": found, "score": score})

    return group


FOUND = "query_id long, vec_id long, score double"


def search(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each vector whose vec_id is divisible by every."""
    spark = embeddings.sparkSession
    none = "query_id long, rank int, vec_id long, score double"
    e = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    rows = rows.filter(finite & F.exists("embedding", lambda x: x != 0))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], none)
    rows = rows.filter(F.size("embedding") == length["n"]).withColumn("h", F.xxhash64("embedding"))
    copies = Window.partitionBy("h", "embedding").orderBy("vec_id")
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding", "h").dropDuplicates(["vec_id", "h"])
    rows = stored(rows.dropDuplicates(["vec_id", "h"]).withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("vec_id", "embedding", "h"), "ann-vectors")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    count, longest = rows.agg(F.count("*"), F.max(norm)).first()
    sample = np.array([r[0] for r in rows.orderBy("h", "vec_id").select("embedding").limit(SAMPLE).collect()])
    shared = spark.sparkContext.broadcast(fit(sample, count, longest, k))

    def load() -> Lists:
        return shared.value

    lists = stored(rows.select("vec_id", "embedding").mapInArrow(assigned(load), "vec_id long, embedding array<double>, list int"), "ann-lists")
    sizes = {r["list"]: r["count"] for r in lists.groupBy("list").count().collect()}
    probes = queries.select("vec_id", "embedding").mapInArrow(probing(load, sizes, k), "vec_id long, embedding array<double>, list int, turn int")
    probes = stored(probes, "ann-probes")
    best = spark.createDataFrame([], FOUND)
    for turn in range(len(TURNS) + 1):
        asked = probes.filter(F.col("turn") == turn)
        if turn and asked.isEmpty():
            break
        bounds = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).filter(F.col("n") == k)
        asked = asked.join(bounds, asked["vec_id"] == bounds["query_id"], "left")
        asked = stored(asked.select("vec_id", "embedding", "list", F.coalesce("least", F.lit(float("-inf"))).alias("least")), "ann-asked")
        best = stored(topmost(best.unionByName(met_rows(lists, asked, sizes, load, k)), k).drop("rank"), "ann-best")
    # The tests may drop what is among the k best: queries left with fewer than k look again at all their lists hold.
    enough = best.groupBy("query_id").count().filter(F.col("count") == min(k, max(1, count - 1))).select("query_id")
    enough = stored(enough, "ann-enough")
    short = probes.join(enough, probes["vec_id"] == enough["query_id"], "left_anti").select("vec_id", "embedding", "list", F.lit(float("-inf")).alias("least"))
    again = met_rows(lists, stored(short, "ann-short"), sizes, load, k, True)
    return topmost(best.join(enough, "query_id", "left_semi").unionByName(again), k).select("query_id", "rank", "vec_id", "score")


def topmost(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)


def met_rows(lists: DataFrame, asked: DataFrame, sizes: dict[int, int], load: Callable[[], Lists], k: int, whole: bool = False) -> DataFrame:
    """query_id, vec_id, score of what queries asked of lists (vec_id, embedding, list, least) find there."""
    wanted = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    if not wanted:
        return lists.sparkSession.createDataFrame([], FOUND)
    parts = lists.sparkSession.createDataFrame([(i, -(-n // GROUP), -(-wanted.get(i, 0) // GROUP)) for i, n in sizes.items()], "list int, v_parts int, q_parts int")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows with their part of the list, once for each part of the other side; one row per list is broadcast."""
        df = df.join(F.broadcast(parts), "list").filter(f"{other} > 0").withColumn(own[0], F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int"))
        return df.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("v_parts", "q_parts")

    keys = ["list", "v", "q"]
    both = dealt(lists, "v_parts", "q_parts").groupBy(*keys).cogroup(dealt(asked, "q_parts", "v_parts").groupBy(*keys))
    return both.applyInPandas(met(load, k, whole), FOUND)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_ann": op7}
SQL: dict[str, str] = {}
