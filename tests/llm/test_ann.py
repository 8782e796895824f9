from __future__ import annotations

import numpy as np

from treelake.llm import ann
from treelake.llm.queries import QUERIES


def brute(ids: np.ndarray, x: np.ndarray, every: int = 20, k: int = 20) -> dict[int, list[tuple[int, float]]]:
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = x @ x[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def recall(found: dict, wanted: dict) -> float:
    return float(np.mean([len({v for v, _ in found.get(q, [])} & {v for v, _ in w}) / len(w) for q, w in wanted.items() if w]))


def gathered(df) -> dict[int, list[tuple[int, float]]]:
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_query_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    wanted, found = brute(ids, x), gathered(QUERIES["op7_ann"](spark, sf_dir.replace("sf0.001", "sf0.01")))
    assert found.keys() == wanted.keys()
    assert all(len(v) == 20 for v in found.values())
    assert recall(found, wanted) > 0.9
    at = {int(i): v for i, v in zip(ids, x)}
    for q, best in found.items():
        assert best == sorted(best, key=lambda b: (-b[1], b[0]))
        assert all(abs(at[q] @ at[v] - s) < 1e-9 for v, s in best)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0]), (40, None), (11, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS h", "2 AS copy", "3 AS list", "4 AS score", "5 AS bound")
    found = gathered(ann.search(df))
    assert found == {0: [(20, 2.0), (1, 0.5), (2, 0.5), (3, -1.0)], 20: [(0, 2.0), (1, 1.0), (2, 1.0), (3, -2.0)]}
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id in (4, 5, 6)")).count() == 0
    assert ann.search(df.filter("vec_id = 20")).count() == 0


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:1500] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    wanted, found = brute(np.arange(3000), x.astype(np.float64)), gathered(ann.search(df))
    assert all(len(found[q]) == 20 for q in wanted)
    assert recall(found, wanted) > 0.9


def test_small_tables_give_all_candidates(spark):
    x = np.random.default_rng(2).normal(size=(21, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    wanted, found = brute(np.arange(len(x)), x, 1), gathered(ann.search(df, 1))
    assert {q: [v for v, _ in w] for q, w in found.items()} == {q: [v for v, _ in w] for q, w in wanted.items()}


def test_recall_over_several_lists(spark):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(80, 64))[rng.integers(0, 80, 20_000)] + rng.normal(size=(20_000, 64)) * 0.6, rng.normal(size=(20_000, 24))):
        x = x.astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        wanted, found = brute(np.arange(20_000), x.astype(np.float64), 200), gathered(ann.search(df, 200))
        assert all(len(found[q]) == 20 for q in wanted)
        print(f"recall on 20000 vectors: {recall(found, wanted):.4f}")
        assert recall(found, wanted) > 0.9
