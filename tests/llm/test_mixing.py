from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from brute import documents, ordered, words

from treelake.llm import mixing
from treelake.llm.queries import QUERIES


def shares(sizes: dict) -> dict:
    """Target of each source, by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 3 * sizes[s]]
        if not over:
            return fixed | part
        fixed |= {s: 3.0 * sizes[s] for s in over}


def assert_mix(rows: list[tuple], found: list) -> None:
    """rows (doc_id, text, source); found has doc_id, source, size, source_size, target, taken."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    target = shares(sizes)
    assert ordered((r["doc_id"], r["source"], r["size"]) for r in found) == ordered((i, s, len(words(t))) for i, t, s in rows)
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for source, size in sizes.items():
        off = abs(taken[source] - target[source])
        rounds = min(3, int(target[source] // size)) if size else 0
        spare = [r["size"] for r in found if r["source"] == source and r["size"] and r["taken"] == rounds * r["size"]]
        assert off <= 0.02 * target[source] or all(n >= 2 * off for n in spare)  # no further document comes nearer


def test_query_meets_the_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = mixing.mix(docs).collect()
    assert_mix([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], found)
    columns = ["doc_id", "size", "source_size", "target", "taken", "shards"]
    again = QUERIES["op5_mixing"](spark, sf_dir)
    assert again.columns == [*columns, "place"]
    assert ordered(again.select(columns).collect()) == ordered(tuple(r[c] for c in columns) for r in found)


def test_odd_rows(spark):
    df = documents(spark)
    rows = df.collect()
    found = mixing.mix(df).collect()
    assert_mix([(r["doc_id"], r["text"], r["source"]) for r in rows], found)
    assert ordered((r["doc_id"], r["source"], r["size"]) for r in found) == ordered((r["doc_id"], r["source"], len(words(r["text"]))) for r in rows)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark, [])).count() == 0


def test_a_very_long_document_among_short_ones(spark):
    rows = [(i, f"w{i} " * (1 + i % 300), "en", "b") for i in range(2000)] + [(5000, "long " * 60_000, "en", "b"), (6000, "x " * 100_000, "en", "a")]
    for seed in (7, 8, 9, 10):
        found = mixing.mix(documents(spark, rows), seed).collect()
        taken, target = sum(r["taken"] for r in found if r["source"] == "b"), next(r["target"] for r in found if r["source"] == "b")
        assert abs(taken - target) <= 0.01 * target


def test_mixed_gives_each_row_as_often_as_it_is_taken(spark):
    rows = [(i, f"word{i} " * (1 + i % 7), "en", "ab"[i % 5 == 0]) for i in range(300)]
    df = documents(spark, rows)
    times = {r["doc_id"]: r["times"] for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    found = defaultdict(int)
    for r in out.collect():
        found[r["doc_id"]] += 1
    assert out.columns == [*df.columns, "shard_", "place_"]
    assert {k: v for k, v in times.items() if v} == found


def test_splitting_tree_is_exact():
    draws = [1000, 7, 0, 333]
    shards = mixing.split_draws(draws, 13, 5)
    assert shards.sum(axis=0).tolist() == draws and (shards >= 0).all()
    assert np.ptp(shards.sum(axis=1)) <= 5
    assert (shards == mixing.split_draws(draws, 13, 5)).all()
