from __future__ import annotations

import zlib

import numpy as np
from brute import documents

from treelake.llm import toxicity
from treelake.llm.queries import QUERIES


def area(scores: np.ndarray, labels: np.ndarray) -> float:
    """Share of pairs (toxic, clean) in right order."""
    a, b = scores[labels == 1], scores[labels == 0]
    return float(((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean())


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")  # some 800 held-out labels; sf0.01 has too few to tell
    found = QUERIES["op4_toxicity"](spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").filter("held_out and toxic in (0, 1)").select("score", "predicted", "toxic").collect()
    scores, labels_ = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert area(scores, labels_) > 0.9
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9


def test_every_row_is_scored(spark, sf_dir):
    rows = QUERIES["op4_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def train(spark):
    bad = [(i, f"you are a vile idiot number{i} go away", "en", "a") for i in range(100, 160)]
    good = [(i, f"the weather in town number{i} is fine today", "en", "a") for i in range(200, 260)]
    docs = documents(spark, bad + good)
    labels = spark.createDataFrame([(r[0], int(r[0] < 200)) for r in bad + good], "doc_id long, toxic int")
    return docs, labels


def test_odd_rows_and_spans(spark):
    model = toxicity.learn(*train(spark))
    said = "\u0130\u0130 what a vile idiot \U0001f600"
    odd = documents(spark).unionByName(documents(spark, [(50, said, "en", "a")]))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 16 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"]: r["predicted"] for r in rows}[50] == 1
    assert {r["doc_id"]: r["predicted"] for r in rows}[2] == 0
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert [said[x["start"] : x["end"]] for x in spans[50]] == [said[: said.index(" \U0001f600")]] and spans[2] == []  # this small field finds all words toxic
    kept = toxicity.reject_toxic(odd, model)
    assert kept.columns == odd.columns and kept.filter("doc_id = 50").count() == 0 and kept.filter("doc_id = 8").count() == 2
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_without_labels(spark):
    docs, labels = train(spark)
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels.filter("toxic = 1"))).collect()} == {1.0}


def test_marginals_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    model = toxicity.Field(np.zeros(1 << toxicity.HASH_BITS), rng.normal(size=(2, 2)), np.zeros(4))
    words = [f"w{i}" for i in range(6)]
    for w in words:
        for i in toxicity.features(w):
            model.weights[i] = rng.normal()
    emit = model.emissions(words)
    total, toxic = 0.0, np.zeros(6)
    for path in range(64):
        s = [path >> i & 1 for i in range(6)]
        weight = np.exp(sum(e * x for e, x in zip(emit, s)) + sum(model.move[a, b] for a, b in zip(s, s[1:])))
        start = [sum(np.exp(model.move[x, s[0]]) for x in (0, 1))]
        weight *= start[0]
        total += weight
        toxic += weight * np.array(s)
    assert np.allclose(model.marginals([words])[0], toxic / total)


def test_fit_scores_its_sample_in_blocks(monkeypatch):
    texts = [f"some words of text number {i} " * 20 + "vile" * (i % 2) for i in range(40)]
    wanted, sizes, marginals = toxicity.fit(texts, [i % 2 for i in range(40)], 0.5), [], toxicity.Field.marginals

    def counted(self, words):
        sizes.append(sum(map(len, words)))
        return marginals(self, words)

    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 500)
    monkeypatch.setattr(toxicity.Field, "marginals", counted)
    found = toxicity.fit(texts, [i % 2 for i in range(40)], 0.5)
    assert 1 < len(sizes) and max(sizes) < 700
    assert (found.scale == wanted.scale).all() and (found.weights == wanted.weights).all()
