from __future__ import annotations

import random

import pytest
from brute import documents, ordered, substrings

from treelake.llm import substring_dedup
from treelake.llm.queries import QUERIES


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op3_substring_dedup"](spark, sf_dir).collect()
    assert ordered(found) == ordered(substrings([tuple(r) for r in docs]))


@pytest.mark.parametrize("group", [2, 2000])
def test_random_repeats(spark, group):
    rng = random.Random(3)
    passages = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(30, 60))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(40)}" for _ in range(rng.randrange(60))) for _ in range(rng.randrange(5))]
        rows.append((i, " ".join(parts), "en", "a"))
    rows += [(200, "same " * 80, "en", "a"), (201, "p q " * 60, "en", "a")]
    found = substring_dedup.digests(documents(spark, rows), group).collect()
    assert ordered(found) == ordered(substrings([(r[0], r[1]) for r in rows]))


def test_odd_rows(spark):
    df = documents(spark)
    found = substring_dedup.digests(df).collect()
    assert ordered(found) == ordered(substrings([(r["doc_id"], r["text"]) for r in df.collect()]))
    assert substring_dedup.digests(documents(spark, [])).count() == 0


def test_texts_keep_their_other_words(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"first {passage} end", "en", "a"), (2, f"second\t{passage}", "en", "a"), (3, "alone", "en", "a")]
    assert {r["doc_id"]: r["text"] for r in substring_dedup.dedup(documents(spark, rows)).collect()} == {1: "first end", 2: "second", 3: "alone"}
