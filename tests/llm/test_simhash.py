from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from brute import components, documents, near, ordered
from brute import simhash as simhash_of

from treelake.llm import simhash
from treelake.llm.components import connected_components
from treelake.llm.queries import QUERIES


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op10_simhash"](spark, sf_dir).collect()
    assert ordered(found) == ordered(near([tuple(r) for r in docs]))


def test_odd_rows(spark):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert ordered(simhash.near_dedup(df).drop("text_key").collect()) == ordered(near(rows))
    assert simhash.near_dedup(documents(spark, [])).count() == 0
    kept = simhash.keep_first(df)
    ids = {r[0] for r in near(rows) if r[0] == r[2]}
    assert kept.columns == df.columns
    assert ordered((r["doc_id"],) for r in kept.collect()) == ordered((i,) for i in ids)


def test_keep_first_keeps_one_row_of_every_component(spark):
    texts = ["red apples fall from old trees in autumn", "seven ships left the harbour before dawn broke", "quiet engines hum under the long steel bridge", "no one answered the letter about the lost dog"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (None, texts[3])]
    assert len(set(components([simhash_of(t) for t in texts]).values())) == 4
    kept = simhash.keep_first(documents(spark, [(i, t, "en", "a") for i, t in rows]))
    assert ordered((r["doc_id"], r["text"]) for r in kept.collect()) == ordered(set(rows[:5]))


def test_golay_code_is_perfect():
    words = np.arange(1 << 12, dtype=np.int64) << 11
    codewords = words ^ simhash.syndrome(words)
    assert (simhash.syndrome(codewords) == 0).all()
    weight = np.bitwise_count(codewords)
    assert weight[weight > 0].min() == 7
    rng = np.random.default_rng(0)
    some = rng.integers(0, 1 << 23, 5000)
    nearest = (codewords[None] ^ some[:500, None])
    best = np.bitwise_count(nearest).argmin(axis=1)
    assert (simhash.codeword_index(some[:500]) == codewords[best] >> 11).all()


def flipped(rng: random.Random, f: int, n: int) -> int:
    for b in rng.sample(range(64), n):
        f ^= 1 << b
    return f


def test_links_find_every_component(spark):
    rng = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            prints.add(f)
            f = flipped(rng, f, rng.randrange(1, 5))
    centre = rng.getrandbits(64)
    prints |= {flipped(rng, centre, rng.randrange(1, 4)) for _ in range(80)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints]
    wanted = components(list(prints))
    for owners in (4096, 3):  # 3: crowded keys go through neighbouring fingerprints
        roots = connected_components(simhash.links(spark.createDataFrame(signed, "fp long"), 3, owners)).collect()
        groups, others = defaultdict(set), defaultdict(set)
        for r in roots:
            groups[r["root"]].add(r["node"] % (1 << 64))
        for f, g in wanted.items():
            others[g].add(f)
        assert ordered(tuple(sorted(g)) for g in groups.values()) == ordered(tuple(sorted(g)) for g in others.values() if len(g) > 1)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    roots = connected_components(edges).collect()
    assert len(roots) == 203 and len({r["root"] for r in roots}) == 2
    assert connected_components(edges.limit(0)).count() == 0
