from __future__ import annotations

import corpus_pipeline
import pytest
from brute import documents, encoded, exact, near, ordered
from test_mixing import assert_mix

from treelake.llm import mixing, toxicity
from treelake.llm.common import stored, table


def test_each_stage_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    (_, reject), (_, first), (_, distinct), (_, mix), (_, encode) = corpus_pipeline.STAGES

    clean = stored(reject(spark, docs, sf_dir), "t-clean")
    kept = {r["doc_id"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).filter("predicted = 0").collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == kept

    unique = stored(first(spark, clean, sf_dir), "t-unique")
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    assert unique.columns == docs.columns
    assert ordered((r["doc_id"],) for r in unique.collect()) == ordered((r[0],) for r in exact(rows) if r[3])

    apart = stored(distinct(spark, unique, sf_dir), "t-apart")
    rows = [(r["doc_id"], r["text"]) for r in unique.collect()]
    assert apart.columns == docs.columns
    assert ordered((r["doc_id"],) for r in apart.collect()) == ordered((r[0],) for r in near(rows) if r[0] == r[2])

    mixed = stored(mix(spark, apart, sf_dir), "t-mixed")
    plan = mixing.mix(apart).collect()
    assert mixed.columns == docs.columns
    assert_mix([(r["doc_id"], r["text"], r["source"]) for r in apart.collect()], plan)
    assert ordered((r["doc_id"],) for r in mixed.collect()) == ordered((r["doc_id"],) for r in plan for _ in range(r["times"]))

    out = encode(spark, mixed, sf_dir).collect()
    assert ordered(out) == ordered(encoded([(r["doc_id"], r["text"]) for r in mixed.collect()]))
    assert ordered(out) == ordered(corpus_pipeline.run(spark, sf_dir).collect())


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows_and_empty_tables(spark, sf_dir, empty):
    docs = documents(spark, []) if empty else documents(spark).unionByName(documents(spark, [(20, None, "en", None), (None, "y", "en", "a"), (None, "unrelated text of its own", None, "b")]))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf_dir), "t-odd")
        if name != "bpe":
            assert docs.columns == before.columns
            assert empty or name == "mixing" or docs.exceptAll(before).isEmpty()
    found = [r["doc_id"] for r in docs.collect()]
    assert (found == []) == empty
    if not empty:
        assert set(found) <= {None, *range(1, 13), 20} and None in found
