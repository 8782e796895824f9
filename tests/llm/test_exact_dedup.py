from __future__ import annotations

from brute import documents, exact, ordered

from treelake.llm import exact_dedup
from treelake.llm.queries import QUERIES, SQL


def test_query_equals_its_sql(compared):
    compared(QUERIES["op9_exact_dedup"], SQL["op9_exact_dedup"])


def test_odd_rows(spark):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for options in ({}, {"memtable_rows": 2}, {"digest_chars": 1}):
        assert ordered(exact_dedup.exact_dedup(df, **options).collect()) == ordered(exact(rows))
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_equal_digests_of_different_texts_are_split(spark):
    rows = [(i, f"text {i % 40}", "en", "a") for i in range(200)]
    found = exact_dedup.exact_dedup(documents(spark, rows), digest_chars=1).collect()
    assert ordered(found) == ordered(exact([(r[0], r[1]) for r in rows]))


def test_keep_first(spark):
    df = documents(spark)
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    wanted = sorted({(r[0], r[4]) for r in exact([(r["doc_id"], r["text"]) for r in df.collect()]) if r[3]}, key=repr)
    assert len(kept.collect()) == len(wanted)
    assert ordered((r["doc_id"],) for r in kept.collect()) == ordered((i,) for i, _ in wanted)


def test_runs_of_batches_merge(spark):
    rows = [(i, f"d{i % 7}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, digest string")
    whole = exact_dedup.build_index(df, 3).collect()
    parts = exact_dedup.compact([exact_dedup.build_index(df.filter("doc_id < 20"), 3), exact_dedup.build_index(df.filter("doc_id >= 20"), 3)])
    assert ordered(whole) == ordered(parts.collect()) == ordered((f"d{k}", k, len(range(k, 50, 7))) for k in range(7))
