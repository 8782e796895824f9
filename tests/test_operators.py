"""Operators on small tables: golden values, invariants and plain versions."""

from __future__ import annotations

import contextlib
import io
import random
import tracemalloc

import pytest

from treelake.functions import text
from treelake.operators import trees


def slow_cuts(data: bytes, least: int, average: int, most: int) -> list[int]:
    cuts, last = [], 0
    while last < len(data):
        x, cut = 0, min(last + most, len(data))
        for i in range(last + least - 32, cut):
            x = (x << 1 ^ data[i]) & 0xFFFFFFFF
            signed = x - (1 << 32) if x >> 31 else x
            wrapped = (signed - (2**31 - 1) + 2**31) % 2**32 - 2**31
            if i + 1 >= last + least and abs(wrapped) < (2**32 - 1) // average:
                cut = i + 1
                break
        cuts.append(cut)
        last = cut
    return cuts


@pytest.mark.parametrize("sizes", [(32, 64, 128), (64, 100, 1000), (256, 1024, 4096)])
def test_cut_points(sizes):
    rng = random.Random(1)
    for n in (0, 1, 31, 32, 33, 500, 20_000):
        for data in (rng.randbytes(n), b"\0" * n, b"ab" * (n // 2)):
            assert trees.cut_points(data, *sizes) == slow_cuts(data, *sizes)


def test_cut_points_of_slices(monkeypatch):
    """A large file is looked through slice by slice, with the same cuts."""
    data = random.Random(2).randbytes(9_000_000)
    tracemalloc.start()
    found = trees.cut_points(data, 256, 1024, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000
    monkeypatch.setattr(trees, "SLICE", len(data))
    assert trees.cut_points(data, 256, 1024, 4096) == found
    monkeypatch.setattr(trees, "SLICE", 7)
    assert trees.cut_points(data[:3000], 64, 100, 1000) == slow_cuts(data[:3000], 64, 100, 1000)


def test_files_go_to_python_in_small_parts(spark):
    found = trees.content_chunks(spark.createDataFrame([("x", bytearray(b"abc")), ("y", None)], "path string, content binary"), 256, 1024, 4096)
    assert [r["path"] for r in found.collect()] == ["x"]
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        found.explain()
    assert "InPandas" not in plan.getvalue() and plan.getvalue().count("BatchEvalPython") == 1


def test_balanced_takes_the_heaviest_until_light(spark):
    rows = [("g", "a", 50), ("g", "b", 30), ("g", "c", 5), ("h", "x", 10)]
    found = trees.balanced(spark.createDataFrame(rows, "group string, name string, weight long"), 40, 10)
    assert sorted(map(tuple, found.collect())) == [("g", "a", 50)]


def slow_balance(dirs, limit, least):
    """The plain version: post-order, the heaviest child first while the directory is too heavy."""
    entries = {p: (1 if mount else n) for p, _, n, mount in dirs}
    mounts = {p for p, _, _, mount in dirs if mount}
    chosen, kids = {}, {p: [c for c, parent, _, _ in dirs if parent == p] for p in entries}

    def weight(path):
        left = {c: weight(c) for c in kids[path]}
        total = entries[path] + sum(left.values())
        for c in sorted((c for c in left if c not in mounts), key=lambda c: (-left[c], c)):
            if total <= limit or left[c] < least:
                break
            chosen[c], total = left[c], total - left[c] + 1
        return total

    if dirs:
        weight("")
    return chosen


def test_balanced_tree_equals_post_order(spark):
    rng = random.Random(5)
    schema = "path string, parent string, entries long, mount boolean"
    for limit, least in ((30, 5), (60, 20)):
        dirs = [("", None, 3, False)]
        for i in range(60):
            above = rng.choice([d for d in dirs if not d[3]])[0]
            dirs.append((f"{above}/d{i}", above, rng.randint(1, 25), rng.random() < 0.1))
        found = trees.balanced_tree(spark.createDataFrame(dirs, schema), limit, least).collect()
        assert {r["path"]: r["weight"] for r in found} == slow_balance(dirs, limit, least) != {}
    assert trees.balanced_tree(spark.createDataFrame([], schema), 30, 5).isEmpty()


def test_content_chunk_query_equals_a_plain_version(spark, sf_dir):
    import hashlib

    from treelake import plans

    found = sorted(map(tuple, plans.queries()["st_chunk_cdc"](spark, sf_dir).select("path", "off", "size", "hash").collect()))
    wanted = []
    for doc_id, content in spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as string)", "cast(text as binary)").collect():
        start = 0
        for end in slow_cuts(bytes(content), 256, 1024, 4096):
            wanted.append((doc_id, start, end - start, hashlib.sha1(content[start:end]).hexdigest()))
            start = end
    assert found == sorted(wanted) and found


def test_links_are_expanded(spark):
    rows = [("plain",), ("$(A)",), ("x$(B:-d)y",), ("$(open",), ("",)]
    df = spark.createDataFrame(rows, "l string").selectExpr("l", "map('A', 'v') AS m")
    found = [r[0] for r in df.select(text.expanded(df["l"], df["m"])).collect()]
    assert found == ["plain", "v", "xdy", "$(open", ""]


def counting(spark, rows, schema):
    """Rows whose derivation is counted, and the counter."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    name = schema.split()[0]
    return spark.createDataFrame(rows, schema).withColumn(name, F.udf(count, "string", useArrow=False).asNondeterministic()(name)), seen


def test_history_derives_the_revisions_once(spark):
    rows = [(f"h{i}", f"h{i - 1}" if i else None, i) for i in range(12)]
    revisions, seen = counting(spark, rows, "hash string, previous string, mtime long")
    found = trees.history(spark.createDataFrame([("h11",), ("h8",)], "hash string"), revisions, 6, 3)
    # h8 is a head, so it is reached at age 0; the first below the time limit is itself visited
    wanted = {"h11": 0, "h8": 0, "h10": 1, "h7": 1, "h9": 2, "h6": 2, "h5": 3, "h4": 4, "h3": 5, "h2": 6}
    assert {r["hash"]: r["age"] for r in found.collect()} == wanted
    assert seen.value == len(rows)


def test_chains_have_no_longest_length(spark):
    """A long chain, one that meets it, one that ends at a missing revision, a cycle, a revision twice, and what no head reaches."""
    rows = [(f"h{i}", f"h{i - 1}" if i else None) for i in range(260)] + [("m1", "m0"), ("m0", "h40"), ("lost", "gone"), ("single", None), ("self", "self")]
    rows += [("c0", "c1"), ("c1", "c2"), ("c2", "c0"), ("twice", "h7"), ("twice", "single"), ("aside", "h9"), ("ring0", "ring1"), ("ring1", "ring0")]
    heads = ["h258", "m1", "lost", "self", "c1", "twice", "twice", "unknown", None]
    reached, ahead = set(), list(heads)
    while ahead:
        if (at := ahead.pop()) not in reached:
            reached.add(at)
            ahead += [previous for node, previous in rows if node == at and previous]
    revisions, seen = counting(spark, rows, "hash string, previous string")
    found = trees.chain(spark.createDataFrame([(h,) for h in heads], "hash string"), revisions)
    assert sorted(r["hash"] for r in found.collect()) == sorted(node for node, _ in rows if node in reached)
    assert seen.value == len(rows)
    none = trees.chain(spark.createDataFrame([], "hash string"), spark.createDataFrame(rows, "hash string, previous string"))
    assert none.columns == ["hash"] and none.isEmpty()


def test_chains_of_all_customers_are_whole(spark, tmp_path):
    """More than a hundred orders of a customer, customers of any number, one order alone, orders before 1970 and without a time."""
    import duckdb

    from treelake import plans

    folder = tmp_path / "orders.parquet"
    orders = [(i, 3 if i < 150 else 70, "F", 10.0 + i, f"19{60 + i // 8:02}-01-{i % 28 + 1:02} 00:00:00", "5-LOW") for i in range(280)]
    orders += [(280, 5, "O", 1.0, "1995-05-05 00:00:00", "5-LOW"), (281, 6, "O", 1.0, None, "5-LOW"), (282, 6, "O", 1.0, "1995-05-06 00:00:00", "5-LOW"), (283, None, "O", 1.0, "1995-05-07 00:00:00", "5-LOW")]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    spark.createDataFrame(orders, schema).selectExpr("* except (o_orderdate)", "cast(o_orderdate as timestamp) AS o_orderdate").write.parquet(str(folder))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    found = sorted(map(tuple, plans.queries()["gr_chain"](spark, str(tmp_path)).collect()))
    assert found == sorted(duck.execute(plans.oracle_sql()["gr_chain"]).fetchall())
    assert len(found) == len(orders)


def test_balancing_derives_the_directories_once(spark):
    rows = [("", None, 1, False)] + [(f"/a{i}", "", 5, False) for i in range(4)] + [(f"/a{i}/b{k}", f"/a{i}", 10 + k, False) for i in range(4) for k in range(3)]
    dirs, seen = counting(spark, rows, "path string, parent string, entries long, mount boolean")
    assert sorted(map(tuple, trees.balanced_tree(dirs, 30, 5).collect())) == sorted(slow_balance(rows, 30, 5).items())
    assert seen.value == len(rows)


def test_recorders_over_slices_of_a_user(spark):
    """The newest bin so far goes from slice to slice: one user, late ticks, users of null."""
    from treelake.operators import states

    rng = random.Random(3)
    rows = [(e, e // 3 + rng.choice([0, 0, 40, -25]), rng.choice([1, 1, 1, 2, None])) for e in rng.sample(range(-50, 900), 600)]
    newest, wanted = {}, {}
    for _, t, user in sorted(rows):
        newest[user] = max(newest.get(user, t // 5), t // 5)
        if newest[user] - t // 5 < 4:
            wanted[user, t // 5] = wanted.get((user, t // 5), 0) + 1
    rows = [(e, t + 1000, user) for e, t, user in rows]
    ticks = spark.createDataFrame(rows, "event_id long, t long, user_id long")
    for width in (7, 100_000):
        found = states.recorded(ticks, 5, 20, width)
        assert {(r["user_id"], r["bin"] - 200): r["n"] for r in found.collect()} == wanted
        last = {u: sum(n for (v, b), n in wanted.items() if v == u and newest[u] - b < 2) for u in (1, 2)}
        assert {r["user_id"]: r["n"] for r in states.looked_back(ticks, [(5, 20)], 10, width).collect()} == last
