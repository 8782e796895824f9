from __future__ import annotations

from treelake.llm import chat
from treelake.llm.queries import QUERIES, SQL


def test_query_equals_its_sql(compared):
    compared(QUERIES["op1_chat"], SQL["op1_chat"])


def talks(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def said(df):
    return {r["conv_id"]: (r["n_turns"], r["n_copies"], r["text"]) for r in df.collect()}


def test_snapshots_collapse_into_the_longest(spark):
    rows = [(1, 0, "user", "a")] + [(2, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("bot", "b")])] + [(3, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("bot", "b"), ("user", "c")])]
    rows += [(4, 0, "user", "other"), (5, 0, "user", "other"), (6, 0, "bot", "a")]
    found = said(chat.chat_format(talks(spark, rows)))
    assert set(found) == {3, 4, 6}
    assert found[3] == (3, 1, "<|user|>\na<|end|>\n<|bot|>\nb<|end|>\n<|user|>\nc<|end|>\n")
    assert found[4][1] == 2


def test_odd_rows(spark):
    rows = [(None, 0, "user", "null id"), (1, None, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (2, 1, "b", "tie"), (2, 1, "a", "tie"), (3, 0, "u", "long " * 50_000)]
    df = talks(spark, rows)
    df = df.selectExpr("*", "1 AS conv", "2 AS place", "'x' AS piece", "'y' AS digest", "0 AS part")
    found = said(chat.chat_format(df))
    assert found[None][2] == "<|user|>\nnull id<|end|>\n"
    assert found[1][0] == 2 and found[1][2].startswith("<||>\n<|end|>\n")
    assert found[2][2] == "<|a|>\ntie<|end|>\n<|b|>\ntie<|end|>\n"
    assert len(found[3][2]) > 250_000
    assert chat.chat_format(talks(spark, [])).count() == 0


def test_long_conversations_come_in_parts(spark):
    df = talks(spark, [(1, i, "user", str(i)) for i in range(200)] + [(2, i, "user", str(i)) for i in range(150)])
    rows = chat.chat_format(df).orderBy("part").collect()
    assert [(r["conv_id"], r["part"], r["n_turns"]) for r in rows] == [(1, p, 200) for p in range(4)]
    assert "".join(r["text"] for r in rows) == "".join(f"<|user|>\n{i}<|end|>\n" for i in range(200))
