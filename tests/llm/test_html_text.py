from __future__ import annotations

import numpy as np
import pyarrow as pa

from treelake.llm import html_text
from treelake.llm.queries import QUERIES

MENU = "<nav><ul><li><a href=/>Home</a><li>News</ul></nav>"


def test_query_gives_every_page(spark, sf_dir):
    rows = QUERIES["op8_html_text"](spark, sf_dir).collect()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert sorted((r["page_id"], r["url"]) for r in rows) == sorted((p["page_id"], p["url"]) for p in pages)
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"][:1] for r in rows)
    assert all(r["text"] for r in rows)


def text(html: str) -> str:
    return html_text.read_page(html).text()


def test_marked_articles():
    page = f"<html><head><title>T</title><style>p {{}}</style></head><body>{MENU}<article><h1>A &amp; B</h1><p>one\n  two<b>three</b> <br>four</p><script>x</script><div class='share-bar'>Share</div><p>&#233;&nbsp;x</p></article><footer>f</footer></body></html>"
    assert text(page) == "A & B\n\none twothree four\n\né x"
    assert text("<main><p>x</p><aside>no</aside><section id=comments><p>c</p></section></main>") == "x"
    assert text("<article><p>a < b and <!-- no --> c<p>d</article><p>after") == "a < b and c\n\nd"
    assert text("<div class=cookie-notice>c</div><div class='post-content'><p>yes</p><form><input>no</form></div>") == "yes"


def test_left_out_end_tags_end_dropped_elements():
    assert text("<article><p class=ad>x<p>y</article>") == "y"
    assert text("<article><p class=notice>x<h2>y</h2>z<ul><li class=share>s<li>t</ul>u</article>") == "y\n\nz\n\nt\n\nu"
    assert text("<article><table><tr><td class=ad>a<td>b<tr class=promo><td>c<tr><td>d</table>e</article>") == "b\n\nd\n\ne"
    assert text("<article><dl><dt class=ad>a<dd>b<dd class=ad>c</dl>d<div><span class=ad>x</div>y</article>") == "b\n\nd\n\ny"
    assert text("<article><div class=ad><ul><li>x<li>y</ul>z<p>p</div>kept <b>bold<p>more</b> text</article>") == "kept bold\n\nmore text"
    assert text("<article><ul><li class=ad>x<ul><li>inner</ul>still ad<li>y</ul><p>z</article><p>after") == "y\n\nz"
    assert text("<head><title>t</title><article><p>x</article>") == "x"


def test_inline_parts_and_headlines():
    assert text("<article><p>Hello <span class='share'>Share this</span> world</p></article>") == "Hello world"
    assert text("<article><p>a <button>press</button><span hidden>no</span> b</p></article>") == "a b"
    assert text("<article><div class='entry-header'><h1>Title</h1></div><p>x</p></article>") == "Title\n\nx"
    assert text("<div class='site-header'>s</div><main><div class=header><h1>T</h1></div>x<div class=footer>f</div></main>") == "T\n\nx"


def brute_text(rows):
    """page_id to text of rows (page_id, url, html), run by run."""
    read = {(html_text.host_of(u), h or ""): html_text.read_page(h or "") for _, u, h in rows}
    out = {}
    for page_id, url, h in rows:
        host, me = html_text.host_of(url), read[html_text.host_of(url), h or ""]
        others = [p for (o, _), p in read.items() if o == host]
        runs = []
        for p in others:
            tokens = [(w, i) for t, i in p.blocks for w in [*t.split(), None]]
            spans = [tokens[k : k + 8] for k in range(len(tokens) - 7)]
            runs.append(({tuple(w for w, _ in x) for x in spans}, {tuple(w for w, _ in x) for x in spans if all(i for _, i in x)}))
        tokens = [(w, i) for t, i in me.blocks for w in [*t.split(), None]]
        gone = set()
        for k in range(len(tokens) - 7):
            run, inside = tuple(w for w, _ in tokens[k : k + 8]), all(i for _, i in tokens[k : k + 8])
            if me.marked and inside and sum(run in a for _, a in runs) >= max(4, sum(p.marked for p in others) / 2) or not me.marked and sum(run in a for a, _ in runs) > 1:
                gone.update(range(k, k + 8))
        at, kept = 0, []
        for t, i in me.blocks:
            n = len(t.split())
            if (i or not me.marked) and not gone.issuperset(range(at, at + n)):
                kept.append(t)
            at += n + 1
        out.setdefault(page_id, set()).add("\n\n".join(kept))
    return out


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    wanted = brute_text(rows)
    for most in (html_text.HOST_TOKENS, 100):
        assert all(r["text"] in wanted[r["page_id"]] for r in html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), most).collect())


def test_random_hosts_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(1, 14))) for _ in range(14)]
    notice = "We use this notice on every page of the whole site for all readers"
    rows = []
    for i in range(60):
        some = "".join(f"<p>{lines[j]}</p>" for j in rng.integers(0, 14, 5)) + f"<p>own words {i} of page {i} are here {i}</p>"
        body = f"<article>{some}<p>{notice}</p></article><div>{lines[0]}</div>" if rng.random() < 0.6 else f"<div>{some}</div>{notice}"
        rows.append((i, f"http://h{i % 5}/{i}", f"<nav>menu</nav>{body}"))
    rows += [(100, "http://h0/x", rows[1][2]), (101, "http://h1/y", rows[1][2]), (102, "http://h2/z", None)]
    wanted = brute_text(rows)
    for most in (html_text.HOST_TOKENS, 10):
        found = {r["page_id"]: {r["text"]} for r in html_text.main_text(pages(spark, rows), most).collect()}
        assert found == wanted
    assert not any(notice in t for i, ts in wanted.items() for t in ts if i < 60)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' AS key", "'h' AS host", "'t' AS tokens", "'c' AS covered", "'x' AS text")


def test_shared_runs_of_a_host_go(spark):
    shell = "All rights reserved by the owners of this very site since long ago"
    rows = [(i, f"https://h.example/{i}", f"<body><p>{shell}</p><p>Unique words of page number {i} stand here alone {i * 7}</p></body>") for i in range(6)]
    for most in (html_text.HOST_TOKENS, 10):
        found = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows), most).collect()}
        assert found == {i: f"Unique words of page number {i} stand here alone {i * 7}" for i in range(6)}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "<p>x</p>"), (3, "no url", "<p>x</p>"), (None, "http://a/b", "plain text"), (4, "http://a/c", "<article>" + "<p>long words</p>" * 20_000 + "</article>"), (5, "http://a/d", "<<<>>> & &bogus; </p></div>"), (6, "http://a/e", "<article><p>unclosed")]
    found = html_text.main_text(pages(spark, rows)).collect()
    by = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and by[1] == by[2] == "" and by[3] == "x" and by[None] == "plain text" and by[6] == "unclosed"
    assert by[4].count("\n\n") == 19_999
    assert html_text.main_text(pages(spark, [])).count() == 0


def test_sizes_of_blocks_come_with_the_blocks():
    """Pages are counted without their words being cut into tokens; the tokens have these sizes."""
    pages = ["<article><p>one  two<p>a&nbsp;b\tc</article><p>out side", "", None, "<p>x"]
    given = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["http://h/a"] * 4), pa.array(list("abcd")), pa.array(pages)], ["page_id", "url", "key", "html"])
    (blocks,) = html_text.block_rows(iter([given]))
    assert blocks["sizes"].to_pylist() == [[3, 4, -3], [], [], [-2]]
    (streams,) = html_text.stream_rows(iter([blocks.select(["host", "key", "marked", "sizes", "blocks"])]))
    assert [[i for i, t in enumerate(x) if t == 0] for x in streams["tokens"].to_pylist()] == [[2, 6, 9], [], [], [1]]
    assert streams["sizes"].to_pylist() == blocks["sizes"].to_pylist()
