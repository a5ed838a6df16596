"""Cases that earlier rounds got wrong."""

import json
import time

import pytest
from pyspark.sql import functions as F

from strandgraph.llm import chat, decontam, html, langid, mixing, urlfilter
from strandgraph.llm.common import bounded_sample

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("limit", [decontam.SLICE_WORDS, 10])
def test_spans_of_items_that_overlap(spark, limit):
    """Cut once after all slices: no slice sees, or leaves, what another one has cut."""
    text = "a " + " ".join(f"w{k}" for k in range(16)) + " b"
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(10))), (2, " ".join(f"w{k}" for k in range(4, 14))), (3, "a w14 w15 b")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "clean", "x")], "doc_id bigint, text string, hit string")
    left = decontam.remove(docs, bench, limit, spans=True)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.hit) for r in left.collect())) == [(1, "a  w14 w15 b", "x"), (2, None, "x"), (3, "clean", "x")]


def test_names_never_lose_an_article():
    cases = {
        '<div class="layout with-sidebar"><div class="content"><p>Body': "Body",
        '<article><h2 class="related-work">RW</h2><p>a</p><section class="discussion"><p>D</p></section>': "RW\na\nD",
        '<article><div class="social-science"><p>Paper': "Paper",
        '<h1 class="post-title">T</h1><div class="text"><p>Body</p></div>': "T\nBody",
        "<main><h1>Title</h1><p>Lead</p><article><p>Art</p></article></main>": "Title\nLead\nArt",
        '<div class="sidebar"><article><p>In</p></article><p>out</p></div>': "In",
        '<div class="comments"><article><p>Reader</p></article></div><p>own</p>': "own",
        '<article><p>a</p><div class="ad-box">x</div><div class="share-buttons">y</div><div class="newsletter-signup">z</div><div class="comment-list">r</div><aside>s</aside></article>': "a",
        '<div class="main-nav">m</div><div id="cookie_notice">c</div><div class="has-ads"><p>t</p></div>': "t",
    }
    assert {k: html.extract(k) for k in cases} == cases


def test_open_cells_and_paragraphs_stay_linear():
    took = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        assert html.extract("<p><td>" + "<div>" * n + "x") == "x"
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_mixing_with_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 4 + 1), "s" if k % 3 else "t") for k in range(60)], "doc_id bigint, text string, source string")
    plain = sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "mix_copy", "mix_block", "mix_position").collect())
    clash = docs.select("*", *(F.lit("own").alias(c) for c in ("m_raw", "m_doc", "m_source", "_m_raw", "raw", "block")))
    out = mixing.mix(clash)
    assert out.columns[: len(clash.columns)] == clash.columns
    assert sorted(tuple(r) for r in out.select("doc_id", "mix_copy", "mix_block", "mix_position").collect()) == plain and out.filter("m_raw <> 'own'").count() == 0


def test_samples(spark):
    rows = [(f"text number {k}" + "." * 10, "a") for k in range(200)] + [("x" * 30_000, "a")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = [r.text for r in bounded_sample(docs, 1000, 20_000).collect()]
    assert sorted(got) == sorted(t for t, _ in rows[:200])
    rare = spark.createDataFrame([(f"le mot {k}", "fr") for k in range(3)] + [(f"the word {k} of it", "en") for k in range(5000)], "text string, lang string")
    by = bounded_sample(rare, langid.MAX_ROWS, langid.MAX_BYTES, F.col("lang")).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in by}["fr"] == 3 and {r["lang"]: r["count"] for r in by}["en"] <= langid.MAX_ROWS


def test_hosts(spark):
    urls = {"https://a@b@c.com/": "c.com", "http://[::1]:80/x": "[::1]", "http://u:p@h.org:8/@x": "h.org", "http://x.com/a@b.com": "x.com", "HTTP://X.Com.": "x.com", "http://[::1": None, "http:///": None, "ftp://a.b": None, None: None, "http://a.b?@c.d": "a.b"}
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.host for r in rows.select("url", urlfilter.host(F.col("url")).alias("host")).collect()} == urls


def test_entries_far_apart(spark):
    """Against each capture's own search; entries twenty years before a capture make no row a day."""
    entries = [(d, f"{y}-0{m}-0{k} 10:00:00", a) for d, y, a in (("x.com", 2004, "block"), ("y.x.com", 2010, "allow"), ("z.org", 2023, "block")) for m in (1, 2) for k in (3, 4)]
    entries += [("x.com", "2024-01-05 08:00:00", "allow"), ("x.com", "2024-01-05 09:00:00", "block"), ("x.com", "2024-01-05 09:00:00", "allow"), ("com", "2024-03-01 00:00:00", "block"), (None, "2024-01-01 00:00:00", "block"), ("z.org", None, "allow")]
    captures = [(k, f"http://{h}/", t) for k, (h, t) in enumerate((h, t) for h in ("x.com", "y.x.com", "q.y.x.com", "z.org", "w.com", "nothing") for t in ("2003-01-01 00:00:00", "2010-01-03 10:00:00", "2024-01-05 08:30:00", "2024-01-05 09:00:00", "2024-01-05 23:00:00", "2024-03-02 00:00:00", None))]
    e = spark.createDataFrame(entries, "domain string, ts string, action string").withColumn("day", F.lit("own"))
    c = spark.createDataFrame(captures, "capture_id bigint, url string, fetched string").withColumn("level", F.lit("own"))
    got = {r.capture_id: (r.matched_domain, r.verdict) for r in urlfilter.judge(c, e).collect()}
    want = {}
    for k, url, at in captures:
        host, found = url[7:-1], (None, "keep")
        parts = host.split(".")
        for name in [".".join(parts[i:]) for i in range(len(parts))]:
            own = [(t, a) for d, t, a in entries if d == name and t is not None and at is not None and t <= at]
            if own:
                found = (name, "block" if max(own)[1] == "block" else "keep")
                break
        want[k] = found
    assert got == want
    asked = spark.createDataFrame([("x.com", "2024-06-01")], "domain string, day string").withColumn("day", F.to_date("day"))
    assert urlfilter.intervals(e, asked).count() < 40


def test_conversation_with_tools(spark, tmp_path):
    call = json.dumps({"tool_calls": [{"id": "ca-1", "name": "search", "arguments": '{"q": 1}', "uses": []}]})
    turns = [(1, 0, "user", "find it"), (1, 1, "assistant", call), (1, 2, "tool", json.dumps({"tool_call_id": "ca-1", "content": "found"})), (1, 3, "assistant", "here it is"), (1, 4, "user", "thanks"), (1, 5, "assistant", "welcome"), (1, 6, "user", "more"), (1, 7, "assistant", "yes")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r.call: r for r in chat.op4(spark, str(tmp_path)).collect()}
    assert rows["ca-1"].valid and rows["ca-1"].status == "linked" and not rows["ca-1"].errors
    assert not any(r.errors for r in rows.values() if r.call)
    assert json.loads(rows["c1-6"].json)["uses"] == ["c1-4"] and rows["c1-4"].status == "linked" and rows["c1-0"].status == "open"
