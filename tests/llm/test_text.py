"""Kernels, classifiers, decontamination, near-dedup, HTML and chat: brute force, accuracy, and edge cases."""

import collections
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import chat, decontam, html, langid, neardup, quality, textnum, toxicity
from strandgraph.llm.common import bounded_sample, hot_join, labelled_sample

from ..compare import assert_same

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, class_id string"


def words(x):
    return WORD.findall((x or "").translate(LOW))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", "mine") for i, t in texts], DOCS)


def test_word_hashes(monkeypatch):
    texts = ["ab", "cd Ab", "", None, "É9x,é", "a" * 5000 + " b", "x" * 70, "ab!"]
    want = [len(words(t)) for t in texts]
    for segment in (1 << 20, 64):
        monkeypatch.setattr(textnum, "SEGMENT", segment)
        data, off = textnum.views(pa.array(texts))
        h, s, e, w = textnum.words(data, off)
        assert np.diff(w).tolist() == want
        assert h[0] == h[w[1] + 1] == h[w[7]] and len(set(h.tolist())) == len({x for t in texts for x in words(t)})
        assert [data[a:b].tobytes().decode() for a, b in zip(s, e)][:3] == ["ab", "cd", "Ab"]


def test_op9_same_as_sql(spark, sf, duck):
    assert_same(decontam.op9(spark, sf).toPandas(), duck.execute(decontam.OP9_SQL).df())


def test_decontamination_edges(spark):
    item = " ".join(f"w{k}" for k in range(14))
    bench = spark.createDataFrame([(1, item), (2, "Short one"), (3, None), (4, "?!"), (1, item)], "item_id bigint, text string")
    long = " ".join(f"z{k}" for k in range(200_000))
    texts = [(1, f"a {item.upper()} b"), (2, None), (3, ""), (4, "a short ONE, b"), (5, long + " " + item), (5, long + " " + item), (6, " ".join(item.split()[:9])), (7, "short. one" * 2)]
    docs = docs_of(spark, texts)
    for limit in (decontam.SLICE_WORDS, 10):
        got = sorted(tuple(r)[:4] for r in decontam.scan(docs, bench, limit).collect())
        assert got == [(1, 16, 14, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 4, 2, 1), (5, 200_014, 14, 1), (5, 200_014, 14, 1), (6, 9, 0, 0), (7, 3, 0, 0)]
        left = decontam.remove(docs, bench, limit)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 6, 7]
    unnamed = decontam.scan(docs, bench.withColumn("item_id", F.lit(None).cast("bigint"))).filter("doc_id = 1").first()
    assert (unnamed.n_hit, unnamed.n_items, unnamed.contaminated) == (14, 0, True)
    spans = {r.doc_id: r.text for r in decontam.remove(docs, bench, spans=True).collect()}
    assert spans[1] == "a  b" and spans[4] == "a , b" and spans[6] == " ".join(item.split()[:9])
    assert decontam.scan(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.scan(docs.limit(0), bench).count() == 0


def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = collections.Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [("", t or "")]))
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            na, nb = sum(a.values()), sum(b.values())
            if min(na, nb) >= 0.8 * max(na, nb):
                inter = sum((a & b).values())
                if inter >= 0.8 * (na + nb - inter):
                    up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


def test_near_duplicates_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()}
    assert got == brute_classes(texts)


def test_near_duplicate_edges(spark):
    random.seed(4)
    base = [f"w{random.randint(0, 999)}" for _ in range(400)]
    near = [*base[:200], "changed", *base[201:]]
    texts = [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base).upper() + "!"), (13, None), (14, ""), (15, "?!"), (16, "one two"), (17, "One, two"), (18, " ".join(f"q{k}" for k in range(60_000))), (19, "a a a a a a a a a a"), (20, "a " * 10), (10, " ".join(base))]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 13: 13, 14: 13, 15: 15, 16: 16, 17: 16, 18: 18, 19: 19, 20: 19}
    kept = neardup.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [10, 13, 15, 16, 18, 19] and kept.columns == docs.columns
    assert neardup.near_classes(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0
    nulls = docs.filter("doc_id < 12").withColumn("doc_id", F.lit(None).cast("bigint"))
    assert neardup.keep_one(nulls).count() == 1


def test_texts_on_one_template(spark):
    """Pairs at 0.84 among 120 texts that are all at 0.78: every bucket is full of texts that are no near copies."""
    body = [f"t{k}" for k in range(400)]
    texts = {}
    for p in range(60):
        own = [f"p{p}x{k}" for k in range(50)]
        texts[2 * p] = " ".join(body + own)
        texts[2 * p + 1] = " ".join(body + own[:34] + [f"q{p}x{k}" for k in range(16)])
    got = {r.doc_id: r.class_id for r in neardup.near_classes(docs_of(spark, list(texts.items()))).collect()}
    assert got == brute_classes(texts) and len(set(got.values())) == 60


def test_repeated_rows_and_clashing_columns(spark):
    docs = docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "other"), (None, "x y"), (None, "x y")])
    rows = neardup.near_classes(docs).collect()
    assert sorted((r.doc_id or 0, r.n_docs) for r in rows if r.kept) == [(0, 2), (1, 3), (3, 1)]
    docs = docs.withColumn("raw", F.lit(1)).withColumn("kept_id", F.lit(2)).withColumn("__copy", F.lit(3)).withColumn("rid", F.lit(4))
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]


def test_hot_keys_are_split(spark):
    left = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.col("k") + 1)
    got = hot_join(left, right, "k", parts=4, least=10)
    assert got.columns == ["k", "id", "v"] and got.count() == 4000 and got.filter("v <> k + 1").count() == 0


def test_signatures_estimate_weighted_similarity():
    random.seed(9)
    a = [f"t{random.randint(0, 5000)}" for _ in range(3000)]
    b = a[:2000] + [f"u{k}" for k in range(1000)]
    h, _, _, w = textnum.words(*textnum.views(pa.array([" ".join(a), " ".join(b)])))
    cell, off = neardup.cells(h, w)
    s = neardup.signatures(cell, off)
    x, y = set(cell[off[0] : off[1]].tolist()), set(cell[off[1] :].tolist())
    assert (s != 0).all() and abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.15


@pytest.mark.parametrize("text", [None, "", "1234 ?!"])
def test_langid_without_letters(spark, sf, text):
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"), ~langid.held_out())
    row = langid.predict(docs_of(spark, [(1, text)]), model).first()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)


def test_langid_accuracy_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, ~langid.held_out())
    rows = langid.predict(docs, model, [langid.held_out().alias("held_out")]).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.95 and rows.score.between(0, 1).all()
    assert langid.keep_known(docs, model).count() >= 0.98 * docs.count() and langid.keep_known(docs, model).columns == docs.columns
    assert langid.train(docs.limit(0), F.lit(True)) is None and langid.keep_known(docs, None).count() == docs.count()
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_long_texts_score_as_the_whole(spark, monkeypatch, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    lang, tox, qual = langid.train(docs, F.lit(True)), toxicity.train(docs, labels, F.lit(True)), quality.train(docs, labels, F.lit(True))
    texts = [*(r.text for r in docs.select("text").limit(60).collect()), None, ""]
    texts.append(" ".join(t or "" for t in texts) * 20)
    col = pa.array(texts)
    whole = langid.score_texts(lang, col)[1], toxicity.scores(tox, col), quality.scores(qual, col)
    alone = [np.concatenate([f(pa.array([t], pa.string())) for t in texts]) for f in (lambda c: langid.score_texts(lang, c)[1], lambda c: toxicity.scores(tox, c), lambda c: quality.scores(qual, c))]
    for x, y in zip(whole, alone):
        assert np.allclose(x, y, atol=1e-6)
    monkeypatch.setattr(textnum, "SEGMENT", 576)
    pieces = langid.score_texts(lang, col)[1], toxicity.scores(tox, col), quality.scores(qual, col)
    for x, y in zip(whole, pieces):
        assert np.allclose(x, y, atol=1e-6)


def test_training_sample_is_bounded(spark):
    rows = [(None, "same text") for _ in range(50)] + [(1, f"text {k}") for k in range(50)] + [(k, "x" * 5000 + str(k)) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("y", F.lit(1))
    got = bounded_sample(docs, 30, 20_000).collect()
    assert 0 < len(got) <= 30 and sum(len(r.text) for r in got) <= 20_000 and len({r.text for r in got}) == len(got)
    assert bounded_sample(docs.filter("doc_id is null"), 30, 20_000).count() == 1
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id bigint, quality int")
    got = labelled_sample(docs, marks, "quality", F.lit(True), 10, 100_000)
    assert {(r.doc_id, r.quality) for r in got.collect()} <= {(1, 1), (2, 0)} and got.count() <= 20
    assert labelled_sample(docs, marks.limit(0), "quality", F.lit(True), 10, 100).count() == 0


def brute_quality(model, text):
    """The network's forward pass, a byte, a step and a chunk at a time."""
    data = list((text or "").encode())
    n_parts = -(-(len(data) + 8) // 64)
    data += [0] * (n_parts * 64 + 8 - len(data))
    steps = [sum(np.concatenate([model.emb[data[2 * (s + k)]], model.emb[data[2 * (s + k) + 1]]]) @ model.w[k] for k in range(4)) for s in range(n_parts * 32)]
    chunks = []
    for first in range(0, max(1, n_parts - 1), 3):
        chunks.append(np.maximum(np.max(steps[first * 32 : min(first + 4, n_parts) * 32], axis=0) + model.b, 0))
    z = np.mean(chunks, axis=0) @ model.out[:16] + np.max(chunks, axis=0) @ model.out[16:] + model.out_bias
    return 1 / (1 + np.exp(-(z - model.cut + np.log(0.3 / 0.7))))


def brute_language(model, text):
    """Logits of every 3- and 4-gram, one by one."""
    data = (text or "").encode()
    total, n = np.zeros(len(model.langs)), 0
    letter = [int(langid._LETTER[b]) for b in data]
    at = lambda i: letter[i] if 0 <= i < len(letter) else 0
    grams = [langid.grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))] if data else []
    for g3, g4 in zip(*grams[0]) if data else ():
        for g in (g3, g4):
            if g < 1 << langid.BUCKET_BITS:
                total += model.table[g].astype(float)
                n += 1
    counted = sum(bool(at(i)) and bool(at(i - 1) or at(i + 1)) for i in range(len(data))) + sum(bool(at(i) and at(i + 1)) and bool(at(i - 1) or at(i + 2)) for i in range(len(data)))
    assert n == counted
    z = (total / max(n, 1) + model.bias) / model.heat if n else np.zeros(len(model.langs))
    return float(np.exp(z - z.max()).max() / np.exp(z - z.max()).sum())


def brute_toxicity(model, text):
    """Embeddings summed word by word, filters slid over the words, the largest response of each, and the logistic layer."""
    h, w_off = toxicity.features(*textnum.views(pa.array([text or ""])))
    n = h.shape[1]
    x = [sum(model.emb[toxicity.buckets(model.seen, np.array([[v]], np.uint64))[0, 0]] for v in h[:, k]) for k in range(n)] + [np.zeros(toxicity.DIM)] * 2
    feat = []
    for width, part, bias in zip(toxicity.WIDTHS, model.w, model.bias):
        top = np.max([sum(x[k + j] @ part[j] for j in range(width)) for k in range(n)], axis=0) if n else np.zeros(toxicity.FILTERS)
        feat.append(np.maximum(top + bias, 0))
    z = np.concatenate(feat) @ model.out + model.out_bias
    told = np.sum([model.lang[toxicity.buckets(model.seen, np.array([[v]], np.uint64))[0, 0]] for v in h[0]], axis=0) if n else np.zeros(model.lang.shape[1])
    return 1 / (1 + np.exp(-(z - model.cuts[int(np.argmax(told))] + np.log(0.3 / 0.7))))


def test_scores_against_plain_forward_passes(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = [*(r.text[:3000] for r in docs.select("text").limit(12).collect()), None, "", "?", "a b"]
    col = pa.array(texts)
    lang, tox, qual = langid.train(docs, F.lit(True)), toxicity.train(docs, labels, F.lit(True)), quality.train(docs, labels, F.lit(True))
    assert np.allclose(quality.scores(qual, col), [brute_quality(qual, t) for t in texts], atol=1e-5)
    assert np.allclose(langid.score_texts(lang, col)[1], [brute_language(lang, t) for t in texts], atol=1e-5)
    assert np.allclose(toxicity.scores(tox, col), [brute_toxicity(tox, t) for t in texts], atol=1e-4)


def test_toxicity_and_quality(spark, sf):
    docs, labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet"), spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    tox = toxicity.predict(docs, toxicity.train(docs, labels, ~toxicity.held_out()), toxicity.held_out()).join(labels, "doc_id").toPandas()
    assert tox.score.between(0, 1).all() and ((tox.score >= 0.3) == (tox.predicted == 1)).all()
    assert (tox.predicted == tox.toxic).mean() > 0.9
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    good = quality.predict(docs, quality.train(docs, labels, ~held), held).join(labels, "doc_id").toPandas()
    assert (good.predicted == good.quality).mean() > 0.9
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert none is None and toxicity.keep_clean(docs, None).count() == docs.count()
    assert quality.predict(docs.limit(3), None, held).filter("score = 0.5").count() == 3


def test_html_extraction():
    cases = {
        None: "", "": "", "plain": "plain",
        "<nav>m</nav><article><h1>T</h1><p>a <b>b</b>\n c<p>d&amp;e &lt;</article><footer>f</footer>": "T\na b c\nd&e <",
        "<body class=has-sidebar><header>s</header><div class='cookie-notice'>c</div><div id=content><p>x<span class=ad>buy</span> y<div class=comments><p>lol</div></div>": "x y",
        "<p>a < b <i>c</i>d<!-- x": "a < b cd", "<script>x='</p>'</script><p>t<style>p{}</style>u": "tu", "<ul><li>a<li>b</ul>": "a\nb",
        "<form><p>q</form><aside>s</aside><table><tr><td>1<td>2</table>": "1\n2", "<p>a<br>b&nbsp; c": "a b c", "<article>x<section id='reader-comments'>y</section></article>": "x",
    }
    assert {k: html.extract(k) for k in cases} == cases


def brute_tree(pages, rules):
    """Every node of a host's merged tree weighed by loops over its pages; then the pages' texts."""
    parsed = {i: html.parse(h or "", rules) for i, (_, h) in enumerate(pages)}
    out = {}
    for host in {x for x, _ in pages}:
        own = [parsed[i] for i, (x, _) in enumerate(pages) if x == host]
        values, shapes, ups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), {}
        on, shaped = collections.Counter(), collections.Counter()
        for p in own:
            for path, text in set(zip(p.path, p.text)):
                values[path][text] += 1
            for path, up in zip(p.path, p.up):
                ups[path] = max(up, ups.get(path, up))
            for path, shape in set(zip(p.branch, p.shape)):
                shapes[path][shape] += 1
            on.update(set(p.path))
            shaped.update(set(p.branch))
        weighed = {}
        for path, counts in values.items():
            m, total = on[path], sum(counts.values())
            content = 1 - sum(n * np.log(n) for n in counts.values()) / total / np.log(m) if m > 1 else 1.0
            above = shapes[ups[path]]
            k, all_ = shaped[ups[path]], sum(above.values())
            shape = min(1.0, -sum(n / all_ * np.log(n / all_) for n in above.values()) / np.log(k)) if k > 1 else 1.0
            weighed[path] = (html.PRIOR + (m - 1) * (html.GAMMA * content + (1 - html.GAMMA) * shape)) / (html.PRIOR + m - 1)
        low, lowest = (frozenset(p for p, w in weighed.items() if w < bar) for bar in (html.LOW, html.LOWEST))
        for i, (x, h) in enumerate(pages):
            if x == host:
                out[i] = html.extract(h, low, lowest, rules)
    return out


def test_style_tree_against_brute_force(spark):
    random.seed(8)
    some = lambda n: " ".join(random.choice("abcdefgh") + str(random.randint(0, 99)) for _ in range(n))
    pages = []
    for k in range(60):
        menu = f"<div class=a><p>Welcome to our site</p><p>item {k % 3}</p></div>"
        body = f"<div class=b><p>unique {k} text</p><p>{some(5)}</p></div>" if k % 2 else f"<div class=b><h2>{some(2)}</h2><p>{some(4)}</p></div><div class=c>see also</div>"
        pages.append(("h.com" if k < 45 else "other.com" if k < 50 else "third.com", menu + body if k < 45 else f"<article><p>copied</p><div>note</div><p>{some(3)}</p></article>"))
    pages += [("", None), ("", ""), ("h.com", "<div>" * 30_000 + "deep")]
    rows = spark.createDataFrame([(k, f"http://{x}/{k}" if x else None, h) for k, (x, h) in enumerate(pages)], "page_id bigint, url string, html string")
    for rules in (True, False):
        got = {r.page_id: (r.text, r.n_chars) for r in html.texts(rows, rules).collect()}
        assert got == {i: (t, len(t)) for i, t in brute_tree(pages, rules).items()}
        assert "Welcome" not in got[1][0] and "unique 1 text" in got[1][0] and got[62][0] == "deep"
    assert html.texts(rows.limit(0)).count() == 0


def test_tool_calls(spark):
    calls = [(1, 0, "a", "f", '{"x": 1.0, "b": [true]}', []), (1, 0, "b", "f", '{"x": 2}', ["a"]), (1, 0, "c", "f", '{"x": "no"}', ["d"]), (1, 0, "d", "f", "oops", ["c"]), (1, 2, "e", "g", "{}", ["zz", "b"]), (1, 1, "a", "f", "{}", []), (None, 0, "q", "f", "{}", []), (1, 0, "h", "f", '{"x": 3}', ["e"])]
    results = [(1, 1, "a", "late"), (1, 0, "a", "first"), (1, 0, "zzz", "orphan"), (1, 1, "e", "before its call"), (1, 3, "b", None)]
    c = spark.createDataFrame(calls, "conv bigint, turn bigint, call string, name string, arguments string, uses array<string>").withColumn("json", F.lit(0))
    r = spark.createDataFrame(results, "conv bigint, turn bigint, call string, content string")
    tools = {"f": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}}, "required": ["x"]}}
    rows = chat.link(c, r, tools).collect()
    got = {(x.call, x.status): x for x in rows}
    assert len(rows) == 9 and got["a", "linked"].valid and got["b", "linked"].level == 1 and got["a", "duplicate"].position is None
    assert got["a", "linked"].json == '{"arguments":{"b":[true],"x":1},"conversation":1,"id":"a","name":"f","result":{"content":"first","turn":0},"turn":0,"uses":[]}'
    assert "uses itself in a circle" in got["c", "open"].errors and "$.x: not integer" in got["c", "open"].errors and "arguments are no JSON" in got["d", "open"].errors
    assert set(got["e", "open"].errors) == {"uses unknown call zz", "unknown tool g"} and got["h", "open"].errors == ["uses later call e"]
    assert ("zzz", "orphan") in got and ("q", "unlinked") in got
    assert sorted(x.position for x in rows if x.position) == [1, 2, 3, 4, 5, 6]
    assert got["a", "linked"].position < got["b", "linked"].position
    assert chat.link(c.limit(0), r.limit(0), tools).count() == 0


def test_odd_json_is_an_error(spark):
    odd = ["[" * 200_000, '{"x": ' * 900 + "1" + "}" * 900, '{"x": "\\ud800"}', '{"\\udfff": 1}', '{"x": ' + "9" * 400 + "}", '{"x": ' + "9" * 5000 + "}", '{"x": 1e400}', "NaN"]
    c = spark.createDataFrame([(1, k, f"c{k}", "f", x, []) for k, x in enumerate(odd)], "conv bigint, turn bigint, call string, name string, arguments string, uses array<string>")
    r = spark.createDataFrame([(1, k, f"c{k}", "done") for k in range(len(odd))], "conv bigint, turn bigint, call string, content string")
    got = {x.call: x for x in chat.link(c, r, {"f": {"properties": {"x": {"type": ["integer", "string"]}}, "type": "object"}}).collect()}
    assert len(got) == len(odd) and got["c0"].errors == ["arguments nest too deeply"] and not got["c5"].valid and not got["c6"].valid and not got["c7"].valid
    assert got["c2"].valid and got["c4"].valid and json.loads(got["c2"].json)["arguments"] == {"x": "\ud800"}


def test_op4_against_brute_force(spark, sf):
    got = {(r.conv, r.turn): r for r in chat.op4(spark, sf).collect()}
    rows = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    users = {k for k, r in rows.items() if r.role == "user"}
    assert set(got) == users
    for (conv, turn), r in got.items():
        back = rows.get((conv, turn + 1))
        line = json.loads(r.json)
        assert line["arguments"] == {"prompt": rows[conv, turn].text, "turn": turn} and r.valid == (r.status == "linked")
        assert (line.get("result") or {}).get("content") == (back.text if back is not None and back.role == "assistant" else None)


def test_op4_keeps_system_and_other_turns(spark, sf, tmp_path):
    told = {(r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").filter("role = 'system'").collect()}
    held = [(r.conv, x["turn"], x["text"]) for r in chat.op4(spark, sf).collect() for x in json.loads(r.json).get("system", [])]
    assert told and sorted(held) == sorted(told)
    far = chat.TURNS_A_PIECE * 2 + 5
    turns = [(1, 0, "system", "s0"), (1, 1, "system", "s1"), (1, 2, "user", "u"), (1, 3, "assistant", "a"), (1, 4, "system", "s4"), (1, far, "user", "v"), (1, far + 1, "system", "end"), (2, 0, "system", "alone"), (3, 0, None, "n"), (3, 1, "critic", "c"), (None, 0, "system", "lost")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = chat.op4(spark, str(tmp_path)).collect()
    line = {(r.conv, r.turn): json.loads(r.json) for r in rows}
    assert len(rows) == 7 and [x["text"] for x in line[1, 2]["system"]] == ["s0", "s1"] and [x["text"] for x in line[1, far]["system"]] == ["s4"]
    assert {(k, v["role"], v["text"]) for k, v in line.items() if "role" in v} == {((1, far + 1), "system", "end"), ((2, 0), "system", "alone"), ((3, 0), None, "n"), ((3, 1), "critic", "c"), ((None, 0), "system", "lost")}


def test_long_chains_of_calls_in_one_message(spark):
    calls = [(1, 0, f"c{k:02d}", "f", "{}", [f"c{k - 1:02d}"] if k else []) for k in range(20)]
    c = spark.createDataFrame(calls, "conv bigint, turn bigint, call string, name string, arguments string, uses array<string>")
    r = spark.createDataFrame([(1, 1, x[2], "done") for x in calls], "conv bigint, turn bigint, call string, content string")
    assert [(x.call, x.level, x.position, x.valid) for x in chat.link(c, r, {"f": {}}).orderBy("call").collect()] == [(x[2], k, k + 1, True) for k, x in enumerate(calls)]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, sf)
        assert seen.columns == docs.columns
    assert corpus_pipeline.run(spark, sf).count() > 0.5 * docs.count()
