"""Fingerprints, mixing and URL filters: brute force, SQL, and edge cases."""

import collections
import hashlib
import unicodedata

from pyspark.sql import functions as F

from strandgraph.llm import fingerprint, mixing, urlfilter

from ..compare import assert_same

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def canon(x):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x or "").casefold()).split())


def test_fingerprints_of_edge_cases(spark):
    texts = ["É x", "é  X ", None, "", "ﬁ①", "fi1", "a" * 300_000, "a" * 300_000 + "b", " a b c", "A b C"]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, fp int")
    rows = {r.doc_id: r for r in fingerprint.fingerprints(df.select("doc_id", "text")).collect()}
    groups = collections.defaultdict(set)
    for i, t in enumerate(texts):
        groups[rows[i or None].fingerprint].add(canon(t))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({canon(t) for t in texts})
    assert rows[3].n_same == 2
    assert fingerprint.fingerprints(df.limit(0)).count() == 0


def test_canonical_form_is_stable(spark):
    """Of every character of the basic plane, between letters: the canonical form of a canonical form is itself, and case is
    folded as Python folds it."""
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(i, f"a{ch}b") for i, ch in enumerate(chars)], "i int, text string")
    rows = df.withColumn("once", fingerprint.canonical(F.col("text"))).withColumn("twice", fingerprint.canonical(F.col("once")))
    assert rows.filter("once <> twice").count() == 0
    old = {ch for ch in chars if unicodedata.category(ch) != "Cn"}
    got = {chars[r.i]: r.once for r in rows.collect()}
    assert all(got[ch] == canon(f"a{ch}b") for ch in old)


def test_op1_against_brute_force(spark, sf):
    got = fingerprint.op1(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    after = [*docs.text[1:], docs.text[0]]
    want = {}
    for i, x, y in zip(docs.doc_id, docs.text, after):
        n = len(x)
        e = x[: n - n // 3] + y[: n // 3]
        want[i] = (n, hashlib.sha256(e.encode()).hexdigest(), float(canon(x) == canon(e)), float(canon(x) == canon(y)))
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got.itertuples()} == want


def test_next_of_ties_nulls_and_one_row(spark):
    rows = spark.createDataFrame([(5, "a"), (5, "b"), (None, "n"), (900, "z"), (-3, "m")], "doc_id bigint, fp string")
    got = {(r.doc_id, r.fp): r.next_fp for r in fingerprint.with_next(rows, ["fp"]).collect()}
    assert got == {(900, "z"): "b", (5, "b"): "a", (5, "a"): "m", (-3, "m"): "n", (None, "n"): "z"}
    assert [r.next_fp for r in fingerprint.with_next(rows.limit(0).union(spark.createDataFrame([(1, "x")], rows.schema)), ["fp"]).collect()] == ["x"]


def test_clashing_digests_are_told_apart(spark):
    rows = spark.createDataFrame([("f", "x", "1"), ("f", "y", "2"), ("g", "z", "3")], "fp string, canon string, sha string")
    bad = fingerprint.clashes(rows.select("fp", "canon"))
    assert {r.out for r in fingerprint.settled(rows, bad, {"out": ("fp", "sha")}).collect()} == {"f1", "f2", "g"}


def test_op2_same_as_sql(spark, sf, duck):
    assert_same(mixing.op2(spark, sf).toPandas(), duck.execute(mixing.OP2_SQL).df())


def test_mixing_quotas_blocks_and_edges(spark):
    rows = [(i, "w " * (1 + i % 5), "x", "big" if i % 10 else None, 0) for i in range(2000)] + [(None, None, "x", "big", 0), (7, "w " * 3, "x", "big", 0), (9000, "", None, "tiny", 0), (9001, "w", None, "tiny", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mix_block", F.lit("taken"))
    out = mixing.mix(docs, entropy=0.5, max_repeat=3.0, block_tokens=500)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_copy", "mix_block", "mix_position"]
    got = out.withColumn("n", F.coalesce(F.regexp_count("text", F.lit("w")), F.lit(0))).toPandas()
    weight = {r.source: (r.quota, r.tokens) for r in mixing.weights(mixing.units(docs).select("source", "n_tokens"), entropy=0.5, max_repeat=3.0).collect()}
    for source, part in got.groupby(got.source.fillna("-")):
        quota, tokens = weight[None if source == "-" else source]
        assert quota <= part.n.sum() <= quota + 6 and part.mix_copy.max() <= quota / tokens
    assert weight["tiny"][0] <= 3.0 * weight["tiny"][1] + 1
    full = got[got.mix_block < got.mix_block.max()].groupby("mix_block").n.sum()
    assert ((full > 400) & (full < 600)).all()
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.filter("text is null")).count() == 0


def test_op5_same_as_sql(spark, sf, duck):
    assert_same(urlfilter.op5(spark, sf).toPandas(), duck.execute(urlfilter.OP5_SQL).df())


def test_judging_edges(spark):
    ts = lambda c: F.to_timestamp(c)
    entries = spark.createDataFrame([("Bad.com.", "2024-01-02", "block"), ("bad.com", "2024-03-01", "allow"), ("bad.com", "2024-03-01", "block"), ("ok.bad.com", "2024-01-10", "ALLOW"), (None, "2024-01-01", "block"), ("x.org", None, "block"), ("y.org", "2024-01-01", "odd")], "domain string, ts string, action string").withColumn("ts", ts("ts"))
    asked = [(1, "http://www.BAD.com:80/a?b", "2024-01-01"), (2, "https://user@www.bad.com./", "2024-01-02"), (3, "http://a.ok.bad.com#x", "2024-02-01"), (4, "http://a.ok.bad.com", "2024-01-05"), (5, None, "2024-05-01"), (6, "no url", "2024-05-01"), (7, "http://bad.com", None), (8, "http://bad.com", "2024-04-01"), (9, "http://notbad.com", "2024-04-01"), (2, "https://user@www.bad.com./", "2024-01-02"), (10, "http://y.org", "2024-02-01")]
    captures = spark.createDataFrame(asked, "capture_id bigint, url string, fetched string").withColumn("fetched", ts("fetched"))
    got = sorted((r.capture_id, r.verdict) for r in urlfilter.judge(captures, entries).collect())
    assert got == sorted([(1, "keep"), (2, "block"), (2, "block"), (3, "keep"), (4, "block"), (5, "keep"), (6, "keep"), (7, "keep"), (8, "block"), (9, "keep"), (10, "keep")])
    assert urlfilter.judge(captures, entries.limit(0)).filter("verdict = 'block'").count() == 0
    assert urlfilter.judge(captures.limit(0), entries).count() == 0


def test_op5_takes_every_event(spark, sf, tmp_path):
    """Several events a user and day: each capture against the last one at or before its fetch, of the nearest domain that has one."""
    rows = [(user, f"2024-01-{day:02d} {hour:02d}:00:00", kind) for user in range(150) for day in range(1, 31) for hour, kind in ((3 + user % 4, "click"), (12, "view"), (21, "error" if (user + day) % 2 else "view"))]
    made = spark.createDataFrame(rows, "user_id bigint, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    made.write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{sf}/pages.parquet").write.parquet(f"{tmp_path}/pages.parquet")
    events = made.toPandas()
    found = urlfilter.op5(spark, str(tmp_path)).toPandas()
    hosts = {h for h in found.host if isinstance(h, str)}
    names = {".".join(h.split(".")[k:]) for h in hosts for k in range(h.count(".") + 1)}
    history = {}
    names = {n for n in names if "." in n}
    for name in names:
        own = events[events.user_id % len(names) == int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % len(names)]
        at = collections.defaultdict(set)
        for ts, kind in zip(own.ts, own.event_type):
            at[ts].add("block" if kind in ("error", "click") else "allow")
        history[name] = sorted((ts, max(actions)) for ts, actions in at.items())
    for r in found.itertuples():
        want, parts = (None, None, "keep"), r.host.split(".") if isinstance(r.host, str) else []
        for k in range(len(parts)):
            name = ".".join(parts[k:])
            past = [x for x in history.get(name, ()) if x[0] <= r.fetched]
            if past:
                want = (name, past[-1][0], "block" if past[-1][1] == "block" else "keep")
                break
        got = (r.matched_domain if isinstance(r.matched_domain, str) else None, None if r.entry_ts != r.entry_ts else r.entry_ts, r.verdict)
        assert got == want
