"""Committed results, lookups that expire and substring joins, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import substrings
from strandgraph.sources import lookups
from strandgraph.sources.results import Results


def test_results_are_seen_when_committed(spark, tmp_path):
    kept = Results(spark, f"file://{tmp_path}/results")
    assert kept.listed().count() == 0 and kept.prune() == 0
    with pytest.raises(KeyError):
        kept.load("a b/ä")
    one = spark.range(5)
    assert kept.commit("a b/ä", one) == 1 and kept.commit("other", one.limit(0)) == 1
    assert kept.load("a b/ä").count() == 5 and kept.load("other").count() == 0
    # a write that breaks half way: rows written, nothing committed
    bad = spark.range(100).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))
    with pytest.raises(Exception, match="broken"):
        kept.commit("a b/ä", bad)
    assert kept.load("a b/ä").count() == 5 and kept.listed().count() == 2
    assert kept.commit("a b/ä", spark.range(7)) == 2 and kept.load("a b/ä").count() == 7 and kept.load("a b/ä", 1).count() == 5
    assert kept.prune() == 1 and kept.load("a b/ä", 1).count() == 5
    # a commit that lost the race for its version leaves no entry
    entry = next((tmp_path / "results/manifest").glob("*-2.json"))
    entry.rename(entry.with_name(entry.name.replace("-2.json", "-3.json")))
    with pytest.raises(Exception, match="exist"):
        kept.commit("a b/ä", spark.range(9))
    assert kept.listed().count() == 3
    # a table that has lost rows since isn't given out
    data = tmp_path / "results" / kept.listed().filter("name = 'a b/ä' AND version = 1").first().data
    next(data.glob("part-*")).unlink()
    with pytest.raises(ValueError, match="were committed"):
        kept.load("a b/ä", 1)


def test_lookups_hold_for_a_while(spark):
    rng = random.Random(6)
    hour = 3_600_000
    rows = [(rng.choice("abc"), rng.randrange(80 * hour), rng.choice([None, "x", "y"])) for _ in range(120)] + [("a", 5 * hour, None), ("a", 5 * hour, "z"), ("d", 100 * hour, None), (None, 1, "n"), ("e", None, "n")]
    asked = [(k, rng.choice("abcd"), rng.randrange(130 * hour)) for k in range(200)] + [(900, "d", 100 * hour + 299_999), (901, "d", 100 * hour + 300_000), (902, None, 5), (903, "a", None), (904, "a", -5)]
    asked += [(1000 + k, r[0], r[1]) for k, r in enumerate(rows[:30])]
    stored = lookups.merged(spark.createDataFrame(rows[:70], "key string, at bigint, payload string"), spark.createDataFrame(rows[60:], "key string, at bigint, payload string"))
    best = {}
    for k, at, p in rows:
        if k is not None and at is not None:
            best[k, at] = max(best.get((k, at)) or "", p or "") or None
    assert {(r.key, r.at): r.payload for r in stored.collect()} == best
    assert {r.key: (r.at, r.payload) for r in lookups.latest(stored).collect()} == {k: max((at, p) for (x, at), p in best.items() if x == k) for k in "abcd"}
    want = {}
    for i, key, at in asked:
        last = max(((x, p) for (k, x), p in best.items() if k == key and at is not None and x <= at), default=None, key=lambda x: x[0])
        fresh = last is not None and at < last[0] + (5 * 60_000 if last[1] is None else 24 * hour)
        want[i] = ("stale", None) if not fresh else ("miss", None) if last[1] is None else ("hit", last[1])
    got = lookups.as_of(spark.createDataFrame(asked, "i bigint, key string, asked_at bigint"), stored)
    assert {r.i: (r.state, r.payload) for r in got.collect()} == want


def test_substring_joins(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    keys = [word(rng.randrange(0, 7)) for _ in range(60)] + [None, "", "a", "zz", "abab", "😀x", "aaaa"]
    texts = [word(rng.randrange(0, 12)) for _ in range(80)] + [None, "", "aaaaaaaa", "x😀x😀", "abababab"]
    k, t = spark.createDataFrame([(x,) for x in keys], "key string"), spark.createDataFrame([(x,) for x in texts], "text string")
    want = {(a, b) for a in keys if a for b in texts if b and a in b}
    rows = [tuple(r) for r in substrings.contained(k, t).collect()]
    assert set(rows) == want and len(rows) == len(want)
    both = {(a, b) for a in keys if a for b in texts if b and (a in b or b in a)}
    rows = [tuple(r) for r in substrings.either_way(k.withColumnRenamed("key", "a"), t.withColumnRenamed("text", "b")).collect()]
    assert set(rows) == both and len(rows) == len(both)
    found = {r.name: (r.key, r.how) for r in substrings.resolve(t.withColumnRenamed("text", "name"), k).collect()}
    known = {x for x in keys if x}
    assert found == {x: (x, "equal") if x in known else (min(y for y in known if y in x or x in y), "part") for x in texts if x and (x in known or any(y in x or x in y for y in known))}
    assert substrings.contained(k.limit(0), t).count() == 0 and substrings.contained(k, t.limit(0)).count() == 0
