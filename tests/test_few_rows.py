"""Joins that must not make rows for every pair: results against plain Python, and the rows that the widest step makes."""

import random

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import aggregate, evaluate, localise
from strandgraph.sources import lookups


def ran(df) -> tuple[list, int]:
    """The rows of df, and how many its widest step gave out."""
    rows, widest, plans = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        elif kind != "ReusedExchangeExec":
            made = plan.metrics().get("numOutputRows")
            widest = max(widest, made.get().value() if made.isDefined() else 0)
            plans += [plan.children().apply(k) for k in range(plan.children().size())]
    return rows, widest


def test_lookups_of_a_busy_key(spark):
    """Many lookups and questions of one key in one hour."""
    stored = spark.range(3000).select(F.lit("k").alias("key"), (F.col("id") * 1000).alias("at"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("payload"))
    asked = spark.range(3000).select(F.lit("k").alias("key"), (F.col("id") * 1000 + 500).alias("asked_at"))
    rows, widest = ran(lookups.as_of(asked, stored))
    assert {(r.asked_at, r.found_at, r.payload) for r in rows} == {(k * 1000 + 500, k * 1000, str(k) if k % 3 else None) for k in range(3000)}
    assert widest <= 20_000


def test_nearest_of_many_events(spark):
    """Many events and queries in one window; and against plain Python over several."""
    events, queries = spark.range(3000).select((F.col("id") * 10).alias("event_id"), (F.col("id") * 7).alias("t")), spark.range(3000).select(F.col("id").alias("qid"), (F.col("id") * 7 + 2).alias("t"))
    rows, widest = ran(localise.nearest(queries, events, 60_000))
    assert {(r.qid, r.event_id) for r in rows} == {(k, k * 10) for k in range(3000)}
    assert widest <= 20_000
    rng = random.Random(3)
    at = [(k, rng.choice([None, -rng.randrange(50), rng.randrange(400)])) for k in range(120)]
    ask = [(k, rng.choice([None, rng.randrange(-80, 460)])) for k in range(200)]
    for within in (5, 40):
        near = {q: min(((abs(t - x), e) for e, x in at if x is not None and t is not None and abs(t - x) <= within), default=None) for q, t in ask}
        got = localise.nearest(spark.createDataFrame(ask, "qid bigint, t bigint"), spark.createDataFrame(at, "event_id bigint, t bigint"), within)
        assert {r.qid: r.event_id for r in got.collect()} == {q: m[1] for q, m in near.items() if m}


def test_pairs_of_sets_that_share_one_common_item(spark):
    """Item 0 is in every set, the others in few: no pair is made for it."""
    sets = {o: {0, o + 1, o + 10_000, o // 2 + 20_000} for o in range(600)}
    df = spark.createDataFrame([(o, i) for o, s in sets.items() for i in s], "owner bigint, item bigint")
    rows, widest = ran(aggregate.jaccard_pairs(df, 0.3))
    assert {(r.a, r.b) for r in rows} == {(o, o + 1) for o in range(0, 600, 2)}
    assert widest <= 20_000


@pytest.mark.parametrize("least", [0.1, 0.5, 0.75])
def test_overlapping_is_whole(spark, least):
    """Small sets, sets of one item, and some beyond the bound to which pairs of items are keys."""
    rng = random.Random(5)
    sets = {o: set(rng.sample(range(12 if o < 60 else 60), rng.choice([1, 1, 2, 3, 5, 8] if o < 60 else [30, 33, 45, 58]))) for o in range(90)}
    other = {o: {i for i in s if i % 5 or len(s) < 2} for o, s in sets.items()}
    make = lambda of: spark.createDataFrame([(o, i) for o, s in of.items() for i in s], "owner bigint, item bigint")
    want = {(a, b) for a in sets for b in other if other[b] and len(sets[a] & other[b]) / len(sets[a] | other[b]) >= least}
    got = [(r.a, r.b) for r in aggregate.overlapping(make(sets), make(other), least).collect()]
    assert len(got) == len(want) and set(got) == want


def test_path_f1_makes_no_pair_for_a_common_node(spark):
    """All paths share a node; a found path is a known one without its last node."""
    known = [(0, p, n) for p in range(500) for n in (-1, p, p + 1000, p + 2000)]
    found = [r for r in known if r[2] < 2000]
    make = lambda rows: spark.createDataFrame(rows, "group bigint, path_id bigint, node_id bigint")
    rows, widest = ran(evaluate.path_f1(make(known), make(found)))
    assert rows[0].f1 == pytest.approx(1.0)
    assert widest <= 20_000
