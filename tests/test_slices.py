"""Searches by slices of their origins, paths back by levels, and what a written table leaves behind."""

import random

from pyspark.sql import functions as F

from strandgraph.operators import graph, paths
from strandgraph.plans import registry
from strandgraph.sources import shared


def test_a_written_table_leaves_no_shuffle(spark):
    files = lambda: spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    made = shared.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert made.count() == 7 and files() <= before + 8  # of the count alone
    assert shared.together(made, made).count() == 7


def test_searches_by_slices_are_whole(spark, monkeypatch):
    """As many origins at a time as asked for; the same rows as all at once, and as plain Python."""
    rng = random.Random(4)
    pairs = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a != b}
    edges = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    start = spark.createDataFrame([(k,) for k in range(0, 60, 4)], "origin bigint")
    asked = spark.createDataFrame([(a, (a * 7 + 3) % 60) for a in range(0, 60, 4)], "a bigint, b bigint")
    want = {}
    for o in range(0, 60, 4):
        level = {o: 0}
        for d in range(1, 5):
            level |= {b: d for a, b in pairs if level.get(a) == d - 1 and b not in level}
        want |= {(o, n): d for n, d in level.items()}
    monkeypatch.setattr(graph, "ORIGINS", 3)
    assert len(list(graph.slices(shared.written(start)))) == 5
    walk = graph.multi_hops(edges, start, 4)
    rows = walk.collect()
    assert {(r.origin, r.node_id): r.depth for r in rows} == want and len(rows) == len(want)
    assert all((r.parent, r.node_id) in pairs and want[r.origin, r.parent] == r.depth - 1 for r in rows if r.depth)
    assert {(r.origin, r.node_id): r.depth for r in graph.shortest_paths(edges, start, 4).collect()} == want
    assert {(r.a, r.b): r.distance for r in graph.hop_distance(edges, asked, 4, "forward").collect()} == {(r.a, r.b): want.get((r.a, r.b)) for r in asked.collect()}
    hits = walk.select("origin", "node_id")
    found = {(r.origin, r.node_id): list(r.path) for r in paths.along(walk, hits).collect()}
    monkeypatch.setattr(paths, "LEVELS", 0)
    assert found == {(r.origin, r.node_id): list(r.path) for r in paths.along(walk, hits).collect()}
    assert all(p[0] == o and p[-1] == n and len(p) == want[o, n] + 1 for (o, n), p in found.items())


def test_siblings_need_no_search_upstream(spark, sf, monkeypatch):
    monkeypatch.setattr(graph, "upstream", None)
    assert registry.queries()["j17_sibling_search"](spark, sf).columns
