"""Queries that must see every row, against brute force over the whole tables."""

import numpy as np
import pytest

from strandgraph.operators import localise, vectors
from strandgraph.plans import registry
from strandgraph.plans.tables import Tables

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def whole(spark, sf):
    t = Tables(spark, sf)
    return sorted(r.node_id for r in t.releases.select("node_id").collect()), sorted((r.src, r.dst) for r in t.dep_edges.collect())


def test_graph_algorithms_take_the_whole_graph(spark, sf, whole):
    nodes, edges = whole
    t = Tables(spark, sf)
    assert sorted(r.node_id for r in t.family.collect()) == nodes
    assert sorted((r.src, r.dst) for r in t.family_edges.collect()) == edges


def test_components_of_the_whole_graph(spark, sf, whole):
    nodes, edges = whole
    up = {i: i for i in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert {r.node_id: r.comp for r in QUERIES["j21_components"](spark, sf).collect()} == {i: root(i) for i in nodes}


def test_pagerank_of_the_whole_graph(spark, sf, whole):
    nodes, edges = whole
    src, dst = (np.searchsorted(nodes, x) for x in zip(*edges))
    want = localise.pagerank(src, dst, len(nodes))
    got = {r.node_id: r.rank for r in QUERIES["j02_pagerank"](spark, sf).collect()}
    assert sorted(got) == nodes and np.allclose([got[i] for i in nodes], want, atol=1e-4)


def test_searches_ask_for_every_50th_point(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    asked = ids % 50 == 0
    d = np.sort(1 - v[asked] @ v.T, axis=1)[:, :10]
    got = {}
    for r in QUERIES["k03_nearest"](spark, sf).collect():
        got.setdefault(r.qid, {})[r.rank] = r.d
    assert sorted(got) == sorted(ids[asked].tolist())
    assert all(np.allclose([got[i][k] for k in range(1, 11)], x, atol=1e-5) for i, x in zip(ids[asked].tolist(), d))


def test_every_cve_is_looked_up(spark, sf):
    sf = sf.replace("0.001", "0.01")  # the smallest tables have too few users
    want = {(r.cve_id, r.node_id) for r in Tables(spark, sf).cve_list.collect()}
    assert {(r.cve_id, r.node_id) for r in QUERIES["d08_nodes_with_cve"](spark, sf).collect()} == want
    events = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'error'")
    assert len(want) == events.count()


def test_index_finds_nine_of_ten_at_its_defaults(spark, sf):
    for d in (sf, sf.replace("0.001", "0.1")):
        row = QUERIES["k03_index_recall"](spark, d).first()
        assert row.n_queries >= 10 and row.recall >= 0.9


def test_probes_are_few_where_vectors_cluster():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = np.repeat(centres, 40, axis=0) + rng.normal(scale=0.02, size=(640, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert vectors.fit_probes(v, centres, 10) == 1
    assert vectors.fit_probes(v[:1], centres, 10) == 16
