"""Root-cause analysis, advisory records, ground truth and fusion on small tables."""

import json

import numpy as np

from strandgraph.operators import evaluate, ground_truth, localise
from strandgraph.sources import advisories


def _case(spark):
    # of query 0 two triangles joined by nothing, a node alone, and a node outside the window; of query 1 one node
    hits = spark.createDataFrame([(0, i, i / 10) for i in (1, 2, 3, 4, 5, 6, 7, 8)] + [(50, 4, 0.5)], "qid long, node_id long, distance double")
    nodes = spark.createDataFrame([(i, 1000 + i) for i in range(1, 8)] + [(8, 9000)], "node_id long, ts long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (8, 1), (9, 1)], "src long, dst long")
    return hits, nodes, edges


def test_root_causes_of_two_communities(spark):
    hits, nodes, edges = _case(spark)
    scores = spark.createDataFrame([(5, 9.5), (6, 2.0), (1, 1.0), (8, 99.0)], "node_id long, score double")
    rows = localise.root_causes(hits, nodes, edges, scores, 8, 0, 5000).collect()
    got = {r.node_id: r for r in rows if r.qid == 0}
    assert {i: r.comm for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: None}
    # earliness is of milliseconds: the first community starts 3 earlier, the second has 10.5 more of CVE scores
    assert [i for i in sorted(got, key=lambda i: got[i].rank)] == [5, 6, 4, 8, 1, 2, 3, 7]
    assert [i for i, r in got.items() if r.in_root] == [i for i in got if i in (4, 5, 6)]
    # the leading vector of two equal triangles beside a node alone
    assert np.allclose([got[i].cent for i in range(1, 8)], [6**-0.5] * 6 + [0.0], atol=1e-4)
    assert [(r.node_id, r.rank, r.in_root) for r in rows if r.qid == 50] == [(4, 1, True)]


def test_root_causes_without_rows_in_the_window_take_all(spark):
    hits, nodes, edges = _case(spark)
    scores = spark.createDataFrame([], "node_id long, score double")
    rows = localise.root_causes(hits, nodes, edges, scores, 8, 1, 2).collect()
    assert len(rows) == 9 and all(r.comm is not None for r in rows)
    assert localise.root_causes(hits.limit(0), nodes, edges, scores, 8).count() == 0


def test_records_of_odd_containers(spark):
    texts = [("osv", "not json"), ("OSV", "{}"), ("nvd", '{"vulnerabilities": [{"cve": {}}]}'), ("osv", None), ("osv", json.dumps({"id": "A"})), ("nvd", json.dumps({"vulnerabilities": [{"cve": {"id": "B"}}, {"cve": {"id": "C"}}]}))]
    rows = {r.id: r for r in advisories.records(spark.createDataFrame(texts, "source string, data string")).collect()}
    assert sorted(rows) == ["A", "B", "C"]
    assert all(r.references == [] and r.packages == [] and r.fix_commits == [] and r.severity.base_score is None for r in rows.values())


def test_spans_pair_each_introduction_with_the_fix_before_the_next(spark):
    events = [{"introduced": "0"}, {"introduced": "1.0.0"}, {"fixed": "1.1.0"}, {"fixed": "1.2.0"}, {"introduced": "2.0.0"}]
    data = {"id": "CVE-2", "affected": [{"package": {"name": "x"}, "ranges": [{"type": "SEMVER", "events": events}]}]}
    got = advisories.osv_spans(spark.createDataFrame([(json.dumps(data),), ("{}",)], "data string")).collect()
    assert {(r.cve_id, r.package, r.introduced, r.fixed) for r in got} == {("CVE-2", "x", "0", None), ("CVE-2", "x", "1.0.0", "1.1.0"), ("CVE-2", "x", "2.0.0", None)}


def test_entries_need_a_version_of_discovery(spark):
    spans = spark.createDataFrame([("C1", "g:a-core", "SEMVER", "0", None), ("C1", "g:b", "SEMVER", "1.0.0", None), ("C1", "g:b", "SEMVER", "1.0.0", "1.5.0"), ("C2", "a", "GIT", "1.0.0", "1.1.0"), ("C3", "a", None, "abcdef0123456789abcd", None)], "cve_id string, package string, kind string, introduced string, fixed string")
    releases = spark.createDataFrame([("a", 1, 0, "1.0.0"), ("a", 2, 86_400_000, "1.1.0")], "package string, node_id long, ts long, version string")
    got = {(r.cve_id, r.origin_version, r.discovered_version, r.time_lag_days, len(r.version_sequence)) for r in ground_truth.entries_from_spans(spans, releases).collect()}
    assert got == {("C1", "a@1.0.0", "a@1.1.0", 1.0, 2), ("C1", "b@1.0.0", "b@1.5.0", 0.0, 0)}


def test_fusion_and_purity(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    comm = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node_id long, comm long")
    got = evaluate.fused(nodes, spark.createDataFrame([(1, 4), (3, 2)], "node_id long, n long"), comm, spark.createDataFrame([(1, 5.0)], "comm long, score double"))
    assert {r.node_id: round(r.score, 6) for r in got.collect()} == {1: 1.0, 2: 0.4, 3: 0.3}
    edges = spark.createDataFrame([(1, 2), (3, 1), (1, 9)], "src long, dst long")
    got = {r.root: (r.purity, round(r.coverage, 6)) for r in evaluate.purity(comm, edges, nodes).collect()}
    assert got == {1: (0.5, round(1 / 3, 6)), 2: (0.5, 1.0), 3: (0.0, 0.0)}
