"""Lookups by name, version and attribute, masks, depth-wise ranks and committed scores, on small cases and odd ones."""

import pytest
from pyspark.sql import functions as F

from strandgraph.operators import evaluate, lookup
from strandgraph.sources import advisories
from strandgraph.sources.results import Results

def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_values(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node_id long")
    values = spark.createDataFrame([(9, 1, "A"), (3, 1, "B"), (5, 2, "A"), (6, 2, "A"), (7, 3, "B"), (8, None, "A"), (2, 3, None)], "value_id long, owner_id long, type string")
    assert rows(lookup.with_values(nodes, values, has=["A"])) == [(1,), (2,)]
    assert rows(lookup.with_values(nodes, values, has=["A"], lacks=["B"])) == [(2,)]
    assert rows(lookup.with_values(nodes, values, lacks=["A"])) == [(3,), (4,)]
    assert rows(lookup.with_values(nodes, values, has=["A", "B"])) == [(1,)]
    assert lookup.with_values(nodes, values).count() == 4 and lookup.with_values(nodes, values.limit(0), has=["A"]).count() == 0
    assert rows(lookup.first_value_is(nodes, values, "B")) == [(1,)]


def test_packages(spark):
    known = spark.createDataFrame([("b:lib",), ("a:lib",), ("c:Other",), (None,)], "full_name string")
    names = spark.createDataFrame([("LIB",), ("x:lib",), ("none",), ("other",), (None,)], "name string")
    got = {r.name: r.full_name for r in lookup.resolve_packages(names, known).collect()}
    assert got == {"LIB": "a:lib", "x:lib": "x:lib", "none": "none", "other": "c:Other", None: None}
    index = lookup.package_index(spark.createDataFrame([(1, "a:lib"), (2, "B:Lib "), (3, ""), (4, None), (5, "lib")], "node_id long, package string"))
    asked = spark.createDataFrame([("p", "A:LIB"), ("q", "z:lib"), ("r", "nope"), ("s", None)], "q string, package string")
    assert rows(lookup.nodes_of(asked, index)) == [("p", 1, "full"), ("q", 1, "artifact"), ("q", 2, "artifact"), ("q", 5, "artifact")]


def test_versions(spark):
    releases = spark.createDataFrame([("p", 1, "1.0.0"), ("p", 2, "1.2.0"), ("p", 3, "v2.0.0-RC"), ("p", 4, "odd"), ("q", 5, "1.0.0"), ("p", 6, None)], "package string, node_id long, version string")
    asked = spark.createDataFrame(
        [
            ("exact", "p", ["ODD", "8.8.8"], [">=0.0.1"]), ("number", "p", ["2.0.0"], []), ("range", "p", ["7.7.7"], [">=1.1.0,<2.0.0", "<0.1.0"]), ("none", "p", None, [">=9.0.0"]),
            ("all", "q", ["7.7.7"], None), ("both", "p", ["1.0.0", "2.0.0"], []), ("gone", "z", ["1.0.0"], None), ("null", "q", [None], [None]),
        ],
        "q string, package string, versions array<string>, ranges array<string>",
    )
    got = rows(lookup.match_versions(asked.unionByName(asked.limit(1)), releases))
    assert got == [("all", 5, "all"), ("both", 1, "exact"), ("exact", 4, "exact"), ("number", 3, "number"), ("range", 2, "range")]
    assert lookup.match_versions(asked, releases.limit(0)).count() == 0 == lookup.match_versions(asked.limit(0), releases).count()


def test_masks_and_ranks(spark):
    scores = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, None)], "node_id long, score double")
    keep = spark.createDataFrame([(1,), (3,), (4,), (4,)], "node_id long")
    assert rows(evaluate.mask_or_fill(scores, keep, -1.0)) == [(1, 5.0), (2, -1.0), (3, 0.0), (4, 0.0)]
    assert evaluate.mask_or_fill(scores.limit(0), keep).count() == 0
    lists = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y"), ("c", 3, "y"), ("d", 1, "z")], "cve_id string, rank int, node_id string")
    asked = spark.createDataFrame([(1, "c", "y"), (2, "c", "y"), (2, "d", "x"), (2, "e", "x")], "depth_limit int, cve_id string, root string")
    assert rows(evaluate.mrr_by_depth(asked, lists)) == [(1, 1, 0.5), (2, 2, 0.25)]


def test_entries_of_mixed_lists(spark):
    lists = spark.createDataFrame([(1, '[{"name":"cve-1-2","severity":"LOW"},{"id":" 1-3 "},{"severity":"HIGH"},7,null,"x",[1]]'), (2, "no list"), (3, None), (4, "[]"), (5, '{"name":"CVE-9-9"}')], "node_id int, cve_list string")
    assert [r for r in rows(advisories.entries(lists, "node_id")) if r[0] < 5] == [(1, "CVE-1-2", "LOW"), (1, "CVE-1-3", None)]


def test_scores_are_loaded_together(spark, tmp_path):
    kept = Results(spark, f"file://{tmp_path}/scores")
    kept.commit("a", spark.range(3))
    with pytest.raises(KeyError, match="b, c"):
        kept.load_all("a", "b", "c")
    kept.commit("b", spark.range(2).select(F.col("id").alias("x")))
    a, b = kept.load_all("a", "b")
    assert (a.count(), b.columns) == (3, ["x"])
