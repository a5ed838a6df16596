"""Ranked search against scoring every document, SQL, and odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandgraph.llm import lexical

from ..compare import assert_same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id bigint, text string, terms string, rank string, score string, query string"
ITEMS = "item_id bigint, text string, query string, doc_id string"


def terms(t):
    return TERM.findall((t or "").translate(LOW))


def brute(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        asked, found = Counter(terms(text)), []
        for i, c, n in counted:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, rank, i if there else None, -s) for rank, (s, there, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(docs, items, **how):
    documents, words = lexical.totals(docs)
    return sorted((tuple(r) for r in lexical.search(lexical.index(docs, documents, words), items, documents, **how).collect()), key=str)


@pytest.mark.parametrize("rows, cols, share", [(1, 1, 1.0), (1, 70, 0.6), (90, 1, 0.7), (70, 40, 0.2), (33, 300, 0.05), (600, 16, 1.0)])
def test_treap_holds_each_point_once(rows, cols, share):
    rng = np.random.default_rng(rows * cols)
    r, c = np.nonzero(rng.random((rows, cols)) <= share)
    v = rng.integers(1, 9, len(r))
    depth = max(int(r.max()).bit_length(), int(c.max()).bit_length())
    treap = lexical.Treap.build(r.astype(np.int64), c.astype(np.int64), v)
    cells = lexical.Cells(treap, depth)
    assert sum(treap.sizes) == len(r)
    assert sorted(zip(cells.row.tolist(), cells.col.tolist(), cells.value.tolist())) == sorted(zip(r.tolist(), c.tolist(), v.tolist()))
    for node in range(len(r)):  # a cell's value bounds those of its quarters
        below = int(cells.first[node])
        assert (cells.value[below : below + int(lexical._BITS[cells.mask[node]])] <= cells.value[node]).all()


def test_same_as_sql(spark, sf, duck):
    assert_same(lexical.op12(spark, sf).toPandas(), duck.execute(lexical.OP12_SQL).df())


@pytest.mark.parametrize("seed, group, limit, batch", [(1, 2, 30, 40), (2, 128, 10_000, 1000), (3, 5, 10_000, 7), (4, 128, 200, 333)])
def test_against_scoring_all(spark, monkeypatch, seed, group, limit, batch):
    """Copies, ties over blocks, repeated and clashing rows, odd texts, several slices of queries."""
    monkeypatch.setattr(lexical, "GROUP", group)
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20, 80, 400])))) for k in range(400)]
    docs += [(1000 - k, docs[7][1]) for k in range(60)] + [(k, "Same TEXT w1, w2") for k in range(2000, 2080)]
    docs += [(None, "same text w3"), (None, None), (5000, None), (5001, ""), (5002, "?! {}"), (5003, "é_ñ É w1"), docs[3], docs[3], (5004, "long " * 30_000 + "w9")]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 40])))) for k in range(25)] + [(30, docs[0][1]), (31, "same text"), (32, None), (33, ""), (34, "nowhere"), (35, "É ñ same same"), (36, "long w9"), (None, "w5 w6"), (30, "w1 w1 w1 w2")]
    frame = spark.createDataFrame([(*d, "a", "b", "c", "d") for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*i, "a", "b") for i in [*items, items[0]]], ITEMS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert run(frame, asked, max_words=limit) == brute(docs, items)
        assert run(frame, asked, k=3) == brute(docs, items, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_totals(spark):
    texts = ["a b", "", None, "a", "b", " c", "d ", "é9 x-y", "--", "e" * 50 + " f"]
    docs = spark.createDataFrame([(k, t, "", "", "", "") for k, t in enumerate(texts)], DOCS).coalesce(1)
    want = [len(terms(t)) for t in texts]
    assert lexical.totals(docs) == (sum(n > 0 for n in want), sum(want))


def test_no_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b", "", "", "", "")], DOCS), spark.createDataFrame([(1, "a", "", "")], ITEMS)
    assert run(docs.limit(0), items) == [] and run(docs, items.limit(0)) == [] and run(docs.withColumn("text", docs.text.substr(9, 9)), items) == []
    assert run(docs, items) == brute([(1, "a b")], [(1, "a")])
