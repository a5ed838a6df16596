"""Toxicity learns from every labelled row, however many there are and wherever they lie."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandgraph.llm import textnum, toxicity
from strandgraph.llm.common import discard, labelled_parts


def test_every_labelled_row_is_learned_from(spark):
    """More texts of a class, and a longer one, than a bounded sample would take: all their words are known and counted."""
    rows = [(k, f"plain words about item{k} here", "en" if k % 2 else "fr", 0) for k in range(1700)] + [(k, f"you awful fool number{k}", "en", 1) for k in range(1700, 1760)]
    rows += [(1760, "long words of a story " * 90_000 + "thelastword", "en", 0)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    data, off = textnum.views(pa.array([r[1] for r in rows]))
    hashes, word_off = toxicity.features(data, off)
    ids = toxicity.buckets(model.seen, hashes[:1])[0]
    assert (ids < 1 << toxicity.BUCKET_BITS).all()
    counts = np.ones(((1 << toxicity.BUCKET_BITS) + 1, 2))
    np.add.at(counts, (ids, np.repeat([int(r[2] == "fr") for r in rows], np.diff(word_off))), 1)
    want = np.log(counts / counts.sum(axis=0))
    assert np.allclose(model.lang[:-1], (want - want.mean(axis=1, keepdims=True))[:-1], atol=1e-5)
    got = toxicity.scores(model, pa.array([r[1] for r in rows])) >= toxicity.THRESHOLD
    assert (got == [r[3] == 1 for r in rows]).all()


def test_parts_hold_every_marked_row(spark):
    docs = [(k % 50 if k % 7 else None, f"text {k}" if k % 11 else None, "en") for k in range(300)]
    marks = [(k, v) for k in range(0, 50, 3) for v in (0, int(k % 2))] + [(4, None), (None, 1), (999, 1), (5, 1)]
    eligible = F.col("doc_id") % 5 != 0
    got = labelled_parts(spark.createDataFrame(docs, "doc_id int, text string, lang string"), spark.createDataFrame(marks, "doc_id bigint, toxic int"), "toxic", eligible, 4)
    best = {}
    for i, v in marks:
        if i is not None and v is not None and i % 5:
            best[i] = max(v, best.get(i, 0))
    want = [(t, x, best[i]) for i, t, x in docs if i in best]
    key = lambda r: (r[0] or "", r[1], r[2])
    assert sorted((tuple(r) for r in got.select("text", "lang", "toxic").collect()), key=key) == sorted(want, key=key)
    assert got.select("part").distinct().count() > 1
    discard(got)


def test_model_does_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 16)
    monkeypatch.setattr(toxicity, "MOST_ROUNDS", 5)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    one = toxicity.train(docs.coalesce(1), labels.repartition(3), F.lit(True))
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        two = toxicity.train(docs.repartition(7), labels, F.lit(True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    assert (one.emb == two.emb).all() and (one.lang == two.lang).all() and (one.seen == two.seen).all() and (one.out == two.out).all()
    assert np.allclose(one.cuts, two.cuts, atol=2 / toxicity.STEPS)


def test_threshold_of_best_f1():
    rng = np.random.default_rng(1)
    for _ in range(20):
        z = np.sort(rng.choice(200, 30, replace=False) / 10)
        n = rng.integers(1, 5, 30)
        ones = rng.binomial(n, z / 25)
        cut = toxicity.cut(z, n, ones)
        f1 = lambda c: 2 * ones[z >= c].sum() / (n[z >= c].sum() + ones.sum())
        assert cut not in z and np.isclose(f1(cut), max(f1(c) for c in z))
