"""Every stage of the pipeline, row by row, against plain Python or SQL on the rows that the stage before it kept."""

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from strandgraph.llm import decontam, langid, mixing, textnum, toxicity

from ..compare import assert_same
from .test_text import brute_classes, brute_language, brute_toxicity


def rows_of(df):
    return {r.doc_id: tuple(r) for r in df.collect()}


def kept_by_language(docs):
    """Texts with a letter that score at the floor or over; a score at the floor's edge is left to the model."""
    model = langid.train(docs, ~langid.held_out())
    out, edge = set(), set()
    for r in docs.collect():
        letter = bool(r.text) and pc.match_substring_regex(pa.array([r.text]), r"\p{L}")[0].as_py()
        score = brute_language(model, r.text)
        if abs(score - model.floor) < 1e-6:
            edge.add(r.doc_id)
        if letter and score >= model.floor:
            out.add(r.doc_id)
    return out, edge


def kept_by_toxicity(docs, labels):
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    scores = {r.doc_id: brute_toxicity(model, r.text) for r in docs.collect()}
    return {i for i, s in scores.items() if s < toxicity.THRESHOLD}, {i for i, s in scores.items() if abs(s - toxicity.THRESHOLD) < 1e-5}


def over(docs, sf, sql):
    """SQL on docs as `documents`."""
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    return con.execute(sql).df()


def test_stage_by_stage(spark, sf):
    import corpus_pipeline

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "toxicity", "near_dedup", "decontamination", "mixing"]

    def check(name, before, want, edge=frozenset()):
        """The stage keeps the wanted rows, unchanged and with their columns."""
        got = corpus_pipeline.materialize(stages[name](spark, before, sf), name)
        had, have = rows_of(before), rows_of(got)
        assert got.count() == len(have) and got.columns == docs.columns
        assert set(have) - edge == want - edge, name
        assert all(had[i] == have[i] for i in have)
        return got

    known = check("language_id", docs, *kept_by_language(docs))
    clean = check("toxicity", known, *kept_by_toxicity(known, labels))
    classes = brute_classes({r.doc_id: r.text for r in clean.collect()})
    single = check("near_dedup", clean, set(classes.values()))
    assert len(classes) > single.count()
    found = over(single, sf, decontam.OP9_SQL)
    free = check("decontamination", single, set(found[~found.contaminated].doc_id))
    assert free.count() < single.count()
    mixed = stages["mixing"](spark, free, sf)
    columns = ["doc_id", "source", *(F.col(f"mix_{x}").alias(x) for x in ("copy", "block", "position"))]
    want = over(free, sf, mixing.OP2_SQL)
    assert_same(mixed.select(*columns).toPandas(), want[["doc_id", "source", "copy", "block", "position"]])
    had = rows_of(free)
    assert all(had[r.doc_id] == tuple(r) for r in mixed.select(*docs.columns).distinct().collect())
    run = corpus_pipeline.run(spark, sf)
    assert_same(run.select("doc_id", "mix_copy", "mix_block", "mix_position").toPandas(), mixed.select("doc_id", "mix_copy", "mix_block", "mix_position").toPandas())


def test_training_reads_blocks(spark, sf, monkeypatch):
    """A model doesn't depend on the blocks in which its sample's words are hashed."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").filter("text IS NOT NULL")
    data, off = textnum.views(pa.array([r.text for r in docs.limit(40).collect()] + ["", "one", ""]))
    whole = toxicity.indexed(data, off)
    monkeypatch.setattr(textnum.row_blocks, "__defaults__", (500,))
    parts = toxicity.indexed(data, off)
    assert all((a == b).all() and a.shape == b.shape for a, b in zip(whole, parts))
    hashes, word_off = toxicity.features(data, off)
    assert (word_off == whole[2]).all() and hashes.shape == whole[1].shape and (toxicity.buckets(whole[0], hashes) == whole[1]).all()
