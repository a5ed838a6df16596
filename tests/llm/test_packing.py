"""Packing: every id in exactly one piece, sequences gapless and full, whatever the input."""

import zlib
from collections import defaultdict

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandgraph.llm import packing

DOCS = "doc_id bigint, text string, ids string, start string, sealed string, task string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, tokenizer, size, padded=1):
    """texts: (doc_id, text) of every row, doc_ids unique."""
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        got = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))]
        assert sum(r.length for r in got) == len(ids) and {r.doc_tokens for r in got} == {len(ids)}
        for r in got:
            assert r.length > 0 and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
    short = 0
    for found in sequences.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(x.length for x in found[:k]) for k in range(len(found))]
        short += sum(r.length for r in found) < size
        assert sum(r.length for r in found) <= size
    assert short <= padded


def digests(pieces):
    return pieces.withColumn("ids_crc32", F.crc32("ids")).collect()


def test_whole_table(spark, sf, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = packing.op13(spark, sf)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(found.collect(), texts, tokenizer, 2048)


def test_many_partitions_and_rounds(spark, tokenizer):
    texts = [(k, " ".join(f"word{j}" for j in range(k * 7 % 61))) for k in range(300)]
    docs = spark.createDataFrame([(*t, "a", "b", "c", "d") for t in texts], DOCS).repartition(40)
    for size, most in ((64, 4), (50, 1), (7, 3)):
        check(digests(packing.pack(docs, size=size, open_windows=most, fan=3)), texts, tokenizer, size)


def test_odd_texts(spark, tokenizer):
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "a\x1cb c d é ́x"), (5, "Don't we'll <|endoftext|>x <|startoftext|>"), (6, "x" * 30_000), (7, "12 345 ½ ٣"), (8, "ΑΣ Σ σ　漢字\r\nİı"), (9, "many words " * 20_000), (None, "no id")]
    docs = spark.createDataFrame([(*t, "a", "b", "c", "d") for t in texts], DOCS)
    check(digests(packing.pack(docs)), texts, tokenizer, 2048)
    twice = docs.filter("doc_id = 1").union(docs.filter("doc_id = 1"))
    assert [(r.start, r.length, r.doc_tokens) for r in packing.pack(twice).collect()] == [(0, 1, 1)] * 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_kept_words(tokenizer, monkeypatch):
    """The ids of words that a worker keeps are those of whole texts, also when it forgets them."""
    monkeypatch.setattr(packing, "WORDS", 5)
    monkeypatch.setattr(packing, "STEP", 7)
    words, whole = packing.Words("word_bpe_49k.json"), packing.Whole("word_bpe_49k.json")
    letters = "".join(chr(c) for c in range(0xC0, 0x100)) + "AZaz"
    texts = [" ".join(f"{a}x{b}" for a in letters for b in letters), " ".join(f"{a}{m}" for a in letters for m in (".", "!?", "...", "'s", "'S", ",5", "×", "÷", "\u0301")), "don't DON'T we'll. l'd's, it's;", "a\u0301bc e\u0301, A\u030a. \u0130 \u212a \ufb01 \u01c5 \u00df\u1e9e", "a,b .a. ... !", None, "", "x" * 60 + "."]
    texts = pa.array([t + " \U0001f600\u00a0\u2003x\ty " if t and k % 2 else t for k, t in enumerate(texts)])
    assert list(words.of(texts)) == list(whole.of(texts)) and list(words.of(texts[2:4])) == list(whole.of(texts[2:4]))
    assert list(words.of(texts[:0])) == []


def test_best_fit_and_the_fullest():
    p = packing.Packer(10, 2)
    put = lambda i, n: [[(d, s, len(x) // 4) for d, s, x, _ in w] for w in p.add(i, 0, b"\0" * 4 * n, n)]
    assert put("a", 6) == [] and put("b", 7) == [] and put("c", 3) == [[("b", 0, 7), ("c", 0, 3)]]
    assert put("d", 8) == [] and put("e", 5) == [[("d", 0, 8), ("e", 0, 2)]]  # fits nowhere: tops up the fullest
    assert [[x[:2] for x in w] for w in p.left()] == [[("a", 0), ("e", 2)]]
    assert put("f", 25) == [[("f", 0, 10)], [("f", 10, 10)]] and put("g", 10) == [[("g", 0, 10)]]
