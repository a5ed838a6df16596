"""Spelling variants against all pairs, SQL, and odd texts."""

import random
import re
import zlib
from collections import Counter

import pytest

from strandgraph.llm import spelling

from ..compare import assert_same

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id bigint, text string, word string, n string, cell string, m string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out = {}
    for w, c in n.items():
        others = [(-n[x], x) for x in n if near(w, x)]
        best = min(others, default=(0, None))
        form = best[1] if others and -best[0] >= 10 * c else None
        out[w] = [form, None, c, len(others), -best[0] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return sorted((w, *row) for w, row in out.items())


def plain(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed", range(6))
def test_composition_against_all_pairs(seed):
    random.seed(seed)
    words = sorted({"".join(random.choice("abé"[: 2 + seed % 2]) for _ in range(random.randint(0, 6))) for _ in range(90)})
    got = sorted(tuple(sorted(p)) for p in spelling.compose(words))
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]
    acceptor = spelling.Acceptor(words)
    assert acceptor.size[acceptor.start] == len(words)
    languages = set()
    for state in range(len(acceptor.next)):
        todo, words_of = [("", state)], []
        while todo:
            w, x = todo.pop()
            words_of += [w] if acceptor.final[x] else []
            todo += [(w + s, t) for s, (t, _) in acceptor.next[x].items()]
        languages.add(tuple(sorted(words_of)))
    assert len(languages) >= len(acceptor.next) - 1  # minimal: no two states alike (but for the start)


def test_same_as_sql(spark, sf, duck):
    assert_same(spelling.op11(spark, sf).toPandas(), duck.execute(spelling.OP11_SQL).df())


@pytest.mark.parametrize("limit", [2, 7, 50_000])
def test_against_brute_force(spark, tmp_path, limit):
    """Hot prefixes and suffixes, cells cut to any depth, chains of forms, ties, repeats and nulls."""
    random.seed(limit)
    words = ["variant", "variants", "varient", "variannt", "ovariant", "straßeÿé", "straßeÿè", "a" * 30, "a" * 31, "a" * 32, "counters"]
    words += ["prefixprefix" + "".join(random.choice("ab") for _ in range(random.randint(3, 7))) for _ in range(60)]
    words += ["".join(random.choice("xy") for _ in range(random.randint(2, 5))) + "suffixsuffix" for _ in range(40)]
    rows = [(k % 40, " ".join(random.choices(words, k=30))) for k in range(60)]
    rows += [(1, "Variant-VARIANT×variant " * 400), (None, "variant nulls nulls"), (2, None), (3, ""), (4, "1234567 ¿?"), (5, "counter " * 5000 + "counters " * 100)]
    rows += rows[:5]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)
    counted = spelling.vocabulary(docs)
    path = f"{tmp_path}/words"
    counted.write.parquet(path)
    found = spelling.variants(spark.read.parquet(path), limit=limit)
    found.write.parquet(f"{tmp_path}/found")
    assert plain(spelling.with_roots(spark.read.parquet(f"{tmp_path}/found"))) == brute(rows)


def test_long_words_and_no_rows(spark, tmp_path):
    long = "".join(random.choice("abcd") for _ in range(20_000))
    words = spark.createDataFrame([(long, 50), (long[:777] + long[778:], 2), (long[:-1] + "x", 3), ("q" + long, 2), (long[::-1], 9)], "word string, n bigint")
    words.write.parquet(f"{tmp_path}/w")
    got = {r.word: (r.n_near, r.form) for r in spelling.variants(spark.read.parquet(f"{tmp_path}/w"), limit=2).collect()}
    assert got[long] == (3, None) and got[long[::-1]] == (0, None) and got["q" + long] == (1, long)
    docs = spark.createDataFrame([], DOCS)
    spelling.vocabulary(docs).write.parquet(f"{tmp_path}/none")
    assert spelling.variants(spark.read.parquet(f"{tmp_path}/none")).count() == 0
