"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy, with calibrated rejection.

Subwords are the byte 3- and 4-grams of lower-cased letters, which may begin or end with the gap beside a word but hold no
other gap. A text's vector is the mean of their embeddings; as that is linear, scoring adds up one precomputed row of
logits for each subword, so a text of any length needs constant memory. Texts are read whole.

Defined results: a null text, or one with no letter, is `und` with score 0 and is rejected; text in no learned language
gets the nearest one with a low score. No labelled row: every text is `und`. Equal scores: the first language by name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import bounded_sample, fit_in_task, fold, map_arrow

#: Bounds of the training sample of each language, and the model's size.
MAX_ROWS, MAX_BYTES, BUCKET_BITS, DIM = 750, 6 << 20, 17, 12
#: Zero bytes after a row: the longest gram but one.
GAP = 3
#: The share of right training texts that the rejection may cost.
MISS = 0.002


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket -> logits; the last row is zero, for grams that don't count
    bias: np.ndarray
    heat: float  # divides logits, so that scores are probabilities
    floor: float  # texts that score less are rejected


def _letters() -> np.ndarray:
    lut = T.WORD_BYTE.copy()
    lut[48:58] = 0
    return lut.astype(np.uint32)


_LETTER = _letters()


def grams(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For 3- and 4-grams the bucket of each one that starts at a byte; 2**BUCKET_BITS where none counts."""
    c = np.zeros(len(data) + 5, np.uint32)
    c[1 : len(data) + 1] = _LETTER[data]
    inner = c != 0
    x = c[:-4] * np.uint32(0x01000193) ^ c[1:-3] * np.uint32(0x85EBCA6B)
    x ^= c[2:-2] * np.uint32(0xC2B2AE35)
    out = []
    ok = inner[1:-3] & (inner[:-4] | inner[2:-2])
    shift = np.uint32(32 - BUCKET_BITS)
    mixed = x * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    out.append(np.where(ok, (mixed * np.uint32(0x9E3779B1)) >> shift, np.uint32(1 << BUCKET_BITS)))
    x ^= c[3:-1] * np.uint32(0x27D4EB2F)
    ok = inner[1:-3] & inner[2:-2] & (inner[:-4] | inner[3:-1])
    mixed = (x + np.uint32(0x165667B1)) * np.uint32(2246822519)
    mixed ^= mixed >> np.uint32(13)
    out.append(np.where(ok, (mixed * np.uint32(0x9E3779B1)) >> shift, np.uint32(1 << BUCKET_BITS)))
    return [g[: len(data)] for g in out]


def apart(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with GAP zero bytes after each, so that no gram reaches into another row; and the rows' offsets."""
    size = np.diff(off)
    gap_off = np.concatenate([[0], np.cumsum(size + GAP)])
    out = np.zeros(gap_off[-1], np.uint8)
    out[np.arange(off[-1] - off[0]) + np.repeat(GAP * np.arange(len(size)), size)] = data[off[0] : off[-1]]
    return out, gap_off


def logits(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of averaged logits for each row of text. A long row is added up piece by piece, with the bytes around a piece
    that its grams see, so the sum is that of the whole."""
    total, n = np.zeros((len(off) - 1, len(model.langs))), np.zeros(len(off) - 1)
    whole = len(off) > 2 or off[-1] - off[0] <= T.SEGMENT
    for a in [int(off[0])] if whole else range(int(off[0]), int(off[-1]), T.SEGMENT):
        b = int(off[-1]) if whole else min(a + T.SEGMENT, int(off[-1]))
        lead = min(1, a - int(off[0]))
        piece, at = apart(data, off) if whole else apart(data, np.array([a - lead, min(b + GAP, int(off[-1]))]))
        for g in grams(piece, at):
            g[:lead] = 1 << BUCKET_BITS  # counted by the piece before
            if not whole:
                g[lead + b - a :] = 1 << BUCKET_BITS
            total += np.add.reduceat(model.table[g], at[:-1], axis=0, dtype=np.float64)
            n += np.add.reduceat(g < (1 << BUCKET_BITS), at[:-1], dtype=np.int64)
    return (total / np.maximum(n, 1)[:, None] + model.bias) * (n > 0)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: pa.ChunkedArray, langs: list[str], epochs: int = 4, seed: int = 7) -> Model:
    """SGD over texts; a fifth of them sets the temperature and the rejection floor."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    data, off = T.views(texts)
    bags = []
    for i in range(len(y)):
        piece = data[off[i] : off[i + 1]]
        ids, counts = np.unique(np.concatenate(grams(piece, np.array([0, len(piece)]))), return_counts=True)
        keep = ids < (1 << BUCKET_BITS)
        bags.append((ids[keep], (counts[keep] / max(1, counts[keep].sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: max(1, len(y) // 5)] if len(y) >= 50 else order
    train = order[len(held) :] if len(y) >= 50 else order
    emb = rng.normal(0, 0.1, ((1 << BUCKET_BITS) + 1, DIM)).astype(np.float32)
    emb[-1] = 0
    w = rng.normal(0, 0.3, (DIM, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    for epoch in range(epochs):
        rate = 4.0 * (1 - epoch / epochs)
        for i in rng.permutation(train):
            ids, share = bags[i]
            if not len(ids):
                continue
            v = share @ emb[ids]
            p = softmax((v @ w + bias)[None])[0]
            p[y[i]] -= 1
            back = w @ p
            w -= 0.1 * rate * np.outer(v, p)
            bias -= 0.01 * rate * p
            emb[ids] -= (rate * 8 * share)[:, None] * back
    model = Model(names, (emb @ w).astype(np.float32), bias, 1.0, 0.0)
    z = np.array([bags[i][1] @ model.table[bags[i][0]] + bias if len(bags[i][0]) else bias * 0 for i in held])
    right = z.argmax(axis=1) == y[held]
    model.heat = min(np.geomspace(0.05, 5, 60), key=lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean())
    top = softmax(z / model.heat).max(axis=1)
    # Rejected: what scores lower than all but MISS of the texts that are labelled right, and never a clear majority.
    model.floor = float(min(0.5, 0.9 * np.quantile(top[right], MISS))) if right.any() else 0.0
    return model


def train(docs: DataFrame, eligible: Column) -> Model | None:
    """Learn from a bounded sample (MAX_ROWS, MAX_BYTES) of different texts of each language."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & eligible)
    return fit_in_task(bounded_sample(rows.select("lang", "text"), MAX_ROWS, MAX_BYTES, F.col("lang")), lambda got: fit(got["text"], got["lang"].to_pylist()))


def score_texts(model: Model | None, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text: the language, its probability, and if the text is rejected."""
    n = len(col)
    if model is None:
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    data, off = T.views(col)
    z = np.concatenate([logits(model, data, off[i : j + 1]) for i, j in T.row_blocks(off)]) if n else np.zeros((0, 1))
    p = softmax(z / model.heat)
    top = p.argmax(axis=1)
    score = p[np.arange(n), top]
    return [model.langs[k] for k in top], score, score < model.floor


def predict(docs: DataFrame, model: Model | None, extra: list[Column] = ()) -> DataFrame:
    """doc_id, the extra columns, lang_pred, score, rejected: one row for each row of docs."""
    rows = docs.select("doc_id", *extra, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    keep = [f for f in rows.schema if f.name not in ("text", "_letter")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["lang_pred string, score double, rejected boolean"])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score, rejected = score_texts(held.value, b["text"])
            letter = b["_letter"].to_numpy(zero_copy_only=False).astype(bool)
            lang = [x if ok else "und" for x, ok in zip(lang, letter)]
            yield pa.RecordBatch.from_arrays(
                [b[f.name] for f in keep] + [pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(rejected | ~letter)],
                [f.name for f in keep] + ["lang_pred", "score", "rejected"],
            )

    return map_arrow(rows, run, schema)


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows that aren't rejected, with all their columns. With no model nothing is known, and nothing is rejected."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow.compute as pc

        for b in batches:
            _, _, rejected = score_texts(held.value, b["text"])
            letter = pc.fill_null(pc.match_substring_regex(b["text"], r"\p{L}"), False)
            yield b.filter(pc.and_(pa.array(~rejected), letter))

    return map_arrow(docs, run, docs.schema)


def held_out() -> Column:
    return fold(F.col("doc_id"), 4) == 2


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return predict(docs, model, [held_out().alias("held_out")])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs, train(docs, ~held_out()))
