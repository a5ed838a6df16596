"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a small embedding; learned filters of eight bytes slide over the text in steps of two. A text is cut into
chunks of 256 bytes that overlap by 64 and cover all of it; each filter is max-pooled in each chunk, and the mean and the
maximum over the chunks go through one logistic layer to a probability. Trained by Adagrad on a bounded sample; the
decision threshold is set on held-back training texts and mapped to a score of THRESHOLD.

Defined results: null and empty texts are one chunk of zero bytes, and get that chunk's score; without labels of both
classes every score is 0.5. Long texts are scored in pieces of whole chunks, so memory doesn't grow with a text, and a
text's score is that of the whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import fold, labelled_sample, map_arrow, sigmoid, table

#: Bounds of the training sample by class (rows, bytes), and the model's size.
MAX_ROWS, MAX_BYTES, DIM, FILTERS = 700, 4 << 20, 8, 16
PART, STRIDE, TAPS = 64, 2, 4  # bytes of a quarter chunk; bytes a step; steps a filter covers
THRESHOLD = 0.3


@dataclass
class Model:
    emb: np.ndarray  # byte -> vector; byte 0 is padding
    w: np.ndarray  # (TAPS, STRIDE * DIM, FILTERS)
    b: np.ndarray
    out: np.ndarray
    out_bias: float
    cut: float


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each text followed by zeros to a multiple of PART (at least a filter's width), and part offsets."""
    size = np.diff(off)
    parts = -(-(size + TAPS * STRIDE) // PART)
    part_off = np.concatenate([[0], np.cumsum(parts)])
    buf = np.zeros(part_off[-1] * PART + TAPS * STRIDE, np.uint8)
    at = np.repeat(part_off[:-1] * PART - (off[:-1] - off[0]), size) + np.arange(off[-1] - off[0])
    buf[at] = data[off[0] : off[-1]]
    return buf, part_off


def responses(emb, w, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of byte vectors, and each filter's response at each step."""
    x = np.take(emb, buf, axis=0).reshape(-1, STRIDE * DIM)
    m = len(x) - TAPS
    z = x[:m] @ w[0]
    for k in range(1, TAPS):
        z += x[k : m + k] @ w[k]
    return x, z


def chunk_bounds(part_off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First part and end of each chunk (four parts, of which one is shared with the next), and chunk offsets by text."""
    parts = np.diff(part_off)
    n = np.maximum(1, -(-(parts - 1) // 3))
    chunk_off = np.concatenate([[0], np.cumsum(n)])
    start = np.repeat(part_off[:-1], n) + 3 * (np.arange(chunk_off[-1]) - np.repeat(chunk_off[:-1], n))
    return start, np.minimum(start + 4, np.repeat(part_off[1:], n)), chunk_off


def pool(model: Model, data: np.ndarray, off: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the sum and the maximum of its chunks' pooled activations, and the number of chunks; with `most`, of
    one text's first so many chunks."""
    buf, part_off = padded(data, off)
    _, z = responses(model.emb, model.w, buf)
    # the last steps of a text's last part see its padding, and no byte of the next text
    z[(part_off[1:, None] * (PART // STRIDE) - np.arange(1, TAPS)).ravel()] = 0
    top = z.reshape(-1, PART // STRIDE, FILTERS).max(axis=1)
    start, end, chunk_off = chunk_bounds(part_off)
    edges = np.stack([start, end], axis=1).ravel()
    chunks = np.maximum(np.maximum.reduceat(np.concatenate([top, top[-1:]]), edges, axis=0)[::2] + model.b, 0)[:most]
    chunk_off = np.minimum(chunk_off, len(chunks))
    return np.add.reduceat(chunks, chunk_off[:-1], axis=0, dtype=np.float64), np.maximum.reduceat(chunks, chunk_off[:-1], axis=0), np.diff(chunk_off)


def scores(model: Model | None, col: pa.Array) -> np.ndarray:
    n = len(col)
    if model is None or not n:
        return np.full(n, 0.5)
    data, off = T.views(col)
    total, top, count = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.zeros(n)
    for i, j in T.row_blocks(off):
        size = int(off[j] - off[i])
        if j > i + 1 or size <= T.SEGMENT:
            total[i:j], top[i:j], count[i:j] = pool(model, data, off[i : j + 1])
            continue
        # a longer text goes on in pieces of whole chunks, each read to the end of its last chunk and filter
        left = max(1, -(-(-(-(size + TAPS * STRIDE) // PART) - 1) // 3))
        step = max(1, T.SEGMENT // (3 * PART))
        for first in range(0, left, step):
            m = min(step, left - first)
            a = int(off[i]) + first * 3 * PART
            s, peak, c = pool(model, data, np.array([a, min(int(off[j]), a + (3 * m + 1) * PART + TAPS * STRIDE)]), m)
            total[i] += s[0]
            top[i] = np.maximum(top[i], peak[0])
            count[i] += c[0]
    z = (total / count[:, None]) @ model.out[:FILTERS] + top @ model.out[FILTERS:] + model.out_bias
    return sigmoid(z - model.cut + np.log(THRESHOLD / (1 - THRESHOLD)))


def fit(data: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int = 6, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    p = {
        "emb": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        "w": rng.normal(0, 0.35, (TAPS, STRIDE * DIM, FILTERS)).astype(np.float32),
        "b": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32),
        "out_bias": np.zeros(1, np.float32),
    }
    p["emb"][0] = 0
    square = {k: np.full_like(v, 1e-6) for k, v in p.items()}
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    quarter, taps = PART // STRIDE, np.arange(TAPS)
    for epoch in range(epochs):
        rate = 0.05 * (1 - epoch / epochs) + 0.005
        for i in rng.permutation(train):
            buf, part_off = padded(data, off[i : i + 2])
            x, z = responses(p["emb"], p["w"], buf)
            start, end, _ = chunk_bounds(part_off)
            z = z.reshape(-1, quarter, FILTERS)
            where = z.argmax(axis=1)
            top = np.take_along_axis(z, where[:, None], axis=1)[:, 0]
            quarters = np.minimum(start[:, None] + np.arange(4), end[:, None] - 1)
            best = top[quarters].argmax(axis=1)
            part = np.take_along_axis(quarters, best, axis=1)
            at = part * quarter + where[part, np.arange(FILTERS)]  # step of each chunk's and filter's maximum
            act = top[part, np.arange(FILTERS)] + p["b"]
            chunks = np.maximum(act, 0)
            peak = chunks.argmax(axis=0)
            feat = np.concatenate([chunks.mean(axis=0), chunks[peak, np.arange(FILTERS)]])
            g = float(sigmoid(feat @ p["out"] + p["out_bias"][0]) - y[i])
            d = np.repeat((g * p["out"][:FILTERS] / len(chunks))[None], len(chunks), axis=0)
            d[peak, np.arange(FILTERS)] += g * p["out"][FILTERS:]
            d *= act > 0
            seen = x[at[:, :, None] + taps]  # (chunk, filter, tap, pair)
            back = np.einsum("cf,tpf->cftp", d, p["w"]).reshape(-1, DIM)
            codes = buf[(at[:, :, None] + taps)[..., None] * STRIDE + np.arange(STRIDE)].ravel()
            emb = np.stack([np.bincount(codes, back[:, k], 256) for k in range(DIM)], axis=1)
            emb[0] = 0
            grads = {"emb": emb, "w": np.einsum("cf,cftp->tpf", d, seen), "b": d.sum(axis=0), "out": g * feat + 1e-4 * p["out"], "out_bias": np.array([g])}
            for k, v in grads.items():
                square[k] += v * v
                p[k] -= rate * v / np.sqrt(square[k])
    model = Model(p["emb"].astype(np.float32), p["w"].astype(np.float32), p["b"], p["out"], float(p["out_bias"][0]), 0.0)
    some = held if len(held) >= 40 else order
    z = np.empty(len(some))
    for k, i in enumerate(some):
        s, m, c = pool(model, data, off[i : i + 2])
        z[k] = (s[0] / c[0]) @ model.out[:FILTERS] + m[0] @ model.out[FILTERS:] + model.out_bias
    model.cut = cut(z, y[some])
    return model


def cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best balanced accuracy for the classes, in the middle of the gap between texts."""
    if y.all() or not y.any():
        return 0.0
    order = np.argsort(z, kind="stable")
    low = np.cumsum(1 - y[order]) / (1 - y).sum()
    high = 1 - np.cumsum(y[order]) / y.sum()
    k = int((low + high).argmax())
    above = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] + 2
    return float((z[order[k]] + above) / 2)


def train(docs: DataFrame, labels: DataFrame, eligible: Column) -> Model | None:
    """Learn from a bounded sample (MAX_ROWS and MAX_BYTES of each class) of labelled rows."""
    got = labelled_sample(docs.select("doc_id", "text"), labels, "quality", eligible, MAX_ROWS, MAX_BYTES).select("text", "quality").toArrow()
    if len(set(got["quality"].to_pylist())) < 2:
        return None
    data, off = T.views(got["text"])
    return fit(data, off, got["quality"].to_numpy().astype(np.float32))


def predict(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = scores(held.value, b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", held_out.alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op3(spark, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out), held_out)
