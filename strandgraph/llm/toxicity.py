"""Toxicity: a convolutional text classifier in numpy. Hashed word embeddings, filters over one to three words, max pooling
and a logistic layer; the decision threshold is calibrated for each language and mapped to a score of THRESHOLD.

Every labelled row is learned from, whole: all of them give the known words and the counts of the languages' words, four
fifths (by hash of the text) move the weights and the last fifth sets the thresholds (if it has too few texts of a class,
all rows set them). The rows are dealt over parts of about
PART_ROWS; in a round each part goes through its texts from the weights of the round before, and the changes are averaged:
of an embedding over the parts that changed it. Tasks read their parts as a stream, and what they send is bounded by the
model's size; the driver gets sums by bucket, never texts. Changes are summed as whole numbers, so the order of tasks and
the way that rows are dealt over them don't matter.

Words and stems unseen in training (by a bitmap of their hashes) have the zero vector, so a hash collision with a toxic
word can't mark a clean text. The language of a text, for its threshold, is told from its words by a second, linear table;
labels, lang, source and doc_id are never inputs. A text is scored whole, piece by piece if long, as a maximum over
positions needs no more.

Defined results: null and empty texts score as texts without words; with labels of one class only, or none, every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import discard, fold, labelled_parts, map_arrow, sigmoid, table

#: The model's size.
BUCKET_BITS, DIM, FILTERS, WIDTHS = 17, 8, 6, (1, 2, 3)
#: Training: labelled rows of a part; rounds over few rows and over many (each round reads every row); 1 / unit of a change.
PART_ROWS, MOST_ROUNDS, LEAST_ROUNDS, ROUND_ROWS, UNIT = 2048, 20, 5, 60_000, 1 << 20
MOST_WEIGHT = 2.5
SEEN_BITS = 24
#: A word's embedding is that of the word and of its first so many bytes, so that forms of one stem share a part.
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.3
#: Thresholds are sought among the logits in steps of 1 / STEPS, between -TOP and TOP.
STEPS, TOP = 64, 40
#: Toxic and other texts that a threshold of its own takes.
LEAST_TEXTS = 8, 30


@dataclass
class Model:
    seen: np.ndarray  # bitmap of hashes of the training words and their beginnings
    emb: np.ndarray  # bucket -> vector; the last row is zero, for what wasn't seen
    w: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    lang: np.ndarray  # bucket -> log odds of each language
    cuts: np.ndarray  # by language: the logit that gets a score of THRESHOLD


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its beginnings, a row for each kind; and the offset of each text's first word."""
    h, _, _, word_off, begins = T.words(data, off, BEGINNINGS)
    return np.concatenate([h[None], begins]), word_off


def buckets(seen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.empty(hashes.shape, np.int32)
    for ids, h in zip(np.atleast_2d(out), np.atleast_2d(hashes)):
        ids[:] = h & T.U((1 << BUCKET_BITS) - 1)
        ids[~seen[(h >> T.U(64 - SEEN_BITS)).astype(np.int64)]] = 1 << BUCKET_BITS
    return out


def vectors(emb: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A word's vector: the sum over the word and its beginnings; zero vectors follow, as many as the widest filter needs."""
    x = np.zeros((ids.shape[1] + max(WIDTHS) - 1, DIM), np.float32)
    for row in ids:
        x[: ids.shape[1]] += np.take(emb, row, axis=0)
    return x


def pooled(w, bias, x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The largest activation of each filter over each text's words, with zero vectors after the last word."""
    n, m = len(off) - 1, len(x) - max(WIDTHS) + 1
    some = np.flatnonzero(np.diff(off))
    best = []
    for width, part, b in zip(WIDTHS, w, bias):
        z = x[:m] @ part[0]
        for k in range(1, width):
            more = x[k : m + k] @ part[k]
            for j in range(1, k + 1):  # a filter doesn't reach into the next text
                over = off[1:][some] - j
                more[over[over >= 0]] = 0
            z += more
        top = np.zeros((n, FILTERS), np.float32)
        if len(some):
            top[some] = np.maximum.reduceat(z, off[:-1][some], axis=0)
        best.append(np.maximum(top + b, 0))
    return np.concatenate(best, axis=1)


def indexed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bitmap of what the texts hold, the buckets of their words and beginnings, and the offset of each text's first word.

    Hashes are made twice, block by block, so that only the buckets of all texts are held at once.
    """
    seen = np.zeros(1 << SEEN_BITS, bool)
    for i, j in T.row_blocks(off):
        for h in features(data, off[i : j + 1])[0]:
            seen[(h >> T.U(64 - SEEN_BITS)).astype(np.int64)] = True
    seen[0] = False  # no beginning
    ids, sizes = [np.zeros((1 + len(BEGINNINGS), 0), np.int32)], [np.zeros(0, np.int64)]
    for i, j in T.row_blocks(off):
        h, word_off = features(data, off[i : j + 1])
        ids.append(buckets(seen, h))
        sizes.append(np.diff(word_off))
    return seen, np.concatenate(ids, axis=1), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def start(seed: int = 3) -> np.ndarray:
    """The weights before training in one array: a row for each bucket, then the filters and the logistic layer."""
    rng = np.random.default_rng(seed)
    n = sum(WIDTHS) * DIM * FILTERS + 2 * len(WIDTHS) * FILTERS + 1
    state = np.zeros(((1 << BUCKET_BITS) + 1 + -(-n // DIM), DIM), np.float32)
    emb, w, bias, out, out_bias = parts_of(state)
    emb[:-1] = rng.normal(0, 0.05, (len(emb) - 1, DIM))
    for part, b in zip(w, bias):
        part[:] = rng.normal(0, 0.4, part.shape)
        b[:] = 0.05
    out[:] = rng.normal(0, 0.3, len(out))
    out_bias[:] = -1
    return state


def parts_of(state: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Views of the weights: emb, w, bias, out, out_bias."""
    n_buckets = (1 << BUCKET_BITS) + 1
    flat, views, a = state[n_buckets:].reshape(-1), [], 0
    for shape in [*((k, DIM, FILTERS) for k in WIDTHS), *((FILTERS,) for _ in WIDTHS), (len(WIDTHS) * FILTERS,), (1,)]:
        b = a + int(np.prod(shape))
        views.append(flat[a:b].reshape(shape))
        a = b
    k = len(WIDTHS)
    return state[:n_buckets], views[:k], views[k : 2 * k], views[-2], views[-1]


def learn(state: np.ndarray, ids: np.ndarray, off: np.ndarray, y: np.ndarray, share: float, rate: float) -> None:
    """SGD over the texts that have words, in their order; changes state. share: that of toxic texts.

    Both classes weigh the same. A text of the rarer class gets its weight in several steps of at most MOST_WEIGHT, and large
    activations shorten a step, so that training doesn't diverge however rare the class is.
    """
    emb, w, bias, out, out_bias = parts_of(state)
    some = np.flatnonzero(np.diff(off))
    weight = np.where(y[some] > 0, 0.5 / share, 0.5 / (1 - share))
    steps_of = np.ceil(weight / MOST_WEIGHT).astype(np.int64)
    for i, own in zip(np.repeat(some, steps_of), np.repeat(weight / steps_of, steps_of)):
        row = ids[:, off[i] : off[i + 1]]
        n = row.shape[1]
        x = vectors(emb, row)
        acts, places = [], []
        for width, part, b in zip(WIDTHS, w, bias):
            z = x[:n] @ part[0]
            for k in range(1, width):
                z += x[k : n + k] @ part[k]
            at = z.argmax(axis=0)
            places.append(at)
            acts.append(z[at, np.arange(FILTERS)] + b)
        act = np.concatenate(acts)
        relu = np.maximum(act, 0)
        g = float(sigmoid(relu @ out + out_bias[0]) - y[i]) * own / max(1.0, float(relu @ relu) / 16)
        back = g * out * (act > 0)
        out -= rate * (g * relu + 1e-4 * out)
        out_bias -= rate * g
        moved, steps = [], []
        for f, (width, part, b, at) in enumerate(zip(WIDTHS, w, bias, places)):
            d = back[f * FILTERS : (f + 1) * FILTERS]
            b -= rate * d
            for k in range(width):
                ok = at + k < n
                moved.append(row[:, (at + k)[ok]])
                steps.append((rate * (part[k] * d).T)[ok])
                part[k] -= rate * (x[at + k] * d[:, None]).T
        moved, steps = np.concatenate(moved, axis=1), np.concatenate(steps)
        np.subtract.at(emb, moved, np.broadcast_to(steps, (len(moved), *steps.shape)))
        emb[-1] = 0


def guess(lang: np.ndarray, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros((len(off) - 1, lang.shape[1]), np.float32)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        total[some] = np.add.reduceat(np.take(lang, ids, axis=0), off[:-1][some], axis=0)
    return total.argmax(axis=1)


def cut(z: np.ndarray, n: np.ndarray, ones: np.ndarray) -> float:
    """The logit threshold of the best F1, in the middle of the gap to the next lower logit of a text.

    z: different logits, n: the texts that have each, ones: the toxic ones among them.
    """
    if not ones.sum() or ones.sum() == n.sum():
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, n, ones = z[order], n[order], ones[order]
    f1 = 2 * np.cumsum(ones) / (np.cumsum(n) + ones.sum())
    k = int(f1.argmax())
    low = z[k + 1] if k + 1 < len(z) else z[k] - 2
    return float((z[k] + low) / 2)


def summed(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], tuple[np.ndarray, dict[str, np.ndarray]]], names: list[str], how=F.sum) -> dict[str, np.ndarray]:
    """What run makes of each task's rows (places, and whole numbers by name), summed by place over all tasks."""

    def task(batches):
        place, columns = run(batches)
        for a in range(0, len(place), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)].astype(np.int64)) for x in (place, *columns.values())], ["place", *columns])

    out = map_arrow(rows, task, ", ".join(f"{c} bigint" for c in ["place", *names]))
    got = out.groupBy("place").agg(*(how(c).alias(c) for c in names)).toArrow()
    return {c: got[c].to_numpy() for c in got.column_names}


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of a batch in pieces of bounded size: the piece, its bytes and offsets."""
    data, off = T.views(batch["text"])
    for i, j in T.row_blocks(off):
        yield batch.slice(i, j - i), data, off[i : j + 1]


def known_words(rows: DataFrame) -> np.ndarray:
    """The bitmap of the words and beginnings that rows hold."""

    def run(batches):
        seen = np.zeros(1 << SEEN_BITS, bool)
        for batch in batches:
            seen |= indexed(*T.views(batch["text"]))[0]
        bits = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(bits)
        return at, {"bits": bits[at]}

    got = summed(rows.select("text"), run, ["bits"], F.bit_or)
    bits = np.zeros((1 << SEEN_BITS) // 64, np.int64)
    bits[got["place"]] = got["bits"]
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def words_by_language(rows: DataFrame, names: list[str], seen) -> np.ndarray:
    """Bucket -> log odds of each language (a lang of names), by the words of all rows. seen: the broadcast bitmap."""
    size = ((1 << BUCKET_BITS) + 1) * len(names)

    def run(batches):
        n = np.zeros(size, np.int64)
        for batch in batches:
            for b, data, off in blocks(batch):
                h, word_off = features(data, off)
                lang = np.array([names.index(x or "") for x in b["lang"].to_pylist()])
                n += np.bincount(buckets(seen.value, h[0]).astype(np.int64) * len(names) + np.repeat(lang, np.diff(word_off)), minlength=size)
        at = np.flatnonzero(n)
        return at, {"n": n[at]}

    got = summed(rows.select("text", "lang"), run, ["n"])
    counts = np.ones(size)
    counts[got["place"]] += got["n"]
    counts = counts.reshape(-1, len(names))
    lang = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    lang -= lang.mean(axis=1, keepdims=True)
    lang[-1] = 0
    return lang


def after_round(rows: DataFrame, state: np.ndarray, seen, share: float, rate: float) -> np.ndarray:
    """The weights after each part's texts moved them from state, averaged over the parts that changed them."""
    sent = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        total, times = np.zeros(state_shape, np.int64), np.zeros(state_shape[0], np.int64)
        now = own = None

        def close():
            if own is not None:
                moved = np.rint((own - sent.value) * UNIT).astype(np.int64)
                np.add(total, moved, out=total)
                np.add(times, moved.any(axis=1), out=times)

        for batch in batches:
            part = batch["part"].to_numpy()
            for piece in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if not len(piece):
                    continue
                if part[piece[0]] != now:
                    close()
                    now, own = part[piece[0]], sent.value.copy()
                for b, data, off in blocks(batch.slice(piece[0], len(piece))):
                    h, word_off = features(data, off)
                    learn(own, buckets(seen.value, h), word_off, b["toxic"].to_numpy(), share, rate)
        close()
        at = np.flatnonzero(times)
        return at, {"n": times[at]} | {f"d{k}": total[at, k] for k in range(DIM)}

    state_shape = state.shape
    got = summed(rows.select("part", "text", "toxic"), run, ["n", *(f"d{k}" for k in range(DIM))])
    sent.destroy()
    out = state.copy()
    out[got["place"]] += (np.stack([got[f"d{k}"] for k in range(DIM)], axis=1) / UNIT / got["n"][:, None]).astype(np.float32)
    return out


def thresholds(rows: DataFrame, model: Model) -> np.ndarray:
    """The cut of each language, from every row's logit. A language with few texts of a class takes the cut of all."""
    n_langs, bins = model.lang.shape[1], 2 * TOP * STEPS + 1
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        n, ones = np.zeros(n_langs * bins, np.int64), np.zeros(n_langs * bins, np.int64)
        for batch in batches:
            z, told = logits(sent.value, batch["text"])
            at = told * bins + np.clip(np.rint((z + TOP) * STEPS), 0, bins - 1).astype(np.int64)
            n += np.bincount(at, minlength=len(n))
            ones += np.bincount(at[batch["toxic"].to_numpy() > 0], minlength=len(n))
        at = np.flatnonzero(n)
        return at, {"n": n[at], "ones": ones[at]}

    got = summed(rows.select("text", "toxic"), run, ["n", "ones"])
    sent.destroy()
    n, ones = np.zeros((n_langs, bins), np.int64), np.zeros((n_langs, bins), np.int64)
    n.flat[got["place"]], ones.flat[got["place"]] = got["n"], got["ones"]

    def best(n, ones):
        at = np.flatnonzero(n)
        return cut(at / STEPS - TOP, n[at], ones[at])

    common = best(n.sum(axis=0), ones.sum(axis=0))
    return np.array([best(a, b) if b.sum() >= LEAST_TEXTS[0] and (a - b).sum() >= LEAST_TEXTS[1] else common for a, b in zip(n, ones)])


def train(docs: DataFrame, labels: DataFrame, eligible: Column) -> Model | None:
    """Learn from every labelled row; None if they are of one class only, or none."""
    rows = labelled_parts(docs.select("doc_id", "text", "lang"), labels, "toxic", eligible, PART_ROWS)
    held = F.pmod(F.xxhash64("text", F.lit("held")), F.lit(5)) == 0
    told = rows.groupBy("lang", held.alias("held"), "toxic").count().collect()
    if len({r.toxic for r in told}) < 2:
        discard(rows)
        return None
    moving = sum(r["count"] for r in told if not r.held)
    share = sum(r["count"] for r in told if not r.held and r.toxic) / max(moving, 1)
    share = min(max(share, 0.002), 0.998)  # a text of a class that is still rarer weighs no more
    context = docs.sparkSession.sparkContext
    bitmap = known_words(rows)
    seen = context.broadcast(bitmap)
    names = sorted({r.lang or "" for r in told})
    lang = words_by_language(rows, names, seen)
    state = start()
    rounds = max(LEAST_ROUNDS, min(MOST_ROUNDS, ROUND_ROWS // max(moving, 1)))
    for k in range(rounds):
        state = after_round(rows.filter(~held), state, seen, share, 0.12 * (1 - k / rounds) + 0.01)
    seen.destroy()
    emb, w, bias, out, out_bias = parts_of(state)
    model = Model(bitmap, emb, w, bias, out, float(out_bias[0]), lang, np.zeros(len(names)))
    apart = [sum(r["count"] for r in told if r.held and bool(r.toxic) == x) for x in (True, False)]
    model.cuts = thresholds(rows.filter(held) if apart[0] >= LEAST_TEXTS[0] and apart[1] >= LEAST_TEXTS[1] else rows, model)
    discard(rows)
    return model


def logits(model: Model, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the logit and the language told from its words."""
    data, off = T.views(col)
    z, told = [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
    for i, j in T.row_blocks(off):
        h, word_off = features(data, off[i : j + 1])
        best = None
        for a in range(0, max(h.shape[1], 1), T.SEGMENT):  # a long text in pieces of so many words, which overlap
            b = min(a + T.SEGMENT + max(WIDTHS), h.shape[1])
            top = pooled(model.w, model.bias, vectors(model.emb, buckets(model.seen, h[:, a:b])), np.clip(word_off, a, b) - a)
            best = top if best is None else np.maximum(best, top)
        z.append(best @ model.out + model.out_bias)
        told.append(guess(model.lang, buckets(model.seen, h[0]), word_off))
    return np.concatenate(z), np.concatenate(told)


def scores(model: Model | None, col: pa.Array) -> np.ndarray:
    if model is None or not len(col):
        return np.zeros(len(col))
    z, told = logits(model, col)
    return sigmoid(z - model.cuts[told] + np.log(THRESHOLD / (1 - THRESHOLD)))


def predict(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = scores(held.value, b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", held_out.alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows that aren't predicted toxic, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scores(held.value, b["text"]) < THRESHOLD))

    return map_arrow(docs, run, docs.schema)


def held_out() -> Column:
    return fold(F.col("doc_id"), 4) == 2


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out()), held_out())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels"), ~held_out()))
