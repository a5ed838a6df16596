"""Packing: documents into sequences of a fixed number of tokens, online in bounded space.

Each partition streams its documents and keeps at most OPEN windows. A document's whole windows are sealed at once; its rest
goes, uncut, into the window where it fits best (the least gap that holds it). If none holds it and no further window may
be opened, the fullest window is topped up with the rest's beginning and emitted, and what remains is placed anew. So every
emitted window is full, documents are cut only where nothing fits, and a task holds OPEN windows however much it reads.
What stays open at a partition's end is a leftover. Leftovers are packed again in the same way, those of FAN partitions in
one task, round by round, until one task has the last; there they are merged into full windows and one padded sequence.

Tokens come from a public tokenizer file, then an id that ends the document. TOKENIZER drops white space and no rule of it
reaches over white space, so text is cut at spaces and line feeds, and each worker keeps the ids of WORDS words it has met.

Defined results: a null or empty text is a document of the ending id alone; repeated rows and rows with one doc_id, or none,
are documents each; a text of any length is cut into windows; an empty table gives no pieces. Only doc_id and text are read,
so other columns can't clash. Which window a document gets depends on the order and partitions of the input.
"""

from __future__ import annotations

import os
from bisect import bisect_right, insort
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table

SIZE, OPEN, FAN = 2048, 16, 64
TOKENIZER, END = "word_bpe_49k.json", 1
#: Words whose ids a worker keeps.
WORDS = 600_000
#: Words of letters that are composed and have one lower-case form each; marks of sentences behind them.
LETTERS, MARKS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", ".,;:!?"
#: Chunks of text whose ids are put together at once.
STEP = 1 << 20
#: Bytes of ids in a record batch that goes back to Spark.
BATCH = 4 << 20


class Whole:
    """Ids of whole texts as little-endian unsigned 32-bit values: right for every tokenizer."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file if os.path.isabs(file) else public_tokenizers.path(file))

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        for text in texts:
            yield self.encode(text.as_py() or "")


class Words(Whole):
    """The same for TOKENIZER: no rule of it reaches over white space, nor from letters to marks. Keeps words it has met.

    Arrow cuts texts at spaces and finds the different chunks and words of a batch; only words not met before reach the model.
    """

    def __init__(self, file: str):
        super().__init__(file)
        self.words: dict[str, bytes] = {}
        self.as_bytes = str.maketrans({chr(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)})

    def _word(self, word: str) -> bytes:
        """A word that LETTERS matches, in lower case: the model alone does."""
        out = self.words.get(word)
        if out is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            found = self.tokenizer.model.tokenize(word.translate(self.as_bytes))
            out = self.words[word] = pack_ids(f"<{len(found)}I", *[t.id for t in found])
        return out

    def _odd(self, chunk: str) -> bytes:
        """Any other chunk; short ones are kept, too."""
        if (out := self.words.get(chunk)) is None:
            out = self.encode(chunk)
            if len(chunk) < 48:
                self.words[chunk] = out
        return out

    def _chunks(self, chunks: pa.Array) -> list[bytes]:
        """The ids of different chunks without spaces."""
        words = pc.utf8_rtrim(chunks, MARKS)
        plain = pc.match_substring_regex(words, LETTERS)
        lower = pc.utf8_lower(words.filter(plain)).dictionary_encode()
        known = list(map(self._word, lower.dictionary.to_pylist()))
        marks = pc.replace_substring_regex(chunks.filter(plain), f"^[^{MARKS}]*", "").dictionary_encode()
        behind = [self.encode(x) for x in marks.dictionary.to_pylist()]
        found = iter([known[i] + behind[j] for i, j in zip(lower.indices.to_pylist(), marks.indices.to_pylist())])
        other = map(self._odd, chunks.filter(pc.invert(plain)).to_pylist())
        return [next(found) if x else next(other) for x in plain.to_pylist()]

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        rows, coded = parts.offsets.to_numpy() - parts.offsets[0].as_py(), parts.flatten().dictionary_encode()
        ids = self._chunks(coded.dictionary)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins, held, seen = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4"), coded.indices.to_numpy()
        out = []
        for k in range(0, len(seen), STEP):
            chosen = seen[k : k + STEP]
            sizes = size[chosen]
            ends = np.cumsum(sizes)
            out.append(held[np.arange(sizes.sum()) + np.repeat(begins[chosen] - ends + sizes, sizes)])
        flat = np.concatenate(out) if out else held[:0]
        cuts = np.concatenate([[0], np.cumsum(size[seen])])[rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield flat[a:b].tobytes()


_ids: dict[str, Whole] = {}


class Packer:
    """Windows of `size` tokens, at most `most` of them open. A piece: (doc_id, start, ids, tokens of its document)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.made = size, most, 0
        self.order: list[tuple[int, int]] = []  # (tokens, window) of the open windows, the fullest last
        self.windows: dict[int, list[tuple]] = {}

    def add(self, doc_id, start: int, ids: bytes, total: int) -> Iterator[list[tuple]]:
        """Place a document, or a piece of one; the windows that are full now."""
        at, end = 0, len(ids) // 4
        while end - at >= self.size:
            yield [(doc_id, start + at, ids[4 * at : 4 * (at + self.size)], total)]
            at += self.size
        while at < end:
            rest = end - at
            fits = bisect_right(self.order, self.size - rest, key=lambda x: x[0]) - 1
            if fits < 0 and len(self.order) < self.most:
                filled, window = 0, self.made
                self.made += 1
                self.windows[window] = []
            else:
                filled, window = self.order.pop(fits)  # -1, if it fits nowhere: the fullest
            take = min(rest, self.size - filled)
            self.windows[window].append((doc_id, start + at, ids[4 * at : 4 * (at + take)], total))
            at += take
            if filled + take == self.size:
                yield self.windows.pop(window)
            else:
                insort(self.order, (filled + take, window))

    def left(self) -> list[list[tuple]]:
        return [self.windows[window] for _, window in reversed(self.order)]


def _merged(left: list[list[tuple]], size: int) -> Iterator[list[tuple]]:
    """The last leftovers, the fullest first, as full windows and one more at most."""
    one = Packer(size, 1)
    for window in left:
        for piece in window:
            yield from one.add(*piece)
    yield from one.left()


def _rows(windows: Iterator[tuple[list[tuple], bool]], round_: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Windows, and if they are sealed, as rows. A sequence's id has the round, the partition and the window's number."""
    base, held, size = (round_ << 56) + (TaskContext.get().partitionId() << 32), [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for k, (window, sealed) in enumerate(windows):
        offset = 0
        for doc_id, start, ids, total in window:
            held.append((doc_id, start, len(ids) // 4, ids, total, base + k, offset, sealed))
            offset += len(ids) // 4
            size += len(ids)
        if size > BATCH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def pack(docs: DataFrame, size: int = SIZE, open_windows: int = OPEN, tokenizer: str = TOKENIZER, end: int = END, fan: int = FAN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    start: the tokens of the piece's document before it; offset: its place in the sequence.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sealed boolean"
    ending = end.to_bytes(4, "little")
    plain = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sealed"]

    def packed(pieces, round_: int, first: pa.DataType, last: bool = False):
        def windows():
            packer = Packer(size, open_windows)
            for piece in pieces:
                for window in packer.add(*piece):
                    yield window, True
            if last:
                for window in _merged(packer.left(), size):
                    yield window, True
            else:
                for window in packer.left():
                    yield window, False

        return _rows(windows(), round_, pa.schema(list(zip(names, [first, *plain]))))

    def tokenized(batches):
        if (known := _ids.get(tokenizer)) is None:
            known = _ids[tokenizer] = (Words if tokenizer == TOKENIZER else Whole)(tokenizer)

        def pieces(batch):
            for doc_id, ids in zip(batch["doc_id"], known.of(batch["text"])):
                ids += ending
                yield doc_id.as_py(), 0, ids, len(ids) // 4

        batches = iter(batches)
        for batch in batches:
            yield from packed((p for b in (x for part in ((batch,), batches) for x in part) for p in pieces(b)), 0, batch.schema.field("doc_id").type)

    def again(round_: int, last: bool):
        def run(batches):
            batches = iter(batches)
            for batch in batches:
                rows = (r for part in ((batch,), batches) for b in part for r in zip(*(b[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))))
                yield from packed(rows, round_, batch.schema.field("doc_id").type, last)

        return run

    out, open_, round_ = None, materialize(map_arrow(docs.select("doc_id", "text"), tokenized, layout), "packed"), 0
    while open_ is not None:
        sealed = open_.filter("sealed").drop("sealed")
        out = sealed if out is None else out.unionByName(sealed)
        left = open_.filter("not sealed")
        tasks = left.select(F.shiftright("sequence_id", 32).alias("task")).distinct().count()
        if not tasks:
            break
        parts, round_ = -(-tasks // fan), round_ + 1
        dealt = left.withColumn("to", F.pmod(F.shiftright("sequence_id", 32), F.lit(parts))).repartition(parts, "to")
        dealt = dealt.sortWithinPartitions("sequence_id", "offset").select("doc_id", "start", "ids", "doc_tokens")
        open_ = materialize(map_arrow(dealt, again(round_, parts == 1), layout), "packed")
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    found = pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
