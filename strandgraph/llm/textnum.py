"""Numpy kernels over the UTF-8 buffers of Arrow string columns.

A word is a run of 0-9, a-z (A-Z are lower-cased) and bytes of non-ASCII characters. No Python object is made for a text
or a word, and temporary arrays hold at most about SEGMENT bytes of text, however long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _word_bytes() -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    lut[128:] = np.arange(128, 256)
    for a, b in ((48, 58), (97, 123)):
        lut[a:b] = np.arange(a, b)
    lut[65:91] = np.arange(97, 123)
    return lut


WORD_BYTE = _word_bytes()
_BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9FB21C651E98DF25))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; grown when asked for more."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, SEGMENT + 64), base, U)
        x[0] = 1
        _powers[base] = have = np.cumprod(x, dtype=U)
    return have


def views(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)
    off = off[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)), off


def row_blocks(off: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of one longer row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def _segments(data: np.ndarray, a: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that end where no word goes on."""
    while a < end:
        b = min(a + SEGMENT, end)
        if b < end:
            gap = np.flatnonzero(WORD_BYTE[data[a:b]] == 0)
            if len(gap):
                b = a + int(gap[-1]) + 1
            else:  # one word fills the segment: go on to its end
                while b < end and not len(gap := np.flatnonzero(WORD_BYTE[data[b : b + SEGMENT]] == 0)):
                    b = min(b + SEGMENT, end)
                b = min(end, b + int(gap[0]) + 1) if len(gap) else end
        yield a, b
        a = b


def words(data: np.ndarray, off: np.ndarray, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Of the rows: each word's hash, first byte and end; and the offset of each row's first word.

    beginnings: lengths in bytes. Then a fifth array follows, with a row for each length: the hash of so many first bytes
    of each word, or 0 where the word isn't longer.
    """
    hashes, firsts, ends, begins = [], [], [], [np.zeros((len(beginnings), 0), U)]
    for a, b in _segments(data, int(off[0]), int(off[-1])):
        c = WORD_BYTE[data[a:b]]
        is_word = c != 0
        rows = off[np.searchsorted(off, a) : np.searchsorted(off, b)] - a
        follows = np.zeros(b - a, bool)
        follows[1:] = is_word[:-1]
        follows[rows] = False
        s = np.flatnonzero(is_word & ~follows)
        goes_on = np.zeros(b - a, bool)
        goes_on[:-1] = is_word[1:]
        goes_on[rows[rows > 0] - 1] = False
        e = np.flatnonzero(is_word & ~goes_on) + 1
        sums = np.zeros(b - a + 1, U)
        np.cumsum(_BYTE_CODE[c] * _power(_BASE, b - a)[: b - a], out=sums[1:])
        scale = _power(_INVERSE, b - a)[s]
        hashes.append(mix((sums[e] - sums[s]) * scale))
        if beginnings:
            begins.append(np.stack([np.where(e - s > k, mix((sums[np.minimum(s + k, e)] - sums[s]) * scale + U(k)), U(0)) for k in beginnings]))
        firsts.append(s + a)
        ends.append(e + a)
    if not hashes:
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z, np.zeros(len(off), np.int64), *begins[: bool(beginnings)]
    firsts = np.concatenate(firsts)
    found = np.concatenate(hashes), firsts, np.concatenate(ends), np.searchsorted(firsts, off)
    return (*found, np.concatenate(begins, axis=1)) if beginnings else found


def windows(h: np.ndarray, word_off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n consecutive words of one row, and the index of the first of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    x = h[:m].copy()
    for k in range(1, n):
        x *= _STEP
        x += h[k : m + k]
    row = np.repeat(np.arange(len(word_off) - 1, dtype=np.int32), np.diff(word_off))
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(x[at]), at


def sequence_hash(h: np.ndarray, word_off: np.ndarray, seed: int) -> np.ndarray:
    """One hash for each row's sequence of words (0 words: a constant)."""
    at = np.arange(len(h)) - np.repeat(word_off[:-1], np.diff(word_off))
    x = mix(h + U(seed)) * _power(_BASE, int(at.max(initial=0)) + 1)[at]
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(x, out=sums[1:])
    return mix(sums[word_off[1:]] - sums[word_off[:-1]] + np.diff(word_off).astype(U))
