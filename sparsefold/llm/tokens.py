"""Words and shingles of Arrow text columns as hash arrays; small NumPy helpers used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: 1 where a byte belongs to a word: no blank, tab, line feed, vertical tab, form feed or carriage return.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
#: 1 where a byte belongs to a word of letters and digits: ASCII letters and digits, and all of non-ASCII.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, modulo 2^64, of an odd base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for i, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``size`` bytes: first row, end row, bytes, and offsets from 0."""
    data, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words end with their row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word_bytes[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by differences of one running polynomial."""
    if not len(starts):
        return np.zeros(0, U)
    power, inverse = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=run[1:])
    return mix64((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = mix64(words[:n])
    for i in range(1, k):
        acc = mix64(acc * U(0x9FB21C651E98DF25) + words[i : i + n])
    return acc


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct hashes of its ``k``-word shingles (a shorter text is one shingle), A-Z lower-cased."""
    for first, end, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, row = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        all_k = rolled(words, k)
        bounds = np.searchsorted(row, np.arange(end - first + 1))
        for i in range(end - first):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                yield first + i, np.unique(all_k[a : b - k + 1])
            elif b > a:
                yield first + i, rolled(words[a:b], b - a) ^ U(b - a)
            else:
                yield first + i, np.zeros(0, U)
