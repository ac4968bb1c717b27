"""Vectorised word and shingle fingerprints over Arrow string columns.

Everything here is a small helper for code that runs inside Spark tasks: it takes
one Arrow batch and returns numpy arrays.  Texts are handled whole; a batch is cut
between rows so that temporary arrays stay near ``CHUNK_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_U = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = _U(0x9E3779B97F4A7C15)
_JOIN = _U(0xD6E8FEB86659FD93)
_FULL = _U(0xFFFFFFFFFFFFFFFF)
#: Keeps the first k of eight bytes.
_FIRST = np.append(_U(0), _FULL >> (_U(64) - np.arange(1, 9, dtype=_U) * _U(8)))
LONG_WORD = 4096

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, row offsets into the bytes); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[off[at] : off[to]], (off[at : to + 1] - off[at])
        at = to


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the index of each row's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True  # a word never crosses a row
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes.

    Eight bytes at a time are mixed into the state by a non-linear step, so unlike a
    polynomial it has no family of colliding words; very long words take a BLAKE2 digest.
    """
    if not len(starts):
        return np.zeros(0, _U)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lane = np.ndarray((len(data) + 1,), _U, padded, 0, (1,))  # the eight bytes from each place on
    n = ends - starts
    out = _splitmix((lane[starts] & _FIRST[np.minimum(n, 8)]) + n.astype(_U) * _STEP)
    live, done = np.flatnonzero((n > 8) & (n <= LONG_WORD)), 8
    while len(live):
        left = n[live] - done
        out[live] = _splitmix(out[live] * _JOIN + (lane[starts[live] + done] & _FIRST[np.minimum(left, 8)]))
        done += 8
        live = live[left > 8]
    for k in np.flatnonzero(n > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def doubled(grams: np.ndarray, apart: int) -> np.ndarray:
    """Fingerprint of each gram together with the one ``apart`` places on."""
    n = max(0, len(grams) - apart)
    return _splitmix(grams[:n] * _JOIN + grams[apart:])


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of the ``size`` words from each position on (the last size - 1 positions are absent)."""
    out, have = words, 1
    while have * 2 <= size:
        out, have = doubled(out, have), have * 2
    return doubled(out, size - have) if size > have else out


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, all rows' sorted distinct shingle fingerprints, row bounds into them).

    Words are taken after lower-casing A-Z.  A row with 1 to size - 1 words has one
    shingle, the whole sequence; a row without words has none.
    """
    for at, to, data, off in text_chunks(column):
        data = ASCII_LOWER[data]
        starts, ends, first = word_spans(data, off)
        words = word_hashes(data, starts, ends)
        grams = gram_hashes(words, size)
        counts = np.diff(first)
        n = np.where(counts >= size, counts - size + 1, 0)
        rows = np.repeat(np.arange(to - at), n)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
        values = grams[place] if len(place) else np.zeros(0, _U)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            rows = np.concatenate([rows, short])
            values = np.concatenate([values, np.array([_short(words[first[r] : first[r + 1]]) for r in short], _U)])
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[keep], values[keep]
        yield at, values, np.searchsorted(rows, np.arange(to - at + 1))


def _short(words: np.ndarray) -> np.uint64:
    out = np.array([len(words)], _U)
    for k in range(len(words)):
        out = _splitmix(out * _JOIN + words[k : k + 1])
    return out[0]
