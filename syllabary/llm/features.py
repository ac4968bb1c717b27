"""Statistics and term features of whole texts, computed a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .tokens import ASCII_LOWER, SPACE, text_chunks, word_hashes, word_spans

STATISTICS = (
    "n_words", "mean_word", "upper", "digit", "symbol", "space", "ending", "distinct", "top_share", "n_lines", "repeated_lines", "shouted", "bars",
)
PREFIXES = (4, 5, 6)
_U = np.uint64
_OPENINGS = {n: _U(0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF) for n in PREFIXES}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[33, 46, 63]] = True
_SYMBOL = ~(_LETTER | _DIGIT | SPACE | _END)
_SYMBOL[[39, 44, 45, 58, 59]] = False
_KINDS = [_UPPER, _DIGIT, _SYMBOL, SPACE, _END]


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` a text; ratios of nothing are 0."""
    out = np.zeros((len(column), len(STATISTICS)))
    for at, to, data, off in text_chunks(column):
        n = to - at
        size = np.maximum(np.diff(off), 1)
        starts, ends, first = word_spans(data, off)
        words = np.diff(first)
        some = np.maximum(words, 1)
        row = np.repeat(np.arange(n), words)
        hashes = word_hashes(ASCII_LOWER[data], starts, ends)
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        runs = np.diff(np.append(np.flatnonzero(new), len(h)))
        top = np.zeros(n)
        np.maximum.at(top, r[new], runs)
        # Lines: pieces between line feeds, judged by their bytes.
        feed = data == 10
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        edge[1:] |= feed
        cut = np.flatnonzero(edge)
        line_row = np.searchsorted(off, cut[:-1], "right") - 1
        lines = word_hashes(data, cut[:-1], cut[1:]) if len(cut) > 1 else np.zeros(0, _U)
        n_lines = np.bincount(line_row, minlength=n)[:n] if len(lines) else np.zeros(n)
        o = np.lexsort((lines, line_row)) if len(lines) else np.zeros(0, int)
        again = (lines[o][1:] == lines[o][:-1]) & (line_row[o][1:] == line_row[o][:-1])
        repeated = np.bincount(line_row[o][1:][again], minlength=n)[:n] if again.any() else np.zeros(n)
        upper = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_UPPER[data], out=upper[1:])
        shouted = np.bincount(row[(upper[ends] - upper[starts]) >= 2], minlength=n)[:n] if len(row) else np.zeros(n)
        bars = np.bincount(row[(ends - starts == 1) & _SYMBOL[data[starts]]], minlength=n)[:n] if len(row) else np.zeros(n)
        kinds = [_sums(k[data], off) / size for k in _KINDS]
        length = np.bincount(row, ends - starts, minlength=n)[:n] if len(row) else np.zeros(n)
        out[at:to] = np.stack([words, length / some, *kinds, np.bincount(r[new], minlength=n)[:n] / some if len(r) else np.zeros(n), top / some, n_lines, repeated / np.maximum(n_lines, 1), shouted / some, bars / some], axis=1)
    return out


def terms(column: pa.Array, openings: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, row of each term, term fingerprint).

    Terms are the runs of letters in lower case, and with ``openings`` their first 4, 5 and
    6 bytes where they are longer, one entry for each occurrence.
    """
    for at, to, data, off in text_chunks(column):
        data = np.where(_LETTER[data], ASCII_LOWER[data], np.uint8(32))
        starts, ends, first = word_spans(data, off)
        row = np.repeat(np.arange(to - at), np.diff(first))
        total = [(row, word_hashes(data, starts, ends))]
        for n in PREFIXES if openings else ():
            longer = ends - starts > n
            total.append((row[longer], word_hashes(data, starts[longer], starts[longer] + n) ^ _OPENINGS[n]))
        yield at, to, np.concatenate([r for r, _ in total]), np.concatenate([h for _, h in total])


def counted_terms(column: pa.Array, wanted: np.ndarray | None = None, openings: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (first row, row, term, count), each row's terms once, in order; ``wanted``: sorted terms, given back as places."""
    for at, _, row, term in terms(column, openings):
        if wanted is not None:
            if not len(wanted):
                continue
            place = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
            keep = wanted[place] == term
            row, term = row[keep], place[keep].astype(_U)
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        first = np.flatnonzero(new)
        yield at, row[first], term[first], np.diff(np.append(first, len(row)))
