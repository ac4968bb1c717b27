"""Lossless WebP for byte payloads: writer, full decoder, and a table operator.

The decoder reads the public lossless bitstream: prefix codes (simple and normal),
meta prefix images, LZ77 back-references with the two-dimensional distance map, the
colour cache, and the predictor, cross-colour, subtract-green and colour-indexing
(palette) transforms; it returns pixel arrays.

A payload becomes a grey image, one byte a pixel, in rows of 64.  The writer finds
repeats of eight bytes or more for back-references, codes literals and lengths with
prefix codes of the image's own, subtracts green (grey needs no red and blue then), and
takes a palette, packed several pixels to one, where 16 values at most occur.  Predictor,
cross-colour and colour cache only pay for colour images; :func:`encode_image` writes
them.

Defined results: null texts count as empty; equal texts give equal media; payloads
above 16,383 rows of 64 bytes use wider images, padded with zero pixels, and a chunk
``LENG`` in the file keeps the payload's true length; one above 256 MB, the most that fits
one image, is an error that names this limit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_SIDE = 1 << 14
LONGEST = 11  # bits of a prefix code the writer makes
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
FURTHEST = (1 << 20) - 120
MOST_COPIED = 4096
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
_U = np.uint64

# Fixed values of the public format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
DISTANCE_MAP = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


#: Each 15-bit number with its bits in the other order.
_TURNED = sum((np.arange(1 << 15) >> k & 1) << 14 - k for k in range(15)).tolist()


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> list[int]:
    """Prefix code lengths by symbol, ``longest`` at most, near the least total."""
    out = [0] * len(counts)
    symbols = np.flatnonzero(counts)
    if len(symbols) < 2:
        for s in symbols.tolist():
            out[s] = 1
        return out
    own, least = counts[symbols], 0
    while True:
        weight = np.maximum(own, least)
        order = np.argsort(weight, kind="stable")
        weights, m = weight[order].tolist(), len(symbols)
        above = [0] * (2 * m - 1)
        leaf, inner = 0, m
        for node in range(m, 2 * m - 1):
            total = 0
            for _ in range(2):
                if leaf < m and (inner >= node or weights[leaf] <= weights[inner]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, inner = inner, inner + 1
                above[k] = node
                total += weights[k]
            weights.append(total)
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:m]) <= longest:
            break
        least = max(2 * least, int(own.sum()) >> longest, 1)
    for k, s in enumerate(symbols[order].tolist()):
        out[s] = depth[k]
    return out


def canonical(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code as it stands in the stream) of a canonical code, shortest first."""
    out, code, last = [], 0, 0
    for n, s in sorted([(n, s) for s, n in enumerate(lengths) if n]):
        code <<= n - last
        out.append((s, n, _TURNED[code << 15 - n]))
        code, last = code + 1, n
    return out


class _Writer:
    """Bits, least significant first; kept as values with their numbers of bits until the end."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.counts: list[int] = []

    def put(self, value: int, bits: int) -> None:
        self.values.append(value)
        self.counts.append(bits)

    def put_all(self, values: np.ndarray, counts: np.ndarray) -> None:
        self._close()
        self.parts.append((values, counts))

    def _close(self) -> None:
        self.parts.append((np.array(self.values, _U), np.array(self.counts, np.int64)))
        self.values, self.counts = [], []

    def bytes(self) -> bytes:
        self._close()
        values, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        some = counts > 0
        values, counts = values[some], counts[some]
        at = np.cumsum(counts) - counts
        total = int(at[-1] + counts[-1])
        word, shift = at >> 6, (at & 63).astype(_U)
        out = np.zeros((total >> 6) + 2, _U)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((at & 63) + counts > 64)  # at most one value crosses into each word
        out[word[over] + 1] |= values[over] >> (_U(64) - shift[over])
        return out.tobytes()[: (total + 7) >> 3]


def _put_simple(w: _Writer, symbols: list[int]) -> None:
    """A code of one or two symbols below 256."""
    wide = int(symbols[0] > 1)
    w.put(1 | len(symbols) - 1 << 1 | wide << 2 | symbols[0] << 3, 11 if wide else 4)
    if len(symbols) == 2:
        w.put(symbols[1], 8)


def _runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra value, extra bits)."""
    found = np.array(lengths)
    cut = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    runs = []
    for value, run in zip(found[cut].tolist(), (np.append(cut[1:], len(found)) - cut).tolist(), strict=True):
        if value:
            runs.append((value, 0, 0))
            run -= 1
        while run:
            if not value and run >= 11:
                n = min(run, 138)
                runs.append((18, n - 11, 7))
            elif run >= 3:
                n = min(run, 6 if value else 10)
                runs.append((16, n - 3, 2) if value else (17, n - 3, 3))
            else:
                n = 1
                runs.append((value, 0, 0))
            run -= n
    return runs


def _put_code(w: _Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n] or [0]
    if len(used) <= 2 and used[-1] < 256:
        _put_simple(w, used)
        return
    runs = _runs(lengths)
    how = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    needed = max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if how[s]))
    w.put(needed - 4 << 1, 5)
    for s in CODE_LENGTH_ORDER[:needed]:
        w.put(how[s], 3)
    w.put(0, 1)  # lengths are given for the whole alphabet
    codes = {s: (code, n) for s, n, code in canonical(how)}
    if len(codes) == 1:
        codes = dict.fromkeys(codes, (0, 0))
    for s, extra, bits in runs:
        code, n = codes[s]
        w.put(code | extra << n, n + bits)


def _table_of(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths by symbol; a code with one symbol has no bits."""
    codes, bits = np.zeros(len(lengths), _U), np.zeros(len(lengths), np.int64)
    found = canonical(lengths)
    for s, n, code in found if len(found) > 1 else ():
        codes[s], bits[s] = code, n
    return codes, bits


def _prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits' number and value for lengths or distance codes from 1 on."""
    x = value - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    extra = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> np.maximum(high - 1, 0) & 1)), extra, x & (1 << extra) - 1


def _repeats(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of copies that do not overlap, found by eight equal bytes."""
    per = 8 // units.itemsize
    none = np.zeros(0, np.int64)
    if len(units) < 2 * per:
        return none, none, none
    units = np.ascontiguousarray(units)
    lanes = np.ndarray((len(units) - per + 1,), _U, units, 0, (units.itemsize,))
    order = np.argsort((lanes * _U(0x9E3779B97F4A7C15) >> _U(48)).astype(np.uint16), kind="stable")
    p, q = order[1:], order[:-1]
    same = (lanes[p] == lanes[q]) & (p - q <= FURTHEST)
    distance = np.zeros(len(lanes), np.int64)
    distance[p[same]] = (p - q)[same]
    first = np.flatnonzero(np.append(True, distance[1:] != distance[:-1]))
    end = np.append(first[1:], len(lanes)) + per - 1
    found = distance[first] > 0
    first, end, distance = first[found], end[found], distance[first[found]]
    first = np.maximum(first, np.append(0, end[:-1])) if len(first) else first
    keep = end - first >= (12 if per == 8 else 2)
    first, end, distance = first[keep], end[keep], distance[keep]
    if not len(first) or (end - first).max() <= MOST_COPIED:
        return first, end - first, distance
    parts = -(-(end - first) // MOST_COPIED)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(first, parts) + step * MOST_COPIED
    return start, np.minimum(np.repeat(end, parts) - start, MOST_COPIED), np.repeat(distance, parts)


def _put_image(w: _Writer, argb: np.ndarray, main: bool, cache_bits: int = 0, repeats: bool = True) -> None:
    """An entropy-coded image with one group of prefix codes."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    green = (argb >> np.uint32(8) & np.uint32(255)).astype(np.uint8)
    grey = not cache_bits and not ((argb ^ argb[0]) & np.uint32(0xFFFF00FF)).any()
    start, length, distance = _repeats(green if grey else argb) if repeats else (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(argb) + 1, np.int8)
    edge[start] = 1
    edge[start + length] -= 1  # 0 where one copy follows another
    is_copy = np.zeros(len(argb), bool)
    is_copy[start] = True
    at = np.flatnonzero((np.cumsum(edge[:-1], dtype=np.int8) == 0) | is_copy)
    copied = is_copy[at]
    symbol = green[at].astype(np.int64)
    literal = ~copied
    if cache_bits:
        slots = ((argb * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache_bits)).tolist()
        cache, hit = [0] * (1 << cache_bits), np.zeros(len(argb), bool)
        for k, (colour, slot) in enumerate(zip(argb.tolist(), slots, strict=True)):
            hit[k] = cache[slot] == colour
            cache[slot] = colour
        hits = literal & hit[at]
        symbol[hits] = LITERALS + LENGTHS + np.array(slots)[at[hits]]
        literal &= ~hits
    length_symbol, length_bits, length_extra = _prefix_of(length)
    distance_symbol, distance_bits, distance_extra = _prefix_of(distance + 120)
    symbol[copied] = LITERALS + length_symbol
    lengths = code_lengths(np.bincount(symbol, minlength=LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0)))
    _put_code(w, lengths)
    codes, n = _table_of(lengths)
    values, bits = codes[symbol], n[symbol]
    lit = argb[:1] if grey else argb[at[literal]]
    for shift in (16, 0, 24):  # red, blue, alpha
        if grey:
            _put_simple(w, [int(lit[0]) >> shift & 255])
            continue
        x = (lit >> np.uint32(shift) & np.uint32(255)).astype(np.int64)
        lengths = code_lengths(np.bincount(x, minlength=256))
        _put_code(w, lengths)
        codes, n = _table_of(lengths)
        values[literal] |= codes[x] << bits[literal].astype(_U)
        bits[literal] += n[x]
    lengths = code_lengths(np.bincount(distance_symbol, minlength=DISTANCES))
    _put_code(w, lengths)
    if len(start):
        codes, n = _table_of(lengths)
        v, b = values[copied], bits[copied]
        for more, k in ((length_extra, length_bits), (codes[distance_symbol], n[distance_symbol]), (distance_extra, distance_bits)):
            v |= more.astype(_U) << b.astype(_U)
            b = b + k
        values[copied], bits[copied] = v, b
    w.put_all(values, bits)


def _file(stream: bytes, length: int | None = None) -> bytes:
    body = b""
    for name, data in ((b"VP8L", stream), *([(b"LENG", struct.pack("<Q", length))] if length is not None else [])):
        body += name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def _head(width: int, height: int) -> _Writer:
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise ValueError("an image has 1 to 16,384 pixels a side")
    w = _Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)  # alpha is used
    w.put(0, 3)  # version
    return w


def _put_palette(w: _Writer, colours: np.ndarray) -> None:
    """The transform's head and the palette, each colour as its difference to the one before."""
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(colours) - 1, 8)
    _put_image(w, _joined(np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.uint8))), False, repeats=False)


def _indexed(index: np.ndarray, colours: int) -> np.ndarray:
    """Rows of palette indices, packed as densely as the number of colours allows, as the green of pixels."""
    each = 1 if colours <= 2 else 2 if colours <= 4 else 4 if colours <= 16 else 8
    per = 8 // each
    index = np.pad(index, ((0, 0), (0, -index.shape[1] % per))).reshape(len(index), -1, per)
    packed = np.bitwise_or.reduce(index.astype(np.uint32) << (np.arange(per, dtype=np.uint32) * np.uint32(each)), axis=2)
    return (np.uint32(0xFF000000) | packed << np.uint32(8)).reshape(-1)


def shape_of(payload_bytes: int) -> tuple[int, int]:
    """Width and height of the image for a payload: 64 pixels a row, wider when too tall."""
    rows = max(1, -(-payload_bytes // 64))
    wide = -(-rows // (MAX_SIDE - 1))
    if wide * 64 > MAX_SIDE:
        raise ValueError("a payload over 256 MB does not fit one image")
    return 64 * wide, -(-rows // wide)


def encode(payload: bytes) -> bytes:
    """A WebP file whose grey pixels are the payload's bytes."""
    width, height = shape_of(len(payload))
    grey = np.zeros(width * height, np.uint8)
    grey[: len(payload)] = np.frombuffer(payload, np.uint8)
    w = _head(width, height)
    values = np.flatnonzero(np.bincount(grey, minlength=256)).astype(np.uint8)
    if len(values) <= 16:
        place = np.zeros(256, np.uint8)
        place[values] = np.arange(len(values))
        _put_palette(w, _joined(np.stack([np.full(len(values), 255, np.uint8), values, values, values], axis=1)))
        pixels = _indexed(place[grey].reshape(height, width), len(values))
    else:
        w.put(1, 1)
        w.put(GREEN, 2)
        pixels = np.uint32(0xFF000000) | grey.astype(np.uint32) << np.uint32(8)
    w.put(0, 1)  # no further transform
    _put_image(w, pixels, True)
    return _file(w.bytes(), len(payload))


def encode_image(pixels: np.ndarray, transforms: list[tuple] = (), cache_bits: int = 0, repeats: bool = True) -> bytes:
    """A lossless file of pixels (height x width x 4: red, green, blue, alpha).

    ``transforms`` in the order they are applied: (PREDICTOR, block bits, modes by block),
    (CROSS, block bits, red-to-blue, green-to-blue and green-to-red factors by block),
    (GREEN,), (PALETTE,), the latter last.
    """
    height, width = pixels.shape[:2]
    argb = _joined(pixels[..., [3, 0, 1, 2]].reshape(-1, 4))
    w = _head(width, height)
    for kind, *given in transforms:
        if kind == PALETTE:
            colours, index = np.unique(argb, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette has 256 colours at most")
            _put_palette(w, colours)
            argb = _indexed(index.reshape(height, width), len(colours))
            continue
        w.put(1, 1)
        w.put(kind, 2)
        if kind == GREEN:
            c = _channels(argb)
            c[:, 1] -= c[:, 2]
            c[:, 3] -= c[:, 2]
            argb = _joined(c)
            continue
        bits, blocks = given
        w.put(bits - 2, 3)
        if kind == PREDICTOR:
            image = np.uint32(0xFF000000) | np.asarray(blocks, np.uint32).reshape(-1) << np.uint32(8)
            _put_image(w, image, False)
            argb = _predict(argb, width, height, bits, image)
        else:
            image = _joined(np.concatenate([np.full((np.asarray(blocks).size // 3, 1), 255), np.asarray(blocks).reshape(-1, 3)], axis=1).astype(np.uint8))
            _put_image(w, image, False)
            argb = _cross(argb, width, bits, image)
    w.put(0, 1)
    _put_image(w, argb, True, cache_bits, repeats)
    return _file(w.bytes())


def chunks(media: bytes) -> dict[bytes, bytes]:
    """The chunks of a WebP file by name."""
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, found = 12, {}
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        found.setdefault(media[at : at + 4], media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def decode(media: bytes) -> np.ndarray:
    """Pixels of a lossless file: array of height x width x 4 (red, green, blue, alpha)."""
    argb, width, height = decode_stream(chunks(media)[b"VP8L"])
    a = np.asarray(argb, np.uint32).reshape(height, width)
    return np.stack([a >> 16 & 255, a >> 8 & 255, a & 255, a >> 24], axis=-1).astype(np.uint8)


def payload_of(media: bytes) -> bytes:
    """The payload that :func:`encode` stored."""
    parts = chunks(media)
    (length,) = struct.unpack("<Q", parts[b"LENG"])
    argb = decode_stream(parts[b"VP8L"])[0]
    return (argb >> np.uint32(8)).astype(np.uint8)[:length].tobytes()


_PIECE = 1 << 16


class _Reader:
    """Bits of a stream; ``window`` holds the eight bytes from each of the next places on."""

    def __init__(self, data: bytes) -> None:
        self.padded = np.frombuffer(data + bytes(16), np.uint8)
        self.at, self.bits, self.base, self.window = 0, len(data) * 8, 0, []
        self.load()

    def load(self) -> None:
        self.base = self.at >> 3
        n = min(_PIECE, len(self.padded) - 8 - self.base)
        if n <= 0:
            raise ValueError("the stream ends early")
        self.window = np.ndarray((n,), _U, self.padded, self.base, (1,)).tolist()

    def peek(self) -> int:
        """At least 57 bits from the current place on."""
        if (self.at >> 3) - self.base >= len(self.window):
            self.load()
        return self.window[(self.at >> 3) - self.base] >> (self.at & 7)

    def ahead(self, size: int) -> int:
        """The next ``size`` bytes or what is left as one number."""
        return int.from_bytes(self.padded[self.at >> 3 : (self.at >> 3) + size].tobytes(), "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        value = self.peek() & (1 << n) - 1 if n else 0
        self.at += n
        if self.at > self.bits:
            raise ValueError("the stream ends early")
        return value


class PrefixCode:
    """A canonical prefix code as a table over its longest length; entries are symbol << 4 | length."""

    def __init__(self, lengths: list[int]) -> None:
        codes = canonical(lengths)
        self.only = codes[0][0] if len(codes) == 1 else 0 if not codes else None
        if self.only is not None:
            self.mask, self.table = 0, [self.only << 4]
            return
        longest = codes[-1][1]
        if sum(1 << (longest - n) for _, n, _ in codes) != 1 << longest:
            raise ValueError("a prefix code is not complete")
        table = np.zeros(1 << longest, np.int64)
        for s, n, code in codes:
            table[code :: 1 << n] = s << 4 | n
        self.mask, self.table = (1 << longest) - 1, table.tolist()

    def read(self, r: _Reader) -> int:
        entry = self.table[r.peek() & self.mask]
        r.at += entry & 15
        return entry >> 4


def _read_code(r: _Reader, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if r.take(1):
        two = r.take(1)
        lengths[r.take(8 if r.take(1) else 1)] = 1
        if two:
            lengths[r.take(8)] = 1
        return PrefixCode(lengths)
    first = [0] * 19
    for k in range(4 + r.take(4)):
        first[CODE_LENGTH_ORDER[k]] = r.take(3)
    how = PrefixCode(first)
    left = 2 + r.take(2 + 2 * r.take(3)) if r.take(1) else alphabet
    value, used, at, before = r.ahead(2 * alphabet), 0, 0, 8  # 14 bits a length at most
    table, mask = how.table, how.mask
    while at < alphabet and left:
        left -= 1
        entry = table[value & mask]
        symbol, n = entry >> 4, entry & 15
        value >>= n
        used += n
        if symbol < 16:
            lengths[at] = symbol
            before = symbol or before
            at += 1
            continue
        base, bits = ((3, 2), (3, 3), (11, 7))[symbol - 16]
        n = base + (value & (1 << bits) - 1)
        value >>= bits
        used += bits
        if at + n > alphabet:
            raise ValueError("code lengths run over")
        if symbol == 16:
            lengths[at : at + n] = [before] * n
        at += n
    r.at += used
    return PrefixCode(lengths)


def _length_or_distance(r: _Reader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.take(extra) + 1


def _distance_of(code: int, width: int) -> int:
    """Pixels back for a distance code; small codes name places nearby in two dimensions."""
    if code > 120:
        return code - 120
    dx, dy = DISTANCE_MAP[code - 1]
    return max(1, dx + dy * width)


def _read_image(r: _Reader, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image as 32-bit values."""
    cache_bits = 0
    if r.take(1):
        cache_bits = r.take(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("colour cache size")
    groups, meta, meta_bits, meta_width = 1, None, 0, 0
    if main and r.take(1):
        meta_bits = r.take(3) + 2
        meta_width = (width + (1 << meta_bits) - 1) >> meta_bits
        meta = _read_image(r, meta_width, (height + (1 << meta_bits) - 1) >> meta_bits, False) >> np.uint32(8) & np.uint32(0xFFFF)
        groups = int(meta.max()) + 1
    codes = [[_read_code(r, n) for n in (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_bits and all(c.only is not None for c in codes[0][1:4]):
        red, blue, alpha = (c.only for c in codes[0][1:4])
        green = _read_greens(r, codes[0][0], codes[0][4], width, total)
        return np.frombuffer(green, np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)
    out: list[int] = []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    group = codes[0]
    while len(out) < total:
        at = len(out)
        if meta is not None:
            group = codes[int(meta[(at // width >> meta_bits) * meta_width + (at % width >> meta_bits)])]
        green = group[0].read(r)
        if green < LITERALS:
            red, blue, alpha = group[1].read(r), group[2].read(r), group[3].read(r)
            new = [alpha << 24 | red << 16 | green << 8 | blue]
        elif green < LITERALS + LENGTHS:
            length = _length_or_distance(r, green - LITERALS)
            distance = _distance_of(_length_or_distance(r, group[4].read(r)), width)
            if distance > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            seen = out[at - distance : at - distance + length]
            new = (seen * (length // distance + 1))[:length]
        else:
            new = [cache[green - LITERALS - LENGTHS]]
        out += new
        if cache_bits:
            for colour in new:
                cache[(0x1E35A7BD * colour & 0xFFFFFFFF) >> shift] = colour
    if r.at > r.bits:
        raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _read_greens(r: _Reader, literals: PrefixCode, distances: PrefixCode, width: int, total: int) -> bytearray:
    """The green samples of an image whose other channels are constant (their codes have no bits).

    The code is looked up at every bit of a piece at once.  Where literals follow one
    another, the place after 1, 2, 4, 8 and 16 of them is found for every bit by doubling,
    so only every sixteenth literal and each back-reference is visited one by one.
    """
    if literals.only is not None and literals.only < LITERALS:
        return bytearray([literals.only]) * total
    out, table = bytearray(), np.array(literals.table, np.int32)
    while len(out) < total:
        start, n = r.at >> 3, min(_PIECE, 8 * total + 64, len(r.padded) - 8 - (r.at >> 3))
        if n <= 0 or r.at > r.bits:
            raise ValueError("the stream ends early")
        window = np.ndarray((n,), np.uint32, r.padded, start, (1,))
        entries = table[(window[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32(literals.mask)).reshape(-1)]
        here, limit = np.arange(8 * n, dtype=np.int32), 8 * n - 16
        after = np.where((entries < LITERALS << 4) & (here < limit), here + (entries & 15), here)  # copies and the end stay
        jumps = [after]
        for _ in range(4):
            jumps.append(jumps[-1][jumps[-1]])
        far, place, begun = jumps.pop().data, r.at & 7, r.at
        stops, runs, copies = [], [], []
        while True:
            q = far[place]
            while q != place:
                stops.append(place)
                place, q = q, far[q]
            runs.append(len(stops))
            if place >= limit:
                break
            entry = int(entries[place])
            r.at = 8 * start + place + (entry & 15)
            if r.at > r.bits:
                break
            try:
                length = _length_or_distance(r, (entry >> 4) - LITERALS)
                code = _length_or_distance(r, distances.read(r))
            except ValueError:  # what follows the image
                break
            place = r.at - 8 * start
            copies.append((length, code, place))
            if place >= limit:
                break
        at = np.array(stops, np.int32)
        for jump in reversed(jumps):
            at = np.stack([at, jump[at]], axis=1).reshape(-1)
        literal = after[at] != at
        at = at[literal]
        samples = (entries[at] >> 4).astype(np.uint8).tobytes()
        ends = np.append(0, np.cumsum(literal))[16 * np.array(runs)].tolist()
        before = 0
        for k, end in enumerate(ends):
            if end > before:
                end = min(end, before + total - len(out))
                out += samples[before:end]
                place = int(at[end - 1]) + (int(entries[at[end - 1]]) & 15)
                before = end
            if len(out) == total:
                break
            if k < len(copies):
                length, distance, place = copies[k][0], _distance_of(copies[k][1], width), copies[k][2]
                if distance > len(out) or len(out) + length > total:
                    raise ValueError("a back-reference leaves the image")
                seen = out[len(out) - distance : len(out) - distance + length]
                out += seen if len(seen) == length else (seen * (length // distance + 1))[:length]
                if len(out) == total:
                    break
        if 8 * start + place <= begun:
            raise ValueError("the stream ends early")
        r.at = 8 * start + place
    return out


def decode_stream(data: bytes) -> tuple[np.ndarray, int, int]:
    """32-bit ARGB values, width and height of a VP8L chunk."""
    r = _Reader(data)
    if r.take(8) != 0x2F:
        raise ValueError("signature")
    width, height = r.take(14) + 1, r.take(14) + 1
    r.take(1)
    if r.take(3):
        raise ValueError("version")
    transforms, now = [], width
    while r.take(1):
        kind = r.take(2)
        if kind in (PREDICTOR, CROSS):
            bits = r.take(3) + 2
            side = (1 << bits) - 1
            transforms.append((kind, bits, now, _read_image(r, now + side >> bits, height + side >> bits, False)))
        elif kind == GREEN:
            transforms.append((kind, 0, now, None))
        else:
            size = r.take(8) + 1
            steps = _read_image(r, size, 1, False)
            palette = np.cumsum(_channels(steps), axis=0, dtype=np.uint8)
            bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, bits, now, palette))
            now = now + (1 << bits) - 1 >> bits
    pixels = _read_image(r, now, height, True)
    for kind, bits, before, extra in reversed(transforms):
        pixels = (_unpredict, _uncross, _add_green, _unpalette)[kind](pixels, before, height, bits, extra)
    return pixels, width, height


def _channels(argb: np.ndarray) -> np.ndarray:
    """Columns alpha, red, green, blue."""
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.uint8)


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _add_green(pixels, width, height, bits, extra):
    green = pixels >> np.uint32(8) & np.uint32(255)
    return pixels & np.uint32(0xFF00FF00) | (pixels & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green) & np.uint32(0x00FF00FF)


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).view(np.int8).astype(np.int32)


def _factors(image: np.ndarray, width: int, bits: int, size: int) -> np.ndarray:
    across = width + (1 << bits) - 1 >> bits
    y, x = np.divmod(np.arange(size), width)
    return _signed(_channels(image)[(y >> bits) * across + (x >> bits)])


def _cross(argb, width, bits, image):
    factor, c = _factors(image, width, bits, len(argb)), _channels(argb).astype(np.int32)
    red = c[:, 1] - (factor[:, 3] * _signed(c[:, 2]) >> 5)
    blue = c[:, 3] - (factor[:, 2] * _signed(c[:, 2]) >> 5) - (factor[:, 1] * _signed(c[:, 1]) >> 5)
    c[:, 1], c[:, 3] = red & 255, blue & 255
    return _joined(c)


def _uncross(pixels, width, height, bits, image):
    factor, c = _factors(image, width, bits, len(pixels)), _channels(pixels).astype(np.int32)
    red = c[:, 1] + (factor[:, 3] * _signed(c[:, 2]) >> 5)
    blue = c[:, 3] + (factor[:, 2] * _signed(c[:, 2]) >> 5) + (factor[:, 1] * _signed(red & 255) >> 5)
    c[:, 1], c[:, 3] = red & 255, blue & 255
    return _joined(c)


def _unpalette(pixels, width, height, bits, palette):
    packed = 1 << bits
    rows = (pixels >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
    each = 8 >> bits
    index = np.stack([rows >> np.uint32(k * each) & np.uint32((1 << each) - 1) for k in range(packed)], axis=-1).reshape(height, -1)[:, :width].reshape(-1)
    table = np.zeros((max(256, len(palette)), 4), np.uint8)
    table[: len(palette)] = palette
    return _joined(table[index])


def _predict(argb, width, height, bits, image):
    """What is left of each pixel without its prediction from those before it."""
    c = _channels(argb).astype(np.int32).reshape(height, width, 4)
    out = c.copy()
    for y, x, guess in _guesses(c, width, height, bits, image):
        out[y, x] = c[y, x] - guess & 255
    return _joined(out.reshape(-1, 4))


def _unpredict(pixels, width, height, bits, image):
    c = _channels(pixels).astype(np.int32).reshape(height, width, 4)
    for y, x, guess in _guesses(c, width, height, bits, image):
        c[y, x] = c[y, x] + guess & 255
    return _joined(c.reshape(-1, 4))


def _guesses(c, width, height, bits, image):
    """(row, column, prediction) of each pixel, from what ``c`` then holds of its neighbours."""
    across = width + (1 << bits) - 1 >> bits
    modes = (image >> np.uint32(8) & np.uint32(15)).reshape(-1).tolist()
    for y in range(height):
        for x in range(width):
            if not y:
                yield y, x, c[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif not x:
                yield y, x, c[y - 1, 0]
            else:
                over = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                yield y, x, _predicted(modes[(y >> bits) * across + (x >> bits)], c[y, x - 1], c[y - 1, x], over, c[y - 1, x - 1])


def _predicted(mode, left, top, over, corner):
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    if mode < 5:
        return (left, top, over, corner)[mode - 1]
    if mode == 5:
        return ((left + over >> 1) + top) >> 1
    if mode < 10:
        a, b = ((left, corner), (left, top), (corner, top), (top, over))[mode - 6]
        return a + b >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + over >> 1)) >> 1
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    middle = left + top >> 1
    half = middle - corner
    return np.clip(middle + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)


def padded(text: str | bytes | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, and those bytes with zeros up to a positive multiple of 64."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def feature_of(payload: bytes) -> str:
    """Rows of 16 pixels, mean sample, distinct samples, and the mean step between rows."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    step = np.abs(np.diff(a.astype(np.int16), axis=0)).mean() if len(a) > 1 else 0.0
    return f"rows={len(a)};mean={a.mean():.6f};distinct={np.count_nonzero(np.bincount(a.reshape(-1), minlength=256))};step={step:.6f}"


def media_table(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Store each text of ``docs(doc_id, text)`` as media, read it back and describe it.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, and with ``keep_media`` the file itself in ``media``.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                rows = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n, payload = padded(text)
                    media = encode(payload)
                    back = payload_of(media)
                    rows.append((i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(back), *([media] if keep_media else [])))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * (8 + keep_media)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_webp(spark, sf_dir: str) -> DataFrame:
    return media_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False)
