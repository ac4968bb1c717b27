"""Phrase collocations by mergeable Misra-Gries summaries and an exact second count.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into
words.  A phrase of up to ``longest`` words within a piece is *frequent* if it occurs
``least`` times in its language.

Summaries: grams are fingerprints that include the language; the range of fingerprints
is dealt to hash partitions.  Map tasks add up grams and send each partition its sums,
preceded by their mass.  A partition merges what arrives into one Misra-Gries summary
whose capacity exceeds mass / least, so what it subtracts from a counter stays below
``least`` and every frequent gram survives; memory is a multiple of the capacity,
however much arrives.  Survivors set bits of a table of bounded size.  A gram of two
words is only looked at if both words survived, a longer one if all its pairs did, since
a part occurs at least as often as the whole.

Second count: grams whose bit is set are counted exactly, as phrases.  A set bit can only
let too much through; the exact counts decide, so tables of any filling give the same
result.  A task adds up phrases by 64-bit fingerprints between two writes and writes the
phrases themselves, a row a hash partition; partitions add up by phrase.

Defined results: a null language is ``und``; a null or empty text has no phrase; repeated
rows count again; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, partitions, saved
from .tokens import ASCII_LOWER, doubled, text_chunks, word_hashes

_U = np.uint64
#: Byte classes: 0 a word's, 1 white space, 2 the end of a piece.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
#: Counters a hash partition holds at most; grams a map task holds; text it keeps of phrases.
COUNTERS, HELD, PHRASE_BYTES = 1 << 20, 1 << 22, 1 << 25
BITS = (20, 30)


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased ``data``, the row of each, and how many words of its piece are left from it on."""
    kind = _CLASS[data]
    word = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    if not len(starts):
        return starts, ends, starts, starts
    cut = np.cumsum((kind == 2) | edge[:-1])[starts]  # rises at each end of a piece and at each row
    last = np.flatnonzero(np.append(cut[1:] != cut[:-1], True))
    left = last[np.searchsorted(last, np.arange(len(starts)))] - np.arange(len(starts)) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1, left


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, their fingerprints, and the place of each row's name among them."""
    coded = pa.array(column.cast(pa.string()).fill_null("und")).dictionary_encode()
    names = coded.dictionary.to_pylist()
    marks = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], _U)
    return names, marks, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Grams:
    """Grams of one chunk of texts, by size; ``tables`` holds the bits of sizes 1, 2 and above."""

    def __init__(self, data: np.ndarray, off: np.ndarray, marks: np.ndarray, of_row: np.ndarray, tables: list[np.ndarray]) -> None:
        self.data = ASCII_LOWER[data]
        self.starts, self.ends, row, self.left = pieces(self.data, off)
        self.language = of_row[row]
        self.mark, self.tables = marks[self.language], tables
        self.plain = {1: word_hashes(self.data, self.starts, self.ends)} if len(self.starts) else {1: np.zeros(0, _U)}

    def hashes(self, size: int) -> np.ndarray:
        """Fingerprint with language and size of the gram from each word on, also where its piece is too short."""
        if size not in self.plain:
            half = 1 << (int(log2(size)) - (size & (size - 1) == 0))
            self.plain[size] = doubled(self._half(half), size - half)
        out = self.plain[size]
        with np.errstate(over="ignore"):
            mixed = ((out ^ self.mark[: len(out)]) + _U(size)) * _U(0x9E3779B97F4A7C15)
        return mixed ^ (mixed >> _U(29))

    def _half(self, size: int) -> np.ndarray:
        if size not in self.plain:
            self.plain[size] = doubled(self._half(size // 2), size // 2)
        return self.plain[size]

    def marked(self, size: int, table: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Which grams lie in one piece and have their bit set."""
        h = self.hashes(size)
        ok = self.left[: len(h)] >= size
        if among is not None:
            ok &= among
        at = np.flatnonzero(ok)
        place = h[at] >> _U(64 - int(log2(len(table) * 8)))
        ok[at] = (table[(place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1
        return ok

    def open(self, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
        """Places of the grams of each size whose smaller parts have survived so far."""
        ok, out = {}, {}
        if self.tables:
            ok[1] = self.marked(1, self.tables[0])
        if len(self.tables) > 1:
            ok[2] = self.marked(2, self.tables[1])
        for size in sizes:
            n = max(0, len(self.starts) - size + 1)
            may = self.left[:n] >= size
            part = max((k for k in ok if k < size), default=0)
            for k in range(size - part + 1) if part else ():
                may &= ok[part][k : k + n]
            out[size] = np.flatnonzero(may)
        return out

    def surviving(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, place and size of the grams whose bit and whose parts' bits are set."""
        found = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        ok = np.ones(len(self.starts) + 1, bool)
        for size in range(1, min(longest, len(self.starts)) + 1):
            ok = self.marked(size, self.tables[min(size, 3) - 1], ok[:-1] & ok[1:])
            at = np.flatnonzero(ok)
            found.append((self.hashes(size)[at], at, np.full(len(at), size)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(at, at + size)).decode()


def _added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    g, c = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g)
    g, c = g[order], c[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(c, first) if len(first) else c


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(grams)
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.diff(np.append(first, len(g)))


class Summary:
    """A Misra-Gries summary of weighted grams: no more than ``2 * capacity`` counters and the last addition are held."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.taken = capacity, 0
        self.grams, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams, self.counts = _added([self.grams, grams], [self.counts, counts.astype(np.int64)])
        if len(self.grams) > 2 * self.capacity:
            self.shrink()

    def shrink(self) -> None:
        """Subtract the largest counter beyond the capacity from all; each such step uses up capacity + 1 times as much mass."""
        if len(self.grams) > self.capacity:
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            keep = self.counts > cut
            self.grams, self.counts, self.taken = self.grams[keep], self.counts[keep] - cut, self.taken + cut

    def frequent(self, least: int) -> np.ndarray:
        """All grams that may have occurred ``least`` times."""
        return self.grams[self.counts + self.taken >= least]


def _dealt(grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash partition of each fingerprint, and its place there in 32 bits; both rise with the fingerprint."""
    v = (grams >> _U(32)) * _U(parts) + ((grams & _U(0xFFFFFFFF)) * _U(parts) >> _U(32))
    return v >> _U(32), (v & _U(0xFFFFFFFF)).astype(np.uint32)


def _places(part: int, inside: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Bits, by the first ``bits`` of a fingerprint, of all fingerprints at these places of a partition: one or two neighbours each."""
    base, inside = _U(part << bits), inside.astype(_U)
    low, high = ((base + (x << _U(bits) >> _U(32))) // _U(parts) for x in (inside, inside + _U(1)))
    return np.unique(np.minimum(np.concatenate([low, high]), _U((1 << bits) - 1)))


def _bits(least: int, mass: int) -> int:
    """Bits of a table with 16 for each gram that can be frequent, within ``BITS``."""
    return min(max(ceil(log2(max(2, 16 * mass // least))), BITS[0]), BITS[1])


def survivors(docs: DataFrame, sizes: tuple[int, ...], least: int, tables: list[np.ndarray], mass: int) -> tuple[np.ndarray, int]:
    """The bit table of the grams of ``sizes`` in ``docs(lang, text)`` that may be frequent, and the mass that was summed up.

    ``mass`` bounds the number of grams from above; partitions and bits follow it.
    """
    spark = docs.sparkSession
    parts = max(partitions(spark), ceil(mass / (least * COUNTERS)))
    bits = _bits(least, mass)
    given = spark.sparkContext.broadcast(tables)
    names = ["part", "kind", "mass", "grams", "counts"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            g, c = _added(grams, counts)
            part, inside = _dealt(g, parts)
            edge = np.searchsorted(part, np.arange(parts + 1, dtype=_U))
            some = np.flatnonzero(np.diff(edge))
            size = np.minimum(c, 0xFFFFFFFF).astype(np.uint32)
            for a in range(0, len(some), 256):
                own = some[a : a + 256]
                masses = [int(c[edge[p] : edge[p + 1]].sum()) for p in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([0] * len(own), pa.int8()), pa.array(masses, pa.int64()), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.binary())], names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array([1] * len(own), pa.int8()), pa.nulls(len(own), pa.int64()), pa.array([inside[edge[p] : edge[p + 1]].tobytes() for p in own], pa.binary()), pa.array([size[edge[p] : edge[p + 1]].tobytes() for p in own], pa.binary())], names
                )
            grams.clear()
            counts.clear()

        for batch in batches:
            _, marks, of_row = _languages(batch.column(0))
            for at, to, data, off in text_chunks(batch.column(1)):
                chunk = Grams(data, off, marks, of_row[at:to], given.value)
                for size, places in chunk.open(sizes).items():
                    if len(places):
                        g, c = _counted(chunk.hashes(size)[places])
                        grams.append(g)
                        counts.append(c)
                        held += len(g)
                if held > HELD:
                    g, c = _added(grams, counts)
                    grams[:], counts[:], held = [g], [c], len(g)
                    if held > HELD // 2:
                        yield from flush()
                        held = 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, summary = -1, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            place = _places(now, summary.frequent(least), parts, bits) if summary else np.zeros(0, _U)
            low = int(place[0]) >> 3 if len(place) else 0
            own = np.zeros(((int(place[-1]) >> 3) - low + 1) if len(place) else 0, np.uint8)
            np.bitwise_or.at(own, (place >> _U(3)).astype(np.int64) - low, (1 << (place & _U(7)).astype(np.uint8)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([total], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["low", "mass", "bits"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for part, kind, mass_of, g, c in zip(*columns, strict=True):
                if part != now:
                    if now >= 0:
                        yield from done()
                    now, total, summary = part, 0, None
                if kind == 0:
                    total += mass_of
                else:
                    summary = summary or Summary(total // least + 1)
                    summary.add(np.frombuffer(g, np.uint32), np.frombuffer(c, np.uint32))
        if now >= 0:
            yield from done()

    sent = docs.select("lang", "text").mapInArrow(sums, "part int, kind byte, mass long, grams binary, counts binary")
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part", "kind")
    found = dealt.mapInArrow(merge, "low long, mass long, bits binary").collect()  # all rows together are one table of `bits` bits
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in found:
        table[r["low"] : r["low"] + len(r["bits"])] |= np.frombuffer(r["bits"], np.uint8)
    given.destroy()
    return table, sum(r["mass"] for r in found)


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5) -> DataFrame:
    """``lang, size, phrase, f`` of all phrases of ``docs(lang, text)`` with f >= ``least``; size 0 holds each language's number of words."""
    size = docs.agg(F.sum(F.octet_length("text") + 1).alias("bytes")).first()["bytes"] or 0
    words, total = survivors(docs, (1,), least, [], size // 2)  # words have a separator each
    tables = [words]
    if longest > 1:
        tables.append(survivors(docs, (2,), least, tables, total)[0])
    if longest > 2:
        tables.append(survivors(docs, tuple(range(3, longest + 1)), least, tables, (longest - 2) * total)[0])
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(tables)
    parts = max(partitions(spark), sum(int(np.bitwise_count(t).sum()) for t in tables) >> 18)
    names = ["part", "lang", "phrases", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a hash partition and language: its phrases, a line each, and their counts; an empty phrase has the number of words."""
        known, told, text_bytes = np.zeros(0, _U), {}, 0
        grams, counts, held, total = [], [], 0, {}

        def row(part: int, lang: str, phrases: list[str], counts: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lang], pa.string()), pa.array(["\n".join(phrases)], pa.string()), pa.array([counts], pa.list_(pa.int64()))], names)

        def flush() -> Iterator[pa.RecordBatch]:
            g, c = _added(grams, counts)
            part, by = _dealt(g, parts)[0].tolist(), {}
            for p, x, n in zip(part, g.tolist(), c.tolist(), strict=True):
                lang, text = told[x]
                own = by.setdefault((p, lang), ([], []))
                own[0].append(text)
                own[1].append(n)
            for (p, lang), own in by.items():
                yield row(p, lang, *own)
            grams.clear()
            counts.clear()
            told.clear()

        for batch in batches:
            languages, marks, of_row = _languages(batch.column(0))
            for at, to, data, off in text_chunks(batch.column(1)):
                chunk = Grams(data, off, marks, of_row[at:to], given.value)
                for k, n in enumerate(np.bincount(chunk.language, minlength=len(languages)).tolist()):
                    total[languages[k]] = total.get(languages[k], 0) + n
                h, places, size = chunk.surviving(longest)
                if not len(h):
                    continue
                order = np.argsort(h)
                h = h[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                g = h[first]
                spot = np.searchsorted(known, g)
                new = np.flatnonzero((spot == len(known)) | (np.append(known, _U(0))[spot] != g))
                for k in new.tolist():
                    p, n = int(places[order[first[k]]]), int(size[order[first[k]]])
                    told[int(g[k])] = (languages[chunk.language[p]], text := chunk.phrase(p, n))
                    text_bytes += 100 + len(text)
                known = np.insert(known, spot[new], g[new])
                grams.append(g)
                counts.append(np.diff(np.append(first, len(h))))
                held += len(g)
                if held > HELD:
                    g, c = _added(grams, counts)
                    grams[:], counts[:], held = [g], [c], len(g)
                if text_bytes > PHRASE_BYTES:
                    yield from flush()
                    known, text_bytes, held = np.zeros(0, _U), 0, 0
        if grams:
            yield from flush()
        for lang, n in total.items():
            yield row(crc32(lang.encode()) % parts, lang, [""], [n])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = -1, {}

        def done() -> Iterator[pa.RecordBatch]:
            rows = [(lang, text.count(" ") + 1 if text else 0, text, n) for (lang, text), n in sums.items() if n >= least or not text]
            sums.clear()
            for a in range(0, len(rows), 10_000):
                columns = zip(*rows[a : a + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "size", "phrase", "f"])

        for batch in batches:
            for part, lang, phrases, c in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part != now:
                    yield from done()
                    now = part
                for text, n in zip(phrases.split("\n"), c, strict=True):
                    sums[lang, text] = sums.get((lang, text), 0) + n
        yield from done()

    sent = docs.select("lang", "text").mapInArrow(run, "part int, lang string, phrases string, counts array<long>")
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part")
    out = saved(dealt.mapInArrow(add, "lang string, size int, phrase string, f long"), "phrase-counts")
    given.destroy()
    return out


def _head(words: Column) -> Column:
    """The first words of the phrase, the last ones where ``words`` is negative."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), words)


def collocations(counts: DataFrame, most: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` from :func:`phrase_counts`: each language's ``most`` best phrases.

    A phrase of 2 words or more is cut after each of its first words; the cut of smallest
    floor(1000 a n / (l r)) counts, of equal ones the first.  A phrase is left out if a
    longer one that contains it occurs as often.  It suffices to look one word further: what
    lies between the two occurs as often as both.
    """
    phrases = counts.where("size >= 1").select("lang", "size", "phrase", "f")
    found = phrases.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    longer = found.where("size >= 3")
    covered = longer.select("lang", F.explode(F.array(_head(F.col("size") - 1), _head(1 - F.col("size")))).alias("phrase"), "a").distinct()
    left = found.join(covered, ["lang", "phrase", "a"], "left_anti")
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": _head(F.col("k")), "rest": _head(F.col("k") - F.col("size"))})
    part = phrases.select(F.col("lang"), F.col("phrase").alias("part"), "f")
    cuts = cuts.join(part.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(part.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    n = saved(counts.where("size = 0").select("lang", F.col("f").alias("n")), "language-words")  # a row a language
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    top = (wide("a", 16) * wide("n", 18) * F.lit(1000).cast("decimal(4,0)")).alias("top")
    cuts = cuts.join(n, "lang").withColumns({"top": top, "below": wide("l", 18) * wide("r", 18)})
    score = F.expr("cast(top div below as bigint)")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", place.cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    return collocations(phrase_counts(docs))
