"""Repeated passages: windows of consecutive words that also start in an earlier document.

Suffixes (word positions) are cut at the window length and sorted into prefix-partitioned
suffix trees.  A first pass keeps those that can repeat: every window holds a smallest
16-word fingerprint, equal windows hold equal ones, and only windows whose smallest one
occurs in two documents go on.  A second pass counts the prefixes of 1, 2, 4, ... words of
these in slots; a suffix's own prefix is the shortest whose slot is small enough for a
group in memory, so common beginnings are split by longer prefixes and rare ones are not.
In a group, suffixes are sorted by their path below the prefix; an inner node at full
depth is a repeat and gives every suffix in it the smallest document that has it.
Neighbouring repeats of a document make up its maximal repeated passages (``spans``).

Paths are fingerprints: two of 64 bits, over the first and the last 32 words of the
window, stand for its words.  Tasks fold equal suffixes before sending, so a passage that
very many documents share reaches its group once a task.

Defined results: null texts have no words; rows with a null doc_id neither lose words
nor cause others to; rows that share doc_id and text get equal results; texts that share
a doc_id count as documents of their own, in the order of a hash; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, forget, keyed, partitions, saved
from .tokens import doubled, text_chunks, word_hashes, word_spans

ANCHOR = 16
BROADCAST_ANCHORS = 2_000_000
_U = np.uint64


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    extra = width - have
    return np.minimum(out[: len(out) - extra], out[extra:]) if extra else out


def _windows(column: pa.Array, window: int) -> Iterator[tuple]:
    """Yield (first row, rows, row and position of each window, its anchor, its prefixes of 1, 2, 4, ... words, its path)."""
    for at, to, data, off in text_chunks(column):
        starts, ends, first = word_spans(data, off)
        words = word_hashes(data, starts, ends)
        n = len(words) - window + 1
        if n <= 0:
            continue
        row = np.repeat(np.arange(to - at), np.diff(first))
        inside = np.flatnonzero(row[:n] == row[window - 1 :])
        if not len(inside):
            continue
        grams, size = [words], 1
        while size * 2 <= window:
            grams.append(doubled(grams[-1], size))
            size *= 2
        short = min(ANCHOR, size)
        anchor = _sliding_min(grams[short.bit_length() - 1], window - short + 1)
        yield at, to, row[inside], (inside - first[row[inside]]).astype(np.int32), anchor[inside], [g[inside] for g in grams], grams[-1][inside + window - size]


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, anchor, n``: smallest fingerprints of each document and the windows around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            for at, _, row, _, anchor, _, _ in _windows(batch.column(1), window):
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])))
                n = np.diff(np.append(new, len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + row[new]]), pa.array(anchor[new].view(np.int64)), pa.array(n)], ["doc_id", "anchor", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, anchor long, n long")


def _candidates(docs: DataFrame, window: int) -> tuple[DataFrame, int, np.ndarray | None]:
    """Documents with a shared anchor, the number of windows around such anchors, and the anchors.

    With more than ``BROADCAST_ANCHORS`` of them each document comes with its own shared
    anchors in ``anchors`` instead.
    """
    found = saved(_anchors(docs, window), "anchors")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("n")).where("lo < hi").select("anchor", "n")
    shared = saved(shared, "shared-anchors")
    size = shared.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if size["k"] <= BROADCAST_ANCHORS:
        marks = np.sort(shared.select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(_U))
        ids = saved(found.join(F.broadcast(shared.select("anchor")), "anchor", "left_semi").select("doc_id").distinct(), "candidate-ids")
        forget(found)
        return docs.join(bounded(ids), "doc_id", "left_semi").withColumn("anchors", F.lit(None).cast("array<long>")), size["n"] or 0, marks
    own = found.select("doc_id", "anchor").join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    return saved(docs.join(own, "doc_id"), "candidates"), size["n"] or 0, None


def _fold(ids: np.ndarray, pos: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (halves, document), and for each row the smallest document of its window."""
    order = np.lexsort((pos, ids, two, one))
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    least = np.repeat(ids[order][first], np.diff(np.append(first, len(order))))
    return order, least


def _packed(key: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    for a, b in zip(cut.tolist(), np.append(cut, len(key))[1:].tolist(), strict=True):
        yield int(key[a]), [c[a:b].tobytes() for c in columns]


def _open_windows(batch: pa.RecordBatch, window: int, marks: np.ndarray | None) -> Iterator[tuple]:
    """Ids, positions, prefixes and path end of the windows of ``batch(doc_id, text, anchors)`` around shared anchors."""
    ids, lists = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False), batch.column(2)
    for at, _, row, pos, anchor, grams, tail in _windows(batch.column(1), window):
        if marks is not None:
            keep = marks[np.minimum(np.searchsorted(marks, anchor), len(marks) - 1)] == anchor if len(marks) else np.zeros(len(anchor), bool)
        else:
            keep, cut = np.zeros(len(row), bool), np.searchsorted(row, np.arange(row[-1] + 2))
            for r in np.flatnonzero(np.diff(cut)).tolist():
                own = np.sort(lists[at + r].values.to_numpy().view(_U))
                mine = anchor[cut[r] : cut[r + 1]]
                keep[cut[r] : cut[r + 1]] = own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine
        yield ids[at + row[keep]], pos[keep], [g[keep] for g in grams], tail[keep]


def _heavy_prefixes(candidates: DataFrame, window: int, marks: np.ndarray | None, slots: int, most: int) -> list[np.ndarray]:
    """For each prefix length, the slots with more than ``most`` windows."""
    given, levels = candidates.sparkSession.sparkContext.broadcast(marks), window.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((levels, slots), np.int64)
        for batch in batches:
            for _, _, grams, _ in _open_windows(batch, window, given.value):
                for k, g in enumerate(grams):
                    counts[k] += np.bincount((g & _U(slots - 1)).astype(np.int64), minlength=slots)
        level, slot = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(slot), pa.array(counts[level, slot])], ["level", "slot", "n"])

    found = candidates.select("doc_id", "text", "anchors").mapInArrow(run, "level int, slot long, n long").groupBy("level", "slot").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
    return [np.array(sorted(r["slot"] for r in found if r["level"] == k), np.int64) for k in range(levels)]


def _groups_of(grams: list[np.ndarray], tail: np.ndarray, heavy: list[np.ndarray], slots: int) -> np.ndarray:
    """Fingerprint of each window's shortest prefix that is not heavy; of the whole window if all are."""
    key = grams[-1] * _U(0x9E3779B97F4A7C15) ^ tail
    for g, full in reversed(list(zip(grams, heavy, strict=True))):
        light = ~np.isin((g & _U(slots - 1)).astype(np.int64), full) if len(full) else np.ones(len(g), bool)
        key = np.where(light, g, key)
    return key


def _sent(candidates: DataFrame, window: int, marks: np.ndarray | None, heavy: list[np.ndarray], slots: int, groups: int, parts: int, limit: int = 1_500_000) -> DataFrame:
    """Packed windows of ``candidates`` by group (``bucket``), folded by task; without a path those known to be later."""
    names = ["bucket", "starts", "ids", "one", "two"]
    types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    given = candidates.sparkSession.sparkContext.broadcast((marks, heavy))

    def send(ids: np.ndarray, pos: np.ndarray, one: np.ndarray, two: np.ndarray, prefix: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, least = _fold(ids, pos, one, two)
        later = ids[order] > least
        rows = [(part, *packed, None, None) for part, packed in _by_part(ids[order[later]], pos[order[later]], parts)]
        kept = order[~later]
        bucket = ((prefix[kept] >> _U(20)) % _U(groups)).astype(np.int32)
        by = np.lexsort((pos[kept], ids[kept], bucket))
        kept, bucket = kept[by], bucket[by]
        for b, (starts, docs_, x, y) in _packed(bucket, [pos[kept], ids[kept], one[kept], two[kept]]):
            rows.append((b, starts, docs_, x, y))
        for k in range(0, len(rows), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 500], strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, (marks, heavy) = 0, given.value
        for batch in batches:
            for ids, pos, grams, tail in _open_windows(batch, window, marks):
                held.append((ids, pos, grams[-1], tail, _groups_of(grams, tail, heavy, slots)))
                size += len(ids)
                if size > limit:
                    yield from send(*(np.concatenate([h[k] for h in held]) for k in range(5)))
                    held, size = [], 0
        if held:
            yield from send(*(np.concatenate([h[k] for h in held]) for k in range(5)))

    return candidates.select("doc_id", "text", "anchors").mapInArrow(run, "bucket int, starts binary, ids binary, one binary, two binary")


def _by_part(ids: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[tuple[int, list[bytes]]]:
    """Positions and documents packed by a share of the documents, in order; ids that share a divisor spread too."""
    part = ((ids.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.int64) % parts
    order = np.lexsort((pos, ids, part))
    return _packed(part[order], [pos[order], ids[order]])


def _later_starts(sent: DataFrame, parts: int) -> DataFrame:
    """``doc_id, starts``: packed positions of windows that an earlier document has."""

    def subtree(key: tuple, part: pa.Table) -> pa.Table:
        known = part.filter(pc.is_null(part.column("one")))
        rest = part.filter(pc.is_valid(part.column("one")))
        pos, ids, one, two = (np.frombuffer(b"".join(rest.column(c).to_pylist()), t) for c, t in (("starts", np.int32), ("ids", np.int64), ("one", _U), ("two", _U)))
        order, least = _fold(ids, pos, one, two)
        gone = order[ids[order] > least]
        rows = [(share, *packed) for share, packed in _by_part(ids[gone], pos[gone], parts)]
        rows += zip(*(known.column(c).to_pylist() for c in ("bucket", "starts", "ids")), strict=True)
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("part", pa.int32()), ("starts", pa.binary()), ("ids", pa.binary())))})

    def gather(key: tuple, part: pa.Table) -> pa.Table:
        pos, ids = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("starts", np.int32), ("ids", np.int64)))
        order = np.lexsort((pos, ids))
        found = [(doc, starts) for doc, (starts,) in _packed(ids[order], [pos[order]])]
        return pa.table({"doc_id": pa.array([d for d, _ in found], pa.int64()), "starts": pa.array([x for _, x in found], pa.binary())})

    found = sent.groupBy("bucket").applyInArrow(subtree, "part int, starts binary, ids binary")
    return found.groupBy("part").applyInArrow(gather, "doc_id long, starts binary")


def _cover(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    """Results of ``docs(id, text, starts)``; starts may be null."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<struct<first:int,last:int>>" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                rows = []
                for i, text, starts in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    gone = np.zeros(len(words) + 1, np.int32)
                    at = np.frombuffer(starts or b"", np.int32)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                    mask = np.cumsum(gone[:-1]) > 0
                    removed = int(mask.sum())
                    kept = b" ".join([w for w, m in zip(words, mask.tolist(), strict=True) if not m] if removed else words)
                    out = (i, len(words), removed, hashlib.sha256(kept).hexdigest())
                    if texts:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                        spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                        out += (kept.decode("utf-8", "surrogatepass") if removed else text, spans)
                    rows.append(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], [f.split()[0] for f in schema.split(", ")])

    return docs.select("id", "text", "starts").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = 50, texts: bool = False, group_rows: int = 2_000_000) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs(doc_id, text)``.

    With ``texts`` also kept_text (the text itself where nothing was removed, else the
    kept words joined by spaces) and the removed spans of words.  ``group_rows`` bounds
    the windows of a group.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(F.col("__key").alias("doc_id"), "text", F.col("doc_id").alias("id"))
    candidates, windows, marks = _candidates(rows.where(F.col("doc_id").isNotNull()), window)
    slots = 1 << max(12, (32 * windows // group_rows).bit_length())
    heavy = _heavy_prefixes(candidates, window, marks, slots, group_rows // 4)
    groups = max(2 * partitions(docs.sparkSession), 4 * windows // group_rows)
    parts = max(partitions(docs.sparkSession), groups // 4)
    starts = saved(_later_starts(_sent(candidates, window, marks, heavy, slots, groups, parts), parts), "starts")
    touched = bounded(starts.select("doc_id"))
    some = _cover(rows.join(touched, "doc_id", "left_semi").join(starts, "doc_id"), window, texts)
    rest = rows.join(touched, "doc_id", "left_anti").withColumn("starts", F.lit(None).cast("binary"))
    return some.unionByName(_cover(rest, window, texts))


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
