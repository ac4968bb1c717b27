"""Exact Jaccard self-join of documents over word shingles, in a metric space.

Documents with equal shingle sets form a class and are represented by their smallest
doc_id.  Nearly all pairs of sets lie at distance 1, where no pivot set tells them
apart, so the first pivots are single shingles: a set belongs to the regions of its
first few shingles in a common order (rarer ones first, by a count sketch of the whole
corpus and by exact counts of the shingles that prefixes are mostly made of), as many as
make any two linked sets meet in one.  Pairs of a small
region must pass bounds on size, position and parity; a larger region is kept as a star.
What stays connected is a space: linked sets are always in one space.

Spaces are joined by pivots, exactly and recursively.  Some members become pivots and
the distance of each member to them is taken.  Members within the link radius of a pivot
are linked through it.  Each member belongs to the Voronoi cell of its nearest pivot, or
to the outer cell if all are far, and by the triangle inequality is replicated into
every other cell that may hold a partner: those whose pivot is at most two radii further
away than its own, and not further than the cell's reach plus one radius.  Cells are
joined in the same way until they are connected or small; small ones are compared pair by
pair.  A space larger than ``space_bytes`` is first cut into cells by Spark itself, and
one that its pivots cannot cut is compared as pairs of blocks.

Two sets are the same class when their sizes and two 64-bit sums of shingle fingerprints
agree; shingles are told apart by 64-bit fingerprints.

Defined results: null, empty and blank texts have no shingles and link with nothing;
rows with a null doc_id keep a null component; rows that share a doc_id count as one
document, linked through each of its texts; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded, forget, partitions, saved
from .graph import components
from .tokens import shingle_sets

SLOTS = 1 << 20
_BLOCK = 1 << 14
_U = np.uint64
PAIRS_UP_TO = 12
#: Sets that are compared without pivots: a space of two is a pair.
LEAF = 2
PIVOTS = 8
NEAR = 0.6
HOT_TOKEN = 1 << 17
LOW = _U(int(0.35 * 2**64))
PLACES = 1 << 24
FREQUENT = 1 << 21
SPACE_BYTES = 64 << 20


def _slots(values: np.ndarray) -> np.ndarray:
    return (values >> _U(44)).astype(np.int64)


BITS = 2048
_PARITY_BLOCK = 1 << 22


def _parity(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set, the parity of its members in each of at least ``BITS`` cells.

    The number of cells is the first power of two that is no smaller than the set, so
    long sets are told apart as well as short ones.  Two sets differ in at least as many
    members as their parities differ in bits.
    """
    n = np.diff(bounds)
    cells = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.cumsum(cells)
    out: list[bytes] = []
    a = 0
    while a < len(n):
        start = ends[a] - cells[a]
        b = max(a + 1, int(np.searchsorted(ends, start + _PARITY_BLOCK, "right")))
        v, row = values[bounds[a] : bounds[b]], np.repeat(np.arange(a, b), n[a:b])
        at = (ends - cells)[row] - start + (v & (cells[row] - 1).astype(_U)).astype(np.int64)
        packed = np.packbits((np.bincount(at, minlength=ends[b - 1] - start) & 1).astype(np.uint8))
        cut = (ends[a:b] - start) // 8
        out += [packed[x:y].tobytes() for x, y in zip(cut - cells[a:b] // 8, cut, strict=True)]
        a = b
    return out


def _bits_apart(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many bits parities differ; the longer of two is folded to the shorter one's cells."""
    x, y = ([np.frombuffer(v, _U) for v in side.to_pylist()] for side in (x, y))
    least = np.zeros(len(x), np.int64)
    shapes = np.array([(len(v), len(w)) for v, w in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    for width in np.unique(shapes, axis=0):
        rows = np.flatnonzero((shapes == width).all(axis=1))
        v, w = (np.bitwise_xor.reduce(np.stack([side[r] for r in rows]).reshape(len(rows), -1, width.min()), axis=1) for side in (x, y))
        least[rows] = np.bitwise_count(v ^ w).sum(axis=1, dtype=np.int64)
    return least


def summaries(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """One pass: per document its set size, two set fingerprints and its parity; per task its count sketch.

    Tasks also send the shingles of the lowest hashes, of which prefixes are mostly made,
    to be counted one by one.
    """
    names = ["doc_id", "n", "s1", "s2", "bits", "block", "counts", "bucket", "low"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def batch_of(rows: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, t)) for c, t in zip(names, types, strict=True)], names)

    def sent(low: np.ndarray) -> pa.RecordBatch:
        low = np.sort(low)
        where = ((low >> _U(32)) % _U(buckets)).astype(np.int32)
        order = np.argsort(where, kind="stable")
        cut = np.flatnonzero(np.diff(where[order], prepend=-1))
        low = low[order].astype(np.uint32)
        packed = [low[a:b].tobytes() for a, b in zip(cut.tolist(), np.append(cut, len(low))[1:].tolist(), strict=True)]
        return batch_of(len(cut), bucket=pa.array(where[order][cut], pa.int32()), low=pa.array(packed, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size, seen = np.zeros(SLOTS, np.int64), [], 0, set()
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for at, values, bounds in shingle_sets(batch.column(1), words):
                counts += np.bincount(_slots(values), minlength=SLOTS)
                n = np.diff(bounds)
                one, two = _sums(values, bounds)
                yield batch_of(
                    len(n), doc_id=ids.slice(at, len(n)), n=pa.array(n), s1=pa.array(one.view(np.int64)), s2=pa.array(two.view(np.int64)), bits=pa.array(_parity(values, bounds), pa.binary())
                )
                fresh = np.array([not (mark in seen or seen.add(mark)) for mark in one.tolist()], bool)
                held.append(values[(values < LOW) & np.repeat(fresh, n)])
                size += len(held[-1])
                if size > 4_000_000:
                    yield sent(np.concatenate(held))
                    held, size, seen = [], 0, set()
        if size:
            yield sent(np.concatenate(held))
        k = SLOTS // _BLOCK
        yield batch_of(k, block=pa.array(np.arange(k, dtype=np.int32)), counts=pa.array([counts[b * _BLOCK : (b + 1) * _BLOCK].tobytes() for b in range(k)], pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bits binary, block int, counts binary, bucket int, low binary")


def _slot_counts(summary: DataFrame) -> np.ndarray:
    """The corpus's count sketch: in how many sets shingles of each slot occur."""

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BLOCK, np.int64)
        for part in parts:
            for c in part.column("counts").to_pylist():
                total += np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

    rows = summary.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    counts = np.zeros(SLOTS, np.int64)
    for r in rows:
        counts[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.int64)
    return counts


def _frequent(summary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places (of the low 32 bits, cut to ``PLACES``) of the counted shingles that exceed ``PAIRS_UP_TO``, and their levels.

    They only order shingles, so the least frequent of more than ``FREQUENT`` may be left out.
    """

    def count(key: tuple, part: pa.Table) -> pa.Table:
        found, n = np.unique(np.frombuffer(b"".join(part.column("low").to_pylist()), np.uint32), return_counts=True)
        keep = n > PAIRS_UP_TO
        return pa.table({"place": pa.array((found[keep] >> np.uint32(8)).astype(np.int64)), "level": pa.array(np.log2(n[keep]).astype(np.int32))})

    found = saved(summary.where("bucket is not null").select("bucket", "low").groupBy("bucket").applyInArrow(count, "place long, level int"), "frequent")
    least, total = 0, 0
    for r in found.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > FREQUENT:
            least = r["level"] + 1
            break
    kept = found.where(F.col("level") >= least).toPandas()
    return kept["place"].to_numpy(np.int64), kept["level"].to_numpy(np.uint8)


def _levels(counts: np.ndarray) -> np.ndarray:
    """How many times (as a power of two) each sketch slot exceeds the mean slot."""
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / max(8.0, counts.mean())))).astype(np.uint8)


def _sums(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    totals = [np.append(np.zeros(1, _U), np.cumsum(v)) for v in (values, values * values ^ (values >> _U(17)))]
    return [t[bounds[1:]] - t[bounds[:-1]] for t in totals]


def _prefix(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first shingles can hold the first one shared with a linked set: of any size, and no smaller than itself."""
    return n - (percent * n + 99) // 100 + 1, n + (-2 * percent * n) // (100 + percent) + 1


def _dealt(tokens: np.ndarray, marks: np.ndarray, n: np.ndarray, rank: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One packed row a bucket of shingles; those of hot slots go as finished edges to some bucket."""
    names, types = ["bucket", "tokens", "marks", "sizes", "ranks", "a", "b"], [pa.int32(), *[pa.binary()] * 6]
    is_hot = np.isin(_slots(tokens), hot) if len(hot) else np.zeros(len(tokens), bool)
    rows = []
    if is_hot.any():
        a, b = marks[is_hot], tokens[is_hot]
        rows.append((int(a[0] % _U(buckets)), None, None, None, None, a.tobytes(), b.tobytes()))
        tokens, marks, n, rank = tokens[~is_hot], marks[~is_hot], n[~is_hot], rank[~is_hot]
    where = (tokens % _U(buckets)).astype(np.int32)
    order = np.argsort(where, kind="stable")
    where, columns = where[order], ((tokens[order] >> _U(32)).astype(np.uint32), marks[order], n[order], rank[order])
    cut = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, int)
    for a, b in zip(cut.tolist(), np.append(cut, len(where))[1:].tolist(), strict=True):
        rows.append((int(where[a]), *(c[a:b].tobytes() for c in columns), None, None))
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), types, strict=True)], names)


def _edges_of(token: np.ndarray, mark: np.ndarray, n: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Distinct edges of one bucket: a < b, their sizes, and whether the edge is part of a star."""
    order = np.lexsort((rank, mark, token))
    token, mark, n, rank = token[order], mark[order], n[order], rank[order]
    new = np.append(True, (token[1:] != token[:-1]) | (mark[1:] != mark[:-1])) if len(token) else np.zeros(0, bool)
    token, mark, n, rank = token[new], mark[new], n[new], rank[new]
    probe, index = _prefix(n, percent)
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
    size = np.diff(np.append(first, len(token)))
    asked = np.add.reduceat((rank < index).astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool)
    left, right, star = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, bool)]
    for k in np.unique(size[(size > 1) & (size <= PAIRS_UP_TO) & asked]).tolist():
        i, j = np.triu_indices(k, 1)
        at = first[(size == k) & asked]
        x, y = (at[:, None] + i).reshape(-1), (at[:, None] + j).reshape(-1)
        room = np.minimum(n[x] - rank[x], n[y] - rank[y])
        ok = (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent) & (room * (100 + percent) >= (n[x] + n[y]) * percent)
        left.append(x[ok])
        right.append(y[ok])
        star.append(np.zeros(int(ok.sum()), bool))
    large = (size > PAIRS_UP_TO) & asked
    if large.any():
        # Members in the order of size; where the next size is too far off, a new star begins.
        inside = np.repeat(large, size)
        region = np.repeat(np.arange(len(first)), size)[inside]
        at = np.flatnonzero(inside)[np.lexsort((mark[inside], n[inside], region))]
        region = np.repeat(np.arange(len(first)), size)[at]
        cut = np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (n[at][:-1] * 100 < n[at][1:] * percent)))
        centre = np.minimum.reduceat(mark[at], cut)
        group = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(at))))
        is_centre = mark[at] == centre[group]
        place = np.zeros(len(cut), int)
        place[group[is_centre]] = at[is_centre]
        left.append(place[group[~is_centre]])
        right.append(at[~is_centre])
        star.append(np.ones(int((~is_centre).sum()), bool))
    x, y, star = np.concatenate(left), np.concatenate(right), np.concatenate(star)
    turned = mark[x] > mark[y]
    x, y = np.where(turned, y, x), np.where(turned, x, y)
    order = np.lexsort((star, mark[y], mark[x]))
    x, y, star = x[order], y[order], star[order]
    new = np.append(True, (mark[x][1:] != mark[x][:-1]) | (mark[y][1:] != mark[y][:-1]) | (star[1:] != star[:-1])) if len(x) else np.zeros(0, bool)
    x, y, star = x[new], y[new], star[new]
    return mark[x].view(np.int64), mark[y].view(np.int64), n[x], n[y], star


def candidate_edges(docs: DataFrame, counts: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int, words: int, buckets: int) -> DataFrame:
    """``a, b, na, nb, star``: marks of classes that share a prefix shingle.

    Pairs of a small region must fit in size and position; of a larger region each member
    is joined with one of them (``star``), and where the sketch calls a shingle hot, with
    the shingle itself, so that no hot region is gathered.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((_levels(counts), np.flatnonzero(counts > HOT_TOKEN), *frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (level, hot, place, often), held, size, seen = given.value, [], 0, set()
        known = np.zeros(PLACES, np.uint8)
        known[place] = often
        for batch in batches:
            null = np.asarray(batch.column(0).is_null())
            for at, values, bounds in shingle_sets(batch.column(1), words):
                n = np.diff(bounds)
                sums = _sums(values, bounds)
                fresh = np.zeros(len(n), bool)
                for r, mark in enumerate(zip(n.tolist(), sums[0].tolist(), sums[1].tolist(), strict=True)):
                    if mark[0] and not null[at + r] and mark not in seen:
                        seen.add(mark)
                        fresh[r] = True
                row = np.repeat(np.arange(len(n)), n)
                rare = np.maximum(level[_slots(values)], known[((values & _U(0xFFFFFFFF)) >> _U(8)).astype(np.int64)])
                values = values[np.lexsort((values, rare, row))]
                rank = np.arange(len(row)) - bounds[row]
                keep = (rank < _prefix(n, percent)[0][row]) & fresh[row]
                row, rank = row[keep], rank[keep]
                held.append((values[keep], sums[0][row], n[row].astype(np.uint32), np.minimum(rank, 65535).astype(np.uint16)))
                size += len(row)
                if size > 2_000_000:
                    yield from _dealt(*(np.concatenate([h[k] for h in held]) for k in range(4)), hot, buckets)
                    held, size, seen = [], 0, set()
        if held:
            yield from _dealt(*(np.concatenate([h[k] for h in held]) for k in range(4)), hot, buckets)

    def meet(key: tuple, part: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(x for x in part.column(name).to_pylist() if x), kind)
        a, b, na, nb, star = _edges_of(read("tokens", np.uint32), read("marks", _U), read("sizes", np.uint32).astype(np.int64), read("ranks", np.uint16).astype(np.int64), percent)
        x, y = read("a", np.int64), read("b", np.int64)
        zero = np.zeros(len(x), np.int64)
        columns = ((a, x), (b, y), (na, zero), (nb, zero), (star, zero == 0))
        return pa.table({k: pa.array(np.concatenate(c)) for k, c in zip(("a", "b", "na", "nb", "star"), columns, strict=True)})

    sent = docs.select("doc_id", "text").mapInArrow(run, "bucket int, tokens binary, marks binary, sizes binary, ranks binary, a binary, b binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long, na long, nb long, star boolean").distinct()


def _plausible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b, na, nb)`` whose parities differ in few enough bits to link; exact, no link is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = _bits_apart(batch.column(4), batch.column(5))
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = pa.array(least * (100 + percent) <= size * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(2)], ["a", "b"])

    left, right = bits.select(F.col("mark").alias("a"), F.col("bits").alias("x")), bits.select(F.col("mark").alias("b"), F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def _distances(flat: np.ndarray, starts: np.ndarray, n: np.ndarray, pivot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set in ``flat`` to the pivot set, and which of them link with it."""
    hit = pivot[np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)] == flat
    same = np.add.reduceat(hit.astype(np.int64), starts)
    union = n + len(pivot) - same
    return 1.0 - same / union, 100 * same >= percent * union


class Sets:
    """Some shingle sets in one array, and which of them are connected so far."""

    def __init__(self, ids: np.ndarray, packed: list[bytes], percent: int) -> None:
        n = np.array([len(p) // 8 for p in packed], np.int64)
        order = np.argsort(n, kind="stable")
        self.ids, self.n, self.percent = ids[order], n[order], percent
        self.sets = [np.frombuffer(packed[k], _U) for k in order.tolist()]
        self.root = list(range(len(ids)))
        self.links: list[tuple[int, int]] = []
        #: Components that each step has united.
        self.united = {"copies": 0, "pivots": 0, "pairs": 0}
        first: dict[int, int] = {}
        for k, i in enumerate(self.ids.tolist()):  # rows of one id are one document
            self.unite(first.setdefault(i, k), k)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def unite(self, i: int, j: int, step: str = "pairs") -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)
            self.united[step] += 1

    def roots(self, group: np.ndarray) -> np.ndarray:
        return np.array([self.find(i) for i in group.tolist()], np.int64)

    def linked(self, i: int, j: int) -> bool:
        x, y = self.sets[i], self.sets[j]
        if len(x) > len(y):
            x, y = y, x
        if not len(x):
            return False
        same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return 100 * same >= self.percent * (len(x) + len(y) - same)

    def near_pairs(self, group: np.ndarray) -> None:
        """Compare all of ``group``, sorted by size, that parities and sizes leave open."""
        group = np.sort(group)
        width = max(BITS, 1 << int(np.ceil(np.log2(max(1, self.n[group].max())))))
        flat, row = np.concatenate([self.sets[i] for i in group.tolist()]), np.repeat(np.arange(len(group)), self.n[group])
        n = self.n[group]
        parity = np.zeros((len(group), width // 8), np.uint8)
        for a in range(0, len(group), 256):
            b = min(a + 256, len(group))
            lo, hi = np.searchsorted(row, (a, b))
            at = (row[lo:hi] - a) * width + (flat[lo:hi] & _U(width - 1)).astype(np.int64)
            parity[a:b] = np.packbits((np.bincount(at, minlength=(b - a) * width) & 1).astype(np.uint8)).reshape(b - a, -1)
        parity = parity.view(_U)
        block = max(1, (1 << 21) // max(1, len(group) * parity.shape[1] // 8))
        for a in range(0, len(group), block):
            b = min(a + block, len(group))
            c = int(np.searchsorted(n, n[b - 1] * 100 // self.percent, "right"))
            roots = self.roots(group[a:c])
            if (roots == roots[0]).all():
                continue
            apart = np.bitwise_count(parity[a:b, None] ^ parity[None, a:c]).sum(axis=2, dtype=np.int64)
            size = n[a:b, None] + n[None, a:c]
            open_ = (apart * (100 + self.percent) <= size * (100 - self.percent)) & (n[a:b, None] * 100 >= n[None, a:c] * self.percent) & (roots[: b - a, None] != roots[None, :])
            for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(open_, 1))), strict=True):
                i, j = int(group[a + i]), int(group[a + j])
                if self.find(i) != self.find(j) and self.linked(i, j):
                    self.unite(i, j)

    def cells(self, group: np.ndarray, pivots: np.ndarray) -> list[np.ndarray]:
        """Link ``group`` through the pivots; its Voronoi cells, each with those outside that may hold a partner."""
        flat, n = np.concatenate([self.sets[i] for i in group.tolist()]), self.n[group]
        starts = np.cumsum(n) - n
        distance = np.ones((len(group), len(pivots)))
        for k, p in enumerate(pivots.tolist()):
            distance[:, k], link = _distances(flat, starts, n, self.sets[p], self.percent)
            for i in group[link].tolist():
                self.unite(i, p, "pivots")
        return [group[inside] for inside in voronoi(distance, 1.0 - self.percent / 100)]

    def join(self, leaf: int = LEAF, pivots: int = PIVOTS, seed: int = 4) -> np.ndarray:
        """Connect all that is linked; returns the smallest id of each row's component."""
        rng = np.random.default_rng(seed)
        work = [np.flatnonzero(self.n > 0)]
        while work:
            group = work.pop()
            roots = self.roots(group)
            if not len(group) or (roots == roots[0]).all():
                continue
            if len(group) <= leaf:
                self.near_pairs(group)
                continue
            mixed = rng.permutation(len(group))
            _, one = np.unique(roots[mixed], return_index=True)  # a pivot of each component first
            chosen = np.append(rng.permutation(mixed[one]), mixed)[:pivots]
            for cell in self.cells(group, group[np.unique(chosen)]):
                if len(cell) * 5 > len(group) * 4:  # pivots hardly cut it
                    self.near_pairs(cell)
                else:
                    work.append(cell)
        roots = self.roots(np.arange(len(self.ids)))
        least = np.full(len(roots), np.iinfo(np.int64).max)
        np.minimum.at(least, roots, self.ids)
        return least[roots]


def voronoi(distance: np.ndarray, radius: float) -> list[np.ndarray]:
    """Masks of the cells by distances to pivots: any two within ``radius`` share a cell.

    A member whose nearest pivot is further than ``NEAR`` belongs to the outer cell (the
    last one), into which all that are further than NEAR - radius come.
    """
    least, home, radius = distance.min(axis=1), distance.argmin(axis=1), radius + 1e-9
    outer, out = least > NEAR, []
    for k in range(distance.shape[1]):
        core = (home == k) & ~outer
        if core.any():
            reach = distance[core, k].max() + radius
            out.append(core | (distance[:, k] <= np.minimum(least + 2 * radius, reach)))
    if outer.any():
        out.append(least > NEAR - radius)
    return out


def _join_spaces(members: DataFrame, percent: int, buckets: int) -> DataFrame:
    """``id, head``: the smallest id connected with each id within its space, from ``members(space, id, shingles)``."""

    def join(key: tuple, part: pa.Table) -> pa.Table:
        space = part.column("space").to_numpy()
        order = np.argsort(space, kind="stable")
        ids, packed = part.column("id").to_numpy()[order], part.column("shingles").combine_chunks()
        cut = np.flatnonzero(np.append(True, np.diff(space[order]) != 0))
        heads = np.empty(len(ids), np.int64)
        for a, b in zip(cut.tolist(), np.append(cut, len(ids))[1:].tolist(), strict=True):
            heads[a:b] = _heads(ids[a:b], [packed[k].as_buffer().to_pybytes() for k in order[a:b].tolist()], percent)
        return pa.table({"id": ids, "head": heads})

    bucket = F.pmod(F.xxhash64("space"), F.lit(buckets)).alias("bucket")
    return members.select(bucket, "space", "id", "shingles").groupBy("bucket").applyInArrow(join, "id long, head long")


def _heads(ids: np.ndarray, packed: list[bytes], percent: int) -> np.ndarray:
    found = Sets(ids, packed, percent)
    least = dict(zip(found.ids.tolist(), found.join().tolist(), strict=True))
    return np.array([least[i] for i in ids.tolist()], np.int64)


def _cut_spaces(members: DataFrame, percent: int, space_bytes: int, pivots: int, rounds: int = 12) -> tuple[DataFrame, list[DataFrame]]:
    """Cut spaces of more than ``space_bytes`` into cells; returns the members and the links found on the way.

    Each round takes pivots from every such space and replaces it by its cells.  One that
    hardly gets smaller is dealt into blocks instead, and every two blocks form a space.
    """
    spark, ready, links = members.sparkSession, [], []
    for turn in range(rounds):
        sizes = saved(members.groupBy("space").agg(F.sum(F.octet_length("shingles")).alias("bytes"), F.count("*").alias("rows")).where(F.col("bytes") > space_bytes), "large-spaces")
        if sizes.isEmpty():
            break
        large = bounded(sizes)
        ready.append(members.join(large.select("space"), "space", "left_anti"))
        wide = saved(members.join(large, "space"), "wide")
        share = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(pivots))
        chosen = wide.groupBy("space", share.alias("share")).agg(F.min_by("id", F.xxhash64("id", F.lit(turn + 100))).alias("id"))
        hubs = wide.select("space", "id", "shingles").join(bounded(chosen.select("space", "id")), ["space", "id"], "left_semi").dropDuplicates(["space", "id"])
        hubs = saved(hubs.groupBy("space").agg(F.collect_list(F.struct("id", "shingles")).alias("hubs")), "pivot-sets")
        salts = partitions(spark)
        if (hubs.agg(F.sum(F.aggregate("hubs", F.lit(0).cast("long"), lambda s, h: s + F.octet_length(h["shingles"])))).first()[0] or 0) <= 32 << 20:
            met = wide.join(F.broadcast(hubs), "space")
        else:  # the rows of a space are spread over all tasks, its pivots go to each
            spread = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            met = wide.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(spread, ["space", "salt"])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far, near = [], []
                for own, hubs in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                    hubs.sort(key=lambda h: (h["id"], h["shingles"]))
                    own = np.frombuffer(own.as_buffer(), _U)
                    n = np.array([len(own)], np.int64)
                    met = [_distances(own, n - n, n, np.frombuffer(h["shingles"], _U), percent) for h in hubs]
                    far.append([float(d[0]) for d, _ in met])
                    near.append([h["id"] for h, (_, link) in zip(hubs, met, strict=True) if link[0]])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.list_(pa.float64())), pa.array(near, pa.list_(pa.int64()))], ["space", "id", "distance", "linked"])

        placed = saved(met.select("space", "id", "shingles", "hubs").mapInArrow(place, "space long, id long, distance array<double>, linked array<long>"), "distances")
        links.append(placed.select("id", F.explode("linked").alias("head")))
        least = F.array_min("distance")
        home = F.array_position("distance", least).cast("int") - 1
        near = placed.withColumn("least", least).withColumn("home", F.when(least > NEAR, -1).otherwise(home))
        reach = near.where("home >= 0").groupBy("space", "home").agg((F.max("least") + F.lit(1 - percent / 100 + 1e-9)).alias("reach"))
        reach = reach.groupBy("space").agg(F.map_from_entries(F.collect_list(F.struct("home", "reach"))).alias("reach"))
        two = 2 * (1 - percent / 100 + 1e-9)
        inside = F.filter(F.sequence(F.lit(0), F.size("distance") - 1), lambda k: (F.col("home") == k) | (F.get("distance", k) <= F.least(F.col("least") + two, F.coalesce(F.try_element_at("reach", k), F.lit(-1.0)))))
        outer = F.when(F.col("least") > NEAR - two / 2, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
        cells = near.join(F.broadcast(reach) if sizes.count() <= 100_000 else reach, "space", "left").select("space", "id", F.explode(F.concat(inside, outer)).alias("cell")).distinct()
        cells = saved(cells, "cells")
        filled = cells.groupBy("space", "cell").agg(F.count("*").alias("n")).join(bounded(sizes), "space")
        stuck = F.col("n") * 5 > F.col("rows") * 4
        plan = bounded(filled.select("space", "cell", F.when(stuck | F.lit(turn == rounds - 1), F.ceil(F.col("bytes") * 2 / F.lit(space_bytes)).cast("int")).otherwise(0).alias("blocks")))
        dealt = cells.join(plan, ["space", "cell"]).withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")).cast("int")).otherwise(0))
        others = F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
        dealt = dealt.withColumn("other", F.explode(others))
        next_ = F.xxhash64("space", "cell", F.least("own", "other"), F.greatest("own", "other"))
        moved = wide.select("space", "id", "shingles").join(dealt.select("space", "id", next_.alias("next"), "blocks"), ["space", "id"]).select(F.col("next").alias("space"), "id", "shingles", "blocks")
        moved = saved(moved, "cell-members")
        ready.append(moved.where("blocks > 0").select("space", "id", "shingles"))
        members = moved.where("blocks = 0").select("space", "id", "shingles")
    for r in ready:
        members = members.unionByName(r)
    return members, links


def _packed_sets(docs: DataFrame, words: int) -> DataFrame:
    """``space, id, shingles`` of ``docs(space, doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values, bounds in shingle_sets(batch.column(2), words):
                rows = len(bounds) - 1
                packed = pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), batch.column(1).slice(at, rows).cast(pa.int64()), packed], ["space", "id", "shingles"])

    return docs.select("space", "doc_id", "text").mapInArrow(run, "space long, id long, shingles binary")


def near_groups(docs: DataFrame, percent: int = 75, words: int = 5, space_bytes: int = SPACE_BYTES, pivots: int = 2 * PIVOTS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``.

    Sets link when 100 * intersection >= percent * union.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    summary = saved(summaries(docs, words, buckets), "summaries")
    counts = _slot_counts(summary)
    meta = summary.where("block is null and bucket is null").select("doc_id", "n", "s1", "s2")
    known = meta.where("n > 0 and doc_id is not null")
    classes = saved(known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")

    edges = saved(candidate_edges(docs, counts, _frequent(summary), percent, words, max(buckets, int(counts.sum()) // 2_000_000)), "edges")
    pairs = edges.where("not star")
    ends = saved(pairs.select(F.explode(F.array("a", "b")).alias("s1")).distinct().join(classes, "s1").select(F.col("s1").alias("mark"), "rep"), "pair-ends")
    bits = summary.where("n > 0").select(F.col("doc_id").alias("rep"), "bits").join(bounded(ends), "rep").select("mark", "bits")
    plausible = _plausible(pairs, saved(bits, "parities"), percent)
    spaces = components(edges.where("star").select("a", "b").unionByName(plausible))
    members = saved(spaces.join(classes, F.col("id") == F.col("s1")).select("rep", F.col("component_id").alias("space")).distinct(), "space-members")

    text = docs.select("doc_id", "text").join(bounded(members), F.col("doc_id") == F.col("rep")).select("space", "doc_id", "text")
    sets = saved(_packed_sets(text, words), "sets")
    total = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    cut, through = _cut_spaces(sets, percent, space_bytes, pivots)
    heads = saved(_join_spaces(cut, percent, max(partitions(spark), total >> 23)), "heads")
    forget(sets)
    twice = known.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("doc_id")
    if not twice.isEmpty():  # rows of one document with several texts hold their classes together
        own = known.join(twice, "doc_id").join(classes, ["n", "s1", "s2"])
        through.append(own.select(F.col("doc_id").alias("id"), F.col("rep").alias("head")))
    if through:
        links = heads
        for more in through:
            links = links.unionByName(more)
        heads = components(links.select(F.col("id").alias("a"), F.col("head").alias("b"))).select("id", F.col("component_id").alias("head"))
    found = saved(classes.join(heads.distinct(), F.col("rep") == F.col("id"), "left").select("n", "s1", "s2", "copies", F.coalesce("head", "rep").alias("component_id")), "class-components")
    usual = attach(known, found.select("n", "s1", "s2", "copies", "component_id"), ["n", "s1", "s2"], "copies")
    rest = meta.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    return usual.select(*rest.columns).unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
