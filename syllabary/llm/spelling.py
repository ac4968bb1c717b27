"""Spelling variants: words one edit apart, found by dense tiles, and the form each leads to.

Words are runs of Latin letters; the driver's rule damages some of them.  Two words are
near if one inserted, deleted or replaced code point makes them equal, which is so exactly
if their common prefix and common suffix together reach the longer length ``m`` less one.
Then one of the two reaches ``m // 2``.  A word therefore stands in the tiles of its first
and of its last ``m // 2`` code points, for ``m`` its length and its length plus one; near
words share a tile.  A tile is compared densely: code points padded to ``m`` on the right
give prefixes, padded on the left suffixes.  A shared start or end with more than ``TILE``
words is cut into blocks, and each pair of blocks is a tile of its own, so no task holds
more than about two blocks at a time.  Only near pairs leave a tile, added up by word.

Defined results: null and empty texts have no words; repeated rows count again; a null
doc_id is written as nothing in the rule; of forms with equal n the first in code-point
order counts; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, partitions, saved

TILE = 1024
PAIRS = 1 << 18
HELD = 20_000


def words(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """``word, n`` of ``docs(doc_id, text)``: lower-cased runs after the rule, of ``shortest`` code points and ``least`` occurrences."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    low = low.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return low.groupBy(word.alias("word")).agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.length("word") >= shortest))


def tiles(table: DataFrame, tile: int = TILE) -> DataFrame:
    """``m, side, mark, i, j, left, word, n``: the words of each tile, by ``mark`` of what they share and pair of blocks.

    Side 0 shares the start, side 1 the end.  ``left`` says that the word is in block i;
    where i = j there is one block.
    """
    size = F.length("word")
    each = table.select("word", "n", F.explode(F.array(size, size + 1)).alias("m")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.floor(F.col("m") / 2).cast("int")
    key = F.when(F.col("side") == 0, F.substring(F.col("word"), F.lit(1), half)).otherwise(F.substring(F.col("word"), F.length("word") - half + 1, half))
    each = each.withColumn("mark", F.xxhash64(key)).withColumn("long", F.length("word") == F.col("m"))
    groups = each.groupBy("m", "side", "mark").agg(F.count("*").alias("size"), F.count_if("long").alias("longs")).where("size > 1 and longs > 0")
    each = each.join(groups, ["m", "side", "mark"]).withColumn("blocks", F.ceil(F.col("size") / tile).cast("int"))
    each = each.withColumn("own", F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select("m", "side", "mark", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "word", "n")


def _padded(column: pa.Array, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words of m or m - 1, padded on the right and on the left, and which words are long."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    size = np.diff(off)
    row = np.repeat(np.arange(len(column)), size)
    place = np.arange(len(row)) - np.repeat(off[:-1] - off[0], size)
    right, left = np.zeros((len(column), m), np.uint8), np.zeros((len(column), m), np.uint8)
    right[row, place] = data[off[0] : off[-1]]
    left[row, place + np.repeat(m - size, size)] = data[off[0] : off[-1]]
    return right, np.ascontiguousarray(left[:, ::-1]), size == m


def near(right: np.ndarray, back: np.ndarray, x: np.ndarray, y: np.ndarray, m: int, side: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart and belong to their side: the start reaches m // 2, or only the end does."""
    prefix = np.argmin(right[x] == right[y], axis=1)
    mine = np.flatnonzero((prefix >= m // 2) == (side[x] == 0))
    suffix = np.argmin(back[x[mine]] == back[y[mine]], axis=1)
    return mine[prefix[mine] + suffix >= m - 1]


def _compare(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Near words of whole tiles of one ``m``, added up by tile and word."""
    m = rows.column(0)[0].as_py()
    side, mark, i, j = (rows.column(k).to_numpy() for k in range(1, 5))
    n, first_block = rows.column(7).to_numpy(), rows.column(5).to_numpy(zero_copy_only=False)
    word = rows.column(6)
    right, back, long = _padded(word, m)
    new = np.append(True, (side[1:] != side[:-1]) | (mark[1:] != mark[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
    group = np.cumsum(new) - 1
    order = np.lexsort((~long, ~first_block, group))  # block i first, long words first
    end = np.append(np.flatnonzero(new)[1:], len(n))[group[order]]
    same = (i == j)[order]
    lefts = np.bincount(group, first_block)[group[order]].astype(np.int64)
    start = np.append(0, np.cumsum(np.bincount(group)))[group[order]]
    low = np.where(same, np.arange(len(n)) + 1, start + lefts)
    count = np.where(same, long[order], first_block[order]) * np.maximum(end - low, 0)
    total = np.append(0, np.cumsum(count))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        c = count[at:to]
        x = np.repeat(np.arange(at, to), c)
        y = np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:to], c)
        if len(x):
            x, y = order[x], order[y]
            hit = near(right, back, x, y, m, side)
            hit = hit[long[x[hit]] | long[y[hit]]]
            found += [(x[hit], y[hit]), (y[hit], x[hit])]
        at = to
    if not found:
        return
    a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    if not len(a):
        return
    bytes_of = word.to_pylist()
    rank = np.empty(len(n), np.int64)
    rank[sorted(range(len(n)), key=bytes_of.__getitem__)] = np.arange(len(n))
    by = np.lexsort((rank[b], -n[b], a))
    a, b = a[by], b[by]
    head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    yield pa.RecordBatch.from_arrays(
        [pa.array([bytes_of[k].decode("latin-1") for k in a[head].tolist()], pa.string()), pa.array(np.diff(np.append(head, len(a)))), pa.array(n[b[head]]), pa.array([bytes_of[k].decode("latin-1") for k in b[head].tolist()], pa.string())],
        ["word", "n_near", "form_n", "form"],
    )


def near_words(table: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, n_near, form_n, form`` of the words of ``table(word, n)`` with a near word: how many, and the one of largest n."""
    keys = ["m", "side", "mark", "i", "j"]
    sent = tiles(table, tile).select("m", "side", "mark", "i", "j", "left", F.encode("word", "ISO-8859-1").alias("word"), "n")
    dealt = sent.repartition(partitions(table.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            m = rows.column(0).to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, m[1:] != m[:-1])), len(m))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield from _compare(rows.slice(a, b - a).combine_chunks().to_batches()[0])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            waiting = now if waiting is None else pa.concat_tables([waiting, now])
            if waiting.num_rows >= HELD:
                last = [waiting.column(k).to_numpy() for k in range(5)]
                changed = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in last]))
                if len(changed):  # the last tile may go on in the next batch
                    cut = int(changed[-1]) + 1
                    yield from compare(waiting.slice(0, cut))
                    waiting = waiting.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield from compare(waiting)

    found = dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms(word, form)``: the end of each chain, by steps that double."""
    now = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, now = now, saved(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = not now.where("moved").isEmpty()
        forget(old)
        now = now.select("word", "root")
        if not moved:
            return now


def variants(table: DataFrame, times: int = 10, tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``table(word, n)``.

    A word's form is its near word of largest n, if that is ``times`` its own n or more.
    """
    rows = table.join(saved(near_words(table, tile), "spelling-near"), "word", "left")
    isform = F.col("form_n") >= times * F.col("n")
    rows = rows.select("word", F.when(isform, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(isform, F.col("form_n")).alias("form_n"))
    rows = saved(rows, "spelling-variants")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(saved(words(docs), "spelling-words"))
