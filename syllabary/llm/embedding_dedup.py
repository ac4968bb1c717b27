"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are first folded into one.  Each tree splits at random hyperplanes; the
split values are medians of a bounded sample of vectors, and vectors near a split go to
both sides (spill; its width follows the link radius and the square root of the
dimension, as the projections' differences do).  Vectors that share a leaf of some tree
are compared by cosine in double precision, and linked pairs are united.  A leaf with
more than ``4 * leaf_rows`` vectors is dealt into blocks, and every two blocks are
compared by a task of their own.

A pair that meets in several leaves is counted in the first of them only: a task finds the
earlier leaves of its vectors again instead of having them sent.  Leaves
send each vector's number of new partners and a spanning set of links, never pairs.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing; only vectors of equal length can link; components may be
as small or large as doubles are, as each vector is scaled by its largest one first;
every row has its own result, also where vec_id is null or repeated; equal vectors link
with each other; a component's id is the smallest vec_id in it, null if it has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded, saved
from .graph import components

_SHIFT = 32


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not again for each element that uses it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, k1, k2, unit`` of ``vectors(vec_id, embedding)``: keys of equal vectors, and the vector at length one; null where it cannot link."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(v.isNotNull() & sound, F.transform(v, lambda x: x + F.lit(0.0))))
    scaled = _once(F.array_max(F.transform(v, F.abs)), lambda most: F.transform(v, lambda x: x / most))
    unit = _once(scaled, lambda s: _once(F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x)), lambda norm: F.transform(s, lambda x: x / norm)))
    keys = (F.when(v.isNotNull(), k) for k in (F.xxhash64(v), F.xxhash64(F.lit(6), v, F.size(v))))
    return rows.select("vec_id", *(k.alias(n) for k, n in zip(keys, ("k1", "k2"), strict=True)), unit.alias("unit"))


def grow(sample: np.ndarray, trees: int, depth: int, spill: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree, one random direction a level and the split values of its inner nodes in heap order."""
    rng, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        planes = rng.standard_normal((max(depth, 1), sample.shape[1]))
        planes /= np.linalg.norm(planes, axis=1, keepdims=True)
        at, cuts, members = sample @ planes.T, np.zeros((1 << depth) - 1), {0: np.arange(len(sample))}
        for node in range(len(cuts)):
            here = members.pop(node)
            side = at[here, (node + 1).bit_length() - 1]
            cuts[node] = np.median(side) if len(side) else 0.0
            members[2 * node + 1], members[2 * node + 2] = here[side < cuts[node] + spill], here[side >= cuts[node] - spill]
        forest.append((planes, cuts))
    return forest


def leaves_of(rows: np.ndarray, forest: list[tuple[np.ndarray, np.ndarray]], spill: float) -> list[list[int]]:
    """Leaf numbers of each vector, over all trees."""
    found: list[list[int]] = [[] for _ in rows]
    for t, (planes, cuts) in enumerate(forest):
        place, node, first = np.arange(len(rows)), np.zeros(len(rows), np.int64), len(cuts)
        side = rows @ planes.T
        for level in range((first + 1).bit_length() - 1):
            at = side[place, level] - cuts[node]
            left, right = at < spill, at >= -spill
            place, node = np.concatenate([place[left], place[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        for p, n in zip(place.tolist(), node.tolist(), strict=True):
            found[p].append((t << 32) + n - first)
    return found


def linked_pairs(v: np.ndarray, threshold: float, leaf_rows: int, seed: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (unit vectors) with cosine of the threshold or more, each once.

    Larger sets are compared block by block against the rows whose projections on a few
    random lines lie close enough: a cosine of c bounds the distance, hence every
    projection's difference, by sqrt(2 - 2c).
    """
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    line = np.random.default_rng(seed).standard_normal(v.shape[1])
    at = v @ (line / np.linalg.norm(line))
    order = np.argsort(at, kind="stable")
    v, at = v[order], at[order]
    for a in range(0, len(v), leaf_rows):
        b = min(a + leaf_rows, len(v))
        for c in range(a, int(np.searchsorted(at, at[b - 1] + reach, "right")), leaf_rows):
            d = min(c + leaf_rows, len(v))
            i, j = np.nonzero(v[a:b] @ v[c:d].T >= threshold - 1e-9)
            i, j = i + a, j + c
            keep = i < j
            i, j = i[keep], j[keep]
            sure = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
            yield order[i[sure]], order[j[sure]]


def _spanning(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Unite pairs in ``root`` (each row's smallest row so far); returns the links that joined two sets."""
    joined = []
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            break
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        high, at = np.unique(np.maximum(x, y), return_index=True)
        low = np.minimum(x, y)[at]
        joined += zip(i[at].tolist(), j[at].tolist(), strict=True)
        root[high] = low
        while (root[root] != root).any():
            root[:] = root[root]
    return joined


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _met_before(v: np.ndarray, forest: list[tuple[np.ndarray, np.ndarray]], spill: float, tree: int, leaf: int) -> list[np.ndarray]:
    """For each tree up to ``tree``, which of its leaves (of the last one, those below ``leaf``) hold which rows (rows x leaves, 0 or 1)."""
    out = []
    for t in range(tree + 1):
        found = leaves_of(v, [forest[t]], spill)
        if t == tree:
            found = [[x for x in own if x < leaf] for own in found]
        row = np.repeat(np.arange(len(v)), [len(x) for x in found])
        known, at = np.unique(np.array([k for x in found for k in x], np.int64), return_inverse=True)
        held = np.zeros((len(v), len(known)), bool)
        held[row, at] = True
        out.append(held)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, trees: int = 6, spill: float = 0.4, leaf_rows: int = 512, sample: int = 50_000, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding)``.

    ``sample`` bounds the vectors on which the trees are fitted; all are then placed.
    ``spill`` is in units of the link radius over the square root of the dimension.
    """
    spark = vectors.sparkSession
    rows = unit_vectors(vectors)
    sound = rows.where("k1 is not null")
    folded = sound.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    folded = saved(folded.withColumn("node", F.monotonically_increasing_id()), "unit-vectors")
    sizes = {r["d"]: r["count"] for r in folded.groupBy(F.size("unit").alias("d")).count().collect()}
    total = sum(sizes.values())
    drawn = folded.where(F.pmod(F.xxhash64("k1", F.lit(6)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, total)))).select("unit").limit(2 * sample)
    fit: dict[int, list] = {}
    for (x,) in zip(drawn.toArrow().column("unit").to_pylist(), strict=True) if total else ():
        fit.setdefault(len(x), []).append(x)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    forests = {}
    for d, n in sorted(sizes.items()):
        depth = min(max(0, int(np.ceil(np.log2(n / leaf_rows)))), max(0, len(fit.get(d, ())).bit_length() - 3))
        forests[d] = (len(forests), spill * radius / d**0.5, grow(np.array(fit.get(d, np.zeros((1, d))), np.float64).reshape(-1, d), trees, depth, spill * radius / d**0.5, seed))
    given = spark.sparkContext.broadcast(forests)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            length = column.value_lengths().to_numpy(zero_copy_only=False)
            leaves: list[list[int]] = [[]] * len(column)
            for d in np.unique(length).tolist():
                number, width, forest = given.value[d]
                at = np.flatnonzero(length == d)
                for k, found in zip(at.tolist(), leaves_of(_matrix(column.take(pa.array(at))), forest, width), strict=True):
                    leaves[k] = [(number * trees << _SHIFT) + x for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], ["node", "copies", "unit", "leaves"])

    placed = folded.select("node", "copies", "unit").mapInArrow(place, "node long, copies long, unit array<double>, leaves array<long>")
    blocks = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().where(F.col("count") > 4 * leaf_rows)
    blocks = saved(blocks.select("leaf", F.ceil(F.col("count") / (2 * leaf_rows)).cast("int").alias("blocks")), "large-leaves")
    in_leaf = placed.select("node", "copies", "unit", F.explode("leaves").alias("leaf")).join(bounded(blocks), "leaf", "left")
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0))
    in_leaf = in_leaf.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
    in_leaf = in_leaf.select("leaf", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "copies", "unit")

    def compare(key: tuple, part: pa.Table) -> pa.Table:
        v = _matrix(part.column("unit").combine_chunks())
        low, high = key[1].as_py(), key[2].as_py()
        side = part.column("own").to_numpy() == low
        _, width, forest = given.value[v.shape[1]]
        tree, leaf = key[0].as_py() >> _SHIFT, key[0].as_py() & (1 << _SHIFT) - 1
        met = _met_before(v, forest, width, tree % trees, leaf)
        copies, number, root = part.column("copies").to_numpy(), np.zeros(len(v), np.int64), np.arange(len(v))
        joined = []
        for i, j in linked_pairs(v, threshold, leaf_rows):
            if low != high:  # pairs within a block are compared by its own task
                across = side[i] != side[j]
                i, j = i[across], j[across]
            new = np.ones(len(i), bool)
            for held in met:
                new &= ~(held[i] & held[j]).any(axis=1)
            np.add.at(number, i[new], copies[j[new]])
            np.add.at(number, j[new], copies[i[new]])
            joined += _spanning(root, i, j)
        ident = part.column("node").to_numpy()
        found = np.flatnonzero(number)
        links = np.array(joined, np.int64).reshape(-1, 2)
        columns = ((ident[found], ident[links[:, 0]]), (np.full(len(found), -1), ident[links[:, 1]]), (number[found], np.full(len(links), -1)))
        return pa.table({k: pa.array(np.concatenate(c).astype(np.int64)) for k, c in zip("abn", columns, strict=True)})

    found = saved(in_leaf.groupBy("leaf", "low", "high").applyInArrow(compare, "a long, b long, n long"), "vector-links")
    counts = found.where("n >= 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(found.where("n < 0").select("a", "b")).select(F.col("id").alias("node"), F.col("component_id").alias("root"))
    heads = folded.drop("unit").join(counts, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = heads.groupBy("root").agg(F.min("id").alias("component_id"))
    heads = heads.join(least, "root").select("k1", "k2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = attach(sound.select("vec_id", "k1", "k2"), saved(heads, "vector-classes"), ["k1", "k2"], "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
