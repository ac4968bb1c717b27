"""Quality classifier: a sparse ensemble of rules.

Shallow random trees over text statistics are fitted by Spark; each path from a root is
a conjunction of thresholds, used as a 0/1 rule.  A lasso logistic model weighs the
rules, those with weight zero go, and the rest become one Spark column expression.

Labelled rows are drawn by the text, about ``fit_rows`` of them; that bound is the only
sampling.  Defined results: null and empty texts have zero statistics and get the score
of those; with a single label every score is the share of label 1, with none 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, saved
from .features import STATISTICS, statistics


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the text statistics of ``docs(doc_id, text)``, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in found.T)], ["doc_id", *STATISTICS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rules:
    """Weighted conjunctions: each is (weight, ((statistic, '<=' or '>', threshold), ...))."""

    bias: float
    weighted: tuple[tuple[float, tuple[tuple[str, str, float], ...]], ...]

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = reduce(lambda a, b: a + b, [F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0)) for w, rule in self.weighted], F.lit(self.bias))
        return 1.0 / (1.0 + F.exp(-total))


def holds(rule: tuple[tuple[str, str, float], ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(s) <= t if side == "<=" else F.col(s) > t for s, side, t in rule])


def _paths(node, names: tuple[str, ...], so_far: tuple = ()) -> Iterator[tuple]:
    """The conjunctions of all nodes below ``node`` but the root."""
    if so_far:
        yield so_far
    if node.numDescendants() == 0:
        return
    split = node.split()
    name, limit = names[split.featureIndex()], float(split.threshold())
    for side, child in (("<=", node.leftChild()), (">", node.rightChild())):
        yield from _paths(child, names, (*so_far, (name, side, limit)))


def _tidy(rule: tuple) -> tuple:
    """At most one bound a side for each statistic."""
    best: dict[tuple[str, str], float] = {}
    for s, side, t in rule:
        old = best.get((s, side))
        best[s, side] = t if old is None else (min if side == "<=" else max)(old, t)
    return tuple(sorted((s, side, t) for (s, side), t in best.items()))


def fit(labelled: DataFrame, names: tuple[str, ...] = STATISTICS, trees: int = 8, depth: int = 3, lasso: float = 0.002, seed: int = 9) -> Rules:
    """Rules from a table of statistics with a ``label`` of 0 or 1."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    share = labelled.agg(F.avg("label"), F.count("*")).first()
    if share[1] == 0 or share[0] in (0.0, 1.0):
        p = 0.5 if share[1] == 0 else min(max(share[0], 1e-3), 1 - 1e-3)
        from math import log

        return Rules(log(p / (1 - p)), ())
    rows = VectorAssembler(inputCols=list(names), outputCol="features").transform(labelled).select("features", F.col("label").cast("double").alias("label"), *names)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed, maxBins=64).fit(rows.select("features", "label"))
    rules = sorted({_tidy(p) for tree in forest.trees for p in _paths(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"), names)})
    fired = rows.select("label", *[holds(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    packed = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(fired).select("features", "label")
    model = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=40, standardization=False).fit(packed)
    weights = model.coefficients.toArray()
    return Rules(float(model.intercept), tuple((float(w), r) for w, r in zip(weights, rules, strict=True) if w))


def learn(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = 8000) -> Rules:
    """Rules from ``docs(doc_id, text)`` joined to ``labels(doc_id, <label>)``."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rate = min(1.0, fit_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    stats = with_statistics(rows).join(F.broadcast(drawn), "doc_id")
    return fit(saved(stats, "quality-fit").coalesce(4))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held)
    rules = learn(docs.where(~held), labels, "quality")
    scored = with_statistics(docs).select("doc_id", rules.score().alias("score"))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
