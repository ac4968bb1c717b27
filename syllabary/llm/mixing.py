"""Mixing documents to target weights of domains, with soft membership.

A multinomial model fitted on labelled rows gives each document a posterior over
domains; a document's tokens belong to the domains in those shares.  Rates, one a
document and not negative, are fitted by projected gradient steps on half the sum of
squared gaps between expected domain tokens and their targets, in the metric that weighs
documents by tokens.  A step needs a few sums over all documents.  At first steps are
scaled by the domains' own products over documents with a positive rate, which meets
targets that can be met in a few steps; where that no longer helps, plain steps follow,
whose length comes from the last two (Barzilai-Borwein) and is taken back where the
squares grow.  Rates are a fold
over the list of past steps, and written now and then so that the list stays short.

``fit_rows`` bounds the labelled rows used for the fit.  Steps end when the gaps are
within the tolerance or, where targets cannot be met, when rates no longer move; else
``settled`` is false.  Defined results: documents without words have no tokens and rate
1; without at least two labelled domains all posteriors are equal and rates move
together; repeated rows get equal results; a null doc_id is kept; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .features import STATISTICS, counted_terms, statistics
from .toxicity import choose_terms

DOMAINS = ("clean", "toxic", "poor")
TARGETS = {"clean": 0.90, "toxic": 0.02, "poor": 0.08}


def domain_of(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: toxic before poor before clean; rows without a label are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain")).where(F.col("domain").isNotNull())


def _features(column: pa.Array, terms: np.ndarray) -> np.ndarray:
    """Statistics (counts as logarithms), then the share of words that are each term, scaled."""
    stats = statistics(column)
    seen = np.zeros((len(column), len(terms)))
    for at, row, term, _ in counted_terms(column, terms):
        seen[row + at, term.astype(np.int64)] = 1.0
    stats[:, [STATISTICS.index("n_words"), STATISTICS.index("n_lines")]] = np.log1p(stats[:, [STATISTICS.index("n_words"), STATISTICS.index("n_lines")]])
    return np.concatenate([stats, seen], axis=1)


class Posteriors:
    """Domain posteriors of texts; weights are of fixed size."""

    def __init__(self, domains: tuple[str, ...], terms: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.domains, self.terms, self.weights, self.bias = domains, terms, weights, bias

    def of(self, docs: DataFrame, carry: bool = False) -> DataFrame:
        """``doc_id, tokens, posterior`` of ``docs(doc_id, text)`` in one pass; with ``carry`` the struct ``row`` in place of doc_id."""
        given = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = given.value
            for batch in batches:
                for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                    x = _features(pc.struct_field(part.column(0), "text") if carry else part.column(1), m.terms)
                    z = x @ m.weights.T + m.bias
                    e = np.exp(z - z.max(axis=1, keepdims=True))
                    p = e / e.sum(axis=1, keepdims=True)
                    tokens = np.rint(np.expm1(x[:, STATISTICS.index("n_words")])).astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.reshape(-1)))
                    first = part.column(0) if carry else part.column(0).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([first, pa.array(tokens), lists], ["row" if carry else "doc_id", "tokens", "posterior"])

        if carry:
            return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(run, f"row {docs.schema.simpleString()}, tokens long, posterior array<double>")
        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long, posterior array<double>")


def learn(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, fit_rows: int = 6000, vocabulary: int = 64) -> Posteriors:
    """Fit on about ``fit_rows`` rows of ``docs(doc_id, text)`` that ``labelled(doc_id, domain)`` names.

    Besides the statistics of :mod:`features`, the classifier sees the ``vocabulary`` terms
    of largest chi-squared with each domain, 30 at least; a table too small for such terms
    is classified by its statistics.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    spark = docs.sparkSession
    known = labelled.where(F.col("domain").isin(*domains)).select("doc_id", F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int").alias("label"))
    rate = min(1.0, fit_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    rows = saved(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "mixing-fit")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    found = [np.zeros(0, np.uint64)]
    for k in range(1, len(domains) + 1):
        positive, total = sizes.get(k, 0), sum(sizes.values())
        if 0 < positive < total and k > 1:
            found.append(choose_terms(rows.select("text", (F.col("label") == k).cast("int").alias("label")), positive, total - positive, vocabulary))
    terms = np.unique(np.concatenate(found))
    width = len(STATISTICS) + len(terms)
    if len(sizes) < 2:
        return Posteriors(domains, terms, np.zeros((len(domains), width)), np.zeros(len(domains)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch.column(0), terms)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.float64()), lists], ["label", "x"])

    fit = saved(rows.select("text", "label").mapInArrow(run, "label double, x array<double>"), "mixing-features").coalesce(4)
    table = fit.select((F.col("label") - 1).alias("label"), array_to_vector("x").alias("features"))
    model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=40).fit(table)
    weights, bias = np.full((len(domains), width), 0.0), np.full(len(domains), -30.0)
    for k in range(model.numClasses):
        weights[k], bias[k] = model.coefficientMatrix.toArray()[k], model.interceptVector[k]
    for k in range(len(domains)):
        if k + 1 not in sizes:
            weights[k], bias[k] = 0.0, -1e3
    return Posteriors(domains, terms, weights, bias)


def _rate(start: Column, steps: list[list[float]]) -> Column:
    """Each document's rate after projected steps along its posterior."""
    if not steps:
        return start
    p = F.col("posterior")
    listed = F.array(*[F.array(*[F.lit(float(g)) for g in step]) for step in steps])
    moved = F.aggregate(listed, start, lambda r, g: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
    return F.when(F.col("tokens") > 0, moved).otherwise(start)


def fit_rates(members: DataFrame, weights: list[float], total: float | None = None, steps: int = 200, tolerance: float = 1e-4, written: int = 16) -> DataFrame:
    """Add ``rate`` and ``settled`` to ``members(tokens, posterior)`` so that expected domain tokens meet weights * total.

    ``total`` defaults to the tokens of the table.  Every ``written`` steps rates are saved.
    """
    k = len(weights)
    share = [F.col("posterior")[i] for i in range(k)]
    sums = members.agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * share[i] * share[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    tokens = float(sums["t"] or 0)
    if not tokens:
        return members.withColumn("rate", F.lit(1.0)).withColumn("settled", F.lit(True))
    goal = np.array(weights, float) / max(sum(weights), 1e-12) * (tokens if total is None else total)
    safe = 1.0 / max(float(np.linalg.eigvalsh(np.array([[float(sums[f"m{i}_{j}"]) for j in range(k)] for i in range(k)])).max()), 1e-300)

    base, taken, settled, scaled = members.withColumn("start", F.lit(1.0)), [], False, True
    known: list[float] = []  # squares of the last iterates that were kept
    gap_before, length = None, safe
    for _ in range(steps):
        now, before = _rate(F.col("start"), taken), _rate(F.col("start"), taken[:-1])
        moved = F.col("now") - F.col("before")
        rates = base.select("tokens", "posterior", now.alias("now"), before.alias("before"))
        open_ = F.when(F.col("now") > 0, F.col("tokens")).otherwise(0)
        row = rates.agg(F.sum(open_).alias("t"), *[F.sum(F.col("tokens") * F.col("now") * share[i]).alias(f"e{i}") for i in range(k)], *[F.sum(open_ * share[i] * share[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)], F.sum(F.col("tokens") * moved * moved).alias("d"), F.sum(F.col("tokens") * F.abs(moved)).alias("a")).first()
        gap = np.array([float(row[f"e{i}"]) for i in range(k)]) - goal
        squares = float(gap @ gap)
        if np.abs(gap).max() <= tolerance * tokens:
            settled = True
            break
        if scaled and not (known and squares > 0.8 * known[-1]):
            known.append(squares)
            if len(taken) >= written:
                base = saved(base.withColumn("start", _rate(F.col("start"), taken)), "rates")
                taken = []
            inner = np.array([[float(row[f"m{i}_{j}"]) for j in range(k)] for i in range(k)])
            taken.append((np.linalg.pinv(inner, rcond=1e-10, hermitian=True) @ gap).tolist())
            continue
        if scaled:  # scaled steps no longer help: on from the better of the last two by plain ones
            scaled, worse = False, squares >= known[-1]
            known = []
            if worse:
                taken.pop()
                continue
        if taken and known and squares > max(known[-4:]) * (1 + 1e-12) and length > safe:
            length = max(safe, length / 4)  # too far: the last step again, shorter
            taken[-1] = (length * gap_before).tolist()
            continue
        if gap_before is not None and float(row["a"]) * safe / length <= 0.01 * tolerance * float(row["t"] or tokens):
            settled = True  # no rate moves: the least squares are found, though not zero
            break
        change = None if gap_before is None else gap - gap_before
        if change is not None and float(change @ change) > 0 and float(row["d"]) > 0:
            length = float(np.clip(float(row["d"]) / float(change @ change), safe, 1e6 * safe))
        known.append(squares)
        gap_before = gap
        if len(taken) >= written:
            base = saved(base.withColumn("start", _rate(F.col("start"), taken)), "rates")
            taken = []
        taken.append((length * gap).tolist())
    return base.withColumn("rate", _rate(F.col("start"), taken)).drop("start").withColumn("settled", F.lit(settled))


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: the whole part of its rate, and one more by chance for the rest."""
    chance = F.pmod(F.xxhash64(key, F.lit(77)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, carry: bool = False, **limits: int) -> DataFrame:
    """``doc_id, tokens, domain, posterior, rate, settled, copies`` for each row of ``docs(doc_id, text)``.

    With ``carry`` the whole row comes as the struct ``row`` in place of doc_id, and the
    chance of a copy follows doc_id and text, so rows without an id do not share one draw.
    """
    targets = targets or TARGETS
    model = learn(docs, domain_of(labels), tuple(targets), **limits)
    members = saved(model.of(docs, carry), "posteriors")
    rated = fit_rates(members, [targets[d] for d in model.domains])
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    key = F.struct("row.doc_id", "row.text") if carry else F.col("doc_id")
    return rated.select("row" if carry else "doc_id", "tokens", F.element_at(F.array(*map(F.lit, model.domains)), best).alias("domain"), "posterior", "rate", "settled", copies(F.col("rate"), key).alias("copies"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shares = [F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(TARGETS)]
    return found.select("doc_id", "tokens", "domain", *shares, "rate", "settled", "copies")
