"""Toxicity by the nearest labelled examples.

Terms are words, runs of letters in lower case; all that the labelled examples have are
dimensions, none is chosen.  A term weighs (1 + ln count) * idf * relevance: its document frequency is
counted over the whole corpus, and its relevance, chi / (chi + RELEVANT) of its chi-squared
with the label, rises smoothly from 0 without a threshold, at every number of examples.
(Plain TF-IDF, without the last factor, finds less; README has the figures.)  Labelled
examples become vectors of length one in an inverted index whose long posting lists are cut
into blocks of examples that carry their largest weight; examples are numbered by their
heaviest term, so that a block's examples are alike and its bound is tight.  For each text
the exact ``neighbours`` of largest cosine are found: what a block's bound shows to be
further is not looked up.  Votes weighted by distance, 1 / (1 - cosine + 0.05), are turned
into a probability by a table fitted on the examples themselves, each judged without itself.

``examples`` bounds the index and with it the dimensions; all texts are scored, whole.
Defined results: texts without a weight in any dimension (also null and empty ones) get the
share of label 1 among such examples; equal cosines are taken by example number; where all
labels are equal every relevance is 1; without labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, saved
from .features import counted_terms

BLOCK = 64
#: The chi-squared at which relevance is a half.
RELEVANT = 100.0
_U = np.uint64


def _weights(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1.0 + np.log(count)) * idf


class Index:
    """Inverted index over example vectors given as (row, term, weight), with block maxima where lists are long.

    Lists of terms that fewer than a tenth of the examples have are added up whole.  The
    few longer ones, which hold most of all weights, are cut into blocks of examples that
    carry their largest weight; only examples are looked up there that can still be among
    the nearest by what the short lists gave and by their block's bound.
    """

    def __init__(self, rows: int, terms: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> None:
        self.labels, self.rows = labels, rows
        blocks = max(1, -(-rows // BLOCK))
        order = np.lexsort((row, term))
        row, term, weight = row[order], term[order], weight[order]
        n = np.bincount(term, minlength=terms)
        long = np.flatnonzero(n > max(BLOCK, rows // 10))
        self.place = np.full(terms, -1)
        self.place[long] = np.arange(len(long))
        at = self.place[term]
        self.lists = np.zeros((len(long), blocks * BLOCK))
        self.lists[at[at >= 0], row[at >= 0]] = weight[at >= 0]
        self.highest = self.lists.reshape(len(long), blocks, BLOCK).max(axis=2)
        self.row, self.weight = row[at < 0].astype(np.int32), weight[at < 0]
        self.term_at = np.searchsorted(term[at < 0], np.arange(terms + 1))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines, to twelve places, of the k nearest with a cosine above 0."""
        low, high = self.term_at[term], self.term_at[term + 1]
        cuts = [slice(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a]
        part = np.zeros(self.lists.shape[1])
        if cuts:
            weights = np.concatenate([self.weight[c] for c in cuts]) * np.repeat(weight, high - low)
            part = np.bincount(np.concatenate([self.row[c] for c in cuts]), weights, len(part))
        place = self.place[term]
        own, factor = place[place >= 0], weight[place >= 0]
        bound = part + np.repeat(factor @ self.highest[own], BLOCK)
        if without >= 0:
            part[without] = bound[without] = -1.0
        least = max(0.0, np.partition(part, len(part) - k)[len(part) - k] if k < len(part) else 0.0)
        ids = np.flatnonzero(bound >= least - 1e-12)
        if 2 * len(ids) > len(part):
            cos = (part + factor @ self.lists[own])[ids]
        else:
            cos = part[ids] + factor @ self.lists[np.ix_(own, ids)]
        cos = np.round(cos, 12)
        some = cos > 0
        ids, cos = ids[some], cos[some]
        if len(ids) > k:
            some = cos >= np.partition(cos, len(cos) - k)[len(cos) - k]
            ids, cos = ids[some], cos[some]
        best = np.lexsort((ids, -cos))[:k]
        return ids[best], np.minimum(cos[best], 1.0)

    def vote(self, ids: np.ndarray, cos: np.ndarray) -> float:
        near = 1.0 / (1.0 - cos + 0.05)
        return float((near * self.labels[ids]).sum() / near.sum())


class Model:
    """Terms, their weights, index and calibration; all of bounded size."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, index: Index, example_ids: np.ndarray, k: int) -> None:
        self.terms, self.idf, self.index, self.example_ids, self.k = terms, idf, index, example_ids, k
        self.edges, self.values, self.blank = np.zeros(1), np.zeros(1), 0.0

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, blank: np.ndarray, prior: float) -> None:
        """Pool neighbouring votes until shares of label 1 rise (isotonic regression), with one prior vote a pool."""
        self.blank = float((blank.sum() + prior) / (len(blank) + 1))
        pools: list[list[float]] = []
        for v, y in sorted(zip(votes.tolist(), labels.tolist(), strict=True)):
            pools.append([v, y, 1.0])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                v2, y2, n2 = pools.pop()
                pools[-1][1] += y2
                pools[-1][2] += n2
        self.edges = np.array([p[0] for p in pools]) if pools else np.zeros(1)
        self.values = np.array([(y + prior) / (n + 1) for _, y, n in pools]) if pools else np.full(1, prior)

    def probability(self, vote: float) -> float:
        at = max(0, int(np.searchsorted(self.edges, vote, "right")) - 1)
        return float(0.999 * self.values[at] + 0.001 * vote)  # votes order equal pools


def _vectors(column: pa.Array, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of all texts with a weight, those of a row having length one; ``idf`` may hold more than the idf."""
    rows, ts, ws = [], [], []
    for at, row, term, count in counted_terms(column, terms, False):
        w = _weights(count, idf[term.astype(np.int64)])
        some = w > 0
        row, term, w = row[some], term[some], w[some]
        norm = np.sqrt(np.bincount(row, w * w, (row.max() + 1) if len(row) else 0))
        rows.append(row + at)
        ts.append(term.astype(np.int64))
        ws.append(w / norm[row])
    return (np.concatenate(rows), np.concatenate(ts), np.concatenate(ws)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def example_terms(labelled: DataFrame, positive: int, negative: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all terms of ``labelled(text, label)`` in order, and the relevance of each.

    As many as the bounded examples have; they arrive packed, a row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ys = [np.zeros(0, _U)], [np.zeros(0)]
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for at, row, term, _ in counted_terms(batch.column(0), openings=False):
                found.append(term)
                ys.append(y[row + at])
        term, place = np.unique(np.concatenate(found), return_inverse=True)
        pos = np.bincount(place, np.concatenate(ys), len(term)).astype(np.int32)
        n = np.bincount(place, minlength=len(term)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (term, pos, n)], ["term", "pos", "n"])

    parts = labelled.select("text", "label").mapInArrow(run, "term binary, pos binary, n binary").collect()
    term, place = np.unique(np.concatenate([np.zeros(0, _U), *(np.frombuffer(r["term"], _U) for r in parts)]), return_inverse=True)
    a, n = (np.bincount(place, np.concatenate([np.zeros(0), *(np.frombuffer(r[c], np.int32) for r in parts)]), len(term)) for c in ("pos", "n"))
    if not positive or not negative:
        return term, np.ones(len(term))
    n1, total = float(positive), float(positive + negative)
    gap, below = a * total - n * n1, n * (total - n) * n1 * (total - n1)
    chi = np.where(below > 0, gap * gap * total / np.maximum(below, 1e-9), 0.0)
    return term, chi / (chi + RELEVANT)


def choose_terms(labelled: DataFrame, positive: int, negative: int, vocabulary: int | None, least_chi: float = 30.0) -> np.ndarray:
    """Fingerprints of the terms whose chi-squared with the label is ``least_chi`` at least (the ``vocabulary`` largest), in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ys = [], []
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for at, row, term, _ in counted_terms(batch.column(0)):
                found.append(term)
                ys.append(y[row + at])
        if found:
            term, place = np.unique(np.concatenate(found), return_inverse=True)
            pos = np.bincount(place, np.concatenate(ys), len(term)).astype(np.int64)
            n = np.bincount(place, minlength=len(term))
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(pos), pa.array(n)], ["term", "pos", "n"])

    n1, total = float(positive), float(positive + negative)
    counts = labelled.select("text", "label").mapInArrow(run, "term long, pos long, n long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("n").alias("n")).where("n >= 4")
    a, n = F.col("a"), F.col("n")
    gap = a * total - n * n1
    chi = gap * gap * total / (n * (total - n) * n1 * (total - n1))
    best = counts.where(n < total).withColumn("chi", chi).where(F.col("chi") >= least_chi)
    best = (best if vocabulary is None else best.orderBy(F.desc("chi"), "term").limit(vocabulary)).collect()  # as many as the examples have terms at most
    return np.sort(np.array([r["term"] for r in best], np.int64).view(_U))


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            total += batch.num_rows
            for _, _, term, _ in counted_terms(batch.column(0), terms, False):
                df += np.bincount(term.astype(np.int64), minlength=len(terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], total))], ["place", "n"])

    counted = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    place, n = (counted.column(c).to_numpy() for c in ("place", "n"))
    df = np.zeros(len(terms))
    df[place[place >= 0]] = n[place >= 0]
    return int(n[place < 0].sum()), df


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", corpus: DataFrame | None = None, examples: int = 6000, neighbours: int = 15) -> Model:
    """An index of about ``examples`` labelled rows of ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``.

    Document frequencies come from ``corpus`` (all of it), or ``docs`` if it is not given.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    rate = min(1.0, examples / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    rows = saved(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "toxicity-examples")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    terms, relevance = example_terms(rows, positive, negative)
    total, df = document_frequencies(docs if corpus is None else corpus, terms)
    scale = (np.log((1.0 + total) / (1.0 + df)) + 1.0) * relevance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, weight = _vectors(batch.column(1), terms, scale)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (term.astype(np.int32), weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), *packed], ["doc_id", "label", "terms", "weights"])

    found = rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, terms binary, weights binary").collect()
    vectors = [(r["doc_id"], r["label"], np.frombuffer(r["terms"], np.int32).astype(np.int64), np.frombuffer(r["weights"])) for r in found]
    vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]) if len(v[2]) else -1, v[0]))
    y = np.array([v[1] for v in vectors], np.int64)
    length = np.array([len(v[2]) for v in vectors], np.int64)
    none = [np.zeros(0)]
    index = Index(len(vectors), len(terms), np.repeat(np.arange(len(vectors)), length), np.concatenate([*none, *(v[2] for v in vectors)]).astype(np.int64), np.concatenate([*none, *(v[3] for v in vectors)]), y)
    model = Model(terms, scale, index, np.array([v[0] for v in vectors], np.int64), neighbours)
    votes, truth = [], []
    for k, (_, label, term, weight) in enumerate(vectors):
        if len(term):
            ids, cos = model.index.nearest(term, weight, neighbours, without=k)
            if len(ids):
                votes.append(model.index.vote(ids, cos))
                truth.append(label)
    prior = positive / max(1, positive + negative)
    model.calibrate(np.array(votes), np.array(truth), y[length == 0], prior)
    return model


def score(docs: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """``doc_id, score, evidence`` for ``docs(doc_id, text)``; evidence is the nearest examples with label and cosine."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, evidence array<struct<example:long,label:int,cosine:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = given.value, {}
        kind = pa.list_(pa.struct([("example", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for batch in batches:
            row, term, weight = _vectors(batch.column(1), m.terms, m.idf)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            scores, shown = [m.blank] * batch.num_rows, [[]] * batch.num_rows
            for r in np.flatnonzero(np.diff(cut)).tolist():
                t, w = term[cut[r] : cut[r + 1]], weight[cut[r] : cut[r + 1]]
                key = t.tobytes() + w.tobytes()
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    ids, cos = m.index.nearest(t, w, m.k)
                    p = m.probability(m.index.vote(ids, cos)) if len(ids) else m.blank
                    known[key] = p, [{"example": int(m.example_ids[i]), "label": int(m.index.labels[i]), "cosine": float(c)} for i, c in zip(ids[:evidence], cos[:evidence], strict=True)]
                scores[r], shown[r] = known[key]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(shown, kind)], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 4) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held)
    model = learn(docs.where(~held), labels, corpus=docs)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
