"""Language identification by compression.

Each language gets a zstandard raw-content dictionary made from pieces of some of its
documents, each taken at a place that follows a hash of the text.  A text is compressed once per language; the language whose
dictionary gives the fewest bytes wins.  When the runner-up is within ``margin`` bytes
the result is rejected (``rejected`` is true; ``lang_pred`` still names the best).

Defined results: null texts and texts without a letter give ``und`` with score 0 and
are rejected; ties go to the language name that sorts first and are rejected; with no
learned language every row is ``und``; repeated rows get equal results; columns of the
input with other names are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

UNKNOWN = "und"
_RESULT = "lang_pred string, score double, margin long, rejected boolean"


_NOT_WORDS = re.compile(r"[\W\d_]+")


@lru_cache(1)
def _other_numbers() -> frozenset[str]:
    """Numbers that are no digits (powers, fractions, Roman ones): word characters to ``re``, but no letters."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))


def _letters(text: str) -> bytes:
    """The words in lower case, one space after each."""
    words = _NOT_WORDS.sub(" ", text.lower())
    if not words.isascii() and (found := _other_numbers().intersection(words)):
        words = " ".join(words.translate(dict.fromkeys(map(ord, found), " ")).split())
    return (words.strip() + " ").encode("utf-8", "surrogatepass")


def learn(docs: DataFrame, per_language: int = 128, piece: int = 1000) -> dict[str, bytes]:
    """Dictionaries by language from ``docs(doc_id, text, lang)``, one for every language that has a text.

    The sample is bounded a language: pieces of ``piece`` characters of ``per_language``
    distinct texts, or of all where a language has fewer.  A piece begins anywhere in its
    text.  The draw rate follows the number of distinct texts, so copies take no places.
    """
    mark = F.xxhash64("text", F.lit(8))
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", mark.alias("mark"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).collect()
    if not counts:
        return {}
    rate = known.sparkSession.createDataFrame([(r["lang"], min(1.0, 2.0 * per_language / max(1, r["n"]))) for r in counts], "lang string, rate double")
    draw = F.pmod("mark", F.lit(1 << 30)) / float(1 << 30)  # equal texts are drawn together
    start = F.pmod(F.shiftright("mark", 30), F.greatest(F.length("text") - F.lit(piece), F.lit(0)) + 1).cast("int") + 1
    sample = known.join(F.broadcast(rate), "lang").where(draw < F.col("rate")).select("lang", "mark", draw.alias("draw"), F.substr("text", start, F.lit(piece)).alias("text"))
    pieces: dict[str, list[str]] = {}
    for r in sample.groupBy("lang", "mark").agg(F.min("draw").alias("draw"), F.min("text").alias("text")).orderBy("lang", "draw", "mark").toLocalIterator():
        kept = pieces.setdefault(r["lang"], [])
        if len(kept) < per_language:
            kept.append(r["text"])
    return {lang: b"".join(map(_letters, texts)) for lang, texts in pieces.items()}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: int = 1, level: int = 6, block: int = 8000, carry: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` for each row of ``docs(doc_id, text)``.

    With ``carry`` the whole row comes as the struct ``row`` in place of doc_id.

    Whole texts are compressed, in blocks of ``block`` bytes so that a long text does
    not become its own dictionary.  ``score`` is the winner's share when each byte
    saved counts as a factor of two.
    """
    names = sorted(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = []
        for name in names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        for batch in batches:
            texts = pc.struct_field(batch.column(0), "text") if carry else batch.column(1)
            rows = [_best(text, names, coders, block) for text in texts.to_pylist()]
            pred, score, gap = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0) if carry else batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.int64()), pa.array([g < margin for g in gap], pa.bool_())],
                ["row" if carry else "doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    if carry:
        return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(run, f"row {docs.schema.simpleString()}, {_RESULT}")
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {_RESULT}")


def _best(text: str | None, names: list[str], coders: list, block: int) -> tuple[str, float, int]:
    body = _letters(text) if text else b" "
    if body == b" " or not names:
        return UNKNOWN, 0.0, 0
    parts = [body[i : i + block] for i in range(0, len(body), block)]
    sizes = [sum(len(code(p)) for p in parts) for code in coders]
    best = min(sizes)
    first = sizes.index(best)
    others = [s for i, s in enumerate(sizes) if i != first]
    share = 1.0 / (1.0 + sum(2.0 ** -min(60, s - best) for s in others))
    return names[first], share, (min(others) - best if others else len(body))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = remainder(F.col("doc_id"), 4) == 2
    found = classify(docs, learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")
