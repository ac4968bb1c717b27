"""Accuracy of scraped courses against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .store import KEY, keep_last

FIELDS = ("title", "description", "credits", "level", "department", "prerequisites_text", "prerequisites_parsed")


def _text(c: Column) -> Column:
    return F.lower(strip(c))


def outcome(field: str, kind: str) -> Column:
    """correct, incorrect or missing; null when the golden set has no value."""
    want, have = F.col(f"g_{field}"), F.col(f"s_{field}")
    if kind == "credits":
        both_text = (want["kind"] == "str") & (have["kind"] == "str")
        both_number = (want["kind"] != "str") & (have["kind"] != "str")
        same = F.when(both_text, _text(want["text"]) == _text(have["text"])).when(both_number, want["num"] == have["num"]).otherwise(False)
    elif kind == "string":
        same = _text(want) == _text(have)
    else:
        same = want == have
    return F.when(want.isNotNull(), F.when(have.isNull(), "missing").when(same, "correct").otherwise("incorrect"))


def compare(scraped: DataFrame, golden: DataFrame, fields: tuple[str, ...] = FIELDS, university: str | None = None) -> DataFrame:
    """One row for each scraped row and field that the golden set states, of one university if it is given."""
    if university is not None:
        scraped, golden = (t.where(F.col("university") == university) for t in (scraped, golden))
    kinds = {f: "credits" if f == "credits" else "string" if dict(scraped.dtypes)[f] == "string" else "other" for f in fields}
    last = keep_last(golden)
    left = scraped.select("nseq", *KEY, *[F.col(f).alias(f"s_{f}") for f in fields])
    right = last.select(*KEY, *[F.col(f).alias(f"g_{f}") for f in fields])
    shown = lambda side, f: (F.col(f"{side}_{f}")["text"] if f == "credits" else F.col(f"{side}_{f}").cast("string"))
    rows = [F.struct(F.lit(k).alias("place"), F.lit(f).alias("field"), outcome(f, kinds[f]).alias("outcome"), shown("g", f).alias("expected"), shown("s", f).alias("actual")) for k, f in enumerate(fields)]
    joined = left.join(right, KEY)
    return joined.select("nseq", *KEY, F.explode(F.array(*rows)).alias("r")).select("nseq", *KEY, "r.*").where(F.col("outcome").isNotNull())


def field_metrics(compared: DataFrame) -> DataFrame:
    """Totals, accuracy and completeness of each field; a missing value counts as incorrect too."""
    n = compared.groupBy("field").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("outcome") == "correct", 1)).alias("correct"),
        F.count(F.when(F.col("outcome") != "correct", 1)).alias("incorrect"), F.count(F.when(F.col("outcome") == "missing", 1)).alias("missing"),
    )
    share = lambda c: F.when(F.col("total") > 0, F.bround(c * 100.0 / F.col("total"), 2)).otherwise(0.0)
    return n.select("*", share(F.col("correct")).alias("accuracy"), share(F.col("total") - F.col("missing")).alias("completeness"))


def overall(compared: DataFrame) -> DataFrame:
    n = compared.agg(F.count("*").alias("total"), F.count(F.when(F.col("outcome") == "correct", 1)).alias("correct"))
    return n.withColumn("accuracy", F.when(F.col("total") > 0, F.bround(F.col("correct") * 100.0 / F.col("total"), 2)).otherwise(0.0))


def wrong_values(compared: DataFrame, limit: int = 10) -> DataFrame:
    """The first wrong values in order; missing ones are not among them."""
    return compared.where(F.col("outcome") == "incorrect").orderBy("nseq", "place").limit(limit)


def report(compared: DataFrame) -> DataFrame:
    """One row: a map of field metrics, overall accuracy, and the number of wrong values."""
    m = field_metrics(compared)
    fields = m.agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("total", "correct", "incorrect", "missing", "accuracy", "completeness")))).alias("fields"))
    n = overall(compared).select("total", "accuracy")
    wrong = compared.agg(F.count(F.when(F.col("outcome") == "incorrect", 1)).alias("error_count"))
    return fields.crossJoin(n).crossJoin(wrong)  # one row each


def sample(rows: DataFrame, size: int = 50, seed: int = 0, university: str | None = None) -> DataFrame:
    """Exactly ``size`` rows (all if there are fewer), the same for the same seed; of one university if it is given."""
    rows = rows if university is None else rows.where(F.col("university") == university)
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *KEY, F.col("nseq").cast("string")).cast("binary")), "nseq").limit(size)
