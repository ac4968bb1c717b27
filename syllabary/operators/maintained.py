"""Statistics kept beside a table and changed by what an upsert adds and removes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["university", "level"]
COUNTS = ["courses", "parsed", "with_text"]


def cells(rows: DataFrame) -> DataFrame:
    """Counts by university and level, from which all statistics follow: rows, parsed rows, rows with prerequisite text."""
    return rows.groupBy(*CELL).agg(F.count("*").alias("courses"), F.count(F.when(F.col("prerequisites_parsed"), 1)).alias("parsed"), F.count("prerequisites_text").alias("with_text"))


def delta(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Signed counts of a change; a row that is replaced is among both."""
    less = cells(removed).select(*CELL, *[(-F.col(c)).alias(c) for c in COUNTS])
    return apply(cells(added), less)


def apply(stored: DataFrame, change: DataFrame) -> DataFrame:
    """Counts after a change; cells without rows go.  A change of a change is a change too."""
    both = stored.select(*CELL, *COUNTS).unionByName(change.select(*CELL, *COUNTS))
    return both.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in COUNTS]).where(" or ".join(f"{c} <> 0" for c in COUNTS))


def statistics(stored: DataFrame) -> DataFrame:
    """``scope, name, courses, parsed, parse_rate``: overall, by university and by level, from cells."""
    sets = stored.groupingSets([["university"], ["level"], []], "university", "level")
    out = sets.agg(F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in COUNTS])
    scope = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "university").otherwise("level")
    name = F.when(F.col("gid") == 1, F.col("university")).when(F.col("gid") == 2, F.col("level"))
    rate = F.when(F.col("with_text") > 0, F.bround(F.col("parsed") * 100.0 / F.col("with_text"), 2)).otherwise(0.0)
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[:2]]
    return out.select(scope.alias("scope"), name.alias("name"), *none, F.coalesce(rate, F.lit(0.0)).alias("parse_rate"))
