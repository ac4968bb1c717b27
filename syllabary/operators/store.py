"""Keyed course tables: keep-one rules, upsert, merge, lookups, search and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_ascii, preview

KEY = ["university", "course_id"]


def whole_row(rows: DataFrame) -> Column:
    """A row as text, equal for equal rows only: what tells rows of one place apart."""
    return F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})


def _order(rows: DataFrame, order: str, last: bool, unique: bool) -> list[Column]:
    by = F.col(order).desc_nulls_last() if last else F.col(order).asc_nulls_last()
    return [by] if unique else [by, whole_row(rows).asc()]


def _one(rows: DataFrame, order: str, last: bool, key: list[str], unique: bool) -> DataFrame:
    """One pass: each task keeps one row a key before anything is shuffled, so a hot key costs a row a task."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*_order(rows, order, last, unique)))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def keep_first(rows: DataFrame, order: str = "nseq", key: list[str] = KEY, unique: bool = False) -> DataFrame:
    """One row of each key: the first by ``order``, nulls last; of equal places the smallest row as JSON text.

    ``unique`` promises that no key has a place twice, and saves that text.
    """
    return _one(rows, order, False, key, unique)


def keep_last(rows: DataFrame, order: str = "nseq", key: list[str] = KEY, unique: bool = False) -> DataFrame:
    """One row of each key: the last by ``order``, nulls before all; ties as in :func:`keep_first`."""
    return _one(rows, order, True, key, unique)


def duplicates(rows: DataFrame, order: str = "nseq", key: list[str] = KEY, unique: bool = False) -> DataFrame:
    """The rows that :func:`keep_first` leaves out, with their place in the key's order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*_order(rows, order, False, unique)))
    return rows.withColumn("occurrence", place.cast("long")).where("occurrence > 1")


def upsert(existing: DataFrame, batch: DataFrame, key: list[str] = KEY, order: str = "nseq", unique: bool = False) -> DataFrame:
    """Rows of the batch (the last of each key) replace rows of the table."""
    new = keep_last(batch, order, key, unique)
    return existing.join(new.select(*key), key, "left_anti").unionByName(new)


def merge(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def by_university(rows: DataFrame, university: str) -> DataFrame:
    return rows.where(F.col("university") == university).orderBy("course_id")


def by_department(rows: DataFrame, university: str, department: str) -> DataFrame:
    return rows.where((F.col("university") == university) & (F.col("department") == department)).orderBy("course_id")


def lookup(rows: DataFrame, university: str, course_id: str) -> DataFrame:
    return rows.where((F.col("university") == university) & (F.col("course_id") == course_id)).limit(1)


def fold_query(query: str) -> str:
    """A-Z to a-z, as in the texts that are searched."""
    return query.translate({c: c + 32 for c in range(65, 91)})


def search(rows: DataFrame, query: str, university: str | None = None) -> DataFrame:
    """Title or description contains the query; ``%`` and ``_`` are wildcards, ASCII case is ignored."""
    pattern = "%" + fold_query(query).replace("\\", "\\\\") + "%"
    hit = fold_ascii(F.col("title")).like(pattern) | fold_ascii(F.col("description")).like(pattern)
    found = rows.where(hit)
    return found.orderBy("university", "course_id") if university is None else found.where(F.col("university") == university).orderBy("course_id")


def search_page(rows: DataFrame, query: str, university: str | None = None, limit: int = 10, order: str = "nseq") -> DataFrame:
    """The first hits with a short description and the number of all hits."""
    found = search(rows, query, university)
    total = found.agg(F.count("*").alias("matches"))
    page = found.orderBy("university", "course_id", order).limit(limit)
    return page.select("university", "course_id", "title", preview(F.col("description")).alias("preview")).crossJoin(F.broadcast(total))  # one row


def counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("courses")).orderBy(F.desc("courses"), column)


def parse_rate(rows: DataFrame) -> DataFrame:
    """Rows parsed for each hundred with prerequisite text (it may exceed 100)."""
    n = rows.agg(F.count(F.when(F.col("prerequisites_parsed"), 1)).alias("parsed"), F.count("prerequisites_text").alias("with_text"))
    return n.withColumn("parse_rate", F.when(F.col("with_text") > 0, F.bround(F.col("parsed") * 100.0 / F.col("with_text"), 2)).otherwise(0.0))


def statistics(rows: DataFrame) -> DataFrame:
    """Counts overall, by university and by level in one pass."""
    sets = rows.groupingSets([["university"], ["level"], []], "university", "level")
    out = sets.agg(F.grouping_id().alias("gid"), F.count("*").alias("courses"), F.count(F.when(F.col("prerequisites_parsed"), 1)).alias("parsed"))
    scope = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "university").otherwise("level")
    return out.select(scope.alias("scope"), F.when(F.col("gid") == 1, F.col("university")).when(F.col("gid") == 2, F.col("level")).alias("name"), "courses", "parsed")
