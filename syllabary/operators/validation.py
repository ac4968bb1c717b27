"""Construction, validity rules, schema conformance and notes of course rows."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.courses import COURSE_ID, LEVELS, checked_level, normalize_course_id
from ..functions.text import SPACE, bind

REQUIRED = ("university", "course_id", "title", "description", "credits", "level", "department")
OPTIONAL = ("prerequisites", "prerequisites_text", "prerequisites_parsed", "corequisites", "restrictions", "offerings", "catalog_url", "last_updated", "notes")
OFFERINGS = ("Fall", "Spring", "Summer", "Winter", "Year-round")


def construct_error(line: Column) -> Column:
    """Why a JSON line cannot become a course: unknown keys, missing keys; null if it can."""
    keys = F.coalesce(F.json_object_keys(line), F.array().cast("array<string>"))
    unknown = F.array_except(keys, F.array(*map(F.lit, REQUIRED + OPTIONAL)))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    return (
        F.when(F.json_object_keys(line).isNull(), "not an object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ",")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(missing), ",")))
        .when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(line), "$.course_id", "variant")) != "STRING", "course_id is not text")
    )


def normalize(courses: DataFrame, run_time: str) -> DataFrame:
    """Normalised ids, checked levels, and a time of update for each course."""
    return courses.withColumns({"course_id": normalize_course_id(F.col("course_id")), "level": checked_level(F.col("level")), "last_updated": F.coalesce("last_updated", F.lit(run_time))})


def errors(credits: str = "credits") -> Column:
    """The validity errors of a row, in order; credits is struct(kind, num, text).

    The checked fields are bound, so that a filter on the errors finds each of them once.
    """
    blank = lambda c: c.isNull() | F.regexp_like(c, F.lit(rf"^{SPACE}*$"))

    def found(r: Column) -> Column:
        value, kind, course_id = r["credits"], r["credits"]["kind"], F.coalesce(r["course_id"], F.lit(""))
        lost = value.isNull() | (kind.isin("int", "float") & (value["num"] == 0)) | ((kind == "str") & blank(value["text"]))
        checks = [F.when(F.coalesce(lost if f == "credits" else blank(r[f]), F.lit(True)), F.lit(f"Missing required field: {f}")) for f in REQUIRED]
        checks.append(F.when(~F.regexp_like(course_id, F.lit(COURSE_ID)), F.concat(F.lit("Invalid course_id format: "), course_id)))
        checks.append(F.when(value.isNull(), "Credits must be number or string: None").when((kind == "str") & ~F.regexp_like(value["text"], F.lit(r"^\d+(-\d+)?$")), F.concat(F.lit("Invalid credits format: "), value["text"])))
        return F.array_compact(F.array(*checks))

    return bind(F.struct(*[F.col(credits if f == "credits" else f).alias(f) for f in REQUIRED]), found)


def with_errors(courses: DataFrame) -> DataFrame:
    return courses.withColumn("errors", errors()).withColumn("is_valid", F.size("errors") == 0)


def annotated_notes() -> Column:
    """Notes with the row's errors appended."""
    warning = F.when(F.size("errors") > 0, F.concat(F.lit("Validation warnings: "), F.array_join("errors", "; ")))
    return F.when(F.size("errors") > 0, F.concat_ws(" | ", F.when(F.col("notes") != "", F.col("notes")), warning)).otherwise(F.col("notes"))


def summary(checked: DataFrame, total: int | None = None) -> DataFrame:
    """Totals and the share of valid rows; no rows give a null share."""
    n = F.count("*") if total is None else F.lit(total).cast("long")
    valid = F.count(F.when(F.col("is_valid"), 1))
    rows = checked.agg(n.alias("total"), valid.alias("valid"), F.count(F.when(~F.col("is_valid"), 1)).alias("invalid"))
    return rows.withColumn("success_rate", F.when(F.col("total") > 0, F.bround(F.col("valid") * 100.0 / F.col("total"), 1)))


def schema_violations(line: Column) -> Column:
    """Names of fields of a JSON course that break the fixed schema."""
    v = F.try_parse_json(line)
    at = lambda f: F.try_variant_get(v, f"$.{f}", "variant")
    kind = lambda f: F.schema_of_variant(at(f))
    text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    number = "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"
    out = [F.when(at(f).isNull(), F.lit(f"{f}: required")) for f in REQUIRED]
    for f in ("university", "course_id", "title", "description", "level", "department", "prerequisites_text", "restrictions", "catalog_url", "last_updated", "notes"):
        out.append(F.when(at(f).isNotNull() & (kind(f) != "STRING"), F.lit(f"{f}: type")))
    out.append(F.when((kind("course_id") == "STRING") & ~F.regexp_like(text("course_id"), F.lit(COURSE_ID)), F.lit("course_id: pattern")))
    out.append(F.when((kind("level") == "STRING") & ~text("level").isin(*LEVELS), F.lit("level: value")))
    out.append(F.when(at("credits").isNotNull() & (kind("credits") != "STRING") & ~F.regexp_like(kind("credits"), F.lit(number)), F.lit("credits: type")))
    out.append(F.when(at("prerequisites_parsed").isNotNull() & (kind("prerequisites_parsed") != "BOOLEAN"), F.lit("prerequisites_parsed: type")))
    for f, allowed in (("corequisites", None), ("offerings", OFFERINGS)):
        items = F.try_variant_get(v, f"$.{f}", "array<string>")
        bad = F.exists(items, lambda x: ~x.isin(*allowed)) if allowed else F.lit(False)
        out.append(F.when(at(f).isNotNull() & (~F.startswith(kind(f), F.lit("ARRAY")) | F.coalesce(bad, F.lit(False))), F.lit(f"{f}: items")))
    out.append(F.when(at("prerequisites").isNotNull() & ~F.regexp_like(kind("prerequisites"), F.lit("^(OBJECT|VOID)")), F.lit("prerequisites: type")))
    return F.array_compact(F.array(*out))


def summary_metrics() -> list[Column]:
    """Aggregates of checked rows: all of them, the valid and the invalid ones."""
    return [F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid")]


def success_rate(good: int, total: int, digits: int) -> float:
    """Percent to some places, halves to even as ``bround`` does, 0 of nothing."""
    return float(Decimal(str(good * 100.0 / total)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN)) if total else 0.0


def write_counted(rows: DataFrame, path: str, *metrics: Column) -> dict:
    """Write rows as Parquet and return aggregates over them that the writing tasks took on the way: nothing is read twice."""
    seen = Observation()
    rows.observe(seen, *metrics).write.mode("overwrite").parquet(path)
    return seen.get


def write_checked(rows: DataFrame, path: str) -> dict:
    """Write checked rows; total, valid, invalid and success rate."""
    n = write_counted(rows, path, *summary_metrics())
    return n | {"success_rate": success_rate(n["valid"], n["total"], 1)}
