"""Course identity, level, department and credits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, bind, nullif_empty, strip

LEVELS = ("Undergraduate", "Graduate", "Professional", "Unknown")
COURSE_ID = r"^[A-Z]{2,6}[\t-\r ]*\d{3,4}[A-Z]?$"


def normalize_course_id(c: Column) -> Column:
    """Single spaces for hyphens and blanks, a space between letters and digits, upper case last."""
    c = F.regexp_replace(strip(c), rf"(-|{SPACE})+", " ")
    c = F.regexp_replace(c, r"([A-Z]+)(\d)", "$1 $2")
    return F.upper(F.regexp_replace(c, rf"{SPACE}+", " "))


def infer_level(course_id: Column) -> Column:
    """Below 5000 in the first run of digits is undergraduate."""
    digits = nullif_empty(F.regexp_extract(course_id, r"\d+", 0))
    return bind(digits, lambda d: F.when(d.isNull(), "Unknown").when(F.coalesce(d.try_cast("bigint"), F.lit(1 << 62)) < 5000, "Undergraduate").otherwise("Graduate"))


def infer_dotted_level(number: Column) -> Column:
    """Level of ids such as 6.001: 500 and more after the dot is graduate."""
    part = F.when(F.contains(number, F.lit(".")), F.split_part(number, F.lit("."), F.lit(2))).otherwise(number)
    digits = nullif_empty(F.regexp_replace(part, r"\D", ""))
    return F.when(digits.isNull(), "Unknown").when(F.coalesce(digits.try_cast("bigint"), F.lit(1 << 62)) >= 500, "Graduate").otherwise("Undergraduate")


def checked_level(level: Column) -> Column:
    return F.when(level.isin(*LEVELS), level).otherwise("Unknown")


def find_course_id(text: Column) -> Column:
    """The first course id in a text, or null."""
    hit = F.regexp_extract(text, r"\b([A-Z]{2,6})[\s\-]*(\d{3,4}[A-Z]?)\b", 0)
    return nullif_empty(hit)


def extract_department(text: Column, course_id: Column) -> Column:
    """The id's prefix, else what follows "Department of" or "Offered by"."""
    named = nullif_empty(F.regexp_extract(text, r"(?i)Department of ([^,.\n]+)", 1))
    offered = nullif_empty(F.regexp_extract(text, r"(?i)Offered by:?\s*([^,.\n]+)", 1))
    return F.coalesce(nullif_empty(F.regexp_extract(course_id, r"^([A-Z]{2,6})", 1)), strip(named), strip(offered))


def credits_value(kind: str | Column, num: Column, text: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), num.cast("double").alias("num"), text.alias("text"))


def extract_credits(text: Column) -> Column:
    """``struct(kind, num, text)`` or null: a range, a number with a unit, a number in brackets, or "variable"."""
    unit = r"\s*(?:credits?|cr\.?|hours?)"
    none = F.lit(None).cast("double")
    span = nullif_empty(F.regexp_replace(F.regexp_extract(text, r"(?i)\d+-\d+" + unit, 0), r"(?i)" + unit + "$", ""))

    def of_number(n: Column) -> Column:
        dot = F.contains(n, F.lit("."))
        plain = credits_value(F.when(dot, "float").otherwise("int"), n.cast("double"), F.when(dot, n.cast("double").cast("string")).otherwise(F.regexp_replace(n, r"^0+(?=\d)", "")))
        return F.when(n.isNotNull(), plain).when(F.regexp_like(text, F.lit(r"(?i)\b(variable|varies|vary)\b")), credits_value("str", none, F.lit("variable")))

    number = F.coalesce(nullif_empty(F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)" + unit, 1)), nullif_empty(F.regexp_extract(text, r"\((\d+(?:\.\d+)?)\)", 1)))
    return bind(span, lambda r: F.when(r.isNotNull(), credits_value("str", none, r)).otherwise(bind(number, of_number)))


def credits_or_unknown(credits: Column) -> Column:
    return F.coalesce(credits, credits_value("str", F.lit(None), F.lit("Unknown")))


def units_credits(text: Column) -> Column:
    """The first number of units such as 3-0-9."""
    first = nullif_empty(F.regexp_extract(text, r"(\d+)-\d+-\d+", 1))
    return bind(first, lambda x: F.when(x.isNotNull(), credits_value("int", x, x)))


def title_line(line: Column) -> Column:
    """``struct<course_id, title, credits>`` of a line ``DEPT 123. Title. 3 credits``; all null if it has another form."""
    line, pattern = strip(line), r"^([A-Z]{2,6})\s+(\d{3,4}[A-Z]?)\.\s+(.+?)(?:\.\s+(.+))?$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    hit = F.regexp_like(line, F.lit(pattern))
    return F.struct(
        F.when(hit, F.concat_ws(" ", part(1), part(2))).alias("course_id"), F.when(hit, strip(part(3))).alias("title"), F.when(hit & (part(4) != ""), extract_credits(part(4))).alias("credits"),
    )
