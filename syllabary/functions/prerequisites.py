"""Prerequisite text to typed trees, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, clean_text, nullif_empty

CODE = r"(?i)\b([A-Z]{2,6})[\s\-]*(\d{3,4}[A-Z]?)\b"

# Phrases that name a requirement other than a course.
KEYWORDS = [
    "permission of instructor", "instructor consent", "department consent", "instructor permission", "junior standing", "senior standing",
    "sophomore standing", "freshman standing", "graduate standing", "admission to", "minimum grade", "grade of", "gpa", "open only to",
    "restricted to", "majors only", "concurrent enrollment", "consent required", "departmental approval", "by invitation", "audition required",
    "portfolio review", "prerequisite waiver",
]
# Ways to state a least grade, in order.
GRADES = [r"(?i)minimum grade of\s+([A-F][+-]?)", r"(?i)grade of\s+([A-F][+-]?)\s+or\s+(?:better|higher)", r"(?i)([A-F][+-]?)\s+or\s+(?:better|higher)"]


def course_codes(text: Column) -> Column:
    """All course codes in order, as ``DEPT NUM``."""
    hits = F.regexp_extract_all(text, F.lit(CODE), F.lit(0))
    return F.transform(hits, lambda x: F.upper(F.regexp_replace(x, r"^([A-Za-z]+)[\s\-]*", "$1 ")))


def non_course_requirements(text: Column) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(low, k))


def minimum_grade(text: Column) -> Column:
    return F.upper(F.coalesce(*[nullif_empty(F.regexp_extract(text, g, 1)) for g in GRADES]))


_GROUP = "struct<op:string,courses:array<string>>"


def tree(op: Column, courses: Column, group: Column | None = None) -> Column:
    return F.struct(op.alias("op"), courses.alias("courses"), (F.lit(None).cast(_GROUP) if group is None else group).alias("group"))


def parse(text: Column) -> Column:
    """``struct(tree struct<op, courses, group struct<op, courses>>, parsed boolean)``.

    One bracketed group becomes ``group``; where the text has no connector the group
    alone is the tree.  Mixed connectors without brackets, or several groups, give no
    tree and parsed false.
    """
    low = F.lower(text)
    has_and, has_or = F.contains(low, F.lit(" and ")), F.contains(low, F.lit(" or "))
    codes = course_codes(text)
    brackets = F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), F.lit(1))
    group = brackets[0]
    outside = course_codes(F.regexp_replace(text, r"[\t-\r ]*\([^)]+\)[\t-\r ]*", " "))
    inner = F.struct(F.when(F.contains(F.lower(group), F.lit(" or ")), "or").otherwise("and").alias("op"), course_codes(group).alias("courses"))
    opened = F.contains(text, F.lit("("))
    flat = F.when(has_and & has_or, F.lit(None)).when(has_or & ~opened, tree(F.lit("or"), codes)).otherwise(tree(F.lit("and"), codes))
    nested = F.when(has_and, tree(F.lit("and"), outside, inner)).when(has_or, tree(F.lit("or"), outside, inner)).otherwise(tree(inner["op"], inner["courses"]))
    shape = F.when(~opened | (F.size(brackets) == 0), flat).when(F.size(brackets) == 1, nested)
    empty = F.lit(None).cast("struct<op:string,courses:array<string>,group:" + _GROUP + ">")
    blank = text.isNull() | (F.trim(text) == "")
    found = F.when(~blank & (F.size(codes) > 0), shape).otherwise(empty)
    parsed = F.when(blank, True).when(F.size(codes) == 0, F.size(non_course_requirements(text)) == 0).otherwise(shape.isNotNull())
    return F.struct(found.alias("tree"), parsed.alias("parsed"))


def tree_json(t: Column) -> Column:
    """The wire form of a tree, such as ``{"and":["CSE 1010",{"or":["A 1","B 2"]}]}``."""
    quoted = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",")
    inner = F.concat(F.lit('{"'), t["group"]["op"], F.lit('":['), quoted(t["group"]["courses"]), F.lit("]}"))
    parts = F.concat_ws(",", nullif_empty(quoted(t["courses"])), inner)
    return F.when(t.isNotNull(), F.concat(F.lit('{"'), t["op"], F.lit('":['), parts, F.lit("]}")))


def parse_prerequisites(text: Column) -> Column:
    """``struct(tree, text, parsed)`` of raw text; nothing gives (null, null, true)."""

    def result(clean: Column) -> Column:
        return bind(parse(clean), lambda r: F.struct(r["tree"].alias("tree"), clean.alias("text"), r["parsed"].alias("parsed")))

    return bind(nullif_empty(clean_text(text)), result)


def corequisites(text: Column) -> Column:
    """Codes after "corequisite(s)" up to a full stop, semicolon or the end; null if none."""
    codes = course_codes(F.regexp_extract(text, r"(?i)corequisites?\s*:?\s*(.+?)(?:[.;]|$)", 1))
    return F.when(F.size(codes) > 0, codes)


def prerequisite_clause(description: Column, pattern: str = r"(?i)(?:prerequisite|prereq)s?\s*:\s*([^.]+)") -> Column:
    return nullif_empty(F.trim(F.regexp_extract(description, pattern, 1)))
