"""Course rows from catalogue pages and catalogue text, driven by a small table of site rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import courses as C
from ..functions import html as H
from ..functions import prerequisites as P
from ..functions.text import bind, clean_text, fix_broken_lines, nullif_empty, strip
from .validation import success_rate, write_counted

RULES_SCHEMA = """name string, university string, block string, code string, title string, hours string, description string,
    prereq string, title_pattern string, level_rule string, default_credits string, link_pattern string, links_kept int, clause string,
    other_links string, other_block string, detail_links string"""
_CLAUSE = r"(?i)prereq(?:uisite)?s?\s*:\s*([^.]+)"
_FAMILY = {
    "block": "courseblock", "code": "detail-code", "title": "detail-title", "hours": "detail-hours_html", "description": "courseblockextra", "prereq": None,
    "title_pattern": None, "level_rule": "number", "default_credits": "Unknown", "link_pattern": "/courses/[a-z]+/", "links_kept": 20, "clause": None,
    "other_links": None, "other_block": None, "detail_links": None,
}

# Sites that share one page layout.
FAMILY_SITES = {
    "columbia": "Columbia University", "upenn": "University of Pennsylvania", "ucsd": "University of California, San Diego", "uci": "University of California, Irvine",
    "ucd": "University of California, Davis", "unc": "University of North Carolina", "wisconsin": "University of Wisconsin", "case_western": "Case Western Reserve University",
    "penn_state": "Pennsylvania State University", "florida": "University of Florida", "colorado": "University of Colorado",
}


def rules(spark: SparkSession, extra: list[dict] = ()) -> DataFrame:
    """One row a site; later rows of the same name win."""
    own = [
        {"name": "uconn", "university": "University of Connecticut", "prereq": "detail-prereqs", "link_pattern": r"/undergraduate/courses/[a-z]+/", "other_links": r"/graduate/courses/[a-z]+/", "other_block": "course", "detail_links": "bubblelink courseblockcode", "clause": _CLAUSE},
        {"name": "mit", "university": "Massachusetts Institute of Technology", "title_pattern": r"(?<code>\d+\.[\dA-Z]+)\s+(?<title>.+?)(?:\.|$)", "level_rule": "dotted", "clause": r"(?i)prereq(?:uisite)?s?\s*[:\-]\s*([^.;]+)"},
        {"name": "yale", "university": "Yale University", "title_pattern": r"^(?<code>[A-Z]{2,6}\s+\d{3,4}[A-Z]?)\.?\s+(?<title>.+)$", "clause": _CLAUSE},
        {"name": "stanford", "university": "Stanford University", "title_pattern": r"^(?<code>[A-Z]+\s+\d+[A-Z]?):\s+(?<title>.+)$", "default_credits": "3", "links_kept": 5},
        {"name": "berkeley", "university": "University of California, Berkeley", "title_pattern": r"^(?<code>[A-Z]+\s+\d+[A-Z]?)\.\s+(?<title>.+?)(?:\.\s+\d+\s+Units?\.?)?$", "default_credits": "3"},
        {"name": "harvard", "university": "Harvard University", "title_pattern": r"^(?<code>[A-Z]+\s+\d+[A-Z]?)[^:]*:\s*(?<title>.+)$", "default_credits": "3"},
        {"name": "princeton", "university": "Princeton University", "title_pattern": r"^(?=(?<code>[A-Z]+\s+\d+[A-Z]?))(?<title>.+)$", "default_credits": "3"},
        {"name": "cornell", "university": "Cornell University", "title_pattern": r"^(?=(?<code>[A-Z]+\s+\d+[A-Z]?))(?<title>.+)$", "default_credits": "3"},
    ]
    own += [{"name": n, "university": u} for n, u in FAMILY_SITES.items()]
    table = {r["name"]: _FAMILY | r for r in [*own, *extra]}
    names = [f.split()[0] for f in RULES_SCHEMA.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in table.values()], RULES_SCHEMA)


@dataclass(frozen=True)
class SiteRule:
    """A row of the rules table, as parameters of the expressions below."""

    name: str
    university: str
    block: str
    code: str
    title: str
    hours: str
    description: str
    prereq: str | None
    title_pattern: str | None
    level_rule: str
    default_credits: str
    link_pattern: str
    links_kept: int
    clause: str | None
    other_links: str | None
    other_block: str | None
    detail_links: str | None


def site_rules(table: DataFrame) -> list[SiteRule]:
    """The rules of all sites; the table is small by nature (one row a site)."""
    return [SiteRule(**r.asDict()) for r in table.orderBy("name").collect()]


def unknown_sites(pages: DataFrame, table: DataFrame) -> DataFrame:
    """Pages whose ``site`` has no rule, whatever its case."""
    return pages.join(F.broadcast(table.select(F.lower("name").alias("__name"))), F.lower("site") == F.col("__name"), "left_anti")


def listed(table: DataFrame) -> DataFrame:
    """``name, university, sites`` in order of the name, with the number of all sites."""
    return table.select("name", "university").crossJoin(F.broadcast(table.agg(F.count("*").alias("sites")))).orderBy("name")  # one row


def discover_links(pages: DataFrame, rule: SiteRule) -> DataFrame:
    """``page_id, url, link`` of the links a site's rule follows, at most ``links_kept`` a page.

    The rule's other pattern counts only on pages where the first finds nothing.
    """
    found = H.distinct_links(F.col("html"), rule.link_pattern, rule.links_kept)
    if rule.other_links:
        found = F.when(F.size(found) > 0, found).otherwise(H.distinct_links(F.col("html"), rule.other_links, rule.links_kept))
    return pages.select("page_id", "url", F.explode(found).alias("link"))


def _blocks(rule: SiteRule) -> Column:
    found = H.blocks(F.col("html"), rule.block)
    return found if not rule.other_block else F.when(F.size(found) > 0, found).otherwise(H.blocks(F.col("html"), rule.other_block))


def course_blocks(pages: DataFrame, rule: SiteRule) -> DataFrame:
    """``page_id, url, department, position, block`` of each course block of ``pages(page_id, url, html)``.

    The rule's other class counts only on pages without a block of the first.
    """
    return pages.select("page_id", "url", H.department_name(F.col("html"), F.col("url")).alias("department"), F.posexplode(_blocks(rule)).alias("position", "block"))


def replace_by_detail(blocks: DataFrame, pages: DataFrame, rule: SiteRule) -> DataFrame:
    """A block that links to another page takes that page's first block, if it has one.

    Links of the rule's classes count, in the order of the classes; without such a rule
    any link.  Of pages with the same url the one with the smallest page_id counts.
    """
    links = [H.class_links(F.col("block"), c) for c in rule.detail_links.split()] if rule.detail_links else [H.links(F.col("block"))]
    details = pages.groupBy(F.col("url").alias("link")).agg(F.min_by("html", "page_id").alias("html"))
    details = details.select("link", F.try_element_at(_blocks(rule), F.lit(1)).alias("detail"))
    joined = blocks.withColumn("link", F.coalesce(*[F.try_element_at(x, F.lit(1)) for x in links])).join(details, "link", "left")
    return joined.withColumn("block", F.coalesce("detail", "block")).drop("detail", "link")


def _block_fields(b: Column, rule: SiteRule) -> Column:
    """``struct(code, title, credits, description, own, within)`` of a block; ``within`` is where a prerequisite clause is sought."""
    dotted = rule.level_rule == "dotted"
    none = F.lit(None).cast("string")
    default = C.credits_value("int", F.lit(3), F.lit("3")) if rule.default_credits == "3" else C.credits_value("str", F.lit(None), F.lit(rule.default_credits))

    def fields(whole: Column) -> Column:
        if rule.title_pattern:
            line = whole if dotted else clean_text(F.coalesce(H.class_text(b, rule.title, "courseblocktitle"), H.element_text(b, "h3"), H.first_text(b)))
            names = [rule.title_pattern.index("(?<code>"), rule.title_pattern.index("(?<title>")]
            place = 1 if names[0] < names[1] else 2

            def head(x: Column) -> Column:
                part = lambda k: F.regexp_extract(x, rule.title_pattern, k)
                return F.struct(nullif_empty(part(place)).alias("code"), nullif_empty(strip(part(3 - place))).alias("title"))

            heads = bind(line, head)
        else:
            raw = F.struct(H.class_text(b, rule.code).alias("code"), H.class_text(b, rule.title).alias("title"))
            code = lambda r: F.when(r["title"].isNotNull() & r["code"].isNotNull(), F.split_part(clean_text(r["code"]), F.lit("."), F.lit(1)))
            title = lambda r: F.when(r["title"].isNotNull(), F.regexp_replace(clean_text(r["title"]), r"\.+$", ""))
            heads = bind(raw, lambda r: F.struct(code(r).alias("code"), title(r).alias("title")))
        hours = H.class_text(b, rule.hours, "courseblockhours")
        source = whole if dotted else F.coalesce(hours, F.regexp_extract(whole, r"(\d+\s+Units?)", 1)) if rule.name == "berkeley" else hours

        def credits(source: Column) -> Column:
            units = C.units_credits(source) if dotted else bind(nullif_empty(F.regexp_extract(source, r"(\d+)\s+Units?", 1)), lambda u: F.when(u.isNotNull(), C.credits_value("int", u, u)))
            return F.coalesce(C.extract_credits(source), units, default)

        stated = H.class_text(b, rule.description, "courseblockdesc")
        description = bind(stated, lambda x: F.when(x.isNotNull(), clean_text(x)).otherwise(whole if dotted else F.lit("")))
        own = H.class_text(b, rule.prereq) if rule.prereq else none
        within = lambda d: F.concat_ws(" ", whole, d) if dotted else d
        row = lambda h, d: F.struct(h["code"].alias("code"), h["title"].alias("title"), bind(source, credits).alias("credits"), d.alias("description"), own.alias("own"), within(d).alias("within"))
        return bind(heads, lambda h: bind(description, lambda d: row(h, d)))

    needed = dotted or rule.name == "berkeley"
    return bind(clean_text(H.all_text(b)), fields) if needed else fields(none)


def parse_blocks(blocks: DataFrame, rule: SiteRule) -> DataFrame:
    """Course rows of a site's blocks; a block without code or title has status ``failed``.

    A block's fields are found by one bound expression, so each part is evaluated once and
    the generated code stays small enough for the JVM to compile.
    """
    rows = blocks.select("page_id", "url", "department", "position", bind(F.col("block"), lambda b: _block_fields(b, rule)).alias("f"))
    clause = P.prerequisite_clause(F.col("f.within"), rule.clause) if rule.clause else F.lit(None).cast("string")
    rows = rows.select("page_id", "url", "department", "position", "f.*", P.parse_prerequisites(F.coalesce("f.own", clause)).alias("p"))

    def ids(code: Column) -> Column:
        course_id = C.normalize_course_id(code)
        return bind(course_id, lambda x: F.struct(x.alias("id"), (C.infer_dotted_level(code) if rule.level_rule == "dotted" else C.infer_level(x)).alias("level")))

    rows = rows.withColumn("i", bind(F.col("code"), ids))
    ok = F.col("code").isNotNull() & F.col("title").isNotNull()
    return rows.select(
        "page_id", "position", F.lit(rule.university).alias("university"), F.col("i.id").alias("course_id"), "title", "description", "credits", F.col("i.level").alias("level"), "department",
        F.col("p.tree").alias("prerequisites"), F.col("p.text").alias("prerequisites_text"), F.col("p.parsed").alias("prerequisites_parsed"), F.col("url").alias("catalog_url"),
        F.when(ok, "parsed").otherwise("failed").alias("status"), F.when(~ok, "no code or title").alias("reason"),
    )


def success_rates(parsed: DataFrame) -> DataFrame:
    """Parsed and failed blocks of each university and the share of the former."""
    n = parsed.groupBy("university").agg(F.count(F.when(F.col("status") == "parsed", 1)).alias("parsed"), F.count(F.when(F.col("status") != "parsed", 1)).alias("failed"))
    total = F.col("parsed") + F.col("failed")
    return n.withColumn("success_rate", F.when(total > 0, F.bround(F.col("parsed") * 100.0 / total, 2)).otherwise(0.0))


def write_parsed(parsed: DataFrame, path: str) -> dict:
    """Write a site's rows; its parsed and failed blocks and the share of the former, counted while writing."""
    n = write_counted(parsed, path, F.count_if(F.col("status") == "parsed").alias("parsed"), F.count_if(F.col("status") != "parsed").alias("failed"))
    return n | {"success_rate": success_rate(n["parsed"], n["parsed"] + n["failed"], 2)}


ENTRY = r"[A-Z]{2,6}\s+\d{3,4}[A-Z]?\.\s"


def catalogue_entries(texts: DataFrame, pattern: str = ENTRY) -> DataFrame:
    """``doc_id, position, entry``: catalogue text cut where a line starts with a course code."""
    start = rf"(?=(?:^|\n)[\t-\r ]*{pattern})"
    parts = F.filter(F.split(F.col("text"), start), lambda x: F.regexp_like(x, F.lit(rf"^[\t-\r ]*{pattern}")))
    return texts.select("doc_id", F.posexplode(F.transform(parts, strip)).alias("position", "entry"))


#: Code, number, title and perhaps credits of an entry's first line.
_HEAD = r"^([A-Z]{2,6})\s+(\d{3,4}[A-Z]?)\.\s+(.+?)(?:\.\s+(\d+(?:\.\d+)?)\s+credits?)?\.?\s*$"


def entry_fields(entry: Column) -> Column:
    """``struct(course_id, title, credits, description, level, p)`` of a catalogue entry; the title is null where the first line is none.

    The first line is taken apart by one match into tokens, a line each.
    """

    def of_tokens(t: Column) -> Column:
        course_id, title, number, rest = t["head"][0], F.get(t["head"], 1), F.get(t["head"], 2), t["rest"]
        credits = F.coalesce(F.when(number != "", C.extract_credits(F.concat(number, F.lit(" credits")))), C.extract_credits(rest), C.credits_value("str", F.lit(None), F.lit("Unknown")))
        return F.struct(
            course_id.alias("course_id"), F.regexp_replace(strip(title), r"\.+$", "").alias("title"), credits.alias("credits"), rest.alias("description"), C.infer_level(course_id).alias("level"),
            P.parse_prerequisites(P.prerequisite_clause(rest)).alias("p"),
        )

    def of_body(body: Column) -> Column:
        first = F.split_part(body, F.lit("\n"), F.lit(1))
        return bind(F.struct(F.split(F.regexp_replace(first, _HEAD, "$1 $2\n$3\n$4"), "\n").alias("head"), clean_text(F.substring(body, F.length(first) + 2, F.length(body))).alias("rest")), of_tokens)

    return bind(fix_broken_lines(entry), of_body)


def parse_entries(entries: DataFrame, university: str, department: str, url: str) -> DataFrame:
    """Course rows of catalogue entries; the first line holds code and title, perhaps credits."""
    one = F.filter(F.array(entry_fields(F.col("entry"))), lambda f: f["title"] != "")  # a filter behind would find the fields twice
    rows = entries.select("doc_id", "position", F.explode(one).alias("f"))
    return rows.select(
        "doc_id", "position", F.lit(university).alias("university"), "f.course_id", "f.title", "f.description", "f.credits", "f.level", F.lit(department).alias("department"),
        F.col("f.p.tree").alias("prerequisites"), F.col("f.p.text").alias("prerequisites_text"), F.col("f.p.parsed").alias("prerequisites_parsed"), F.lit(url).alias("catalog_url"),
    )
