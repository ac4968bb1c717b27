"""Parts of HTML pages by patterns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, decode_entities, nullif_empty, strip


def links(html: Column, pattern: str | None = None) -> Column:
    """All link targets in page order, or those in which the pattern is found."""
    found = F.regexp_extract_all(html, F.lit(r'<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))
    return found if pattern is None else F.filter(found, lambda x: F.regexp_like(x, F.lit(pattern)))


def distinct_links(html: Column, pattern: str | None = None, most: int | None = None) -> Column:
    out = F.array_sort(F.array_distinct(links(html, pattern)))
    return out if most is None else F.slice(out, 1, most)


def class_text(html: Column, *classes: str) -> Column:
    """The first direct text of the first element that has one of the classes; null if none."""
    names = "|".join(classes)
    hit = F.regexp_extract(html, rf'<\w+[^>]*class="(?:[^"]*\s)?(?:{names})(?:\s[^"]*)?"[^>]*>([^<]+)', 1)
    return nullif_empty(decode_entities(hit))


def element_text(html: Column, tag: str) -> Column:
    return nullif_empty(decode_entities(F.regexp_extract(html, rf"<{tag}\b[^>]*>([^<]+)", 1)))


def all_text(html: Column) -> Column:
    return decode_entities(F.regexp_replace(html, r"<[^>]+>", " "))


#: Elements that have no content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_OPEN = "array<struct<start:int,tag:string,depth:int>>"
_DONE = "array<struct<start:int,stop:int>>"


def blocks(html: Column, css_class: str) -> Column:
    """The elements of the class, each from its start tag to its own end tag, in page order; nested ones count too.

    The page is read as start and end tags, each with the text behind it.  An open element
    counts the tags of its name, one up and one down, and ends where the count is back at
    none; a paragraph also ends where the next one starts; an element that nothing ends goes
    on to the end of the page.  Comments are no part of the page.
    """
    page = F.regexp_replace(html, r"<!--[\s\S]*?(?:-->|$)", "")
    start = rf'^<\w[^>]*\bclass="(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"'

    def cut(page: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_OPEN).alias("open"), F.array().cast(_DONE).alias("done"))

        def read(part: Column) -> Column:
            """What the fold asks of a part, found once."""
            close = F.when(F.startswith(part, F.lit("<")), F.instr(part, ">")).otherwise(0)
            size = F.when(F.startswith(part, F.lit("<")) & (close == 0), F.length(part)).otherwise(close)
            begins = F.contains(part, F.lit('class="')) & F.regexp_like(part, F.lit(start))
            tag = F.lower(F.regexp_extract(part, r"^</?(\w+)", 1))
            return F.struct(tag.alias("tag"), F.startswith(part, F.lit("</")).alias("ends"), size.alias("size"), F.length(part).alias("length"), begins.alias("begins"))

        def step(s: Column, part: Column) -> Column:
            tag, ends, begins = part["tag"], part["ends"], part["begins"]
            behind, after = s["at"] + part["size"], s["at"] + part["length"]
            change = F.when(ends | (tag == "p"), F.lit(-1)).otherwise(F.lit(1))
            lone = tag.isin(*VOID)
            more = F.array(F.struct(s["at"].alias("start"), tag.alias("tag"), F.lit(1).alias("depth")))
            whole = F.array(F.struct(s["at"].alias("start"), behind.alias("stop")))

            def counted(moved: Column) -> Column:
                shut = F.transform(F.filter(moved, lambda o: o["depth"] <= 0), lambda o: F.struct(o["start"].alias("start"), F.when(ends, behind).otherwise(s["at"]).alias("stop")))
                done = F.concat(s["done"], shut)
                left = F.filter(moved, lambda o: o["depth"] > 0)
                return F.struct(after.alias("at"), F.when(begins & ~lone, F.concat(left, more)).otherwise(left).alias("open"), F.when(begins & lone, F.concat(done, whole)).otherwise(done).alias("done"))

            moved = F.transform(s["open"], lambda o: F.struct(o["start"].alias("start"), o["tag"].alias("tag"), F.when(o["tag"] == tag, o["depth"] + change).otherwise(o["depth"]).alias("depth")))
            quiet = ~begins & ~F.exists(s["open"], lambda o: o["tag"] == tag)
            return F.when(quiet, F.struct(after.alias("at"), s["open"].alias("open"), s["done"].alias("done"))).otherwise(bind(moved, counted))

        def finish(s: Column) -> Column:
            rest = F.transform(s["open"], lambda o: F.struct(o["start"].alias("start"), s["at"].alias("stop")))
            return F.transform(F.array_sort(F.concat(s["done"], rest)), lambda b: F.substring(page, b["start"] + 1, b["stop"] - b["start"]))

        return F.aggregate(F.transform(F.split(page, "(?=<)"), read), zero, step, finish)

    some = F.regexp_like(page, F.lit(start.removeprefix("^")))  # most pages of most sites have none
    return F.when(some, bind(page, cut)).otherwise(F.array().cast("array<string>"))


def class_links(html: Column, css_class: str) -> Column:
    """Targets of the links that have the class, in page order."""
    tags = F.regexp_extract_all(html, F.lit(rf'(<a\b[^>]*\bclass="(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"[^>]*>)'), F.lit(1))
    return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r'\bhref="([^"]*)"', 1)), lambda x: x != "")


def last_crumb(html: Column) -> Column:
    """The text of the last item of the element with class ``breadcrumb``; null if none."""
    inside = F.regexp_extract(html, r'class="(?:[^"]*\s)?breadcrumb(?:\s[^"]*)?"[^>]*>([\s\S]*?)</(?:ul|ol|nav)>', 1)
    items = F.regexp_extract_all(inside, F.lit(r"<li\b[^>]*>([^<]*)"), F.lit(1))
    return nullif_empty(decode_entities(F.try_element_at(items, F.lit(-1))))


def first_text(html: Column) -> Column:
    """The first text that is not inside a tag, null if there is none."""
    return nullif_empty(decode_entities(F.regexp_extract(html, r">([^<]+)", 1)))


def department_name(html: Column, url: Column, path: str = r"/courses/([a-z]+)/") -> Column:
    """The heading without its code, else the last breadcrumb, else the code in the address, else Unknown."""
    heading = F.regexp_replace(element_text(html, "h1"), r"\s*\([A-Z]+\)\s*", "")
    return F.coalesce(strip(heading), strip(last_crumb(html)), F.upper(nullif_empty(F.regexp_extract(url, path, 1))), F.lit("Unknown"))
