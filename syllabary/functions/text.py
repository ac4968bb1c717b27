"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space: ASCII, information separators, next line, and Unicode separators.
SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def bind(c: Column, f) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), 0)


def strip(c: Column) -> Column:
    """Without white space at the ends; the look-behind tries a run of it once, however long it is."""
    return F.regexp_replace(c, rf"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def normalize_whitespace(c: Column) -> Column:
    """One space for each run of white space, none at the ends; null gives an empty text."""
    return F.coalesce(F.trim(F.regexp_replace(c, rf"{SPACE}+", " ")), F.lit(""))


def fix_broken_lines(c: Column) -> Column:
    """Join words that a hyphen breaks at a line end, and lines that go on in lower case."""
    joined = F.regexp_replace(c, rf"-{SPACE}*\n{SPACE}*", "")
    return F.regexp_replace(joined, r"(?<![.!?;:])\n(?=[a-z])", " ")


def decode_entities(c: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def clean_text(c: Column) -> Column:
    """Normalised text with four entities decoded and no white space before ``.,;:``."""
    return F.trim(F.regexp_replace(decode_entities(normalize_whitespace(c)), r" +([.,;:])", "$1"))  # no other white space is left


def split_entries(c: Column, delimiter: str = r"\n[\t-\r ]*\n") -> Column:
    """The non-empty stripped pieces between blank lines."""
    return F.filter(F.transform(F.split(c, delimiter), strip), lambda x: x != "")


def fold_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def preview(c: Column, size: int = 100) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def nullif_empty(c: Column) -> Column:
    """Null for an empty text; ``c`` is evaluated once, also inside a lambda, where Spark does not share expressions."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), 0)
