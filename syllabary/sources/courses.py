"""Reading and writing course files and tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prerequisites import tree_json
from ..operators.validation import construct_error

TEXT_FIELDS = ("university", "course_id", "title", "description", "level", "department", "prerequisites_text", "restrictions", "catalog_url", "last_updated", "notes")


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Course columns of JSON lines, with ``construct_error`` and the ``line`` itself.

    Credits keep their kind: int, float or str.
    """
    c = F.col(line)
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.credits", "variant"))
    lexeme = F.get_json_object(c, "$.credits")
    credits = F.when(
        lexeme.isNotNull(),
        F.struct(
            F.when(kind == "STRING", "str").when(F.contains(lexeme, F.lit(".")), "float").otherwise("int").alias("kind"),
            F.when(kind != "STRING", lexeme.try_cast("double")).alias("num"), lexeme.alias("text"),
        ),
    )
    return lines.select(
        *[F.get_json_object(c, f"$.{f}").alias(f) for f in TEXT_FIELDS], credits.alias("credits"), F.get_json_object(c, "$.prerequisites").alias("prerequisites"),
        F.get_json_object(c, "$.prerequisites_parsed").try_cast("boolean").alias("prerequisites_parsed"),
        *[F.from_json(F.get_json_object(c, f"$.{f}"), "array<string>").alias(f) for f in ("corequisites", "offerings")],
        construct_error(c).alias("construct_error"), c.alias("line"), *[x for x in lines.columns if x != line],
    )


def numbered(rows: DataFrame, place: list[str], row: str = "row") -> DataFrame:
    """Add ``nseq``: 0, 1, 2, ... in the order of the ``place`` columns and then of ``row``.

    ``row`` must count up by one within each place.  Rows are counted by place first (one
    short row for each block of a file), so no row is sorted or moved.
    """
    sizes = rows.groupBy(*place).agg(F.min(row).alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*place, (before - F.col("first")).alias("shift"))
    return rows.join(starts, place).withColumn("nseq", F.col(row) + F.col("shift")).drop("shift")


def _files(spark: SparkSession, paths: tuple[str, ...], *more: Column, **options: str) -> DataFrame:
    """``value, arg, file, block`` of text files, and more columns of theirs."""
    for p in paths:
        _check_suffix(p)
    parts = [spark.read.text(p, **options).select("value", F.lit(k).alias("arg"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), *more) for k, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def place_of(arg: Column, file: Column, block: Column, row: Column) -> Column:
    """A binary key that sorts as argument, file, block and row do, without a second look at the files."""
    number = lambda c: F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.concat(F.lpad(F.hex(arg.cast("long")), 8, "0"), file, F.lit("\x00"), number(block), number(row)).cast("binary")


def read_jsonl(spark: SparkSession, *paths: str, bad: str = "keep", dense: bool = True) -> DataFrame:
    """JSON lines as courses; blank lines are skipped.

    ``nseq`` orders rows by argument, then by file name and by place in the file.  With
    ``dense`` off, a binary ``place`` does so instead: it has no numbers without gaps, and
    the files are read once and not twice.  ``bad`` says what happens to lines that cannot
    become a course: ``keep`` (with their error), ``skip`` or ``fail``.
    """
    rows = _files(spark, paths).withColumn("row", F.monotonically_increasing_id())
    if dense:
        lines = numbered(rows, ["arg", "file", "block"]).select("value", "nseq")
    else:
        lines = rows.select("value", place_of(*(F.col(c) for c in ("arg", "file", "block", "row"))).alias("place"))
    return _with_policy(parse_lines(lines.where(~F.regexp_like("value", F.lit(r"^\s*$")))), bad)


def _with_policy(parsed: DataFrame, bad: str) -> DataFrame:
    if bad == "skip":
        return parsed.where("construct_error is null")
    if bad == "fail":
        return parsed.withColumn("construct_error", F.when(F.col("construct_error").isNotNull(), F.raise_error(F.concat(F.lit("bad course: "), "construct_error"))))
    return parsed


#: A string, also one that the text begins inside of (after a quote put before it) or ends inside of.
_STRING = r'"(?:[^"\\]|\\[\s\S])*+(?:"|\z)'


def document_elements(spark: SparkSession, *paths: str) -> DataFrame:
    """``arg, file, element, value``: the elements of the JSON array in each file, or the file where it is no array.

    Files are read in blocks by many tasks, cut at each closing brace.  Sums over the blocks
    before, and over the pieces before in a block, tell whether a piece begins inside a
    string and how deep in brackets; a piece that comes back to the array's own depth ends
    an element.  Only an element's own pieces are brought together.
    """
    pieces = _files(spark, paths, F.col("_metadata.file_size").alias("bytes"), lineSep="}").withColumn("row", F.monotonically_increasing_id())
    # What a piece does where it begins outside a string, and where it begins inside one.
    quotes = F.length(F.regexp_replace("value", r'\\[\s\S]?|[^"\\]', ""))
    rest = {False: F.regexp_replace("value", _STRING, ""), True: F.regexp_replace(F.concat(F.lit('"'), "value"), _STRING, "")}
    turn = lambda c: F.length(F.regexp_replace(c, r"[^\[{]", "")) - F.length(F.regexp_replace(c, r"[^\]]", ""))
    odd = (quotes % 2).cast("int")
    # The brace that ended the piece counts where it stands outside a string.
    deep = {s: turn(c) - F.when((odd + int(s)) % 2 == 0, 1).otherwise(0) for s, c in rest.items()}
    pieces = pieces.withColumns({"odd": odd, "out": deep[False], "in": deep[True]})
    own = Window.partitionBy("arg", "file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(own), F.lit(0)) % 2
    pieces = pieces.withColumn("inside", inside.cast("int"))
    # Depth before a piece of a block, for a block that begins outside a string and for one that begins inside.
    step = lambda first: F.when((F.col("inside") + first) % 2 == 0, F.col("out")).otherwise(F.col("in"))
    pieces = pieces.withColumns({"step0": step(0), "step1": step(1)})
    pieces = pieces.withColumns({f"depth{k}": F.coalesce(F.sum(f"step{k}").over(own), F.lit(0)) for k in (0, 1)})
    place = ["arg", "file", "block"]
    sizes = pieces.groupBy(*place).agg((F.sum("odd") % 2).cast("int").alias("odd"), F.sum("step0").alias("step0"), F.sum("step1").alias("step1"))
    before = Window.partitionBy("arg", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.withColumn("first", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int")).withColumn("all", F.when(F.col("first") == 0, F.col("step0")).otherwise(F.col("step1")))
    blocks = blocks.select(*place, "first", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))  # a short row a block
    known = pieces.join(blocks, place)
    at_start = F.col("first") == 0
    depth = F.col("base") + F.when(at_start, F.col("depth0")).otherwise(F.col("depth1"))
    known = known.withColumn("after", depth + F.when(at_start, F.col("step0")).otherwise(F.col("step1"))).withColumn("string", (F.col("inside") + F.col("first")) % 2)
    opening = known.where((F.col("block") == 0)).groupBy("arg", "file").agg(F.min_by("value", "row").alias("head")).select("arg", "file", F.regexp_like("head", F.lit(r"^[\x{FEFF}\s]*\[")).alias("list"))
    known = known.join(opening, ["arg", "file"])
    ends = (F.col("list") & (F.col("after") == 1) & ((F.col("string") + F.col("odd")) % 2 == 0)).cast("int")
    in_order = Window.partitionBy("arg", "file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("ends", ends).withColumn("element", F.coalesce(F.sum("ends").over(in_order), F.lit(0)))
    closed = known.groupBy(*place).agg(F.sum("ends").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*place, "shift")
    known = known.join(closed, place).withColumn("element", F.col("element") + F.col("shift"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    whole = known.groupBy("arg", "file", "list", "element").agg(F.max("bytes").alias("bytes"), F.array_join(F.transform(ordered, lambda x: x["value"]), "}").alias("text"), F.max("ends").alias("ended"))
    # Between two elements stand commas, perhaps values that are no objects, and at last the closing bracket.
    # A file that is no array may end with the brace that its last piece was cut at.
    lost = F.when(F.endswith("file", F.lit(".gz")), F.try_parse_json("text").isNull()).otherwise(F.octet_length("text") < F.col("bytes"))
    body = F.when(~F.col("list"), F.concat("text", F.when(lost, "}").otherwise(""))).otherwise(F.concat(F.regexp_replace("text", r"^[\x{FEFF}\s]*[\[,]", ""), F.when(F.col("ended") == 1, "}").otherwise("")))
    return whole.select("arg", "file", "element", "list", "ended", body.alias("value"))


#: Elements that are numbered together.
CHUNK = 10_000


def read_json_document(spark: SparkSession, *paths: str, bad: str = "keep") -> DataFrame:
    """JSON arrays of courses, or one course object a file, as courses with ``nseq`` by argument, file and place.

    ``bad`` as in :func:`read_jsonl`; an element that is no object is a bad row, so is a
    file that is no JSON.  Large files are read by several tasks.
    """
    found = document_elements(spark, *paths)
    text = F.when(F.col("ended") == 1, F.col("value")).otherwise(F.regexp_replace("value", r"\]\s*$", ""))
    values = F.when(F.col("list") & (F.trim(text) == ""), F.array().cast("array<variant>")).when(F.col("list"), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<variant>"))
    rows = found.select("arg", "file", "element", "value", F.coalesce(values, F.array(F.try_parse_json("value"))).alias("each"))
    # Numbers: values before the element in its chunk, and before the chunk (a short row a chunk).
    rows = rows.withColumns({"chunk": F.floor(F.col("element") / CHUNK), "n": F.size("each")})
    sums = rows.groupBy("arg", "file", "chunk").agg(F.sum("n").alias("all"))
    base = F.coalesce(F.sum("all").over(Window.orderBy("arg", "file", "chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("arg", "file", "chunk").orderBy("element").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("own", own).join(sums.select("arg", "file", "chunk", base.alias("base")), ["arg", "file", "chunk"])
    lines = rows.select("value", (F.col("base") + F.col("own")).alias("first"), F.posexplode("each").alias("at", "v"))
    return _with_policy(parse_lines(lines.select(F.coalesce(F.to_json("v"), F.col("value")).alias("value"), (F.col("first") + F.col("at")).alias("nseq"))), bad)


def first_rows(rows: DataFrame, most: int | None, order: str = "nseq") -> DataFrame:
    """The first ``most`` rows, all if it is null: an item limit, a test run or a partial validation."""
    return rows if most is None else rows.orderBy(order).limit(most)


def _check_suffix(path: str) -> None:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not name.endswith((".jsonl", ".json", ".gz")):
        raise ValueError(f"unsupported file type: {path}")


def credits_json(c: Column) -> Column:
    return F.when(c["kind"] == "str", F.to_json(F.struct(c["text"].alias("x")))).otherwise(F.concat(F.lit('{"x":'), c["text"], F.lit("}")))


def export_rows(courses: DataFrame) -> DataFrame:
    """Flat rows: credits as text, trees and lists as JSON text, empty lists null."""
    out = courses.withColumn("credits", F.col("credits")["text"]).withColumn("prerequisites", tree_json(F.col("prerequisites")))
    for f in ("corequisites", "offerings"):
        if f in courses.columns:
            out = out.withColumn(f, F.when(F.size(f) > 0, F.to_json(f)))
    return out


def export_decoded(table: DataFrame, university: str | None = None) -> DataFrame:
    """Rows of a stored table with JSON text as values again, in the order of university and course_id."""
    rows = table if university is None else table.where(F.col("university") == university)
    for f, kind in (("prerequisites", "variant"), ("corequisites", "array<string>"), ("offerings", "array<string>")):
        if f in table.columns and dict(table.dtypes)[f] == "string":
            rows = rows.withColumn(f, F.try_parse_json(f) if kind == "variant" else F.from_json(f, kind))
    return rows.drop("nseq").orderBy("university", "course_id")


def write_jsonl(courses: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    courses.write.mode("overwrite").json(path)


def write_csv(courses: DataFrame, path: str) -> None:
    export_rows(courses).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def to_json_array(courses: DataFrame) -> DataFrame:
    """Lines that form one JSON array of all rows when written as text in order; no row is gathered.

    Columns ``part`` and ``line``: the opening bracket, one line a row, the closing one.
    """
    spark = courses.sparkSession
    ends = spark.createDataFrame([(-1, "["), (2**62, "]")], "part long, line string")
    rows = courses.select(F.to_json(F.struct("*")).alias("json"), F.monotonically_increasing_id().alias("part"))
    first = rows.agg(F.min("part").alias("first"))
    lines = rows.crossJoin(F.broadcast(first)).select("part", F.concat(F.when(F.col("part") > F.col("first"), ",").otherwise(""), "json").alias("line"))  # one row
    return lines.unionByName(ends).orderBy("part")


def append_runs(runs: DataFrame, path: str) -> None:
    """Append rows of the scrape log."""
    runs.write.mode("append").parquet(path)


def write_version(table: DataFrame, path: str, version: int) -> str:
    """Write a new version of a keyed table beside the old ones; readers are pointed to it afterwards."""
    target = f"{path}/v{version:08d}"
    table.write.mode("errorifexists").parquet(target)
    return target


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder; in local mode a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="syllabary-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
