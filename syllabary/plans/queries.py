"""Registered queries over the driver's tables, each with an independent DuckDB oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import courses as C
from ..functions import html as H
from ..functions import prerequisites as P
from ..functions import text as T
from ..operators import buckets, extraction, golden, refresh, search_index, store, validation
from ..sources import courses as sources
from ..streaming import ingest
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = views.NOW

_WITH = f"""WITH courses_raw AS ({views.COURSES_RAW}),
golden_changes AS ({views.GOLDEN_CHANGES}),
snapshot_rows AS ({views.SNAPSHOTS}),
snapshots AS (SELECT university, url, nseq, sha256(body) AS content_hash, last_checked, last_updated, course_count FROM snapshot_rows),
current_rows AS ({views.CURRENT}),
current_hashes AS (SELECT university, url, sha256(body) AS content_hash FROM current_rows),
run_events AS ({views.RUN_EVENTS}),
ids AS (SELECT courses_raw.*, upper(regexp_replace(regexp_replace(trim(course_id), '(-|\\s)+', ' ', 'g'), '([A-Z]+)(\\d)', '\\1 \\2', 'g')) AS norm_id FROM courses_raw),
digits AS (SELECT ids.*, regexp_extract(norm_id, '\\d+') AS digits FROM ids),
levels AS (SELECT digits.*, CASE WHEN digits = '' THEN 'Unknown' WHEN CAST(digits AS BIGINT) < 5000 THEN 'Undergraduate' ELSE 'Graduate' END AS level,
  CASE WHEN credits_text LIKE '%-%' THEN '3-4' WHEN credits_text = '3 credits' THEN '3' WHEN credits_text LIKE '%(4)%' THEN '4' WHEN credits_text LIKE '%vary%' THEN 'variable' WHEN credits_text LIKE '3.5%' THEN '3.5' ELSE 'Unknown' END AS credits,
  CASE WHEN credits_text LIKE '%-%' OR credits_text LIKE '%vary%' OR credits_text LIKE 'none%' THEN 'str' WHEN credits_text LIKE '3.5%' THEN 'float' ELSE 'int' END AS credits_kind FROM digits),
checked AS (SELECT levels.*, list_filter([
    CASE WHEN trim(description) = '' THEN 'Missing required field: description' END,
    CASE WHEN NOT regexp_matches(norm_id, '^[A-Z]{{2,6}}\\s*\\d{{3,4}}[A-Z]?$') THEN 'Invalid course_id format: ' || norm_id END,
    CASE WHEN credits IN ('variable', 'Unknown') THEN 'Invalid credits format: ' || credits END], lambda x: x IS NOT NULL) AS errors FROM levels)
"""


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = _WITH + oracle
        return f

    return add


def _view(spark: SparkSession, sf_dir: str, sql: str, **tables: DataFrame | str) -> DataFrame:
    """A view's SQL over tables given as DataFrames, or by their names in the folder."""
    frames = {n: spark.read.parquet(f"{sf_dir}/{t}.parquet") if isinstance(t, str) else t for n, t in tables.items()}
    for n in frames:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    if "part" in frames:
        sql = sql.replace("part.*", "*")
    return spark.sql(sql, **frames)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to some tasks a core by their key: a table of few bytes is read by as many tasks as it has row groups, however much is done on a row."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, key)


def courses_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, views.COURSES_RAW, part=spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey"))


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed courses: normalised ids, levels, credits and prerequisite trees."""
    rows = courses_raw(spark, sf_dir)
    rows = rows.withColumn("course_id", C.normalize_course_id(F.col("course_id"))).withColumn("p", P.parse_prerequisites(F.col("prerequisites_text")))
    return rows.select(
        "nseq", "university", "course_id", "title", "description", C.credits_or_unknown(C.extract_credits(F.col("credits_text"))).alias("credits"), C.infer_level(F.col("course_id")).alias("level"),
        "department", F.col("p.tree").alias("prerequisites"), F.col("p.text").alias("prerequisites_text"), F.col("p.parsed").alias("prerequisites_parsed"), "notes",
    )


def golden_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, views.GOLDEN_CHANGES, courses_raw=courses_raw(spark, sf_dir))
    rows = rows.withColumn("course_id", C.normalize_course_id(F.col("course_id"))).withColumn("p", P.parse_prerequisites(F.col("prerequisites_text")))
    return rows.select(
        "nseq", "university", "course_id", "title", "description", C.credits_or_unknown(C.extract_credits(F.col("credits_text"))).alias("credits"), C.infer_level(F.col("course_id")).alias("level"),
        "department", F.col("p.text").alias("prerequisites_text"), F.col("p.parsed").alias("prerequisites_parsed"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, views.SNAPSHOTS, events="events")
    return rows.select("university", "url", "nseq", F.sha2("body", 256).alias("content_hash"), *[F.col(c).cast("timestamp").alias(c) for c in ("last_checked", "last_updated")], "course_count", F.lit(None).cast("string").alias("notes"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, views.CURRENT, events="events").select("university", "url", F.sha2("body", 256).alias("content_hash"))


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *(columns or ["text"]))


@query("SELECT university, count(*) AS courses FROM (SELECT university, norm_id FROM checked WHERE len(errors) = 0 GROUP BY ALL) GROUP BY university")
def valid_courses_by_university(spark, sf_dir):
    valid = validation.with_errors(courses(spark, sf_dir)).where("is_valid")
    return store.counts(store.keep_first(valid, unique=True), "university")


# --- identity, validation, keep-one ---------------------------------------------------

@query("""SELECT nseq, norm_id AS course_id, level, regexp_extract(course_id, '^([A-Z]{2,6})', 1) AS prefix,
CASE WHEN CAST(right('00' || CAST(nseq % 1000 AS VARCHAR), 3) AS INTEGER) >= 500 THEN 'Graduate' ELSE 'Undergraduate' END AS dotted FROM levels""")
def normalize_ids(spark, sf_dir):
    raw = courses_raw(spark, sf_dir)
    cid = C.normalize_course_id(F.col("course_id"))
    dotted = F.concat(F.lit("6."), F.lpad((F.col("nseq") % 1000).cast("string"), 3, "0"))
    return raw.select("nseq", cid.alias("course_id"), C.checked_level(C.infer_level(cid)).alias("level"), F.regexp_extract("course_id", "^([A-Z]{2,6})", 1).alias("prefix"), C.infer_dotted_level(dotted).alias("dotted"))


@query("SELECT nseq, norm_id AS course_id, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS is_valid FROM checked")
def validate_rows(spark, sf_dir):
    return validation.with_errors(courses(spark, sf_dir)).select("nseq", "course_id", F.array_join("errors", "; ").alias("errors"), "is_valid")


@query("""SELECT count(*) AS total, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid,
round_even(count(*) FILTER (len(errors) = 0) * 100.0 / count(*), 1)::DOUBLE AS success_rate FROM checked""")
def validation_summary(spark, sf_dir):
    return validation.summary(validation.with_errors(courses(spark, sf_dir))).withColumn("success_rate", F.col("success_rate").cast("double"))


@query("""SELECT nseq, CASE WHEN len(errors) > 0 THEN concat_ws(' | ', notes, 'Validation warnings: ' || array_to_string(errors, '; ')) ELSE notes END AS notes FROM checked""")
def annotate_notes(spark, sf_dir):
    return validation.with_errors(courses(spark, sf_dir)).select("nseq", validation.annotated_notes().alias("notes"))


@query("SELECT university, norm_id AS course_id, min(nseq) AS nseq, arg_min(title, nseq) AS title FROM checked WHERE len(errors) = 0 GROUP BY ALL")
def dedupe_first(spark, sf_dir):
    return store.keep_first(validation.with_errors(courses(spark, sf_dir)).where("is_valid"), unique=True).select("university", "course_id", "nseq", "title")


@query("SELECT university, norm_id AS course_id, max(nseq) AS nseq, arg_max(title, nseq) AS title FROM ids GROUP BY ALL")
def keep_last(spark, sf_dir):
    return store.keep_last(courses(spark, sf_dir), unique=True).select("university", "course_id", "nseq", "title")


@query("""SELECT university, norm_id AS course_id, nseq, occurrence FROM (SELECT university, norm_id, nseq, row_number() OVER (PARTITION BY university, norm_id ORDER BY nseq) AS occurrence FROM ids) WHERE occurrence > 1""")
def duplicate_report(spark, sf_dir):
    return store.duplicates(courses(spark, sf_dir), unique=True).select("university", "course_id", "nseq", "occurrence")


@query("""SELECT university, norm_id AS course_id, max(nseq) AS nseq FROM ids WHERE nseq % 3 = 0 GROUP BY ALL
UNION ALL SELECT university, norm_id, nseq FROM (SELECT university, norm_id, max(nseq) AS nseq FROM ids WHERE nseq % 3 <> 0 GROUP BY ALL) o
WHERE NOT EXISTS (SELECT 1 FROM ids b WHERE b.nseq % 3 = 0 AND b.university = o.university AND b.norm_id = o.norm_id)""")
def upsert(spark, sf_dir):
    rows = courses(spark, sf_dir)
    return store.upsert(store.keep_last(rows.where("nseq % 3 <> 0"), unique=True), rows.where("nseq % 3 = 0"), unique=True).select("university", "course_id", "nseq")


@query("""SELECT nseq, university, title, notes, NULL::VARCHAR AS extra FROM courses_raw UNION ALL SELECT nseq, university, title, NULL, 'golden' FROM golden_changes""")
def merge_union(spark, sf_dir):
    return store.merge(courses(spark, sf_dir).select("nseq", "university", "title", "notes"), golden_courses(spark, sf_dir).select("nseq", "university", "title", F.lit("golden").alias("extra")))


# --- lookups, search, statistics ---------------------------------------------------------

@query("SELECT nseq, norm_id AS course_id, title FROM ids WHERE university = 'Brand#7'")
def by_university(spark, sf_dir):
    return store.by_university(courses(spark, sf_dir), "Brand#7").select("nseq", "course_id", "title")


@query("SELECT nseq, norm_id AS course_id, title FROM ids WHERE university = 'Brand#7' AND department = 'ECONOMY'")
def by_department(spark, sf_dir):
    return store.by_department(courses(spark, sf_dir), "Brand#7", "ECONOMY").select("nseq", "course_id", "title")


@query("SELECT university, norm_id AS course_id, max(nseq) AS nseq FROM ids WHERE university = 'Brand#17' AND norm_id = 'MATH 1700' GROUP BY ALL")
def point_lookup(spark, sf_dir):
    return store.lookup(store.keep_last(courses(spark, sf_dir)), "Brand#17", "MATH 1700").select("university", "course_id", "nseq")


@query("SELECT nseq, university, norm_id AS course_id FROM ids WHERE lower(title) LIKE '%widg_t%' OR lower(description) LIKE '%widg_t%'")
def search(spark, sf_dir):
    return store.search(courses(spark, sf_dir), "WIDG_T").select("nseq", "university", "course_id")


@query("""SELECT university, norm_id AS course_id, title, CASE WHEN length(description) > 100 THEN left(description, 100) || '...' ELSE description END AS preview, (SELECT count(*) FROM ids WHERE lower(title) LIKE '%ring%' OR lower(description) LIKE '%ring%') AS matches
FROM ids WHERE lower(title) LIKE '%ring%' OR lower(description) LIKE '%ring%' ORDER BY university, norm_id, nseq LIMIT 10""")
def search_preview(spark, sf_dir):
    return store.search_page(courses(spark, sf_dir), "Ring")


@query("SELECT university, count(*) AS courses FROM ids GROUP BY ALL")
def stats_by_university(spark, sf_dir):
    return store.counts(courses(spark, sf_dir), "university")


@query("SELECT level, count(*) AS courses FROM levels GROUP BY ALL")
def stats_by_level(spark, sf_dir):
    return store.counts(courses(spark, sf_dir), "level")


_PARSED = "(prerequisites_text IS NULL OR trim(prerequisites_text) = '' OR nseq % 10 IN (0, 1, 2, 8, 9))"


@query(f"""SELECT count(*) FILTER ({_PARSED}) AS parsed, count(*) FILTER (trim(prerequisites_text) <> '') AS with_text,
round_even(count(*) FILTER ({_PARSED}) * 100.0 / count(*) FILTER (trim(prerequisites_text) <> ''), 2)::DOUBLE AS parse_rate FROM courses_raw""")
def prereq_parse_rate(spark, sf_dir):
    return store.parse_rate(courses(spark, sf_dir)).withColumn("parse_rate", F.col("parse_rate").cast("double"))


@query(f"""SELECT 'all' AS scope, NULL AS name, count(*) AS courses, count(*) FILTER ({_PARSED}) AS parsed FROM levels
UNION ALL SELECT 'university', university, count(*), count(*) FILTER ({_PARSED}) FROM levels GROUP BY university
UNION ALL SELECT 'level', level, count(*), count(*) FILTER ({_PARSED}) FROM levels GROUP BY level""")
def stats_bundle(spark, sf_dir):
    return store.statistics(courses(spark, sf_dir))


# --- text --------------------------------------------------------------------------------

_S = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
_SQUEEZED = f"regexp_replace(regexp_replace(coalesce(text, ''), '{_S}+', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g')"
_ENTITIES = "replace(replace(replace(replace({0}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"


@query(f"SELECT doc_id, {_SQUEEZED} AS text FROM documents")
def normalize_ws(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_ENTITIES.format(_SQUEEZED)}, '{_S}+([.,;:])', '\\1', 'g'), '^{_S}+|{_S}+$', '', 'g') AS text FROM documents")
def clean_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("text"))


_JOINED = f"regexp_replace(text, '-{_S}*\\n{_S}*', '', 'g')"
_ONCE = "regexp_replace({0}, '(^|[^.!?;:])\\n([a-z])', '\\1 \\2', 'g')"


@query(f"SELECT doc_id, {_ONCE.format(_ONCE.format(_JOINED))} AS text FROM documents")
def fix_broken_lines(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.fix_broken_lines(F.col("text")).alias("text"))


@query(f"""SELECT doc_id, CAST(place - 1 AS BIGINT) AS position, entry FROM (SELECT doc_id, unnest(parts) AS entry, generate_subscripts(parts, 1) AS place FROM (
SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\\. ', chr(10) || ' ' || chr(10), 'g'), chr(10) || ' ' || chr(10)), lambda x: regexp_replace(x, '^{_S}+|{_S}+$', '', 'g')), lambda x: x <> '') AS parts FROM documents))""")
def split_entries(spark, sf_dir):
    paragraphs = F.regexp_replace("text", r"\. ", "\n \n")
    parts = F.posexplode(T.split_entries(paragraphs, r"\n \n")).alias("position", "entry")
    return _documents(spark, sf_dir).select("doc_id", parts).withColumn("position", F.col("position").cast("long"))


# --- credits and prerequisites --------------------------------------------------------------

@query("SELECT nseq, credits_kind AS kind, CASE WHEN credits_kind <> 'str' THEN CAST(credits AS DOUBLE) END AS num, credits AS text FROM levels")
def extract_credits(spark, sf_dir):
    c = F.col("credits")
    return courses(spark, sf_dir).select("nseq", c["kind"].alias("kind"), c["num"].alias("num"), c["text"].alias("text"))


_CODES = r"list_transform(regexp_extract_all({0}, '(?i)\b([A-Z]{{2,6}})[\s\-]*(\d{{3,4}}[A-Z]?)\b'), lambda x: upper(regexp_replace(x, '^([A-Za-z]+)[\s\-]*', '\1 ')))"


@query(f"SELECT nseq, array_to_string({_CODES.format('prerequisites_text')}, ',') AS codes FROM courses_raw WHERE prerequisites_text IS NOT NULL")
def prereq_codes(spark, sf_dir):
    raw = courses_raw(spark, sf_dir).where("prerequisites_text is not null")
    return raw.select("nseq", F.array_join(P.course_codes(F.col("prerequisites_text")), ",").alias("codes"))


_Q = "list_transform({0}, lambda x: '\"' || x || '\"')"


@query(f"""SELECT nseq, CASE WHEN n = 0 THEN NULL WHEN groups = 0 THEN CASE WHEN has_and AND has_or THEN NULL ELSE '{{"' || CASE WHEN has_or THEN 'or' ELSE 'and' END || '":[' || array_to_string(all_codes, ',') || ']}}' END
 WHEN groups = 1 THEN '{{"' || CASE WHEN has_and THEN 'and' ELSE 'or' END || '":[' || CASE WHEN len(outer_codes) > 0 THEN array_to_string(outer_codes, ',') || ',' ELSE '' END || '{{"' || CASE WHEN g LIKE '% or %' THEN 'or' ELSE 'and' END || '":[' || array_to_string(inner_codes, ',') || ']}}]}}' END AS tree,
 coalesce(trim(prerequisites_text) = '', true) OR (n > 0 AND (groups = 1 OR (groups = 0 AND NOT (has_and AND has_or)))) AS parsed
FROM (SELECT nseq, prerequisites_text, coalesce(prerequisites_text LIKE '% and %', false) AS has_and, coalesce(prerequisites_text LIKE '% or %', false) AS has_or, coalesce(len(regexp_extract_all(prerequisites_text, '\\([^)]+\\)')), 0) AS groups,
 lower(regexp_extract(prerequisites_text, '\\(([^)]+)\\)', 1)) AS g, coalesce(len({_CODES.format('prerequisites_text')}), 0) AS n, {_Q.format(_CODES.format('prerequisites_text'))} AS all_codes,
 {_Q.format(_CODES.format("regexp_replace(prerequisites_text, ' *[(][^)]+[)] *', ' ', 'g')"))} AS outer_codes, {_Q.format(_CODES.format("regexp_extract(prerequisites_text, '[(]([^)]+)[)]', 1)"))} AS inner_codes FROM courses_raw)""")
def prereq_parse(spark, sf_dir):
    return courses(spark, sf_dir).select("nseq", P.tree_json(F.col("prerequisites")).alias("tree"), F.col("prerequisites_parsed").alias("parsed"))


@query(f"""SELECT nseq, CASE WHEN len(c) > 0 THEN array_to_string(c, ',') END AS corequisites FROM (SELECT nseq, {_CODES.format("regexp_extract(coalesce(prerequisites_text, ''), '(?i)corequisites?[ ]*:?[ ]*(.+?)(?:[.;]|$)', 1)")} AS c FROM courses_raw)""")
def corequisites(spark, sf_dir):
    return courses_raw(spark, sf_dir).select("nseq", F.array_join(P.corequisites(F.col("prerequisites_text")), ",").alias("corequisites"))


@query("""SELECT nseq, CASE nseq % 10 WHEN 5 THEN 'permission of instructor' WHEN 8 THEN 'grade of' WHEN 9 THEN 'open only to' ELSE '' END AS requirements, CASE WHEN nseq % 10 = 8 THEN 'C' END AS grade FROM courses_raw WHERE prerequisites_text IS NOT NULL""")
def non_course_reqs(spark, sf_dir):
    t = F.col("prerequisites_text")
    return courses_raw(spark, sf_dir).where("prerequisites_text is not null").select("nseq", F.array_join(P.non_course_requirements(t), ",").alias("requirements"), P.minimum_grade(t).alias("grade"))


@query("""SELECT nseq, coalesce(nullif(regexp_extract(norm_id, '^([A-Z]{2,6})', 1), ''), nullif(trim(regexp_extract(description, '(?i)Department of ([^,.' || chr(10) || ']+)', 1)), '')) AS department,
nullif(trim(regexp_extract(description, '(?i)Department of ([^,.' || chr(10) || ']+)', 1)), '') AS named, nullif(regexp_extract(prerequisites_text, '[A-Z]{2,6}[ -]*\\d{3,4}[A-Z]?'), '') AS found_id FROM ids""")
def extract_department(spark, sf_dir):
    rows = courses_raw(spark, sf_dir)
    return rows.select("nseq", C.extract_department(F.col("description"), C.normalize_course_id(F.col("course_id"))).alias("department"), C.extract_department(F.col("description"), F.lit("")).alias("named"), C.find_course_id(F.col("prerequisites_text")).alias("found_id"))


# --- golden validation ------------------------------------------------------------------------

_GOLDEN = r"""golden_ids AS (SELECT golden_changes.*, upper(regexp_replace(regexp_replace(trim(course_id), '(-|\s)+', ' ', 'g'), '([A-Z]+)(\d)', '\1 \2', 'g')) AS norm_id FROM golden_changes),
golden_last AS (SELECT * FROM golden_ids QUALIFY row_number() OVER (PARTITION BY university, norm_id ORDER BY nseq DESC) = 1),
pairs AS (SELECT s.nseq, s.university, s.norm_id, s.title AS st, g.title AS gt, s.description AS sd, g.description AS gd, s.credits AS sc, gl.credits AS gc, s.credits_kind AS sk, gl.credits_kind AS gk, s.level AS sl, gl.level AS gll, s.department AS sdep, g.department AS gdep,
 nullif(trim(s.prerequisites_text), '') AS sp, nullif(trim(g.prerequisites_text), '') AS gp, s.nseq % 10 AS sm, g.nseq % 10 AS gm FROM levels s JOIN golden_last g ON s.university = g.university AND s.norm_id = g.norm_id JOIN levels gl ON gl.nseq = g.nseq),
compared AS (
 SELECT nseq, university, norm_id, 0 AS place, 'title' AS field, gt AS expected, st AS actual, lower(trim(gt)) = lower(trim(st)) AS same FROM pairs
 UNION ALL SELECT nseq, university, norm_id, 1, 'description', gd, sd, lower(trim(gd)) = lower(trim(sd)) FROM pairs
 UNION ALL SELECT nseq, university, norm_id, 2, 'credits', gc, sc, CASE WHEN sk = 'str' AND gk = 'str' THEN sc = gc WHEN sk <> 'str' AND gk <> 'str' THEN CAST(sc AS DOUBLE) = CAST(gc AS DOUBLE) ELSE false END FROM pairs
 UNION ALL SELECT nseq, university, norm_id, 3, 'level', gll, sl, gll = sl FROM pairs
 UNION ALL SELECT nseq, university, norm_id, 4, 'department', gdep, sdep, lower(trim(gdep)) = lower(trim(sdep)) FROM pairs
 UNION ALL SELECT nseq, university, norm_id, 5, 'prerequisites_text', gp, sp, lower(gp) = lower(sp) FROM pairs
 UNION ALL SELECT nseq, university, norm_id, 6, 'prerequisites_parsed', CAST(gm IN (0, 1, 2, 6, 7, 8, 9) AS VARCHAR), CAST(sm IN (0, 1, 2, 6, 7, 8, 9) AS VARCHAR), gm IN (0, 1, 2, 6, 7, 8, 9) = sm IN (0, 1, 2, 6, 7, 8, 9) FROM pairs),
stated AS (SELECT compared.*, CASE WHEN actual IS NULL THEN 'missing' WHEN same THEN 'correct' ELSE 'incorrect' END AS outcome FROM compared WHERE expected IS NOT NULL)
"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.compare(courses(spark, sf_dir), golden_courses(spark, sf_dir))


@query("," + _GOLDEN + """SELECT field, count(*) AS total, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome <> 'correct') AS incorrect, count(*) FILTER (outcome = 'missing') AS missing,
round_even(count(*) FILTER (outcome = 'correct') * 100.0 / count(*), 2)::DOUBLE AS accuracy, round_even(count(*) FILTER (outcome <> 'missing') * 100.0 / count(*), 2)::DOUBLE AS completeness FROM stated GROUP BY field""")
def golden_field_metrics(spark, sf_dir):
    return golden.field_metrics(_compared(spark, sf_dir)).withColumns({c: F.col(c).cast("double") for c in ("accuracy", "completeness")})


@query("," + _GOLDEN + """SELECT count(*) AS total, count(*) FILTER (outcome = 'correct') AS correct, round_even(count(*) FILTER (outcome = 'correct') * 100.0 / count(*), 2)::DOUBLE AS accuracy FROM stated""")
def golden_overall(spark, sf_dir):
    return golden.overall(_compared(spark, sf_dir)).withColumn("accuracy", F.col("accuracy").cast("double"))


@query("," + _GOLDEN + """SELECT nseq, norm_id AS course_id, field, expected, actual FROM stated WHERE outcome = 'incorrect' ORDER BY nseq, place LIMIT 10""")
def golden_errors(spark, sf_dir):
    return golden.wrong_values(_compared(spark, sf_dir)).select("nseq", "course_id", "field", "expected", "actual")


@query("SELECT nseq, university, norm_id AS course_id FROM ids ORDER BY md5(concat_ws('|', '3', university, norm_id, CAST(nseq AS VARCHAR))), nseq LIMIT 50")
def golden_sample(spark, sf_dir):
    return golden.sample(courses(spark, sf_dir), 50, seed=3).select("nseq", "university", "course_id")


# --- refresh ------------------------------------------------------------------------------------

_CHECK = f"""checks AS (SELECT c.university, c.content_hash AS new_hash, s.content_hash AS old_hash, s.university IS NOT NULL AS known, CASE WHEN s.university IS NULL THEN c.url ELSE s.url END AS url, s.last_checked, s.last_updated, s.course_count,
 CASE WHEN c.content_hash IS NULL THEN 'failed' WHEN s.university IS NULL THEN 'first' WHEN TIMESTAMP '{NOW}' - s.last_checked < INTERVAL 1 HOUR THEN 'recent' WHEN c.content_hash IS DISTINCT FROM s.content_hash THEN 'changed' ELSE 'same' END AS action
 FROM current_hashes c LEFT JOIN snapshots s ON c.university = s.university),
reasons AS (SELECT checks.*, action IN ('first', 'changed') AS changed, CASE action WHEN 'failed' THEN 'Failed to fetch catalog' WHEN 'first' THEN 'First snapshot - needs scraping' WHEN 'recent' THEN 'Checked recently - skipping' WHEN 'changed' THEN 'Catalog content changed' ELSE 'No changes detected' END AS reason FROM checks)
"""


@query("," + _CHECK + f"""SELECT university, url, action, changed, reason, CASE WHEN changed THEN new_hash ELSE old_hash END AS content_hash, CASE WHEN action IN ('first', 'changed', 'same') THEN TIMESTAMP '{NOW}' ELSE last_checked END AS last_checked,
CASE WHEN changed THEN TIMESTAMP '{NOW}' ELSE last_updated END AS last_updated, CASE WHEN action = 'first' THEN 0 ELSE course_count END AS course_count FROM reasons""")
def change_detection(spark, sf_dir):
    return refresh.check(current(spark, sf_dir), snapshots(spark, sf_dir), NOW).drop("notes")


@query(f"SELECT university, last_updated FROM snapshots WHERE TIMESTAMP '{NOW}' - last_updated > INTERVAL 7 DAY")
def stale_catalogs(spark, sf_dir):
    return refresh.stale(snapshots(spark, sf_dir), NOW).select("university", "last_updated")


_AGE = f"CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_updated)) / 86400000000) AS BIGINT)"


@query("," + _CHECK + f"""SELECT university, NOT known OR coalesce(TIMESTAMP '{NOW}' - last_updated > INTERVAL 30 DAY, false) OR changed AS refresh, CASE WHEN NOT known THEN 'Never scraped before' WHEN TIMESTAMP '{NOW}' - last_updated > INTERVAL 30 DAY
THEN 'Stale data (last updated ' || CAST({_AGE} AS VARCHAR) || ' days ago)' ELSE reason END AS reason FROM reasons""")
def should_refresh(spark, sf_dir):
    return refresh.should_refresh(current(spark, sf_dir), snapshots(spark, sf_dir), NOW)


@query(f"SELECT university, {_AGE} AS priority FROM snapshots")
def refresh_priority(spark, sf_dir):
    return refresh.priorities(snapshots(spark, sf_dir), NOW).select("university", "priority")


@query(f"SELECT university, url, {_AGE} AS priority, last_updated, course_count FROM snapshots ORDER BY {_AGE} DESC, nseq LIMIT 5")
def refresh_plan(spark, sf_dir):
    return refresh.plan(snapshots(spark, sf_dir), NOW).select("university", "url", "priority", "last_updated", "course_count")


@query(f"""SELECT c.university, coalesce(s.priority, 0) AS priority FROM (SELECT university, min(event_order) AS o FROM (SELECT concat('U', CAST(user_id AS VARCHAR)) AS university, event_id AS event_order FROM events WHERE user_id % 4 <> 1) GROUP BY 1) c
LEFT JOIN (SELECT university, {_AGE} AS priority FROM snapshots) s ON c.university = s.university ORDER BY 2 DESC, o LIMIT 5""")
def ranked_configs(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    enabled = F.when(F.col("user_id") % 4 == 1, F.lit(False)).when(F.col("user_id") % 4 == 2, F.lit(True))
    configs = events.groupBy("user_id").agg(F.min("event_id").alias("nseq")).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("university"), enabled.alias("enabled"), "nseq")
    return refresh.rank_configs(configs, snapshots(spark, sf_dir), NOW).select("university", "priority")


@query("," + _CHECK + """SELECT count(*) FILTER (changed) AS successes, count(*) AS attempts, CAST(sum(coalesce(course_count, 0)) AS BIGINT) AS courses FROM reasons""")
def refresh_summary(spark, sf_dir):
    checked = refresh.check(current(spark, sf_dir), snapshots(spark, sf_dir), NOW)
    return checked.agg(F.count(F.when(F.col("changed"), 1)).alias("successes"), F.count("*").alias("attempts"), F.sum(F.coalesce("course_count", F.lit(0))).alias("courses"))


@query("""SELECT university, CAST(sum(courses) AS BIGINT) AS courses, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(errors) AS BIGINT) AS errors, max(memory_mb) AS memory_peak_mb,
round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 2) AS duration_s,
CASE WHEN max(ts) > min(ts) THEN round_even(sum(courses) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 2) ELSE 0.0 END AS courses_per_second FROM run_events GROUP BY 1""")
def run_metrics(spark, sf_dir):
    return refresh.run_metrics(_view(spark, sf_dir, views.RUN_EVENTS, events="events"))


@query("SELECT count(*) AS iterations, round_even(avg(value * 1000), 3) AS avg_ms, round_even(min(value * 1000), 3) AS min_ms, round_even(max(value * 1000), 3) AS max_ms FROM events")
def timing_summary(spark, sf_dir):
    return refresh.timing_summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")


# --- pages and catalogue text ------------------------------------------------------------------

@query("SELECT page_id, sha256(html) AS content_hash FROM pages")
def content_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"))


@query("""SELECT page_id, unnest(list_slice(list_sort(list_distinct(list_filter(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1), lambda x: regexp_matches(x, '^/[a-z]+')))), 1, 20)) AS link FROM pages""")
def page_links(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.explode(H.distinct_links(F.col("html"), "^/[a-z]+", 20)).alias("link"))


@query(f"""SELECT page_id, nullif({_ENTITIES.format("regexp_extract(html, '<h1\\b[^>]*>([^<]+)', 1)")}, '') AS heading, nullif({_ENTITIES.format("regexp_extract(html, '<[0-9A-Za-z_]+[^>]*class=\"(?:[^\"]*\\s)?ad(?:\\s[^\"]*)?\"[^>]*>([^<]+)', 1)")}, '') AS ad FROM pages""")
def page_heading(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", H.element_text(F.col("html"), "h1").alias("heading"), H.class_text(F.col("html"), "ad").alias("ad"))


@query(f"""SELECT page_id, {_ENTITIES.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS text FROM pages""")
def page_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", H.all_text(F.col("html")).alias("text"))


def catalogue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue page for each raw course, in the layout that many sites share; every 17th has no code."""
    c = courses_raw(spark, sf_dir)
    code = F.when(F.col("nseq") % 17 == 0, "").otherwise(F.concat(F.lit('<span class="detail-code">'), C.normalize_course_id(F.col("course_id")), F.lit(". </span>")))
    html = F.concat(
        F.lit("<html><h1>"), F.col("department"), F.lit(' (DEPT)</h1><div class="courseblockextra-alt">no</div><div class="courseblock">'), code, F.lit('<span class="big detail-title">'), F.col("title"),
        F.lit('.</span><span class="detail-hours_html">'), F.col("credits_text"), F.lit('</span><p class="courseblockextra">'), F.coalesce(F.regexp_replace("description", "&", "&amp;"), F.lit("")), F.lit("</p></div></html>"),
    )
    return c.select(F.col("nseq").alias("page_id"), F.concat(F.lit("https://example.org/courses/"), F.lower("department"), F.lit("/")).alias("url"), html.alias("html"))


def _family_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = next(r for r in extraction.site_rules(extraction.rules(spark)) if r.name == "columbia")
    return extraction.parse_blocks(extraction.course_blocks(catalogue_pages(spark, sf_dir), rule), rule)


@query("""SELECT nseq AS page_id, CASE WHEN nseq % 17 <> 0 THEN norm_id END AS course_id, title, credits, CASE WHEN nseq % 17 = 0 THEN 'Unknown' ELSE level END AS level, department, CASE WHEN nseq % 17 = 0 THEN 'failed' ELSE 'parsed' END AS status FROM levels""")
def course_blocks(spark, sf_dir):
    rows = _family_rows(spark, sf_dir)
    return rows.select("page_id", "course_id", "title", F.col("credits.text").alias("credits"), F.coalesce("level", F.lit("Unknown")).alias("level"), "department", "status")


def _rule(spark: SparkSession, name: str) -> extraction.SiteRule:
    return next(r for r in extraction.site_rules(extraction.rules(spark)) if r.name == name)


@query("""SELECT nseq AS page_id, unnest([0, 1, 2])::BIGINT AS position, unnest(['One ' || title || ' Two In Three', 'In', 'Last ' || department]) AS text FROM ids
UNION ALL SELECT nseq, 3, 'Open end' FROM ids WHERE nseq % 5 = 0""")
def balanced_blocks(spark, sf_dir):
    """Blocks end at their own end tags: nested blocks, other text between them, and a footer behind the last."""
    c = courses_raw(spark, sf_dir)
    html = F.concat(
        F.lit('<div>Top<div class="x courseblock">One <b>'), F.col("title"), F.lit("</b><div>Two</div><!-- </div> --><div class='n'><div class=\"courseblock\">In</div></div> Three</div>between</div>"),
        F.lit('<section class="courseblock">Last <br>'), F.col("department"), F.lit('</section><div class="footer">Prerequisite: CSE 9999</div>'), F.when(F.col("nseq") % 5 == 0, '<div class="courseblock">Open<p>end').otherwise(""),
    )
    pages = c.select(F.col("nseq").alias("page_id"), F.lit("https://example.org/courses/x/").alias("url"), html.alias("html"))
    found = extraction.course_blocks(pages, _rule(spark, "columbia"))
    return found.select("page_id", F.col("position").cast("long").alias("position"), T.clean_text(H.all_text(F.col("block"))).alias("text"))


@query("""SELECT nseq AS page_id, CAST(nseq % 90 AS VARCHAR) || '.01' AS course_id, title, CASE WHEN nseq % 2 = 0 THEN 'Told apart' ELSE CAST(nseq % 90 AS VARCHAR) || '.01 ' || title || '. 3-0-9 units. Prereq: CSE 1010 and CSE 1729; x.' END AS description,
'3' AS credits, CASE WHEN nseq % 3 = 0 AND nseq % 2 = 0 THEN NULL ELSE 'CSE 1010 and CSE 1729' END AS prerequisites_text FROM ids""")
def whole_text_fields(spark, sf_dir):
    """A site without field elements: description and prerequisite clause from the block's whole text, none from the footer."""
    c = courses_raw(spark, sf_dir)
    clause = F.when((F.col("nseq") % 3 == 0) & (F.col("nseq") % 2 == 0), "").otherwise(" Prereq: CSE 1010 and CSE 1729; x.")
    stated = F.when(F.col("nseq") % 2 == 0, '<i class="courseblockextra">Told apart</i>').otherwise("")
    html = F.concat(F.lit('<div class="courseblock"><p>'), (F.col("nseq") % 90).cast("string"), F.lit(".01 "), F.col("title"), F.lit(". 3-0-9 units."), clause, F.lit("</p>"), stated, F.lit("</div><footer>Prerequisite: CSE 9999</footer>"))
    rule = _rule(spark, "mit")
    rows = extraction.parse_blocks(extraction.course_blocks(c.select(F.col("nseq").alias("page_id"), F.lit("u").alias("url"), html.alias("html")), rule), rule)
    return rows.select("page_id", "course_id", "title", "description", F.col("credits.text").alias("credits"), "prerequisites_text")


@query("""SELECT 'Columbia University' AS university, count(*) FILTER (nseq % 17 <> 0) AS parsed, count(*) FILTER (nseq % 17 = 0) AS failed, round_even(count(*) FILTER (nseq % 17 <> 0) * 100.0 / count(*), 2)::DOUBLE AS success_rate FROM ids""")
def scrape_success(spark, sf_dir):
    return extraction.success_rates(_family_rows(spark, sf_dir)).withColumn("success_rate", F.col("success_rate").cast("double"))


@query("""SELECT nseq AS doc_id, unnest([0, 1])::BIGINT AS position, unnest(['CSE ' || CAST(1000 + nseq % 9000 AS VARCHAR), 'MATH 2410Q']) AS course_id, unnest([title, 'Linear ' || title]) AS title, unnest(['3', CASE WHEN credits = 'Unknown' THEN 'Unknown' ELSE credits END]) AS credits,
unnest([NULL, 'CSE 1010 and CSE 1729']) AS prerequisites_text FROM levels""")
def catalogue_entries(spark, sf_dir):
    c = courses_raw(spark, sf_dir)
    text = F.concat(
        F.lit("Preface\n  CSE "), (1000 + F.col("nseq") % 9000).cast("string"), F.lit(". "), F.col("title"), F.lit(". 3 credits.\n  A course.\n\n  MATH 2410Q. Linear "), F.col("title"),
        F.lit(".\n  Taught as "), F.col("credits_text"), F.lit(". Prerequisite: CSE 1010 and\n  CSE 1729."),
    )
    entries = extraction.catalogue_entries(c.select(F.col("nseq").alias("doc_id"), text.alias("text")))
    rows = extraction.parse_entries(entries, "University", "Department", "https://example.org")
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), "course_id", "title", F.col("credits.text").alias("credits"), "prerequisites_text")


# --- files, schema, streams -----------------------------------------------------------------------

def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw courses as JSON lines; some lack a title, some have an unknown key or a wrong type."""
    c = courses_raw(spark, sf_dir)
    body = F.struct("university", "course_id", "description", F.lit(3).alias("credits"), F.when(F.col("nseq") % 19 == 0, "Invalid").otherwise("Graduate").alias("level"), "department", F.when(F.col("nseq") % 23 != 0, F.col("title")).alias("title"), F.when(F.col("nseq") % 29 == 0, F.lit("x")).alias("colour"), F.when(F.col("nseq") % 31 == 0, F.array(F.lit("Fall"), F.lit("Never"))).alias("offerings"))
    return c.select("nseq", F.to_json(body).alias("value"))


@query("""SELECT nseq, CASE WHEN nseq % 29 = 0 THEN 'unknown: colour' WHEN nseq % 23 = 0 THEN 'missing: title' END AS construct_error, course_id, 'int' AS kind FROM courses_raw""")
def read_lines(spark, sf_dir):
    return sources.parse_lines(json_lines(spark, sf_dir)).select("nseq", "construct_error", "course_id", F.col("credits.kind").alias("kind"))


@query(r"""SELECT nseq, concat_ws(', ', CASE WHEN nseq % 23 = 0 THEN 'title: required' END, CASE WHEN NOT regexp_matches(course_id, '^[A-Z]{2,6}\s*\d{3,4}[A-Z]?$') THEN 'course_id: pattern' END, CASE WHEN nseq % 19 = 0 THEN 'level: value' END, CASE WHEN nseq % 31 = 0 THEN 'offerings: items' END) AS violations FROM courses_raw""")
def schema_violations(spark, sf_dir):
    return json_lines(spark, sf_dir).select("nseq", F.array_join(validation.schema_violations(F.col("value")), ", ").alias("violations"))


@query("""SELECT nseq, norm_id AS course_id, credits, nullif(trim(prerequisites_text), '') AS prerequisites_text FROM levels""")
def export_rows(spark, sf_dir):
    return sources.export_rows(courses(spark, sf_dir)).select("nseq", "course_id", "credits", "prerequisites_text")


@query("SELECT university, norm_id AS course_id, min(nseq) AS nseq FROM checked WHERE nseq % 23 <> 0 AND nseq % 29 <> 0 AND NOT list_contains(list_transform(errors, lambda x: left(x, 7)), 'Missing') AND NOT list_contains(list_transform(errors, lambda x: left(x, 17)), 'Invalid course_id') GROUP BY ALL")
def stream_ingest(spark, sf_dir):
    """The stream's result over all files equals keeping the first valid row of each key."""
    base = sources.scratch(spark, "stream")
    lines = json_lines(spark, sf_dir).select(F.concat(F.col("nseq").cast("string"), F.lit("\t"), F.col("value")).alias("value"))
    lines.write.text(f"{base}/in")
    ingest.ingest_lines(spark, f"{base}/in", f"{base}/out", f"{base}/state", NOW).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("university", "course_id", "nseq")


@query("""SELECT university, norm_id AS course_id, CAST(min(struct_pack(place := nseq % 3, nseq := coalesce(nullif(nseq % 10, 9), 100), title)).title AS VARCHAR) AS title
FROM checked WHERE nseq % 23 <> 0 AND nseq % 29 <> 0 AND NOT list_contains(list_transform(errors, lambda x: left(x, 7)), 'Missing') AND NOT list_contains(list_transform(errors, lambda x: left(x, 17)), 'Invalid course_id') GROUP BY ALL""")
def stream_batches(spark, sf_dir):
    """Three arrivals of two files each with repeated and missing nseq, and one arrival again: one row a key, from the first arrival that has it."""
    base = sources.scratch(spark, "stream")
    rows = json_lines(spark, sf_dir).withColumn("place", F.col("nseq") % 3)
    nseq = F.when(F.col("nseq") % 10 == 9, "").otherwise((F.col("nseq") % 10).cast("string"))
    for k in (0, 1, 2, 0):
        own = rows.where(F.col("place") == k).select(F.concat(nseq, F.lit("\t"), F.col("value")).alias("value"))
        own.repartition(2).write.mode("append").text(f"{base}/in")
        ingest.ingest_lines(spark, f"{base}/in", f"{base}/out", f"{base}/state", NOW).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("university", "course_id", "title")


@query("""SELECT university, norm_id AS course_id, 'first' AS kept, min(struct_pack(o := nseq % 4, t := title)).t AS title FROM ids GROUP BY ALL
UNION ALL SELECT university, norm_id, 'last', min(struct_pack(o := CASE WHEN nseq % 4 = 3 THEN 9 ELSE -(nseq % 4) END, t := title)).t FROM ids GROUP BY ALL""")
def keep_one_with_ties(spark, sf_dir):
    """Places that repeat within a key, some null: one row a key either way."""
    rows = courses(spark, sf_dir).select("title", "university", "course_id", F.when(F.col("nseq") % 4 != 3, F.col("nseq") % 4).alias("nseq"))
    kept = [f(rows).withColumn("kept", F.lit(k)) for k, f in (("first", store.keep_first), ("last", store.keep_last))]
    return kept[0].unionByName(kept[1]).select("university", "course_id", "kept", "title")


@query("""SELECT row_number() OVER (ORDER BY nseq) - 1 AS nseq, CASE WHEN nseq % 29 = 0 THEN 'unknown: colour' WHEN nseq % 23 = 0 THEN 'missing: title' END AS construct_error, course_id, CASE WHEN nseq % 23 <> 0 THEN title END AS title FROM courses_raw""")
def read_document(spark, sf_dir):
    """One JSON array of all courses in one file, read by as many tasks as it has blocks."""
    base = sources.scratch(spark, "document")
    rows = json_lines(spark, sf_dir)
    array = rows.select(F.concat(F.when(F.col("nseq") == 0, "[").otherwise(","), "value").alias("value"), "nseq")
    array.unionByName(spark.createDataFrame([("]", 2**62)], "value string, nseq long")).orderBy("nseq").coalesce(1).select("value").write.text(f"{base}/courses.json")
    found = sources.read_json_document(spark, f"{base}/courses.json")
    return found.select("nseq", "construct_error", "course_id", "title")


def _bucketed(spark: SparkSession, sf_dir: str) -> str:
    """A table of two thirds of the courses and then an upsert of the others."""
    path, rows = sources.scratch(spark, "table"), courses(spark, sf_dir)
    buckets.create(rows.where("nseq % 3 <> 0"), path, buckets=16, unique=True)
    buckets.upsert(rows.where("nseq % 3 = 0"), path, unique=True)
    return path


@query("""SELECT university, norm_id AS course_id, max(nseq) AS nseq FROM ids WHERE nseq % 3 = 0 GROUP BY ALL
UNION ALL SELECT university, norm_id, nseq FROM (SELECT university, norm_id, max(nseq) AS nseq FROM ids WHERE nseq % 3 <> 0 GROUP BY ALL) o
WHERE NOT EXISTS (SELECT 1 FROM ids b WHERE b.nseq % 3 = 0 AND b.university = o.university AND b.norm_id = o.norm_id)""")
def upsert_buckets(spark, sf_dir):
    return buckets.read(spark, _bucketed(spark, sf_dir)).select("university", "course_id", "nseq")


@query(f""", both_rows AS (SELECT university, norm_id, level, nseq, prerequisites_text, row_number() OVER (PARTITION BY university, norm_id ORDER BY nseq % 3 = 0 DESC, nseq DESC) AS place FROM levels),
kept AS (SELECT *, {_PARSED} AS parsed FROM both_rows WHERE place = 1),
counted AS (SELECT 'all' AS scope, NULL AS name, count(*) AS courses, count(*) FILTER (parsed) AS parsed, count(*) FILTER (trim(prerequisites_text) <> '') AS t FROM kept
UNION ALL SELECT 'university', university, count(*), count(*) FILTER (parsed), count(*) FILTER (trim(prerequisites_text) <> '') FROM kept GROUP BY university
UNION ALL SELECT 'level', level, count(*), count(*) FILTER (parsed), count(*) FILTER (trim(prerequisites_text) <> '') FROM kept GROUP BY level)
SELECT scope, name, courses, parsed, CASE WHEN t > 0 THEN round_even(parsed * 100.0 / t, 2) ELSE 0 END::DOUBLE AS parse_rate FROM counted""")
def statistics_maintained(spark, sf_dir):
    """Statistics that an upsert has changed by what it added and removed, against counting the table that came of it."""
    out = buckets.statistics(spark, _bucketed(spark, sf_dir))
    return out.withColumn("parse_rate", F.col("parse_rate").cast("double"))


@query("""SELECT query, nseq, university, norm_id AS course_id FROM ids, (SELECT unnest(['%widg_t%', '%ring%', '%a%', '%e &_mp; mo%', '%TYPE_0%zzz%', '%size 1_.%']) AS query)
WHERE translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE lower(query) OR translate(description, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE lower(query)""")
def search_indexed(spark, sf_dir):
    """Searches by the trigram index: a wildcard, a plain word, one too short for the index, and one without hits."""
    path = sources.scratch(spark, "index")
    search_index.build(courses(spark, sf_dir).select("nseq", "university", "course_id", "title", "description"), path)
    found = [search_index.indexed_search(spark, path, q).select(F.lit(f"%{q}%").alias("query"), "nseq", "university", "course_id") for q in ("widg_t", "ring", "a", "e &_mp; mo", "TYPE_0%zzz", "size 1_.")]
    return store.merge(*found)


@query("""SELECT count(*) AS total, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid,
round_even(count(*) FILTER (len(errors) = 0) * 100.0 / count(*), 1)::DOUBLE AS success_rate FROM checked""")
def validation_summary_written(spark, sf_dir):
    n = validation.write_checked(validation.with_errors(courses(spark, sf_dir)), sources.scratch(spark, "checked"))
    return spark.createDataFrame([n], "total long, valid long, invalid long, success_rate double")


@query("""SELECT count(*) FILTER (nseq % 17 <> 0) AS parsed, count(*) FILTER (nseq % 17 = 0) AS failed, round_even(count(*) FILTER (nseq % 17 <> 0) * 100.0 / count(*), 2)::DOUBLE AS success_rate FROM ids""")
def scrape_success_written(spark, sf_dir):
    n = extraction.write_parsed(_family_rows(spark, sf_dir), sources.scratch(spark, "parsed"))
    return spark.createDataFrame([n], "parsed long, failed long, success_rate double")


@query("," + _CHECK + """SELECT count(*) FILTER (changed) AS successes, count(*) AS attempts, CAST(sum(coalesce(course_count, 0)) AS BIGINT) AS courses FROM reasons""")
def refresh_summary_written(spark, sf_dir):
    n = refresh.write_refreshed(refresh.check(current(spark, sf_dir), snapshots(spark, sf_dir), NOW), sources.scratch(spark, "refreshed"))
    return spark.createDataFrame([n], "successes long, attempts long, courses long")


# --- files, sinks and state, written and read again ----------------------------------------------------

@query("""SELECT row_number() OVER (ORDER BY nseq % 2, nseq) - 1 AS nseq, CASE WHEN nseq % 23 <> 0 THEN title END AS title, nseq % 29 <> 0 AND nseq % 23 <> 0 AS good FROM courses_raw""")
def read_files_in_order(spark, sf_dir):
    """JSON lines of two arguments, blank lines among them: numbers follow the arguments and the places in their files."""
    base, rows = sources.scratch(spark, "lines"), json_lines(spark, sf_dir)
    for k in (0, 1):
        rows.where(F.col("nseq") % 2 == k).orderBy("nseq").coalesce(1).select(F.concat("value", F.when(F.col("nseq") % 5 == 0, "\n \t").otherwise(""))).write.text(f"{base}/{k}")
    found = sources.read_jsonl(spark, f"{base}/0", f"{base}/1")
    return _dense(found.select("nseq", "title", F.col("construct_error").isNull().alias("good")))


def _dense(rows: DataFrame) -> DataFrame:
    """``nseq`` without the gaps that blank lines leave."""
    return rows.withColumn("nseq", F.row_number().over(Window.orderBy("nseq")).cast("long") - 1)


@query("""SELECT university, title, description, count(*) AS n FROM courses_raw WHERE nseq % 29 <> 0 AND nseq % 23 <> 0 GROUP BY ALL""")
def read_lines_skipping(spark, sf_dir):
    """Rows that cannot become courses are left out."""
    base = sources.scratch(spark, "lines")
    json_lines(spark, sf_dir).select("value").write.text(f"{base}/in")
    return sources.read_jsonl(spark, f"{base}/in", bad="skip", dense=False).groupBy("university", "title", "description").agg(F.count("*").alias("n"))


@query("""SELECT nseq, norm_id AS course_id, title, notes, notes IS NOT NULL AS has_notes FROM ids""")
def written_jsonl(spark, sf_dir):
    """Courses as JSON lines without null fields, read again."""
    base = sources.scratch(spark, "jsonl")
    sources.write_jsonl(courses(spark, sf_dir).select("nseq", "course_id", "title", "notes"), base)
    c = F.col("value")
    return spark.read.text(base).select(F.get_json_object(c, "$.nseq").cast("long").alias("nseq"), *[F.get_json_object(c, f"$.{f}").alias(f) for f in ("course_id", "title", "notes")], F.array_contains(F.json_object_keys(c), "notes").alias("has_notes"))


@query("""SELECT nseq, norm_id AS course_id, credits, nullif(trim(prerequisites_text), '') AS prerequisites_text FROM levels""")
def written_csv(spark, sf_dir):
    base = sources.scratch(spark, "csv")
    sources.write_csv(courses(spark, sf_dir).select("nseq", "course_id", "credits", "prerequisites", "prerequisites_text"), base)
    return spark.read.option("header", True).csv(base).select(F.col("nseq").cast("long").alias("nseq"), "course_id", "credits", "prerequisites_text")


@query("""SELECT norm_id AS course_id, title, CASE WHEN len(c) > 0 THEN array_to_string(c, ',') END AS corequisites FROM (SELECT ids.*, """ + _CODES.format("regexp_extract(coalesce(prerequisites_text, ''), '(?i)corequisites?[ ]*:?[ ]*(.+?)(?:[.;]|$)', 1)") + """ AS c FROM ids) WHERE university = 'Brand#7'""")
def decoded_export(spark, sf_dir):
    """A stored table's JSON text as lists again, of one university."""
    rows = courses(spark, sf_dir).withColumn("corequisites", P.corequisites(F.col("prerequisites_text")))
    base = sources.scratch(spark, "stored")
    sources.export_rows(rows).write.parquet(base)
    out = sources.export_decoded(spark.read.parquet(base), "Brand#7")
    return out.select("course_id", "title", F.array_join("corequisites", ",").alias("corequisites"))


@query("""SELECT nseq, title FROM courses_raw""")
def json_array_round_trip(spark, sf_dir):
    """One JSON array of all rows, written by many tasks and read by many."""
    base = sources.scratch(spark, "array")
    lines = sources.to_json_array(courses_raw(spark, sf_dir).select("nseq", "title"))
    lines.orderBy("part").coalesce(1).select("line").write.text(f"{base}/all.json")
    c = F.col("line")
    return sources.read_json_document(spark, f"{base}/all.json").select(F.get_json_object(c, "$.nseq").cast("long").alias("nseq"), F.get_json_object(c, "$.title").alias("title"))


@query("""SELECT university, CAST(sum(courses) AS BIGINT) AS courses, 2::BIGINT AS runs FROM (SELECT university, courses FROM run_events) GROUP BY university""")
def scrape_log(spark, sf_dir):
    """Two appends to the scrape log: halves of each university's courses."""
    base, n = sources.scratch(spark, "log"), refresh.run_metrics(_view(spark, sf_dir, views.RUN_EVENTS, events="events"))
    half = F.floor(F.col("courses") / 2)
    for part in (half, F.col("courses") - half):
        sources.append_runs(n.select("university", part.cast("long").alias("courses_added"), F.lit(NOW).alias("scrape_date")), base)
    return spark.read.parquet(base).groupBy("university").agg(F.sum("courses_added").alias("courses"), F.count("*").alias("runs"))


@query("," + _CHECK + f"""SELECT university, url, content_hash, CASE WHEN length(university) = 2 THEN 77 ELSE course_count END AS course_count FROM (
SELECT university, url, CASE WHEN changed THEN new_hash ELSE old_hash END AS content_hash, CASE WHEN action = 'first' THEN 0 ELSE course_count END AS course_count FROM reasons WHERE action <> 'failed' OR last_checked IS NOT NULL
UNION ALL SELECT university, url, content_hash, course_count FROM snapshots s WHERE NOT EXISTS (SELECT 1 FROM current_hashes c WHERE c.university = s.university))""")
def snapshot_versions(spark, sf_dir):
    """The state after a check, written as a version, with course counts of a later run."""
    base, old = sources.scratch(spark, "snapshots"), snapshots(spark, sf_dir)
    first = sources.write_version(refresh.next_state(refresh.check(current(spark, sf_dir), old, NOW), old), base, 1)
    state = spark.read.parquet(first)
    runs = state.where(F.length("university") == 2).select("university", F.lit(77).cast("long").alias("n"), F.lit("").alias("note"))
    second = sources.write_version(refresh.update_counts(state, runs), base, 2)
    return refresh.snapshots_listed(spark.read.parquet(second)).select("university", "url", "content_hash", "course_count")


@query("," + _CHECK + "SELECT university, reason FROM reasons WHERE changed")
def refresh_tasks(spark, sf_dir):
    return refresh.tasks(refresh.check(current(spark, sf_dir), snapshots(spark, sf_dir), NOW)).select("university", "reason")


@query("""SELECT university, CASE WHEN university LIKE '%7' THEN 'Unknown' ELSE CAST(d // 3600 AS VARCHAR) || ':' || lpad(CAST(d // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(d % 60 AS VARCHAR), 2, '0') END AS duration
FROM (SELECT university, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS d FROM run_events GROUP BY university)""")
def run_durations(spark, sf_dir):
    runs = _view(spark, sf_dir, views.RUN_EVENTS, events="events").groupBy("university").agg(F.min("ts").cast("string").alias("start_time"), F.max("ts").cast("string").alias("end_time"))
    runs = runs.withColumn("end_time", F.when(F.col("university").endswith("7"), "no time").otherwise(F.col("end_time")))
    return refresh.run_duration(runs).select("university", "duration")


@query("," + _GOLDEN + """SELECT field, count(*) AS total, count(*) FILTER (outcome = 'correct') AS correct, (SELECT count(*) FROM stated WHERE outcome = 'incorrect') AS error_count FROM stated GROUP BY field""")
def golden_report(spark, sf_dir):
    """The report document, written as JSON and read again."""
    base = sources.scratch(spark, "report")
    sources.write_report(golden.report(_compared(spark, sf_dir)), base)
    schema = "fields map<string, struct<total: long, correct: long>>, error_count long"
    return spark.read.schema(schema).json(base).select(F.explode("fields").alias("field", "m"), "error_count").select("field", "m.total", "m.correct", "error_count")


@query("," + _GOLDEN + """SELECT field, count(*) AS total, count(*) FILTER (outcome = 'correct') AS correct FROM stated WHERE university = 'Brand#17' GROUP BY field""")
def golden_one_university(spark, sf_dir):
    compared = golden.compare(courses(spark, sf_dir), golden_courses(spark, sf_dir), university="Brand#17")
    return golden.field_metrics(compared).select("field", "total", "correct")


@query("""SELECT count(*) AS total, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid FROM (SELECT * FROM checked ORDER BY nseq LIMIT 90)""")
def validation_of_first_rows(spark, sf_dir):
    """Only the first rows are validated."""
    return validation.summary(validation.with_errors(sources.first_rows(courses(spark, sf_dir), 90))).select("total", "valid", "invalid")


@query(f"""SELECT nseq, norm_id AS course_id, CASE WHEN nseq % 19 = 0 THEN 'Unknown' ELSE 'Graduate' END AS level, '{NOW}' AS last_updated FROM ids""")
def normalized_rows(spark, sf_dir):
    """Defaults of construction: checked levels, and the time of the run where a row has none."""
    return validation.normalize(sources.parse_lines(json_lines(spark, sf_dir)), NOW).select("nseq", "course_id", "level", "last_updated")


@query("""SELECT nseq, norm_id AS course_id, title, CASE WHEN credits_text = '3 credits' THEN '3' WHEN credits_text = '3-4 credits' THEN '3-4' WHEN credits_text = 'Lecture (4)' THEN '4' WHEN credits_text = 'credits vary' THEN 'variable' WHEN credits_text = '3.5 cr.' THEN '3.5' END AS credits
FROM ids WHERE nseq % 4 <> 3""")
def title_lines(spark, sf_dir):
    """Title lines taken apart; a line of another form gives no row."""
    c = courses_raw(spark, sf_dir).withColumn("id", C.normalize_course_id(F.col("course_id")))
    line = F.concat(F.lit("  "), "id", F.when(F.col("nseq") % 4 != 3, ". ").otherwise(": "), "title", F.lit(". "), "credits_text")
    r = C.title_line(line)
    return c.select("nseq", r["course_id"].alias("course_id"), r["title"].alias("title"), r["credits"]["text"].alias("credits")).where("course_id is not null")


@query("""SELECT site, nseq AS page_id, CASE site WHEN 'stanford' THEN title WHEN 'harvard' THEN title WHEN 'yale' THEN title WHEN 'berkeley' THEN title ELSE 'MATH 1' || CAST(100 + nseq % 900 AS VARCHAR) || ' ' || title END AS title, 'MATH 1' || CAST(100 + nseq % 900 AS VARCHAR) AS course_id,
CASE site WHEN 'berkeley' THEN CAST(1 + nseq % 5 AS VARCHAR) WHEN 'yale' THEN 'Unknown' ELSE '3' END AS credits, 'https://example.org/courses/' || site || '/' AS catalog_url
FROM ids, (SELECT unnest(['stanford', 'berkeley', 'harvard', 'princeton', 'cornell', 'yale']) AS site)""")
def site_layouts(spark, sf_dir):
    """The title lines of six sites over the same courses: codes, titles, defaults of credits, page addresses."""
    c = courses_raw(spark, sf_dir)
    code = F.concat(F.lit("MATH 1"), (100 + F.col("nseq") % 900).cast("string"))
    lines = {
        "stanford": F.concat(code, F.lit(": "), "title"), "berkeley": F.concat(code, F.lit(". "), "title", F.lit(". "), (1 + F.col("nseq") % 5).cast("string"), F.lit(" Units.")), "harvard": F.concat(code, F.lit(" (fall): "), "title"),
        "princeton": F.concat(code, F.lit(" "), "title"), "cornell": F.concat(code, F.lit(" "), "title"), "yale": F.concat(code, F.lit(". "), "title"),
    }
    out = []
    for site, line in lines.items():
        html = F.concat(F.lit('<div class="courseblock"><span class="courseblocktitle">'), line, F.lit("</span></div><p>foot</p>"))
        pages = c.select(F.col("nseq").alias("page_id"), F.lit(f"https://example.org/courses/{site}/").alias("url"), html.alias("html"))
        rule = _rule(spark, site)
        out.append(extraction.parse_blocks(extraction.course_blocks(pages, rule), rule).select(F.lit(site).alias("site"), "page_id", "course_id", "title", F.col("credits.text").alias("credits"), "catalog_url"))
    return store.merge(*out)


@query("""SELECT nseq AS page_id, CASE WHEN nseq % 3 = 0 THEN 'Full ' || title ELSE title END AS title, CASE WHEN nseq % 3 = 0 THEN 'CSE 1010 and CSE 1729' END AS prerequisites_text FROM ids""")
def detail_pages(spark, sf_dir):
    """A listing's block takes its detail page's block where there is one; prerequisites come from there."""
    c = courses_raw(spark, sf_dir)
    block = lambda title, link, more: F.concat(F.lit('<div class="courseblock"><a class="bubblelink" href="'), link, F.lit('">x</a><b class="detail-code">CSE 1010.</b><b class="detail-title">'), title, F.lit(".</b>"), more, F.lit("</div>foot"))
    link = F.concat(F.lit("/detail/"), F.col("nseq").cast("string"))
    listing = c.select(F.col("nseq").alias("page_id"), F.lit("/list").alias("url"), block(F.col("title"), link, F.lit("")).alias("html"))
    details = c.where("nseq % 3 = 0").select((F.col("nseq") + 1_000_000_000).alias("page_id"), link.alias("url"), block(F.concat(F.lit("Full "), "title"), F.lit("/self"), F.lit('<i class="detail-prereqs">CSE 1010 and CSE 1729</i>')).alias("html"))
    rule = _rule(spark, "uconn")
    found = extraction.replace_by_detail(extraction.course_blocks(listing, rule), listing.unionByName(details), rule)
    return extraction.parse_blocks(found, rule).select("page_id", "title", "prerequisites_text")


@query("""SELECT site, count(*) AS pages FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'nowhere' WHEN 1 THEN 'Else' END AS site FROM pages) WHERE site IS NOT NULL GROUP BY site""")
def unknown_sites(spark, sf_dir):
    """Pages of sites without a rule; names of sites are compared whatever their case."""
    site = F.when(F.col("page_id") % 3 == 0, "nowhere").when(F.col("page_id") % 3 == 1, "Else").otherwise("COLUMBIA")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", site.alias("site"))
    return extraction.unknown_sites(pages, extraction.rules(spark)).groupBy("site").agg(F.count("*").alias("pages"))


@query("""SELECT nseq AS doc_id, unnest([0, 1])::BIGINT AS position, unnest(['Unit ' || CAST(nseq AS VARCHAR) || ': ' || title, 'Unit 9: last']) AS entry FROM ids""")
def entries_by_own_pattern(spark, sf_dir):
    """Catalogue text cut by a pattern that the user gives."""
    c = courses_raw(spark, sf_dir)
    text = F.concat(F.lit("preface\nUnit "), F.col("nseq").cast("string"), F.lit(": "), "title", F.lit("\n\n  Unit 9: last\n"))
    return extraction.catalogue_entries(c.select(F.col("nseq").alias("doc_id"), text.alias("text")), r"Unit \d+: ").withColumn("position", F.col("position").cast("long"))


@query("""SELECT university, CASE WHEN length(university) = 2 THEN 'second' ELSE content_hash END AS content_hash, CASE WHEN length(university) = 2 THEN 'Catalog updated' ELSE 'Initial snapshot' END AS notes FROM current_hashes WHERE content_hash IS NOT NULL""")
def watched_catalogues(spark, sf_dir):
    """Two arrivals of catalogue contents folded into the snapshot state; within one the last content counts."""
    base, now = sources.scratch(spark, "watch"), current(spark, sf_dir).where("content_hash is not null")
    first = now.select("university", "content_hash", F.lit(2).cast("long").alias("seq")).unionByName(now.select("university", F.lit("early").alias("content_hash"), F.lit(1).cast("long").alias("seq")))
    second = now.where(F.length("university") == 2).select("university", F.lit("second").alias("content_hash"), F.lit(3).cast("long").alias("seq"))
    for arrival in (first, second):
        arrival.write.mode("append").parquet(f"{base}/in")
        ingest.watch_catalogues(spark, f"{base}/in", f"{base}/state", f"{base}/checkpoint", NOW).awaitTermination()
    return spark.read.parquet(f"{base}/state/v1").select("university", "content_hash", "notes")
