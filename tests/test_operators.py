import json
import random

import pytest
from pyspark.sql import functions as F

from syllabary.functions import courses as C
from syllabary.functions import html as H
from syllabary.operators import buckets, extraction, golden, maintained, refresh, search_index, store, validation
from syllabary.sources import courses as sources
from syllabary.streaming import ingest

ROW = {"university": "TestU", "course_id": "CSE 2100", "title": "Data Structures", "description": "Lists", "credits": 3, "level": "Undergraduate", "department": "CSE"}


def lines(spark, *rows):
    return spark.createDataFrame([(k, json.dumps(r) if isinstance(r, dict) else r) for k, r in enumerate(rows)], "nseq long, value string")


def checked(spark, *rows):
    return validation.with_errors(validation.normalize(sources.parse_lines(lines(spark, *rows)), "2024-01-01T00:00:00Z")).orderBy("nseq").collect()


def test_validity(spark):
    got = checked(spark, ROW, ROW | {"university": "", "title": ""}, ROW | {"course_id": "Invalid-123"}, ROW | {"credits": 0}, ROW | {"credits": "3-4"}, ROW | {"credits": "variable"}, ROW | {"credits": "3.5"}, ROW | {"credits": None}, ROW | {"level": "Odd"})
    assert got[0]["is_valid"] and got[4]["is_valid"] and got[8]["is_valid"] and got[8]["level"] == "Unknown"
    assert got[1]["errors"] == ["Missing required field: university", "Missing required field: title"]
    assert got[2]["errors"] == ["Invalid course_id format: INVALID 123"]
    assert got[3]["errors"] == ["Missing required field: credits"]
    assert len(got[5]["errors"]) == len(got[6]["errors"]) == 1 and len(got[7]["errors"]) == 2


def test_construction_and_schema(spark):
    bad = [ROW, ROW | {"x": 1}, {k: v for k, v in ROW.items() if k != "title"}, "[1]", "not json", ROW | {"course_id": 5}]
    got = sources.parse_lines(lines(spark, *bad)).orderBy("nseq").collect()
    assert [r["construct_error"] for r in got] == [None, "unknown: x", "missing: title", "not an object", "not an object", "course_id is not text"]
    rows = lines(spark, ROW, ROW | {"level": "InvalidLevel"}, {k: v for k, v in ROW.items() if k != "title"}, ROW | {"prerequisites": {"and": ["CSE 1010", {"or": ["MATH 1131Q"]}]}}, ROW | {"offerings": ["Fall", "Never"]}, ROW | {"notes": None})
    assert [r[0] for r in rows.select("nseq", validation.schema_violations(F.col("value")).alias("v")).orderBy("nseq").select("v").collect()] == [[], ["level: value"], ["title: required"], [], ["offerings: items"], ["notes: type"]]


def test_keep_one_and_upsert(spark):
    rows = spark.createDataFrame([(1, "U", "A 100", None), (2, "U", "A 100", "b"), (3, "U", "B 100", "c")], "nseq long, university string, course_id string, title string")
    assert sorted(r["nseq"] for r in store.keep_first(rows).collect()) == [1, 3]
    assert sorted(r["nseq"] for r in store.keep_last(rows).collect()) == [2, 3]
    assert [r["nseq"] for r in store.duplicates(rows).collect()] == [2]
    batch = rows.where("nseq < 3")
    assert sorted((r["course_id"], r["title"]) for r in store.upsert(rows.where("nseq = 3"), batch).collect()) == [("A 100", "b"), ("B 100", "c")]
    assert store.keep_first(rows.where("false")).count() == 0


def test_search_folds_only_ascii(spark):
    rows = spark.createDataFrame([("U", "A 1", "DATA 50%", "x"), ("U", "A 2", "É", "y\\z")], "university string, course_id string, title string, description string")
    hits = lambda q: [r["course_id"] for r in store.search(rows, q).collect()]
    assert hits("data") == ["A 1"] and hits("é") == [] and hits("d_t") == ["A 1"] and hits("Y\\z") == ["A 2"] and hits("50%") == ["A 1"]


def test_golden(spark):
    def course(n, title, credits, level="Unknown"):
        return (n, "U", "A 100", title, None, credits, level, "D", None, True)

    schema = "nseq long, university string, course_id string, title string, description string, credits struct<kind:string,num:double,text:string>, level string, department string, prerequisites_text string, prerequisites_parsed boolean"
    scraped = spark.createDataFrame([course(1, " Data ", ("int", 3.0, "3")), course(2, None, ("str", None, "3"))], schema)
    gold = spark.createDataFrame([course(1, "old", ("int", 9.0, "9")), course(2, "DATA", ("float", 3.0, "3.0"))], schema)
    m = {r["field"]: r for r in golden.field_metrics(golden.compare(scraped, gold)).collect()}
    assert (m["title"]["total"], m["title"]["correct"], m["title"]["missing"]) == (2, 1, 1)
    assert (m["credits"]["correct"], m["credits"]["incorrect"]) == (1, 1)
    assert "description" not in m
    wrong = golden.wrong_values(golden.compare(scraped, gold)).collect()
    assert [(r["nseq"], r["field"]) for r in wrong] == [(2, "credits")]
    assert golden.report(golden.compare(scraped, gold)).first()["error_count"] == 1


def test_refresh_chain(spark):
    now = "2024-01-31 00:00:00"
    snap = spark.sql("""SELECT * FROM VALUES
      ('recent', 'h', timestamp'2024-01-30 23:01:00', timestamp'2024-01-30 00:00:00', 5L, 'n'), ('same', 'h', timestamp'2024-01-30 00:00:00', timestamp'2024-01-01 00:00:00', 5L, 'n'),
      ('new', 'old', timestamp'2024-01-30 00:00:00', timestamp'2023-12-31 23:59:59', 5L, 'n') AS t(university, content_hash, last_checked, last_updated, course_count, notes)""")
    cur = spark.createDataFrame([("recent", "x"), ("same", "h"), ("new", "x"), ("first", "x"), ("gone", None)], "university string, content_hash string")
    got = {r["university"]: r for r in refresh.check(cur, snap, now).collect()}
    assert {u: r["action"] for u, r in got.items()} == {"recent": "recent", "same": "same", "new": "changed", "first": "first", "gone": "failed"}
    assert got["new"]["notes"] == "Catalog updated" and got["first"]["course_count"] == 0
    assert refresh.check(cur, snap, now, force=True).where("university = 'recent'").first()["action"] == "changed"
    should = {r["university"]: r["reason"] for r in refresh.should_refresh(cur, snap, now).collect()}
    assert should["new"] == "Stale data (last updated 30 days ago)" and should["same"] == "No changes detected" and should["first"] == "Never scraped before"
    runs = spark.createDataFrame([("same", 9, ""), ("u2", 100, "hi")], "university string, n long, note string")
    counts = {r["university"]: (r["course_count"], r["notes"]) for r in refresh.update_counts(snap, runs).collect()}
    assert counts["same"] == (9, "n") and counts["u2"] == (100, "hi")
    assert refresh.next_state(refresh.check(cur, snap, now), snap).count() == 4


def test_entries(spark):
    text = "\n        CSE 2100. Data Structures and Algorithms. 3 credits.\n        Lists and trees.\n        Prerequisite: CSE 1729.\n\n        CSE 3100. Systems Programming. 4 credits.\n        Processes.\n        "
    rows = extraction.parse_entries(extraction.catalogue_entries(spark.createDataFrame([(1, text)], "doc_id long, text string")), "U", "D", "u").orderBy("position").collect()
    assert [(r["course_id"], r["title"], r["credits"]["num"]) for r in rows] == [("CSE 2100", "Data Structures and Algorithms", 3.0), ("CSE 3100", "Systems Programming", 4.0)]
    assert rows[0]["prerequisites_text"] == "CSE 1729" and rows[1]["prerequisites_text"] is None


@pytest.mark.parametrize(
    ("site", "block", "want"),
    [
        ("columbia", '<span class="detail-code">CSE 2100.</span><span class="detail-title">Data.</span>', ("CSE 2100", "Data", "Unknown")),
        ("uconn", '<span class="detail-code">CSE 2100.</span><span class="detail-title">Data</span><span class="detail-hours_html">3 credits</span>', ("CSE 2100", "Data", "3")),
        ("mit", "<p>6.001 Structure of Programs. 3-0-9 Prereq: 18.01</p>", ("6.001", "Structure of Programs", "3")),
        ("stanford", '<span class="courseblocktitle">CS 106A: Programming</span>', ("CS 106A", "Programming", "3")),
        ("berkeley", '<span class="courseblocktitle">COMPSCI 61A. Structure. 4 Units.</span>', ("COMPSCI 61A", "Structure", "4")),
        ("harvard", '<span class="courseblocktitle">CS 50: Introduction</span>', ("CS 50", "Introduction", "3")),
        ("cornell", '<span class="courseblocktitle">CS 1110 Introduction</span>', ("CS 1110", "CS 1110 Introduction", "3")),
        ("yale", "<h3>CPSC 2010. Introduction</h3>", ("CPSC 2010", "Introduction", "Unknown")),
    ],
)
def test_site_rules(spark, site, block, want):
    rule = next(r for r in extraction.site_rules(extraction.rules(spark)) if r.name == site)
    page = spark.createDataFrame([(1, "https://x.org/courses/cs/", f'<h1>CS (CS)</h1><div class="courseblock">{block}</div>')], "page_id long, url string, html string")
    row = extraction.parse_blocks(extraction.course_blocks(page, rule), rule).first()
    assert (row["course_id"], row["title"], row["credits"]["text"]) == want and row["department"] == "CS" and row["status"] == "parsed"


def test_detail_pages_and_unknown_sites(spark):
    rules = extraction.rules(spark)
    rule = next(r for r in extraction.site_rules(rules) if r.name == "uconn")
    block = lambda title, link: f'<div class="courseblock"><a class="bubblelink" href="{link}">x</a><b class="detail-code">CSE 1.</b><b class="detail-title">{title}</b></div>'
    pages = spark.createDataFrame([(1, "/list", block("Short", "/detail") + block("Other", "/none")), (2, "/detail", block("Long", "/self"))], "page_id long, url string, html string")
    got = extraction.parse_blocks(extraction.replace_by_detail(extraction.course_blocks(pages.where("page_id = 1"), rule), pages, rule), rule)
    assert sorted(r["title"] for r in got.collect()) == ["Long", "Other"]
    sites = spark.createDataFrame([("UConn",), ("nowhere",)], "site string")
    assert [r["site"] for r in extraction.unknown_sites(sites, rules).collect()] == ["nowhere"]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(ROW) + "\n\n" + json.dumps(ROW | {"title": "Second"}) + "\nbad\n")
    (tmp_path / "b.json").write_text(json.dumps([ROW, ROW | {"credits": 3.5}]))
    rows = sources.read_jsonl(spark, str(tmp_path / "a.jsonl"), bad="skip")
    assert [r["title"] for r in rows.orderBy("nseq").collect()] == ["Data Structures", "Second"]
    assert sources.read_jsonl(spark, str(tmp_path / "a.jsonl")).where("construct_error is not null").count() == 1
    with pytest.raises(Exception, match="bad course"):
        sources.read_jsonl(spark, str(tmp_path / "a.jsonl"), bad="fail").select("construct_error", "title").collect()
    assert sorted(r["credits"]["kind"] for r in sources.read_json_document(spark, str(tmp_path / "b.json")).collect()) == ["float", "int"]
    with pytest.raises(ValueError):
        sources.read_jsonl(spark, str(tmp_path / "c.xml"))
    out = rows.select("university", "title", "notes")
    sources.write_jsonl(out, str(tmp_path / "out"))
    assert "notes" not in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert len(json.loads("\n".join(r["line"] for r in sources.to_json_array(out).collect()))) == 2
    assert json.loads("".join(r["line"] for r in sources.to_json_array(out.where("false")).collect())) == []


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write = lambda name, *rows: (folder / name).write_text("".join(f"{k}\t{json.dumps(r)}\n" for k, r in rows))
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), "2024-01-01T00:00:00Z")
    write("a.txt", (2, ROW | {"title": "Later"}), (1, ROW))
    ingest.ingest_lines(*args).awaitTermination()
    write("b.txt", (3, ROW | {"title": "Third"}), (4, ROW | {"course_id": "CSE 3100"}), (5, ROW | {"title": ""}))
    ingest.ingest_lines(*args).awaitTermination()
    assert sorted((r["course_id"], r["nseq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("CSE 2100", 1), ("CSE 3100", 4)]
    hashes = tmp_path / "hashes"
    for k, h in enumerate(("a", "b")):
        spark.createDataFrame([("U", h, k)], "university string, content_hash string, seq long").write.mode("append").parquet(str(hashes))
        ingest.watch_catalogues(spark, str(hashes), str(tmp_path / "snap"), str(tmp_path / "state2"), "2024-01-31 00:00:00").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "snap/v1")).first()["notes"] == "Catalog updated"


def test_files_are_read_in_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name, size in (("a", 1), ("b", 30), ("c", 400)):  # Spark packs the largest first
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(ROW | {"title": f"{name}{k}"}) + "\n\n" for k in range(size)))
    rows = sources.read_jsonl(spark, str(folder)).orderBy("nseq")
    assert [r["title"] for r in rows.collect()] == [f"{n}{k}" for n, size in (("a", 1), ("b", 30), ("c", 400)) for k in range(size)]
    assert store.keep_first(rows).first()["title"] == "a0" and store.keep_last(rows).first()["title"] == "c399"
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # one file in several blocks
    try:
        split = sources.read_jsonl(spark, str(folder / "c.jsonl"), *[str(folder / "a.jsonl")] * 130)
        titles = [r["title"] for r in split.orderBy("nseq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    assert titles == [f"c{k}" for k in range(400)] + ["a0"] * 130
    once = sources.read_jsonl(spark, str(folder), str(folder / "a.jsonl"), dense=False)
    assert [r["title"] for r in once.orderBy("place").collect()] == [r["title"] for r in rows.collect()] + ["a0"]
    assert store.keep_first(once, "place").first()["title"] == "a0" and store.keep_last(once, "place").first()["title"] == "a0"
    assert store.keep_last(once.where("title <> 'a0'"), "place").first()["title"] == "c399"
    assert store.keep_first(once, "place")._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2  # one an argument
    (tmp_path / "d.json").write_text(json.dumps([ROW | {"title": "x"}, ROW | {"title": "y"}]))
    (tmp_path / "e.json").write_text(json.dumps(ROW | {"title": "z"}))
    documents = sources.read_json_document(spark, str(tmp_path / "d.json"), str(tmp_path / "e.json"))
    assert [(r["nseq"], r["title"]) for r in documents.orderBy("nseq").collect()] == [(0, "x"), (1, "y"), (2, "z")]
    assert store.keep_first(documents).first()["title"] == "x"
    assert [r["title"] for r in sources.first_rows(documents, 2).collect()] == ["x", "y"] and sources.first_rows(documents, None).count() == 3


def test_uconn_fallbacks(spark):
    rule = next(r for r in extraction.site_rules(extraction.rules(spark)) if r.name == "uconn")
    block = lambda code, link="": f'<div class="course"><a class="courseblockcode" href="/wrong">w</a><a href="{link}" class="x bubblelink">c</a><span class="detail-code">{code}.</span><span class="detail-title">T.</span></div>'
    pages = spark.createDataFrame(
        [
            (1, "u1", '<a href="/undergraduate/courses/cse/">a</a><a href="/graduate/courses/cse/">b</a>'), (2, "u2", '<a href="/graduate/courses/math/">b</a>'),
            (3, "u3", '<ul class="breadcrumb"><li>Home</li><li>Mathematics </li></ul>' + block("MATH 100", "d")), (5, "d", '<div class="courseblock"><span class="detail-code">MATH 200</span></div>'),
            (6, "d", '<div class="courseblock"><span class="detail-code">MATH 300</span></div>'),
        ],
        "page_id long, url string, html string",
    )
    assert [(r["page_id"], r["link"]) for r in extraction.discover_links(pages, rule).orderBy("page_id").collect()] == [(1, "/undergraduate/courses/cse/"), (2, "/graduate/courses/math/")]
    found = extraction.course_blocks(pages, rule)
    assert {(r["page_id"], r["department"]) for r in found.collect()} >= {(3, "Mathematics")}
    assert [r["block"] for r in extraction.replace_by_detail(found.where("page_id = 3"), pages, rule).collect()] == ['<div class="courseblock"><span class="detail-code">MATH 200</span></div>']
    assert extraction.listed(extraction.rules(spark)).first()["sites"] == extraction.rules(spark).count()


def test_title_lines(spark):
    lines = ["CSE 2100. Data Structures. 3 credits", "MATH 101Q. Calculus", "no course"]
    got = spark.createDataFrame([(t,) for t in lines], "t string").select(C.title_line(F.col("t")).alias("r")).select("r.*").collect()
    assert [(r["course_id"], r["title"], r["credits"] and r["credits"]["num"]) for r in got] == [("CSE 2100", "Data Structures", 3.0), ("MATH 101Q", "Calculus", None), (None, None, None)]


def test_yale_title_from_any_text(spark):
    rule = next(r for r in extraction.site_rules(extraction.rules(spark)) if r.name == "yale")
    blocks = spark.createDataFrame([(1, "u", "D", 0, '<div class="courseblock">CPSC 201. Introduction<p>x</p></div>')], "page_id long, url string, department string, position int, block string")
    assert extraction.parse_blocks(blocks, rule).first()["course_id"] == "CPSC 201"


def test_snapshots_and_runs(spark):
    snap = spark.createDataFrame([("b", "h"), ("a", "h")], "university string, content_hash string")
    assert refresh.snapshot(snap, "b").count() == 1 and refresh.snapshot(snap, "z").count() == 0
    assert [r["university"] for r in refresh.snapshots_listed(snap).collect()] == ["a", "b"]
    checked = spark.createDataFrame([("a", True), ("b", False)], "university string, changed boolean")
    assert refresh.tasks(checked).count() == 1 and refresh.tasks(checked, force=True).count() == 2
    runs = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 01:02:03"), ("bad", "2024-01-01 01:02:03"), (None, None)], "start_time string, end_time string")
    assert [r["duration"] for r in refresh.run_duration(runs).collect()] == ["1:02:03", "Unknown", "Unknown"]


def test_export_decoded(spark, tmp_path):
    table = spark.createDataFrame([(1, "V", "B 1", '["A 1"]'), (2, "U", "C 1", None), (3, "U", "A 1", "[]")], "nseq long, university string, course_id string, corequisites string")
    got = sources.export_decoded(table).collect()
    assert [(r["university"], r["course_id"], r["corequisites"]) for r in got] == [("U", "A 1", []), ("U", "C 1", None), ("V", "B 1", ["A 1"])]
    assert sources.export_decoded(table, "V").count() == 1 and "nseq" not in got[0].asDict()
    sources.write_report(table.limit(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_keep_one_with_ties_and_nulls(spark):
    schema = "nseq long, university string, course_id string, title string"
    rows = spark.createDataFrame([(1, "U", "A 1", "y"), (1, "U", "A 1", "x"), (1, "U", "A 1", "x"), (None, "U", "A 1", "w"), (None, "U", "B 1", "q"), (None, "U", "B 1", "p"), (3, None, None, "n"), (3, None, None, "m")], schema)
    first = {r["course_id"]: r["title"] for r in store.keep_first(rows).collect()}
    last = {r["course_id"]: r["title"] for r in store.keep_last(rows).collect()}
    assert first == {"A 1": "x", "B 1": "p", None: "m"} and last == {"A 1": "x", "B 1": "p", None: "m"}
    assert store.keep_first(rows).count() == store.keep_last(rows).count() == 3 and store.duplicates(rows).count() == 5
    shuffled = rows.orderBy(F.desc("title")).repartition(3)
    assert {r["course_id"]: r["title"] for r in store.keep_first(shuffled).collect()} == first


def test_keep_one_reads_its_source_once(spark, tmp_path):
    spark.createDataFrame([(1, "U", "A 1")], "nseq long, university string, course_id string").write.parquet(str(tmp_path / "t"))
    plan = store.keep_first(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("WindowGroupLimit") == 2  # one of them before the shuffle


def test_stream_state(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write = lambda name, *rows: (folder / name).write_text("".join((f"{k}\t" if k is not None else "") + json.dumps(r) + "\n" for k, r in rows))
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), "2024-01-01T00:00:00Z", 1)
    titles = lambda: sorted((r["course_id"], r["nseq"], r["title"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    other = ROW | {"course_id": "CSE 3100"}
    write("a.txt", (0, ROW | {"title": "B"}), (0, ROW | {"title": "A"}), (None, other | {"title": "no place"}))
    write("b.txt", (0, ROW | {"title": "C"}), (5, other))
    ingest.ingest_lines(*args).awaitTermination()
    assert len(titles()) == 2 and ("CSE 3100" in {t[0] for t in titles()})
    before = titles()
    write("c.txt", (-7, ROW | {"title": "late"}), (1, other), (2, ROW | {"course_id": "CSE 1"}), (3, ROW | {"course_id": "CSE 4100"}))
    (folder / "d.txt").write_text((folder / "a.txt").read_text())  # the same lines again
    ingest.ingest_lines(*args).awaitTermination()
    assert titles() == sorted([*before, ("CSE 4100", 3, "Data Structures")])
    ingest.ingest_lines(*args).awaitTermination()
    assert len(titles()) == 3
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none") != ingest.STATE_STORE["spark.sql.streaming.stateStore.providerClass"]


def test_elements_end_where_their_tag_ends(spark):
    cut = lambda page: spark.createDataFrame([(page,)], "h string").select(H.blocks(F.col("h"), "block").alias("r")).first()["r"]
    assert cut('<div><div class="block">a<div>b</div>c</div>foot</div><p>end') == ['<div class="block">a<div>b</div>c</div>']
    assert cut('<div class="block">a<div class="block x">b</div>c</div>') == ['<div class="block">a<div class="block x">b</div>c</div>', '<div class="block x">b</div>']
    assert cut('<DIV class="block">a<!-- </div> --></div>z') == ['<DIV class="block">a</div>']
    assert cut('<p class="block">one<p class="block">two</p>x') == ['<p class="block">one', '<p class="block">two</p>']
    assert cut('<img class="block">x<div class="block">open<b>y') == ['<img class="block">', '<div class="block">open<b>y']
    assert cut('<div class="blocks">x</div>') == cut("") == cut(None) == []
    assert cut('<div class="block">é</div>' * 50) == ['<div class="block">é</div>'] * 50


def test_mit_takes_the_whole_text(spark):
    rule = next(r for r in extraction.site_rules(extraction.rules(spark)) if r.name == "mit")
    html = '<div class="courseblock"><p>8.01 Physics I. 3-0-9 units. Mechanics. Prereq: CSE 1010; none.</p></div><footer>Prerequisite: CSE 9999</footer>'
    page = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    row = extraction.parse_blocks(extraction.course_blocks(page, rule), rule).first()
    assert row["description"] == "8.01 Physics I. 3-0-9 units. Mechanics. Prereq: CSE 1010; none." and row["prerequisites_text"] == "CSE 1010"


def test_addresses_in_state_and_plan(spark):
    now = "2024-01-31 00:00:00"
    current = spark.createDataFrame([("a", "x", "new"), ("b", "y", "b-url")], "university string, content_hash string, url string")
    snap = spark.sql("SELECT 'a' AS university, 'old' AS url, 'h' AS content_hash, timestamp'2024-01-01' AS last_checked, timestamp'2024-01-01' AS last_updated, 1L AS course_count, 'n' AS notes, 0L AS nseq")
    state = refresh.next_state(refresh.check(current, snap, now), snap)
    assert {r["university"]: r["url"] for r in state.collect()} == {"a": "old", "b": "b-url"}
    assert [(r["university"], r["url"]) for r in refresh.plan(snap, now).collect()] == [("a", "old")]
    assert refresh.plan(snap.drop("url"), now).first()["url"] is None


def _table(spark, *rows):
    return spark.createDataFrame(rows, "nseq long, university string, course_id string, level string, prerequisites_parsed boolean, prerequisites_text string")


def _paths(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("part-*") if "/data/" in str(p)}


def test_upsert_leaves_other_buckets_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, "U" if k % 5 else None, f"A {k}", "Graduate", k % 2 == 0, "x" if k % 3 else None) for k in range(400)]
    assert buckets.create(_table(spark, *rows, (-1, "U", "A 1", "old", True, None)), path, buckets=32) == 0
    before = _paths(tmp_path)
    changed = [(1000 + k, "U" if k % 5 else None, f"A {k}", "Undergraduate", True, None) for k in (5, 6, 7)] + [(2000, "V", "A 9", "Graduate", False, "y"), (1999, "V", "A 9", "lost", False, "y")]
    assert buckets.upsert(_table(spark, *changed), path) == 1
    after = _paths(tmp_path)
    assert {p: t for p, t in after.items() if p in before} == before  # no file of version 0 was touched
    new = {p for p in after if p not in before}
    assert 0 < len({p.split("/bucket=")[1].split("/")[0] for p in new}) <= 4
    want = {(r[1], r[2]): r[0] for r in rows} | {(r[1], r[2]): r[0] for r in changed[:4]}
    got = buckets.read(spark, path).collect()
    assert {(r["university"], r["course_id"]): r["nseq"] for r in got} == want and len(got) == len(want)
    assert buckets.read(spark, path, version=0).where("university = 'V'").count() == 0
    assert buckets.lookup(spark, path, None, "A 5").first()["nseq"] == 1005 and buckets.lookup(spark, path, "U", "none").count() == 0
    whole = sorted(map(tuple, maintained.statistics(maintained.cells(buckets.read(spark, path))).collect()), key=str)
    assert sorted(map(tuple, buckets.statistics(spark, path).collect()), key=str) == whole
    assert buckets.upsert(_table(spark), path) == 2 and buckets.read(spark, path).count() == len(want)
    assert sorted(map(tuple, buckets.statistics(spark, path).collect()), key=str) == whole
    with pytest.raises(RuntimeError, match="already there"):
        buckets._publish(spark.createDataFrame([], "bucket int, folder string"), path, 2)


def test_bucket_tables_of_other_columns(spark, tmp_path):
    plain = spark.createDataFrame([(1, "k", "v")], "nseq long, name string, bucket2 string")
    buckets.create(plain.where("false"), str(tmp_path / "p"), key=["name"])
    assert buckets.read(spark, str(tmp_path / "p")).count() == 0
    buckets.upsert(plain, str(tmp_path / "p"))
    assert [tuple(r) for r in buckets.read(spark, str(tmp_path / "p")).collect()] == [(1, "k", "v")]


def test_signed_changes_cancel(spark):
    rows = _table(spark, (1, "U", "A", "G", True, "x"), (2, None, "B", None, None, None))
    assert maintained.apply(maintained.cells(rows), maintained.delta(rows, rows.where("false"))).count() == 0
    assert maintained.delta(rows, rows).count() == 0
    assert maintained.statistics(maintained.cells(rows.where("false"))).count() == 0  # as store.statistics


def test_indexed_search_is_search(spark, tmp_path):
    texts = ["DATA 50%", "É_data", "x\\y z", None, "", "ab", "aaa", "Data structures", "structure of data", "\U0001f600data\U0001f600x"]
    rows = spark.createDataFrame([(k, "U" if k % 2 else "V", f"A {k}", t, texts[-1 - k]) for k, t in enumerate(texts)], "nseq long, university string, course_id string, title string, description string")
    search_index.build(rows, str(tmp_path / "i"))
    for q in ("data", "DATA", "d_ta", "ata%ure", "50%", "", "%", "a", "aa", "x\\y", "É_d", "é_d", "ture of", "none at all", "\U0001f600x", "aaaa"):
        for u in (None, "U"):
            assert [tuple(r) for r in search_index.indexed_search(spark, str(tmp_path / "i"), q, u).select(*rows.columns).collect()] == [tuple(r) for r in store.search(rows, q, u).collect()], q
    assert search_index.literal_trigrams("Da_ABCD%x") == ["abc", "bcd"] and search_index.candidates(spark, str(tmp_path / "i"), "ab%c") is None


def test_counters_come_from_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3 == 0, "parsed" if k % 4 else "failed", k % 2 == 0, k) for k in range(10)], "is_valid boolean, status string, changed boolean, course_count long")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert validation.write_checked(rows, str(tmp_path / "a")) == {"total": 10, "valid": 4, "invalid": 6, "success_rate": 40.0}
    assert extraction.write_parsed(rows, str(tmp_path / "b")) == {"parsed": 7, "failed": 3, "success_rate": 70.0}
    assert refresh.write_refreshed(rows, str(tmp_path / "c")) == {"successes": 5, "attempts": 10, "courses": 45}
    assert spark.read.parquet(str(tmp_path / "a")).count() == 10
    assert validation.write_checked(rows.where("false"), str(tmp_path / "d")) == {"total": 0, "valid": 0, "invalid": 0, "success_rate": 0.0}


def _values(rng, depth=0):
    k = rng.random()
    if k < 0.45 or depth > 3:
        return rng.choice(['a"}b', "\\", 'x\\"}{[', "é}", "", "]", "plain", "}\n{"])
    if k < 0.6:
        return rng.choice([1, 2.5, None, True])
    inner = [_values(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f'{rng.choice("abc}")}{i}': v for i, v in enumerate(inner)} if k < 0.8 else inner


def test_documents_are_read_in_blocks(spark, tmp_path):
    rng = random.Random(3)
    documents = [
        [{"title": f"t{i}", "x": _values(rng)} for i in range(40)], [], {"title": "one", "x": {"y": 1}}, [1, {"a": {"b": "}"}}, "s", [{"c": 1}, {"d": 2}], None, {"e": []}, 7], [{"k": {"z": {}}}], "bad{", [5, 6],
    ]
    paths = []
    for i, x in enumerate(documents):
        paths.append(str(tmp_path / f"d{i}.json"))
        (tmp_path / f"d{i}.json").write_text(x if isinstance(x, str) else json.dumps(x, indent=rng.choice([None, 2]), ensure_ascii=False) + rng.choice(["", "\n"]))
    want = [e for x in documents for e in (x if isinstance(x, list) else [x])]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (None, "120"):
            for k in old if size else ():
                spark.conf.set(k, size)
            got = sources.read_json_document(spark, *paths).select("nseq", "line").orderBy("nseq").collect()
            assert [r["nseq"] for r in got] == list(range(len(want)))
            assert [r["line"] if r["line"] == "bad{" else json.loads(r["line"]) for r in got] == want
        assert spark.read.option("lineSep", "}").text(paths[0]).select(F.spark_partition_id().alias("p")).distinct().count() > 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sources.read_json_document(spark, paths[0], paths[5], bad="skip").count() == 0
    with pytest.raises(Exception, match="bad course"):
        sources.read_json_document(spark, paths[5], bad="fail").select("construct_error").collect()


def test_courses_of_one_row_group_are_dealt_to_all_cores(spark):
    from syllabary.plans import queries as Q

    for rows in (Q.courses_raw(spark, "/root/testdata/sf0.001"), Q.catalogue_pages(spark, "/root/testdata/sf0.001"), Q.json_lines(spark, "/root/testdata/sf0.001")):
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) * spark.sparkContext.defaultParallelism <= 2 * sum(sizes)


def test_repeated_texts_are_indexed_once(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("nseq"), F.lit("U").alias("university"), F.lit("A 1").alias("course_id"), F.concat(F.lit("Data "), F.col("id") % 2).alias("title"), F.lit("None").alias("description"))
    search_index.build(rows, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i/postings")).count() == 4 * 2 + 2
    assert search_index.indexed_search(spark, str(tmp_path / "i"), "ta 1").count() == 200 and search_index.indexed_search(spark, str(tmp_path / "i"), "none").count() == 400


def test_parts_are_found_once(spark):
    from syllabary.plans import queries as Q

    plan = Q.valid_courses_by_university(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "to_json" not in plan and "structstojson" not in plan
    assert str(H.blocks(F.col("html"), "c")).count("regexp_extract(") == 1
    for name, part in (("yale", "courseblocktitle"), ("berkeley", "courseblocktitle"), ("uconn", "detail-title")):
        assert str(extraction._block_fields(F.col("block"), Q._rule(spark, name))).count(part) == 1, name


def test_blocks_by_parts_with_odd_tags(spark):
    page = 'a > b<div class="c">1 < 2<p class="c">x<p>y</p><br class="c"><img class="c"></div><DIV CLASS="c">no</DIV><div class="c" '
    got = spark.createDataFrame([(page,)], "html string").select(H.blocks(F.col("html"), "c")).head()[0]
    assert got == ['<div class="c">1 < 2<p class="c">x<p>y</p><br class="c"><img class="c"></div>', '<p class="c">x', '<br class="c">', '<img class="c">', '<div class="c" ']
