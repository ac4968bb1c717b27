import json

import pytest
from pyspark.sql import functions as F

from syllabary.functions import courses as C
from syllabary.functions import html as H
from syllabary.functions import prerequisites as P
from syllabary.functions import text as T


def values(spark, texts, f):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in rows.select("k", f(F.col("t")).alias("x")).orderBy("k").select("x").collect()]


def test_text(spark):
    assert values(spark, ["  hello   world  ", "hello\n\nworld", "hello\tworld", None, " a\x1fb"], T.normalize_whitespace) == ["hello world", "hello world", "hello world", "", "a b"]
    assert values(spark, ["This is a sen-\ntence", "one\ntwo", "End.\nnext", "a\nB"], T.fix_broken_lines) == ["This is a sentence", "one two", "End.\nnext", "a\nB"]
    assert values(spark, ["  Hello  &nbsp; world  ", "a &amp;lt; b , c"], T.clean_text) == ["Hello   world", "a < b, c"]
    assert values(spark, ["a\n\nb \n \n\n c"], T.split_entries) == [["a", "b", "c"]]
    assert values(spark, ["x" * 101, "x" * 100], T.preview) == ["x" * 100 + "...", "x" * 100]


def test_ids_and_levels(spark):
    ids = ["CSE2100", "CSE-2100", "CSE  2100", "cse2100", "MATH-2410Q", "18.S997", "Invalid-123"]
    assert values(spark, ids, C.normalize_course_id) == ["CSE 2100"] * 3 + ["CSE2100", "MATH 2410Q", "18.S 997", "INVALID 123"]
    assert values(spark, ["CSE 1010", "CSE 4999", "CSE 5100", "ABC", "X 99999999999999999999"], C.infer_level) == ["Undergraduate", "Undergraduate", "Graduate", "Unknown", "Graduate"]
    dotted = {"Undergraduate": ["6.001", "STS.499", "4.100", "1.00", "1.A05"], "Graduate": ["21A.500", "18.901", "CMS.600", "1.563", "18.S997"], "Unknown": ["NoDot", "1.ABC"]}
    for level, some in dotted.items():
        assert values(spark, some, C.infer_dotted_level) == [level] * len(some)
    assert values(spark, ["CSE 2100", "Department of Computer Science, x", "Offered by: Mathematics"], lambda t: C.extract_department(t, t)) == ["CSE", "Computer Science", "Mathematics"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("3 credits", ("int", 3.0)), ("4 cr.", ("int", 4.0)), ("(3)", ("int", 3.0)), ("3.5 credits", ("float", 3.5)), ("1.5 cr", ("float", 1.5)), ("3-4 credits", ("str", "3-4")), ("variable credit", ("str", "variable")), ("credits vary", ("str", "variable")), ("no credits here", None), ("", None)],
)
def test_credits(spark, text, want):
    got = values(spark, [text], C.extract_credits)[0]
    assert (got and (got["kind"], got["num"] if got["kind"] != "str" else got["text"])) == want


PREREQUISITES = [
    ("CSE 1010 and CSE 1729", {"and": ["CSE 1010", "CSE 1729"]}, True),
    ("MATH 1131Q or MATH 1151Q", {"or": ["MATH 1131Q", "MATH 1151Q"]}, True),
    ("CSE 2100 and (MATH 2210Q or MATH 2410Q)", {"and": ["CSE 2100", {"or": ["MATH 2210Q", "MATH 2410Q"]}]}, True),
    ("CSE 1010", {"and": ["CSE 1010"]}, True),
    ("", None, True),
    ("Permission of instructor required", None, False),
    ("CSE 1010 and CSE 1729 or MATH 2210Q and junior standing", None, False),
    ("None", None, True),
    ("(CSE 1010 or CSE 1020)", {"or": [{"or": ["CSE 1010", "CSE 1020"]}]}, True),
    ("CSE 1010 (grade of C or better)", {"or": ["CSE 1010", {"or": []}]}, True),
    ("(CSE 1010 or CSE 1020) and (MATH 1131 or MATH 1132)", None, False),
    ("CSE 1010 or 1729", {"or": ["CSE 1010", "OR 1729"]}, True),
    ("(CSE 1010 or CSE 1020", {"and": ["CSE 1010", "CSE 1020"]}, True),
]


def test_prerequisites(spark):
    got = values(spark, [t for t, _, _ in PREREQUISITES], lambda t: F.struct(P.tree_json(P.parse_prerequisites(t)["tree"]).alias("tree"), P.parse_prerequisites(t)["parsed"].alias("parsed")))
    assert [(g["tree"] and json.loads(g["tree"]), g["parsed"]) for g in got] == [(tree, parsed) for _, tree, parsed in PREREQUISITES]
    assert values(spark, ["Corequisite: CSE 1010", "Corequisites: CSE 1010 and CSE 1729; x", "none", None], P.corequisites) == [["CSE 1010"], ["CSE 1010", "CSE 1729"], None, None]
    assert values(spark, ["CSE2100", "CSE-2100", "CSE 1, CSE 1010, MATH 2210Q"], P.course_codes) == [["CSE 2100"], ["CSE 2100"], ["CSE 1010", "MATH 2210Q"]]
    assert all(values(spark, ["Junior standing required", "Permission of instructor", "Minimum GPA of 3.0", "Open only to majors"], P.non_course_requirements))


def test_prerequisites_stay_native(spark):
    rows = spark.createDataFrame([("x",)], "t string").select(P.parse_prerequisites(F.col("t")))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_html(spark):
    page = '<h1>Computer Science (CSE)</h1><p class="courseblockextra">no</p><div class="x courseblock"><b class="code-alt">A</b><b class="code">B &amp; C</b></div><div class="courseblock">D</div>'
    assert values(spark, [page], lambda c: F.size(H.blocks(c, "courseblock"))) == [2]
    assert values(spark, [page], lambda c: H.class_text(c, "code")) == ["B & C"]
    assert values(spark, [page, "<p>"], lambda c: H.department_name(c, F.lit("https://x.org/courses/cse/"))) == ["Computer Science", "CSE"]
    assert values(spark, ['<a href="/b"><a class="y" href="/a"><a href="/b">'], H.distinct_links) == [["/a", "/b"]]
