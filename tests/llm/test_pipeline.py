import hashlib
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    """Rows with null, repeated and shared doc_ids, copies, near copies, a shared passage and rejects."""
    rng = random.Random(11)
    letters = {"aa": "abcdef", "bb": "rstuvw"}
    vocabulary = {lang: ["".join(rng.choice(x) for _ in range(6)) for _ in range(300)] for lang, x in letters.items()}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    passage, near = text("aa", 60), text("aa", 120)
    out = [(k, text(lang, 90), lang) for k, lang in enumerate(["aa", "bb"] * 10)]
    out += [(20, text("aa", 200) + " " + passage, "aa"), (21, passage + " " + text("aa", 200), "aa"), (22, passage, "aa")]
    out += [(30, near, "aa"), (31, near + " abc", "aa"), (32, near, "aa")]
    out += [(None, text("bb", 80), "bb"), (None, near, "aa"), (None, near, "aa"), (None, text("aa", 50) + " " + passage, "aa")]
    out += [(4, out[4][1], "aa"), (5, text("aa", 70), "aa"), (5, near, "aa"), (6, passage + " " + text("aa", 40), "aa")]
    out += [(40, None, None), (41, "123 !", None), (None, "", None)]
    return [(i, t, lang, "test", None if t is None else len(t)) for i, t, lang in out]


def _linked(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
    return 100 * len(a & b) >= 75 * len(a | b)


def _first_of_groups(rows, order):
    docs = sorted({r[:2] for r in rows if r[0] is not None}, key=order)
    root = {d: d for d in docs}
    for n, d in enumerate(docs):
        for e in docs[:n]:
            if _linked(d[1], e[1]):
                old, new = max(root[d], root[e], key=order), min(root[d], root[e], key=order)
                root = {k: new if v == old else v for k, v in root.items()}
    return [r for r in rows if r[0] is None or root[r[:2]] == r[:2]]


def _without_repeats(rows, order):
    first, kept = {}, {}
    for n, d in enumerate(sorted({r[:2] for r in rows if r[0] is not None}, key=order)):
        words = d[1].split()
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            if first.setdefault(tuple(words[k : k + 50]), n) < n:
                gone[k : k + 50] = [True] * 50
        kept[d] = None if words and all(gone) else " ".join(w for w, g in zip(words, gone, strict=True) if not g)
    found = [(*r[:1], r[1] if r[0] is None else kept[r[:2]], *r[2:4]) for r in rows]
    return [(*r, len(r[1])) for r in found if r[1] is not None]


def test_pipeline_equals_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = sorted({r[1] for r in rows if r[1] is not None})
    mark = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text")).collect()}
    order = lambda r: (r[0], mark[r[1]])

    known = [r for r in rows if r[2] is not None]
    single = _first_of_groups(known, order)
    left = _without_repeats(single, order)
    assert len(known) > len(single) > len(left) and sum(r[0] is None for r in left) == 4 and {r[0] for r in left} >= {4, 5, 6}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, (known, single, left, left), strict=False):
        docs = corpus_pipeline.saved(stage(spark, docs, str(tmp_path)), name)
        assert sorted(map(repr, map(tuple, docs.collect()))) == sorted(map(repr, want)), name

    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digest = lambda t: hashlib.sha256(" ".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()
    got = [(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr((r[0], digest(r[1]))) for r in left)


def test_empty_table_twice(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    for _ in range(2):
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
