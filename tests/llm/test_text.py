"""Collocations, chat formatting, spelling variants and toxicity neighbours against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from syllabary.llm import chat, collocations, spelling, toxicity


def _ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def _collocations(rows, least, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", _ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        inside = {q[k : k + size] for q in found for size in range(2, len(q)) for k in range(len(q) - size + 1) if found[q] >= counts[q[k : k + size]]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((lang, " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], k + 1, *r[1:]) for k, r in enumerate(rows[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(1)
    words = ["the", "of", "New", "York", "été", "a-b", "x", " ", "long" * 20]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " | "]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und"]), text(rng.randint(0, 60))) for _ in range(200)]
    return rows + [("en", "new york city hall now " * 40), ("en", "xx xx xx xx xx xx xx"), ("en", None), ("fr", ""), ("fr", " \t.\n"), rows[0], rows[0], ("de", text(20_000))]


def test_collocations_by_hand(spark, spoken):
    docs = spark.createDataFrame(spoken, "lang string, text string").repartition(5).withColumn("phrase", F.lit("clash"))
    got = collocations.collocations(collocations.phrase_counts(docs, least=7)).collect()
    assert sorted(map(tuple, got)) == _collocations(spoken, 7) and any(r["lang"] == "und" for r in got)
    assert sorted(map(tuple, collocations.collocations(collocations.phrase_counts(docs, least=7), most=3).collect())) == _collocations(spoken, 7, 3)


def test_tasks_that_write_often_count_the_same(spark, spoken, monkeypatch):
    docs = spark.createDataFrame(spoken, "lang string, text string").coalesce(1)
    want = sorted(map(tuple, collocations.phrase_counts(docs, least=7).collect()))
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "PHRASE_BYTES", 4000)
    monkeypatch.setattr(collocations, "BITS", (3, 6))  # tables so full that they let nearly all through
    assert sorted(map(tuple, collocations.phrase_counts(docs, least=7).collect())) == want


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_007
    rows = [("en", 0, "", big), ("en", 1, "a", 1_000_003), ("en", 1, "b", 700_001), ("en", 2, "a b", 600_011), ("en", 1, "c", big - 7), ("en", 1, "d", big - 9), ("en", 2, "c d", big - 11)]
    got = {r["phrase"]: r["score"] for r in collocations.collocations(spark.createDataFrame(rows, "lang string, size int, phrase string, f long")).collect()}
    assert got == {"a b": 1000 * 600_011 * big // (1_000_003 * 700_001), "c d": 1000 * (big - 11) * big // ((big - 7) * (big - 9))}


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(4)
    for least in (5, 40):
        stream = np.minimum(rng.zipf(1.3, 30_000), 1 << 30).astype(np.uint32)
        summary = collocations.Summary(len(stream) // least + 1)
        for part in np.array_split(stream, 50):
            summary.add(*collocations._counted(part))
        values, counts = np.unique(stream, return_counts=True)
        kept = set(summary.frequent(least).tolist())
        assert set(values[counts >= least].tolist()) <= kept and summary.taken < least
        assert len(summary.grams) <= 2 * summary.capacity


def test_places_cover_their_fingerprints():
    rng = np.random.default_rng(5)
    grams = np.sort(rng.integers(0, 1 << 64, 5000, np.uint64, endpoint=False))
    for parts, bits in ((7, 6), (211, 20), (1, 10)):
        part, inside = collocations._dealt(grams, parts)
        for p in np.unique(part).tolist():
            own = part == p
            assert set((grams[own] >> np.uint64(64 - bits)).tolist()) <= set(collocations._places(p, inside[own], parts, bits).tolist())


MESSAGES = "tree string, id long, parent long, role string, text string, score double"


def test_branches_of_a_tree(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "low", 1.0), ("t", 3, 1, "assistant", "high", 9.0), ("t", 4, 3, "user", "more", None), ("t", 5, 4, "assistant", "end", 3.0), ("t", 6, 3, "user", "other", 9.0),
        ("u", 1, 77, "user", "orphan", 1.0), ("u", 2, 1, None, None, 1.0), ("v", 1, 2, "user", "a", 1.0), ("v", 2, 1, "user", "b", 1.0), ("v", 3, 2, "user", "below a cycle", 1.0), ("w", 1, None, "user", "x", 1.0), ("w", 1, None, "assistant", "x", 1.0), ("x", 1, 1, "user", "own parent", 1.0),
    ]
    messages = spark.createDataFrame(rows, MESSAGES).repartition(3)
    paths = defaultdict(list)
    for r in chat.branches(messages.where("tree <> 'w'"), best=9).collect():
        paths[r["tree"], r["place"]].append((-r["back"], r["id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in paths.items()} == {("t", 1): [1, 3, 6], ("t", 2): [1, 3, 4, 5], ("t", 3): [1, 2], ("u", 1): [1, 2]}
    got = {r["tree"]: r for r in chat.format_branches(messages).collect()}
    assert set(got) == {"t", "u", "w"} and chat.parse(got["t"]["formatted"]) == [("user", "q"), ("assistant", "high"), ("user", "other")]
    assert [got["t"]["formatted"][m["start"] : m["start"] + m["length"]] for m in got["t"]["mask"]] == ["high"]
    assert chat.parse(got["u"]["formatted"]) == [("user", "orphan"), ("", "")] and chat.parse(got["w"]["formatted"]) == [("assistant", "x")]
    assert chat.format_branches(messages.where("false")).count() == 0


def test_long_threads_and_reversible_marks(spark):
    rng = random.Random(2)
    bits = ["<|", "|>", "<", "\\", "|", "<\\|", "<|im_end|>", "<|im_start|>", "assistant", "\n", "é😀", "nl", "<|nl|>"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [("long", k, k - 1 if k else None, text(), text(), 0.0) for k in range(300)]
    rows += [(f"c{c}", k, k - 1 if k else None, rng.choice(["assistant", "user", "a\nb", None]), rng.choice([text(), None]), None) for c in range(40) for k in range(rng.randint(1, 6))]
    formatted = chat.format_branches(spark.createDataFrame(rows, MESSAGES).repartition(4))
    texts = {r["tree"]: r for r in formatted.collect()}
    got = {r["tree"]: r for r in chat.digests(formatted).collect()}
    for tree, r in texts.items():
        want = [(x[3] or "", x[4] or "") for x in rows if x[0] == tree]
        assert chat.parse(r["formatted"]) == want
        said = "".join(t for role, t in want if role == "assistant")
        assert (got[tree]["n_turns"], got[tree]["loss_chars"], got[tree]["formatted_chars"]) == (len(want), len(said), len(r["formatted"]))
        assert got[tree]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[tree]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
    assert len(texts) == 41


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _variants(n):
    near = {w: [v for v in n if _one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


@pytest.mark.parametrize("tile", [1024, 6])
def test_variants_by_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 50)
    monkeypatch.setattr(spelling, "HELD", 40)
    rng = random.Random(tile)
    base = ["abcabcabc", "éàüéàüéà", "aaaaaaaaaaaa", "zyxwvut", "prefixed" * 4]
    n = {}
    for _ in range(500):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["a", "é", "", "bc"])
        if len(w := "".join(w)) >= 7:
            n[w] = rng.choice([2, 3, 20, 25, 200, 250, 2600])
    table = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = spelling.variants(table, tile=tile).collect()
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in got) == _variants(n)
    assert spelling.variants(table.where("false")).count() == 0


def test_words_after_the_rule(spark):
    rng = random.Random(7)
    runs = ["".join(rng.choice("abcÀÿ×÷éß") for _ in range(rng.randint(1, 11))) for _ in range(60)]
    rows = [(k if k % 9 else None, rng.choice([None, ""]) if k % 31 == 0 else " 1".join(rng.choices(runs, k=40)) + "ĀABCdefgÉ Ωx") for k in range(150)]
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    got = spelling.words(spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1))).collect()
    assert {r["word"]: r["n"] for r in got} == {w: c for w, c in n.items() if len(w) >= 7 and c >= 2} and "abcdefgÉ" in {r["word"] for r in got}


def _letters(text):
    return Counter(re.findall(rb"[a-z\x80-\xff]+", _ascii_lower(text or "").encode()))


def test_neighbours_by_brute_force(spark):
    """Scores and evidence of op1 from cosines over all words of the examples, in plain Python."""
    rng = random.Random(9)
    common, bad = [f"w{chr(97 + k)}x" for k in range(20)], ["awful", "vile"]
    rows = [(k, " ".join(rng.choices(common, k=rng.randint(3, 40)) + (rng.choices(bad, k=2) if k % 5 == 0 else []))) for k in range(260)]
    rows += [(300, None), (301, "12 -"), (302, "unseen words only"), (303, "vile unseen"), (304, rows[5][1])]
    marked = [(k, int(k % 5 == 0)) for k in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marked, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    counts = {i: _letters(t) for i, t in rows}
    df = Counter(w for c in counts.values() for w in c)
    y = dict(marked)
    n, a = Counter(w for i in y for w in counts[i]), Counter(w for i in y if y[i] for w in counts[i])
    total, pos = len(y), sum(y.values())

    def weight(w):
        gap, below = a[w] * total - n[w] * pos, n[w] * (total - n[w]) * pos * (total - pos)
        chi = gap * gap * total / below if below else 0.0
        return (math.log((1 + len(rows)) / (1 + df[w])) + 1) * chi / (chi + toxicity.RELEVANT)

    def vector(c):
        v = {w: (1 + math.log(k)) * weight(w) for w, k in c.items() if w in n and weight(w) > 0}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    examples = {i: vector(counts[i]) for i in y}
    for i, _ in rows:
        v = vector(counts[i])
        cos = sorted((-sum(x * e.get(w, 0.0) for w, x in v.items()), j) for j, e in examples.items())
        cos = [(-c, j) for c, j in cos if c < 0]
        assert np.allclose([e["cosine"] for e in got[i]["evidence"]], [min(c, 1.0) for c, _ in cos[:3]], atol=1e-9)
        if not v:
            assert got[i]["score"] == model.blank and not got[i]["evidence"]
            continue
        if len(cos) > 15 and cos[14][0] - cos[15][0] < 1e-9:
            continue  # a tie at the border is taken by number
        near = [(1 / (1 - min(c, 1.0) + 0.05), y[j]) for c, j in cos[:15]]
        assert abs(got[i]["score"] - model.probability(sum(w * l for w, l in near) / sum(w for w, _ in near))) < 1e-6
    assert len({r["score"] for r in got.values()}) > 2 and got[303]["score"] > 0.3 > got[301]["score"]
    assert {e["label"] for e in got[303]["evidence"]} == {1}


def test_small_and_one_sided_tables(spark):
    rows = [(k, f"bad{chr(97 + k)} awful thing" if k % 2 else f"nice{chr(97 + k)} day") for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    two = toxicity.score(docs, toxicity.learn(docs, spark.createDataFrame([(k, k % 2) for k in range(24)], "doc_id long, toxic int"))).collect()
    assert min(r["score"] for r in two if r["doc_id"] % 2) > 0.3 > max(r["score"] for r in two if not r["doc_id"] % 2)
    one = toxicity.score(docs, toxicity.learn(docs, spark.createDataFrame([(k, 0) for k in range(24)], "doc_id long, toxic int"))).collect()
    assert all(r["score"] < 0.05 for r in one)
    none = toxicity.score(docs, toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert {r["score"] for r in none} == {0.0}
