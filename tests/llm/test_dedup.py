import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from syllabary.llm import embedding_dedup, graph, jaccard, substrings


def _sets(corpus):
    out = {}
    for i, t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def _components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("space_bytes", [64 << 20, 3000])
def test_jaccard_groups_equal_brute_force(spark, docs, corpus, space_bytes):
    sets = _sets(corpus)
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _components(ids, linked)
    got = jaccard.near_groups(docs, space_bytes=space_bytes, pivots=3).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), want[i]) for i in ids}


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["component_id"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 130), 100)}


def test_substrings_equal_brute_force(spark, docs, corpus):
    first, want = {}, set()
    for i, t in sorted(corpus):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        want.add((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    got = substrings.remove_repeats(docs, texts=True).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    assert sum(r["n_removed"] for r in got) > 0 and all(bool(r["spans"]) == (r["n_removed"] > 0) for r in got)


def _turned(n):
    """The Thue-Morse word of 2^n letters, and its complement."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_ids_that_share_a_divisor(spark, docs, corpus):
    """Ids that count by a thousand spread over all shares, and give the same results."""
    rows = [substrings._by_part(np.arange(0, 5_000_000, 1000), np.zeros(5000, np.int32), 8)]
    assert sorted(p for part in rows for p, _ in part) == list(range(8))
    want = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    wide = substrings.remove_repeats(docs.withColumn("doc_id", F.col("doc_id") * 1000))
    assert {r["doc_id"] // 1000: r["n_removed"] for r in wide.collect()} == want


def test_words_that_polynomial_hashes_confuse(spark):
    one, other = _turned(11)
    line = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join([*line, one, *line[::-1]])), (2, " ".join(["x", *line[:30], other, *line[30:]])), (3, one), (4, other)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(frame).collect()} == {k: k for k in range(1, 5)}
    assert {r["n_removed"] for r in substrings.remove_repeats(frame).collect()} == {0}


def test_jaccard_of_repeated_ids_null_ids_and_empty_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (2, a + " x"), (5, b), (2, b), (7, b), (None, a), (8, ""), (9, None), (1, a)]
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr)
    assert found == sorted([(1, 36, 1), (1, 36, 1), (2, 37, 1), (2, 36, 1), (5, 36, 1), (7, 36, 1), (None, 36, None), (8, 0, 8), (9, 0, 9)], key=repr)


def test_spaces_are_joined_by_pivots_and_cells():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):  # chains of neighbours, so that cells overlap
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        for _ in range(12):
            base = base.copy()
            base[rng.integers(0, 60, 4)] = rng.integers(0, 2**63, 4, dtype=np.uint64)
            sets.append(np.unique(base))
    linked = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))]
    want = _components(range(len(sets)), linked)
    for leaf, pivots in ((2, 3), (8, 4), (200, 4)):
        space = jaccard.Sets(np.arange(len(sets)), [x.tobytes() for x in sets], 75)
        assert dict(zip(space.ids.tolist(), space.join(leaf, pivots).tolist(), strict=True)) == want
    space = jaccard.Sets(np.arange(len(sets)), [x.tobytes() for x in sets], 75)
    space.join()
    assert space.united["pivots"] > space.united["pairs"] and sum(space.united.values()) == len(sets) - len(set(want.values()))
    for few in (2, 3, 7):  # small spaces take the same way
        space = jaccard.Sets(np.arange(few), [x.tobytes() for x in sets[:few]], 75)
        assert dict(zip(space.ids.tolist(), space.join().tolist(), strict=True)) == _components(range(few), [(i, j) for i, j in linked if max(i, j) < few])
    points = rng.random((200, 2)) * 1.2
    distance = np.linalg.norm(points[:, None] - points[None, :6], axis=2)
    cells = jaccard.voronoi(distance, 0.25)
    near = np.linalg.norm(points[:, None] - points[None], axis=2) <= 0.25
    assert (sum(np.outer(c, c) for c in cells) > 0)[near].all()


def test_prefixes_of_a_frequent_line(spark, docs):
    rng = np.random.default_rng(9)
    lines = [" ".join(f"line{line}w{k}" for k in range(20)) for line in range(12)]
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    frame = spark.createDataFrame([(i, words(45) + " " + " ".join(lines) + " " + words(45)) for i in range(150)], "doc_id long, text string")
    candidates, windows, marks = substrings._candidates(frame, 50)
    assert windows > 10_000
    for most, long in ((10**9, False), (200, True)):
        heavy = substrings._heavy_prefixes(candidates, 50, marks, 1 << 12, most)
        assert any(len(x) for x in heavy) == long  # a frequent beginning is split by longer prefixes
    for given in (docs, frame):
        one, other = (sorted(map(repr, substrings.remove_repeats(given, texts=True, group_rows=n).collect())) for n in (2_000_000, 80))
        assert one == other


def test_substrings_without_a_broadcast_and_with_shared_ids(spark, docs, monkeypatch):
    want = sorted(map(repr, substrings.remove_repeats(docs, texts=True).collect()))
    monkeypatch.setattr(substrings, "BROADCAST_ANCHORS", 0)
    assert sorted(map(repr, substrings.remove_repeats(docs, texts=True).collect())) == want
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(1, "one " + passage), (2, "two three"), (2, "four " + passage + " five"), (None, passage), (2, "two three")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
    assert sorted(((r["doc_id"], r["kept_text"]) for r in got), key=repr) == sorted([(1, "one " + passage), (2, "two three"), (2, "four five"), (None, passage), (2, "two three")], key=repr)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 16))
    v[100:160] = v[:60] + 0.05 * rng.standard_normal((60, 16))
    v[160:170] = v[5]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [None] + [1.0] * 15)]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    comp = _components(range(304), list(zip(i.tolist(), j.tolist(), strict=True)))
    links = np.bincount(np.concatenate([i, j]), minlength=304)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf_rows=32).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(k, int(links[k]), comp[k], comp[k] == k) for k in range(304)}


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, [1.0, 0.0]), (1, None), (2, [0.0, 1.0])], [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True)]),
        ([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [5.0, 5.0])], [(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (3, 0, 3, True)]),
        ([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [0.0, 1.0])], [(None, 1, 4, True), (4, 1, 4, True), (None, 0, None, True)]),
        ([(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 0.0]), (4, [2e200, 0.0])], [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False)]),
        ([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, []), (6, [0.0, -0.0])], [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True)]),
    ],
)
def test_odd_vectors(spark, rows, want):
    got = [tuple(r) for r in embedding_dedup.near_duplicates(_vectors(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_links_of_a_tight_group_in_blocks(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.standard_normal(32) + 0.1 * rng.standard_normal((200, 32)), rng.standard_normal((100, 32))])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(_vectors(spark, list(enumerate(v.tolist()))), leaf_rows=16).collect()}
    assert all(got[k] <= links[k] for k in range(300)) and sum(got.values()) >= 0.99 * links.sum()


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert jaccard.near_groups(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
