import hashlib
import os
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from syllabary.llm import bpe, language_id, mixing, quality, sharding, toxicity, webp
from syllabary.llm.common import remainder

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_language_held_out(spark, tables):
    docs, _ = tables
    held = remainder(F.col("doc_id"), 4) == 2
    found = language_id.classify(docs, language_id.learn(docs.where(~held))).join(docs.where(held & F.col("lang").isNotNull()).select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !")], "doc_id long, text string")
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in language_id.classify(odd, {"en": b"the "}).collect()} == {("und", 0.0, True)}
    assert language_id.learn(docs.where("false")) == {}


def test_language_of_copies_and_many_languages(spark):
    word = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    copied = spark.range(20_000).select(F.concat(F.lit("text "), F.translate((F.col("id") % 40).cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("copied").alias("lang"))
    rare = spark.createDataFrame([(f"word {word(k)}", f"l{k}") for k in range(80)], "text string, lang string")
    found = language_id.learn(copied.unionByName(rare))
    assert set(found) == {"copied"} | {f"l{k}" for k in range(80)}
    assert {w for w in found["copied"].decode().split() if w != "text"} == {word(k) for k in range(40)}


def test_other_numbers_are_no_letters(spark):
    rows = spark.createDataFrame([(1, "\u00bd\u00b2"), (2, "\u2167"), (3, "the \u00bd")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.classify(rows, {"en": b"the "}).orderBy("doc_id").collect()] == ["und", "und", "en"]


def test_equal_dictionaries_tie_and_are_rejected(spark):
    rows = spark.createDataFrame([(1, "same words"), (1, "same words")], "doc_id long, text string")
    got = language_id.classify(rows, {"b": b"same words ", "a": b"same words "}).collect()
    assert [(r["lang_pred"], r["margin"], r["rejected"]) for r in got] == [("a", 0, True)] * 2


def test_quality_held_out(tables):
    docs, labels = tables
    held = remainder(F.col("doc_id"), 3) == 1
    rules = quality.learn(docs.where(~held), labels.where(~held), "quality")
    got = quality.with_statistics(docs.where(held)).select("doc_id", rules.score().alias("s")).join(labels, "doc_id")
    assert got.agg(F.avg(((F.col("s") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.9
    assert quality.fit(quality.with_statistics(docs.where("false")).withColumn("label", F.lit(1))).weighted == ()


def test_toxicity_held_out_and_index(spark, tables):
    docs, labels = tables
    held = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.learn(docs.where(~held), labels.where(~held), corpus=docs)
    got = toxicity.score(docs, model).join(labels.where(held), "doc_id").toPandas()
    assert got.score[got.toxic == 1].mean() > got.score[got.toxic == 0].mean() + 0.4
    rng = np.random.default_rng(1)
    dense = rng.random((300, 20)) * (rng.random((300, 20)) < 0.3)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    row, term = np.nonzero(dense)
    index = toxicity.Index(300, 20, row, term, dense[row, term], np.zeros(300))
    for k in range(50):
        t = np.flatnonzero(dense[k])
        ids, cos = index.nearest(t, dense[k][t], 9)
        exact = np.sort(dense @ dense[k])[::-1][:9]
        assert np.allclose(cos, np.minimum(exact[exact > 0], 1.0)) and np.allclose((dense @ dense[k])[ids], cos)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {r["score"] for r in toxicity.score(odd, model).collect()} == {model.blank}


def test_bpe_equals_library(spark, tables):
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["Hello WORLD's\x1cfoo\x85 ΣΑΣ İx ½ ²3 ٣ _a_b don't I'LL <|endoftext|>abc é 你好 emoji😀😀 a\0b", "", " ", "'ve'S<|startoftext|>", "x" * 300, None]
    rows = odd + [r["text"] for r in tables[0].limit(60).collect()]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    vocabulary = bpe.read_vocabulary()
    got = {r["doc_id"]: r for r in bpe.encode_decode(frame, vocabulary, bpe.build_lexicon(frame, vocabulary, size=500), texts=True).collect()}
    for k, text in enumerate(rows):
        e = library.encode(text or "", add_special_tokens=False)
        assert got[k]["ids"] == e.ids and got[k]["decoded"] == library.decode(e.ids, skip_special_tokens=False)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()


def test_bpe_lower_case_of_every_code_point():
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    changed = library.normalizer
    odd = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c in bpe._LATER_CAPITALS or chr(c).lower() != chr(c))]
    for c in odd:
        text = unicodedata.normalize("NFC", f"a{chr(c)}b")
        low = "".join(x.lower() for x in text).translate(bpe._LATER_CAPITALS)
        assert changed.normalize_str(text) == low, hex(c)
    encoder = bpe.read_vocabulary()
    for c in bpe._LATER_CAPITALS:
        assert "".join(bpe._words(f"a{chr(c)}b")) == changed.normalize_str(f"a{chr(c)}b") and encoder


def test_shards(spark, docs):
    docs = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 50_000)  # one longer than a shard cannot be balanced
    rows = sharding.metadata(docs)
    placed = sharding.number_slots(sharding.assign(rows, shards=3)).toPandas()
    assert len(placed) == docs.count() and set(placed["shard"]) == {0, 1, 2}
    for _, part in placed.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.assign(sharding.metadata(docs.where("false")), shards=8).count() == 0
    even = spark.createDataFrame([(k, "same text") for k in range(800)], "doc_id long, text string")
    sizes = sharding.assign(sharding.metadata(even), shards=8).groupBy("shard").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 4  # one group larger than a shard is cut by doc_id


def test_mixing_meets_targets(tables):
    docs, labels = tables
    got = mixing.mix(docs, labels)
    sums = got.agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * F.col("rate") * F.col("posterior")[k]).alias(d) for k, d in enumerate(mixing.TARGETS)]).first()
    assert all(abs(sums[d] / sums["t"] - w) < 0.03 for d, w in mixing.TARGETS.items())
    assert got.where("rate < 0").count() == 0


def _fitted(spark, rows, weights):
    got = mixing.fit_rates(spark.createDataFrame(rows, "tokens long, posterior array<double>"), weights).collect()
    t, p, r = (np.array([x[c] for x in got], float) for c in ("tokens", "posterior", "rate"))
    gap = (t * r) @ p - np.array(weights) / sum(weights) * t.sum()
    slope = p @ gap / max(t.sum(), 1)  # at the least squares 0 where a rate is positive, and not negative where it is 0
    return r, np.abs(gap).max() / max(t.sum(), 1), np.abs(np.where(r > 0, slope, np.minimum(slope, 0)))[t > 0].max(initial=0), {x["settled"] for x in got}


def test_rates_are_least_squares(spark):
    rate, _, _, settled = _fitted(spark, [(10, [0.6, 0.4])], [0.1, 0.9])
    assert abs(rate[0] - 0.42 / 0.52) < 1e-6 and settled == {True}
    rng = np.random.default_rng(0)
    rows = [(int(t), p.tolist()) for t, p in zip(rng.integers(0, 500, 200), rng.dirichlet([8, 0.3, 0.5], 200), strict=True)]
    rate, gap, slope, settled = _fitted(spark, rows, [0.9, 0.02, 0.08])
    assert gap <= 1e-4 and settled == {True} and (rate >= 0).all() and set(rate[[t == 0 for t, _ in rows]]) <= {1.0}
    _, gap, slope, settled = _fitted(spark, rows, [0.01, 0.01, 0.98])  # cannot be met
    assert gap > 0.1 and slope < 1e-4 and settled == {True}
    assert mixing.fit_rates(spark.createDataFrame([], "tokens long, posterior array<double>"), [0.5, 0.5]).count() == 0


def test_webp_round_trip(tables):
    texts = [r["text"] for r in tables[0].limit(40).collect()] + ["a" * 9000, "ab" * 40, "".join(map(chr, range(1, 128))) * 3, "x" * 70 + "abcdefghijklm" * 400]
    for payload in [webp.padded(os.urandom(n))[1] for n in (0, 1, 63, 64, 65, 5000, 1_200_000)] + [webp.padded(t)[1] for t in texts]:
        assert webp.payload_of(webp.encode(payload)) == payload
    assert all(len(webp.encode(webp.padded(t)[1])) < 0.8 * len(t) for t in texts if len(t) > 1000)


def _pictures():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 256, (9, 13, 4), dtype=np.uint8)
    noise[3:7] = noise[2]  # rows that repeat
    yield noise, [], 0
    yield np.tile(noise[:3], (4, 3, 1)), [], 6  # back-references and a colour cache
    yield noise, [(webp.GREEN,)], 0
    for colours in (1, 2, 3, 5, 17):
        yield noise.reshape(-1, 4)[:colours][rng.integers(0, colours, (9, 13))], [(webp.PALETTE,)], 0
    for mode in range(14):
        yield noise, [(webp.PREDICTOR, 2, np.full((3, 4), mode))], 0
    yield noise, [(webp.CROSS, 2, rng.integers(-128, 128, (3, 4, 3)))], 0
    yield noise, [(webp.PREDICTOR, 2, rng.integers(0, 14, (3, 4))), (webp.CROSS, 3, rng.integers(-128, 128, (2, 2, 3))), (webp.GREEN,)], 7


def test_webp_pictures():
    for pixels, transforms, cache_bits in _pictures():
        for repeats in (True, False):
            assert (webp.decode(webp.encode_image(pixels, transforms, cache_bits, repeats)) == pixels).all()


def test_webp_predictors_by_hand():
    left, top, over, corner = (np.array([v] * 4) for v in (10, 40, 90, 20))
    want = [None, 10, 40, 90, 20, 45, 15, 25, 30, 65, 40, 40, 30, 27]  # 10: average of 15 and 65; 13: 25 and half of 25 - 20
    assert [int(webp._predicted(m, left, top, over, corner)[0]) for m in range(1, 14)] == want[1:]
    assert webp._predicted(0, left, top, over, corner).tolist() == [255, 0, 0, 0]
    pixel = np.array([0xFF000000 | 200 << 16 | 100 << 8 | 50], np.uint32)
    turned = webp._uncross(pixel, 1, 1, 2, np.array([0xFF000000 | 32 << 16 | 0 << 8 | 32], np.uint32))  # green to red 1, green to blue 0, red to blue 1
    assert int(turned[0]) == 0xFF000000 | (200 + 100 & 255) << 16 | 100 << 8 | (50 + (200 + 100 & 255)) & 255


class _Stream:
    """Writes small lossless streams with simple codes, to test the decoder's other parts."""

    def __init__(self, width, height):
        self.w = webp._Writer()
        for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            self.w.put(value, bits)

    def put(self, *pairs):
        for value, bits in pairs:
            self.w.put(value, bits)
        return self

    def code(self, *symbols):
        """A simple prefix code of one or two symbols."""
        self.put((1, 1), (len(symbols) - 1, 1), (1, 1), (symbols[0], 8))
        return self.put(*[(s, 8) for s in symbols[1:]])

    def pixels(self):
        argb, width, height = webp.decode_stream(self.w.bytes())
        return [(int(x) >> 16 & 255, int(x) >> 8 & 255, int(x) & 255, int(x) >> 24) for x in argb]


def test_webp_transforms():
    plain = lambda s, green, red=(0,), blue=(0,): s.code(*green).code(*red).code(*blue).code(255).code(0)
    s = _Stream(2, 1).put((1, 1), (2, 2), (0, 1), (0, 1), (0, 1))  # subtract green
    assert plain(s, (10, 20), (5,), (250,)).put((0, 1), (1, 1)).pixels() == [(15, 10, 4, 255), (25, 20, 14, 255)]
    s = _Stream(4, 1).put((1, 1), (3, 2), (1, 8), (0, 1))  # a palette of two colours, eight pixels a byte
    s = s.code(7, 9).code(1).code(2).code(0).code(0).put((0, 1), (1, 1), (0, 1), (0, 1), (0, 1))
    assert plain(s, (0b0110,)).pixels() == [(1, 7, 2, 0), (2, 16, 4, 0), (2, 16, 4, 0), (1, 7, 2, 0)]
    s = _Stream(3, 1).put((1, 1), (0, 2), (0, 3), (0, 1)).code(1).code(0).code(0).code(0).code(0).put((0, 1), (0, 1), (0, 1))  # predictor: left
    assert s.code(3).code(0).code(0).code(0).code(0).pixels() == [(0, 3, 0, 255), (0, 6, 0, 255), (0, 9, 0, 255)]


def test_empty_and_null_media(spark):
    rows = webp.media_table(spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0][1:] == rows[1][1:] and (rows[0]["n_bytes"], rows[0]["payload_bytes"]) == (0, 64)
    assert bytes(webp.payload_of(bytes(rows[2]["media"]))) == b"abc" + b"\0" * 61
