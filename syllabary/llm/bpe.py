"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words and the ids they encode to are compiled into a minimal acyclic automaton: equal suffixes share states, and
the numbers on a word's arcs add up to its place in a table of id lists.  Words are
counted over all documents; the lexicon is compiled by a task, reaches each executor once
as a file and is mapped into memory there.  Tasks split each distinct run without white
space into words once, and walk all new words of a batch at once;
a word that is not in the lexicon is merged exactly by the vocabulary's merge ranks.  The
lexicon's size therefore only affects speed.

Normalisation and splitting follow the vocabulary file ``word_bpe_49k.json`` (canonical
composition, lower case, words, single digits, runs of symbols, and the two special
strings, which are found before anything else).  None of it looks across white space.

Defined results: null texts are empty texts; an empty text has no ids; repeated rows
get equal results; a null doc_id is kept; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_dir

_SPACES = r"\t-\r \x85\xa0  -     　"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_PLAIN_TEXT = re.compile("[^\x00-\x1b\x20-\x7f\xc0-įı-ɏ]")
_PLAIN_WORDS = re.compile(rf"{_ENDINGS}|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special strings of a vocabulary file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.end: str = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.letters = byte_letters()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: str) -> list[int]:
        """Ids of one word by its merges, lowest rank first."""
        parts = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.end
        rank, never = self.ranks.get, 1 << 30
        order = [rank(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while order and (best := min(order)) < never:
            k = order.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del order[k]
            if k < len(order):
                order[k] = rank((parts[k], parts[k + 1]), never)
            if k:
                order[k - 1] = rank((parts[k - 1], parts[k]), never)
        return [self.ids[p] for p in parts if p in self.ids]

    def encode(self, word: str) -> list[int]:
        return [self.special[word]] if word in self.special else self.merge(word)

    def words(self, text: str) -> list[str]:
        """The words of a text in order; special strings stand as they are."""
        if self.split_special and "<|" in text:
            out: list[str] = []
            for k, part in enumerate(self.split_special.split(text)):
                out += [part] if k % 2 else _words(part)
            return out
        return _words(text)


#: Letters of Unicode 17 (first and last code points), which are symbols to the tokenizer's Unicode 16.
_LATER_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x1C89, 0x1C89), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CB, 0xA7CC), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DA), (0xA7DC, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10D50, 0x10D65), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


#: Capitals newer than Python's tables, and what the vocabulary's lower case makes of them.
_LATER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


@lru_cache(1)
def _slow_words():
    """The word pattern for any text."""
    import regex

    later = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _LATER_LETTERS)
    letters = rf"[\p{{L}}--[{later}]]" if later else r"\p{L}"
    return regex.compile(rf"(?V1){_ENDINGS}|[{letters}]+|[\p{{N}}]|[^{_SPACES}{letters}\p{{N}}]+")


def _words(text: str) -> list[str]:
    if not _PLAIN_TEXT.search(text):
        return _PLAIN_WORDS.findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    low = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
    return _slow_words().findall(low.translate(_LATER_CAPITALS))


#: The arrays of a compiled lexicon, in order.
_ARRAYS = (("root", np.int64), ("keys", np.int64), ("targets", np.int32), ("numbers", np.int32), ("final", np.uint8), ("starts", np.int32), ("ids", np.int32))


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The minimal acyclic transducer of distinct words, as one block of arrays."""
    words = sorted(entries)
    known: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int], ...]] = []  # of each finished state: (byte, next state)
    final: list[bool] = []
    reach: list[int] = []  # words that end in or below a state

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(arcs)
            arcs.append(key[1])
            final.append(node[0])
            reach.append(int(node[0]) + sum(reach[to] for _, to in key[1]))
        return known[key]

    path: list[list] = [[False, []]]  # the open states along the last word

    def close(depth: int, last: bytes) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], finish(node)))

    last = b""
    for word, _ in words:
        shared = len(os.path.commonprefix([word, last]))
        close(shared, last)
        path.extend([False, []] for _ in word[shared:])
        path[-1][0] = True
        last = word
    close(0, last)
    root = finish(path[0])

    keys, targets, numbers = [], [], []
    for state, out in enumerate(arcs):
        before = int(final[state])
        for byte, to in out:
            keys.append(state << 8 | byte)
            targets.append(to)
            numbers.append(before)
            before += reach[to]
    starts = np.concatenate([[0], np.cumsum([len(ids) for _, ids in words])])
    values = ([root], keys, targets, numbers, final, starts, [i for _, ids in words for i in ids])
    arrays = [np.array(v).astype(kind) for v, (_, kind) in zip(values, _ARRAYS, strict=True)]
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Lexicon:
    """A compiled transducer, mapped from a file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = 8 * len(_ARRAYS)
        for (name, kind), n in zip(_ARRAYS, np.frombuffer(mapped, np.int64, len(_ARRAYS)).tolist(), strict=True):
            setattr(self, name, np.frombuffer(mapped, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the id table, or -1."""
        sizes = np.array([len(w) for w in words], np.int64)
        place = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self.keys):
            return place
        data, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        live, state, number = np.arange(len(words)), np.full(len(words), self.root[0]), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            done = sizes[live] == step
            ended = done & (self.final[state] == 1)
            place[live[ended]] = number[ended]
            live, state, number = live[~done], state[~done], number[~done]
            key = state << 8 | data[first[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            live, at = live[found], at[found]
            state, number = self.targets[at].astype(np.int64), number[found] + self.numbers[at]
            step += 1
        return place

    def ids_at(self, place: int) -> list[int]:
        return self.ids[self.starts[place] : self.starts[place + 1]].tolist()


def shipped(spark: SparkSession, content: bytes) -> str:
    """Send a file of the shared folder to all executors, once for each content; returns its name."""
    context = spark.sparkContext
    name = f"syllabary-{hashlib.sha256(content).hexdigest()[:24]}"
    if not any(f.endswith(name) for f in context.listFiles):
        path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(content))
        out.close()
        context.addFile(path.toString())
    return name


@lru_cache(4)
def _vocabulary(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return Vocabulary(f.read())


@lru_cache(4)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


class Encoder:
    """Results for runs without white space and for their words in one task; both memories are emptied when full."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, memory: int = 500_000) -> None:
        self.vocabulary, self.lexicon, self.memory = vocabulary, lexicon, memory
        self.words: dict[str, tuple[str, str]] = {}
        self.text: dict[bytes, str] = {}
        self.shown: dict[bytes, str] = {}

    def _learn_words(self, new: list[str]) -> None:
        names = self.vocabulary.names
        for word, place in zip(new, self.lexicon.places([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True):
            ids = self.lexicon.ids_at(place) if place >= 0 else self.vocabulary.encode(word)
            self.words[word] = " ".join(map(str, ids)), " ".join([names[i] for i in ids])

    def learn(self, runs: set[bytes]) -> None:
        if len(self.text) > self.memory:
            self.text.clear()
            self.shown.clear()
        if len(self.words) > self.memory:
            self.words.clear()
        new = [r for r in runs if r not in self.text]
        split = [self.vocabulary.words(r.decode("utf-8", "surrogatepass")) for r in new]
        self._learn_words([w for w in set(chain.from_iterable(split)) if w not in self.words])
        for run, words in zip(new, split, strict=True):
            if len(words) == 1:
                self.text[run], self.shown[run] = self.words[words[0]]
            else:
                found = [x for x in map(self.words.__getitem__, words) if x[0]]
                self.text[run], self.shown[run] = " ".join([t for t, _ in found]), " ".join([n for _, n in found])

    def encode(self, runs: list[bytes]) -> tuple[int, str, str]:
        """Number of ids, the ids as decimal text, and the decoded text of learnt runs."""
        ids = " ".join(filter(None, map(self.text.__getitem__, runs)))
        return ids.count(" ") + 1 if ids else 0, ids, " ".join(filter(None, map(self.shown.__getitem__, runs)))


def word_counts(docs: DataFrame, vocabulary: str, longest: int = 48) -> DataFrame:
    """``word, n`` over all of ``docs(text)`` for words that occur twice at least and have ``longest`` letters at most.

    ``vocabulary`` is the name of a shipped file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, runs = _vocabulary(vocabulary), Counter()

        def out() -> pa.RecordBatch:
            words: dict[str, int] = {}
            for r, n in runs.items():
                for w in v.words(r.decode("utf-8", "surrogatepass")):
                    words[w] = words.get(w, 0) + n
            runs.clear()
            rows = [(w, n) for w, n in words.items() if len(w) <= longest and w not in v.special]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                runs.update((text or b"").split())
                if len(runs) > 500_000:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


def build_lexicon(docs: DataFrame, vocabulary: str, size: int = 1 << 17) -> bytes:
    """A lexicon of the most frequent words of all documents, ``size`` at most."""
    name = shipped(docs.sparkSession, vocabulary.encode())
    counted = saved(word_counts(docs, name), "word-counts").withColumn("level", F.floor(8 * F.log2("n")).cast("int"))
    least, total = 0, 0
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():  # 512 levels at most
        total += r["count"]
        if total > size:
            least = r["level"] + 1
            break

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.encode(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    def compiled(part: pa.Table) -> pa.Table:  # ``size`` rows at most
        return pa.table({"lexicon": pa.array([compile_lexicon(zip(part.column("word").cast(pa.binary()).to_pylist(), part.column("ids").to_pylist(), strict=True))], pa.binary())})

    entries = counted.where(F.col("level") >= least).select("word").mapInArrow(encode, "word string, ids array<int>")
    found = entries.groupBy(F.lit(0).alias("all")).applyInArrow(compiled, "lexicon binary").first()
    return found["lexicon"] if found else compile_lexicon([])


def read_vocabulary(path: str | None = None) -> str:
    """The vocabulary file's text; ``path`` defaults to the installed ``word_bpe_49k.json``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, vocabulary: str, lexicon: bytes, texts: bool = False) -> DataFrame:
    """Encode each text of ``docs(doc_id, text)`` and decode its ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``texts`` also
    ``ids array<int>`` and ``decoded string``.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if texts else 4]
    given = [shipped(docs.sparkSession, content) for content in (vocabulary.encode(), bytes(lexicon))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(given[0]), _lexicon(given[1]))
        for batch in batches:
            for part in (batch.slice(k, 128) for k in range(0, batch.num_rows, 128)):
                rows = []
                split = [(text or b"").split() for text in part.column(1).cast(pa.binary()).to_pylist()]
                encoder.learn(set().union(*split))
                for i, words in zip(part.column(0).to_pylist(), split, strict=True):
                    n, ids, decoded = encoder.encode(words)
                    sha = hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                    rows.append((i, n, *sha, *([np.array(ids.split(), np.int32), decoded] if texts else [])))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Texts of ``encoded(doc_id, ids array<int>)``: the tokens joined by spaces."""
    name = shipped(encoded.sparkSession, vocabulary.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _vocabulary(name).names
        for batch in batches:
            texts = [" ".join([names[i] for i in ids or () if i in names]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary = read_vocabulary()
    return encode_decode(docs, vocabulary, build_lexicon(docs, vocabulary))
