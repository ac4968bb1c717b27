import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, shared passages, nulls, blanks, ties and a very long text."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, base = text(70), text(120).split()
    rows = [text(rng.randint(1, 200)) for _ in range(60)]
    rows += [text(30) + " " + passage + " " + text(20) for _ in range(6)] + [rows[3]] * 5
    for k in range(12):
        words = list(base)
        for _ in range(k):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(9)
        rows.append(" ".join(words))
    rows += [None, "", "  \n\t ", "one two", "ONE  two", "a", "é ü\tÉ", text(30_000), "word " * 400]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in corpus], "doc_id long, text string, n string, rep string")
