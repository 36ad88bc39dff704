"""Small corpora for the operators."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "ru", "sta", "é") for b in ("n", "r", "t", "lo", "mi", "ka", "s")]


def sentence(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages and lines, and the odd cases."""
    r = random.Random(5)
    passage, line = sentence(r, 60), "A line that many of them share."
    texts = [sentence(r, r.choice([3, 20, 120, 400])) for _ in range(60)]
    base = sentence(r, 200).split()
    for i in range(12):
        copy = list(base)
        for _ in range(i):
            copy[r.randrange(200)] = "odd" + str(r.random())
        texts.append(" ".join(copy))
    texts += [f"{sentence(r, 30)}\n{passage}\n{sentence(r, 30)}" for _ in range(8)]
    texts += [f"{line}\n{sentence(r, 5)}\n  {line.upper()} \nshort\n\n" for _ in range(6)]
    texts += [None, "", " \t\n ", "one", "one", "x" * 5000, "a b c d", "日本語 テキスト 🙂", "<|endoftext|> it's", texts[0], texts[0]]
    return [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With an extra column whose name operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(corpus, SCHEMA).repartition(3).withColumn("key", F.lit(1)).withColumn("_gone", F.lit("x"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
