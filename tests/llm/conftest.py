from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    parts = ["the", "an", "on", "re", "ti", "ou", "ed", "er", "ing", "st", "é", "ß"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    for i in range(9, n, 10):
        words[i] += rng.choice([".", ".\n", ",", "!\n"])
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, shared passages and lines, blanks, nulls and a long text."""
    rng = random.Random(7)
    docs: list[str | None] = [prose(rng, rng.randint(5, 120)) for _ in range(60)]
    passage = prose(rng, 40)
    docs += [docs[3], docs[3], docs[5] + " tail end", docs[10].replace("the", "thx", 1)]
    docs += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(8)]
    docs += [f"{passage} {prose(rng, 5)}", f"{prose(rng, 5)} {passage}"]
    docs += [f"A common footer line.\n{prose(rng, 15)}\n  a COMMON footer line.\r\n" for _ in range(6)]
    docs += [None, "", " ", "\n\n", "one", "one two", "x" * 5000, "\t\x0b\x0c\r\n a  b", "a b c d e " * 30]
    docs += [prose(rng, 6000), "中文 字 " * 20, "a b   c " * 9]
    return [(i, t) for i, t in enumerate(docs)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(i, t, ["en", "fr", None][i % 3], "src0" if i % 3 else "src1", None if t is None else len(t)) for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated ids with equal and with other texts, and columns that clash."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, f"{long}\nthe same long line", "x", 5, True, 9),
        (1, f"{long}\nthe same long line", "x", 5, True, 9),
        (1, "another text\nthe same long line", None, 6, None, None),
        (2, f"{long} phi\nthe same long line", "y", None, False, 1),
        (None, f"{long}\nthe same long line", "z", 7, None, 2),
        (None, None, None, None, None, None),
        (3, None, "n", 0, True, 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, keep string, n_lines long, kept boolean, n_words long")
