"""Spelling variants against comparing every two words, and their defined cases."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import queries, spelling
from cadenza.llm.spelling import BlockIndex, exact_part, near_words, spelling_variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def _pairs(words):
    """Pairs of both searches over one block each, with the rule that leaves no pair twice."""
    out = []
    for way in (0, 1):
        keys = sorted(w[::-1] if way else w for w in words)
        exact = exact_part(np.array([len(k) for k in keys], np.int64), way)
        q, found = BlockIndex(keys).near(keys, exact)
        for i, j in zip(q.tolist(), found.tolist(), strict=True):
            if way == 0:
                out.append((keys[i], keys[j]))
            elif not keys[j].endswith(keys[i][exact[i] :]):
                out.append((keys[i][::-1], keys[j][::-1]))
    return sorted(out)


@given(st.sets(st.text(alphabet="ab", min_size=1, max_size=8), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_pairs_of_two_letters(words):
    assert _pairs(words) == sorted((a, b) for a in words for b in words if brute.one_edit(a, b))


@given(st.sets(st.text(alphabet="aé中😀", min_size=1, max_size=6), min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_pairs_of_any_script(words):
    assert _pairs(words) == sorted((a, b) for a in words for b in words if brute.one_edit(a, b))


def test_many_symbols():
    """More symbols than get a bit vector each."""
    rng = random.Random(2)
    words = {"".join(chr(0x4E00 + rng.randrange(900)) for _ in range(4)) for _ in range(600)}
    words |= {w[:2] + w[3:] for w in list(words)[:100]}
    assert len(BlockIndex(sorted(words)).symbols) > spelling.SYMBOLS
    assert _pairs(words) == sorted((a, b) for a in words for b in words if brute.one_edit(a, b))


def _vocabulary(rng, n):
    parts = ["th", "er", "on", "a", "ti", "é", "in"]
    words = {"".join(rng.choice(parts) for _ in range(rng.randint(3, 7))): rng.randint(1, 9) for _ in range(n)}
    for w in list(words)[::3]:
        at = rng.randrange(len(w))
        words[rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "o" + w[at + 1 :]])] = rng.choice([1, 200, 4000])
    return {w: c for w, c in words.items() if w}


@pytest.mark.parametrize(("block", "foreign"), [(7, 3), (100, 10_000)])
def test_variants_over_small_blocks(spark, monkeypatch, block, foreign):
    """Halves that run over many blocks, and blocks that are copied for their queries."""
    words = _vocabulary(random.Random(block), 500)
    words |= {f"common{x}": 3 for x in ("a", "b", "ab", "ba", "abc", "abd")}
    monkeypatch.setattr(spelling, "near_words", lambda v: near_words(v, block, foreign))
    monkeypatch.setattr(spelling, "SLICE", 16)
    got = spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute.variants(words), key=str)


def test_chains_of_forms(spark):
    words = {"aaaaaaaa": 10**9, "aaaaaaab": 10**7, "aaaaaabb": 10**5, "aaaaabbb": 10**3, "aaaabbbb": 50, "aaabbbbb": 5, "zzzzzzz": 1}
    got = spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.variants(words), key=str)
    assert {r.word: r.root for r in got}["aaabbbbb"] == "aaaaaaaa"


def test_query(spark, corpus, documents, tmp_path):
    rng = random.Random(5)
    extra = [(500 + i, " ".join(rng.choice(["together", "Together", "togethre", "weather,whether", "wéathers", "somewhere-else"]) for _ in range(60))) for i in range(60)]
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in extra], documents.schema).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_spelling(spark, str(tmp_path))
    assert got.columns == COLUMNS and [t for _, t in got.dtypes] == ["string"] * 3 + ["bigint"] * 3
    want = brute.variants(brute.noisy_words(corpus + extra))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] is not None for r in want) > 5


def test_defined_cases(spark, odd, nothing):
    empty = spelling.word_counts(queries.noisy_words(nothing))
    assert spelling_variants(empty).count() == 0
    assert {r.word for r in spelling_variants(spelling.word_counts(queries.noisy_words(odd))).collect()} == {"epsilon", "omicron", "upsilon"}
    rows = [(None, 3, "x"), ("", 4, "x"), ("twice", 20, "x"), ("twice", 30, "y"), ("twices", None, "z"), ("twicer", 5, None)]
    got = spelling_variants(spark.createDataFrame(rows, "word string, n int, form string")).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == [("twice", None, "twice", 50, 2, None), ("twicer", "twice", "twice", 5, 2, 50), ("twices", "twice", "twice", 0, 2, 50)]


def test_very_long_word(spark):
    long = "ab" * 20_000
    rows = [(long, 1), (long[:-1], 50), (long[:9000] + long[9001:], 2), ("a" * 30_000, 1), ("a" * 29_999, 1)]
    got = {r.word: (r.n_near, r.form_n) for r in spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got[long] == (2, 50) and got[long[:-1]] == (1, None) and got["a" * 30_000] == (1, None)
