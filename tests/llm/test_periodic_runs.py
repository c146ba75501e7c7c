"""Periodic runs against trying every period, and their defined cases."""

from __future__ import annotations

import random
import time

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import queries
from cadenza.llm.periodic_runs import find_runs, lag_classes, periodic_runs


def _runs(rows):
    names = {w: i for i, w in enumerate(sorted({w for r in rows for w in r}))}
    code = np.array([names[w] for r in rows for w in r], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return find_runs(code, row, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))


def _want(rows):
    return [(i, *r) for i, words in enumerate(rows) for r in brute.all_runs(words)]


@given(st.lists(st.text(alphabet="ab", max_size=60).map(list), max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_of_two_letters(rows):
    assert list(map(tuple, _runs(rows).tolist())) == _want(rows)


@st.composite
def _periodic(draw):
    words = []
    for _ in range(draw(st.integers(1, 4))):
        unit = draw(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=25))
        words += draw(st.lists(st.sampled_from("abcxyz"), max_size=6)) + (unit * 9)[: draw(st.integers(1, 5 * len(unit) + 4))]
    return words


@given(st.lists(_periodic(), min_size=1, max_size=3))
@settings(max_examples=300, deadline=None)
def test_runs_of_planted_periods(rows):
    assert list(map(tuple, _runs(rows).tolist())) == _want(rows)


def test_classes_leave_no_lag_out():
    lags = [(low, high, k) for low, high, k in lag_classes(4000)]
    assert [x for low, high, _ in lags for x in range(low, high + 1)][:1000] == list(range(1, 1001))
    assert all(2 * high <= k <= max(6 - low, 3 * low) for low, high, k in lags)


def test_one_word_all_along_takes_linear_time():
    code = np.zeros(1_000_000, np.int64)
    begun = time.perf_counter()
    assert find_runs(code, code, np.array([0, len(code)])).tolist() == [[0, 0, 1_000_000, 1]]
    assert time.perf_counter() - begun < 10
    long = np.tile(np.arange(100_000), 5)
    assert find_runs(long, long * 0, np.array([0, len(long)])).tolist() == [[0, 0, 500_000, 100_000]]


def test_query(spark, corpus, documents, tmp_path):
    rng = random.Random(3)
    extra = [(1000 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 300)))) for i in range(150)]
    extra += [(2000, "x " * 3000), (2001, "a b c d e f g\nh " * 40 + "z"), (2002, None)]
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in extra], documents.schema).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    want = brute.periodic_runs(corpus + extra)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 20


def test_defined_cases(spark, odd, nothing):
    assert periodic_runs(nothing).count() == 0
    got = periodic_runs(odd.withColumnRenamed("keep", "runs")).collect()
    assert len(got) == odd.count() and all(r.runs == [] for r in got)
    assert sorted(periodic_runs(odd).columns) == sorted([*odd.columns, "runs", "collapsed"])
    (row,) = periodic_runs(spark.createDataFrame([("a  b\n" * 4 + "c", 7)], "text string, n_words int")).collect()
    assert (row.n_words, row.collapsed, [tuple(r) for r in row.runs]) == (9, "a b c", [(0, 8, 2)])


def test_very_long_text(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(300_000))
    (row,) = periodic_runs(spark.createDataFrame([(text,)], "text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 70_000)] and row.collapsed.count(" ") == 69_999
