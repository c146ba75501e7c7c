"""Percentiles by narrowing against sorted lists."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.operators import ranks, stats
from cadenza.operators.ranks import as_doubles, in_order, narrowed_percentiles

FRACTIONS = [0.0, 0.013, 0.25, 1 / 3, 0.5, 0.51, 0.9, 0.999, 1.0]


def _want(values, fractions):
    own = sorted(values, key=lambda v: (math.isnan(v), v))
    out = []
    for q in fractions:
        h = q * (len(own) - 1)
        low, high = math.floor(h), math.ceil(h)
        out.append(own[low] if low == high else (high - h) * own[low] + (h - low) * own[high])
    return out


def _same(a, b):
    return len(a) == len(b) and all((math.isnan(x) and math.isnan(y)) or x == y for x, y in zip(a, b, strict=True))


@given(st.lists(st.floats(), min_size=1))
@settings(max_examples=300, deadline=None)
def test_order_of_doubles(values):
    keys = in_order(np.array(values))
    back = as_doubles(keys[np.argsort(keys, kind="stable")])
    assert _same(back.tolist(), sorted((v + 0.0 for v in values), key=lambda v: (math.isnan(v), v)))


def _values(rng, kind, n):
    if kind == "ties":
        return [rng.choice([0.0, -0.0, 0.0, 1.5, -2.0]) for _ in range(n)]
    if kind == "wide":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(n)]
    if kind == "close":
        return [1.0 + rng.randrange(1000) * 2**-52 for _ in range(n)]
    if kind == "odd":
        return [rng.choice([math.inf, -math.inf, math.nan, 0.0, 5e-324, rng.gauss(0, 1)]) for _ in range(n)]
    return [rng.gauss(0, 3) for _ in range(n)]


@pytest.mark.parametrize(("cells", "single"), [(1 << 20, 1 << 18), (1 << 20, 20), (700, 0)])
def test_percentiles_of_groups(spark, monkeypatch, cells, single):
    """Ties, values of all sizes, values that differ in their last bits; in one pass and in many."""
    rng = random.Random(cells + single)
    monkeypatch.setattr(ranks, "HELD", 100)
    groups = {(kind, i): _values(rng, kind, rng.choice([1, 2, 40, 400])) for kind in ("ties", "wide", "close", "odd", "plain", None) for i in (1, None)}
    if cells < 1000:
        groups = {k: v for k, v in groups.items() if k[0] in ("ties", "close")}
    rows = [(*k, v) for k, own in groups.items() for v in own] + [("ties", 1, None), ("none", 1, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "kind string, i int, value double").repartition(4)
    got = {(r.kind, r.i): r["at"] for r in narrowed_percentiles(table, FRACTIONS, "kind", "i", cells=cells, single=single).collect()}
    assert got.keys() == groups.keys()
    assert all(_same(got[k], _want(own, FRACTIONS)) for k, own in groups.items())


def test_arrays_and_ranges_give_the_same(spark):
    rng = random.Random(5)
    lists = [(rng.choice("ab"), [rng.choice([None, 0.0, rng.gauss(0, 1)]) for _ in range(rng.randint(0, 9))]) for _ in range(200)] + [("a", None)]
    table = spark.createDataFrame(lists, "k string, value array<double>").repartition(3)
    flat = {k: [v for g, own in lists if g == k for v in own or () if v is not None] for k in "ab"}
    one, two = stats.percentiles(table, FRACTIONS, "k"), stats.percentiles_by_ranges(table.select("k", F.explode("value").alias("value")), FRACTIONS, "k")
    for found in (one, two):
        assert {r.k: r["at"] for r in found.collect()} == {k: _want(own, FRACTIONS) for k, own in flat.items()}
    whole = stats.percentiles(table.select("value"), [0.5]).collect()
    assert [r["at"] for r in whole] == [_want(flat["a"] + flat["b"], [0.5])]


def test_too_many_groups_go_by_ranges(spark, monkeypatch):
    table = spark.range(3000).select((F.col("id") % 500).alias("g"), F.col("id").cast("double").alias("value"))
    assert narrowed_percentiles(table, [0.5], "g", cells=400) is None
    monkeypatch.setattr(stats, "narrowed_percentiles", lambda *a, **b: None)
    got = {r.g: r["at"] for r in stats.percentiles(table, [0.5], "g").collect()}
    assert got == {g: [_want([float(g + 500 * i) for i in range(6)], [0.5])[0]] for g in range(500)}


def test_nothing(spark):
    assert stats.percentiles(spark.createDataFrame([], "g int, value double"), [0.5], "g").count() == 0
