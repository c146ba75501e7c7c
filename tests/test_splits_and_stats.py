"""Splits by hash, percentiles, densities and periods against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.hashing import id_split, integer, normal, split_bounds, uniform
from cadenza.operators import lookups, stats
from cadenza.plans import pairs, periods


def test_known_splits(spark):
    ids = [60396676, 60396678, 60396759, 60396710, 60397123, 60397177]
    t = spark.createDataFrame([(i,) for i in ids], "i long").select("i", id_split(F.col("i")).alias("s"))
    got = {r.i: r.s for r in t.collect()}
    assert [got[i] for i in ids] == ["TRAIN"] * 3 + ["TUNE"] * 3


@pytest.mark.parametrize("shares", [(0.1, 0.9), (0.5, 0.5), (0.1, 0.2, 0.3, 0.4)])
@pytest.mark.parametrize("n", [100, 1000])
def test_split_divergence(spark, shares, n):
    splits = {f"s{i}": x for i, x in enumerate(shares)}
    t = spark.range(n).select(id_split(F.col("id"), splits, "test_salt").alias("split"))
    assert stats.split_divergence(t, splits).first().kl < len(shares) / n * 4


def test_split_agrees_with_hashlib(spark):
    bounds = split_bounds({"a": 1, "b": 2})
    want = {i: "a" if int(hashlib.sha1(f"salt{i}".encode()).hexdigest()[:12], 16) <= bounds["a"] else "b" for i in range(200)}
    got = {r.id: r.s for r in spark.range(200).select("id", id_split(F.col("id"), {"a": 1, "b": 2}, "salt").alias("s")).collect()}
    assert got == want


def test_uniforms(spark):
    r = spark.range(5000).select(uniform(1, F.col("id")).alias("u"), normal(1, F.col("id")).alias("z"), integer(10, 1, F.col("id")).alias("k")).agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("z"), F.stddev("z"), F.count_distinct("k")).first()
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.02 and abs(r[3]) < 0.05 and abs(r[4] - 1) < 0.05 and r[5] == 10


def test_percentile_cutoffs(spark):
    values = [float(i) for i in range(100)]
    t = spark.createDataFrame([(v,) for v in values], "value double")
    cuts = stats.percentile_cutoffs(t, 4).first().cutoffs
    assert cuts == pytest.approx([np.percentile(values, 100 * i / 5) for i in range(1, 5)])
    few = spark.createDataFrame([(float(i % 2),) for i in range(50)], "value double")
    assert len(stats.percentile_cutoffs(few, 4).first().cutoffs) == 4


def test_percentiles_of_groups(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=3000).round(1), "b": rng.integers(0, 3, 500).astype(float), "c": np.array([7.5])}
    t = spark.createDataFrame([(k, float(v)) for k, own in values.items() for v in own] + [("d", None)], "k string, v double").repartition(7)
    fractions = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    got = {r.k: r["at"] for r in stats.percentiles(t, fractions, "k", value="v").collect()}
    assert got.keys() == values.keys()
    for k, own in values.items():
        assert got[k] == pytest.approx(np.quantile(own, fractions))
    one = stats.percentiles(t, [0.5], value="v").first()["at"]
    assert one == pytest.approx([np.median(np.concatenate(list(values.values())))])
    assert stats.percentiles(t.limit(0), [0.5], value="v").where("size(at) > 0").count() == 0


def test_positions_are_gapless_beyond_the_range_sample(spark):
    """Range partitions are cut by a sample; positions must not depend on it."""
    n = 1_000_000
    table = spark.range(n).select((F.hash("id") % 500_000).alias("key"), "id", F.col("id").cast("string").alias("extra"), F.lit(1.5).alias("more"))
    placed = lookups.numbered(table, "key", "id")
    r = placed.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.count("*")).first()
    assert tuple(r) == (n, 0, n - 1, n)
    order = placed.where("pos < 1000").orderBy("pos").collect()
    assert [(x.key, x.id) for x in order] == sorted((x.key, x.id) for x in order)
    within = lookups.numbered_within(table.withColumn("g", F.col("id") % 3), "g", "key", "id")
    assert {tuple(x) for x in within.groupBy("g").agg(F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.max("n")).collect()} == {(0, 333334, 0, 333333, 333334), (1, 333333, 0, 333332, 333333), (2, 333333, 0, 333332, 333333)}


def test_mixing_gives_every_draw_once(spark):
    sources = {"a": spark.range(1000).select(F.col("id").alias("object_id")), "b": spark.range(70_000).select((F.col("id") + 10**6).alias("object_id"))}
    r = pairs.mixed(sources, {"a": 1, "b": 3}, 200_000, 3).agg(F.count("*"), F.count_distinct("draw"), F.avg((F.col("source") == "a").cast("int"))).first()
    assert r[0] == r[1] == 200_000 and abs(r[2] - 0.25) < 0.01


def test_histogram_has_unit_area(spark):
    t = spark.createDataFrame([(float(i * i),) for i in range(50)] + [(None,)], "v double")
    h = stats.histogram(t, "v", 10).collect()
    assert sum(r.n for r in h) == 50
    assert sum(r.density * (49 * 49 / 10) for r in h) == pytest.approx(1.0)
    assert stats.histogram(spark.createDataFrame([(1.0,)], "v double"), "v", 5).first().n == 1


def test_density_2d_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=60), rng.normal(size=60)
    b += a
    t = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double")
    got = {(r.ia, r.ib): r.density for r in stats.density_2d(t, "a", "b", 5).collect()}
    cov = np.cov(a, b) * 60 ** (-1 / 3)
    inv, lead = np.linalg.inv(cov), 1 / (60 * 2 * math.pi * math.sqrt(np.linalg.det(cov)))
    for i, x in enumerate(np.linspace(a.min(), a.max(), 5)):
        for j, y in enumerate(np.linspace(b.min(), b.max(), 5)):
            d = np.stack([x - a, y - b])
            assert got[i, j] == pytest.approx(lead * np.exp(-0.5 * np.einsum("in,ij,jn->n", d, inv, d)).sum())


def test_periodogram_finds_the_period_and_fits(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 60, 80))
    rows = []
    for band, base in (("a", 5.0), ("b", -3.0)):
        for i, x in enumerate(t):
            rows.append((1, band, float(x), float(base + 2 * math.sin(2 * math.pi * x / 3.7 + 1) + rng.normal(0, 0.05)), 0.1 + 0.01 * (i % 5)))
    obs = spark.createDataFrame(rows, "object_id long, band string, time double, flux double, flux_err double")
    grid = [*periods.frequency_periods(1.0, 20.0, 60), 3.7]
    powers = periods.periodogram(obs, periods.period_grid(spark, grid))
    assert stats.best_period(powers, "object_id").first().period == pytest.approx(3.7)
    # one power against a weighted least-squares fit
    got = {round(r.period, 9): r.power for r in powers.collect()}
    period = grid[20]
    chi, fit = 0.0, 0.0
    for band in "ab":
        own = [r for r in rows if r[1] == band]
        x, y, w = (np.array(v) for v in ([r[2] for r in own], [r[3] for r in own], [1 / r[4] ** 2 for r in own]))
        design = np.stack([np.ones_like(x), np.cos(2 * math.pi * x / period), np.sin(2 * math.pi * x / period)], 1)
        normal_matrix = (design * w[:, None]).T @ design
        rest = y - design @ np.linalg.solve(normal_matrix, (design * w[:, None]).T @ y)
        zero = (w * (y - np.average(y, weights=w)) ** 2).sum()
        chi += zero
        fit += zero - (w * rest**2).sum()
    assert got[round(period, 9)] == pytest.approx(fit / chi)


def _sinusoid(period: float, object_id: int, seed: int, n: int = 70) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [(object_id, "ab"[i % 2], float(x), float(5 + math.sin(2 * math.pi * x / period + i % 2) + rng.normal(0, 0.02)), 0.1, 1, i) for i, x in enumerate(np.sort(rng.uniform(0, 90, n)))]


def test_periods_of_the_span_are_found_and_refined(spark):
    """Short and long periods; a curve dealt to several groups has the powers of the whole one."""
    truth = {1: 0.324499300710728, 2: 33.3, 3: 2.5}
    rows = [r for o, p in truth.items() for r in _sinusoid(p, o, o)] + [(4, "a", 1.0, 2.0, 0.1, 1, 0)]
    obs = spark.createDataFrame(rows, "object_id long, band string, time double, flux double, flux_err double, detected int, tie long")
    powers = periods.span_periodogram(obs)
    dealt = {(r.object_id, r.period): r.power for r in periods.span_periodogram(obs, chunk=20).collect()}
    got = {(r.object_id, r.period): r.power for r in powers.collect()}
    assert got.keys() == dealt.keys() and all(got[k] == pytest.approx(dealt[k], abs=1e-9) for k in got)
    listed = periods.periodogram(obs.where("object_id = 3"), periods.period_grid(spark, sorted(p for o, p in got if o == 3)[::50]))
    assert all(got[3, r.period] == pytest.approx(r.power, abs=1e-9) for r in listed.collect())
    top = stats.top_periods(powers)
    fine = {r.object_id: r for r in periods.refined(obs, top).where("rank = 1").collect()}
    for o, p in truth.items():
        assert fine[o].period == pytest.approx(p, rel=2e-3)
        assert fine[o].score >= max(v for (i, _), v in got.items() if i == o)
    assert abs(fine[1].period - truth[1]) < 2e-4 and 4 not in fine


def _terms(t, y, err, frequency):
    w, angle = 1 / err**2, 2 * math.pi * t[:, None] * frequency
    c, s = np.cos(angle), np.sin(angle)
    return np.stack([(w[:, None] * v).sum(axis=0) for v in (1 + 0 * c, y[:, None] + 0 * c, c, s, (y**2)[:, None] + 0 * c, c * c, s * s, c * s, y[:, None] * c, y[:, None] * s)])


@pytest.mark.parametrize(("n", "span"), [(3, 20.0), (60, 30.0), (700, 400.0)])
def test_sums_by_transform_equal_sums_of_terms(n, span, monkeypatch):
    """Term by term and by fast transform, in one block of frequencies and in several."""
    rng = np.random.default_rng(n)
    t, y, err = np.sort(rng.uniform(0, span, n)), rng.normal(5, 2, n), rng.uniform(0.1, 0.5, n)
    low, step, count = 1 / span, 1 / (5 * span), 3000
    want = _terms(t, y, err, low + step * np.arange(count))
    for block in (256, 8192):
        monkeypatch.setattr(periods, "FREQUENCIES", block)
        for direct in (0, 10**9):
            got = periods.band_sums(t, y, err, low, step, count, direct)
            assert np.abs(got - want).max() <= 1e-9 * np.abs(want).max()


def test_long_spans_take_little_time_and_memory():
    """300 points over 1,100 days, 55,000 frequencies: by blocks, in well under a second."""
    rng = np.random.default_rng(5)
    t, y, err = np.sort(rng.uniform(0, 1100, 300)), rng.normal(5, 2, 300), rng.uniform(0.1, 0.5, 300)
    n = int((10 - 1 / 1100) * 5 * 1100) + 1
    periods.band_sums(t, y, err, 1 / 1100, 1 / 5500, 100)
    tracemalloc.start()
    begun = time.perf_counter()
    got = periods.band_sums(t, y, err, 1 / 1100, 1 / 5500, n)
    took, peak = time.perf_counter() - begun, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (10, n) and took < 1 and peak < 50e6


def test_blocks_of_a_grid_are_one_grid(spark, monkeypatch):
    obs = spark.createDataFrame(_sinusoid(2.5, 1, 1) + _sinusoid(0.7, 2, 2), "object_id long, band string, time double, flux double, flux_err double, detected int, tie long")
    want = sorted(map(tuple, periods.grid_powers(obs, periods.span_grids(obs)).collect()))
    monkeypatch.setattr(periods, "GRID_BLOCK", 500)
    got = sorted(map(tuple, periods.grid_powers(obs, periods.span_grids(obs)).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(want) > 5000
    assert all(a[3:] == pytest.approx(b[3:], abs=1e-9) for a, b in zip(got, want, strict=True))


def test_flat_curves_have_no_power(spark):
    obs = spark.createDataFrame([(1, "a", float(i), 1.0, 0.1) for i in range(5)], "object_id long, band string, time double, flux double, flux_err double")
    assert periods.periodogram(obs, periods.period_grid(spark, [2.5])).first().power is None


def test_top_periods_are_local_maxima(spark):
    rows = [(1, float(p), s) for p, s in zip(range(1, 8), (0.1, 0.5, 0.2, 0.4, 0.9, 0.3, 0.6), strict=True)]
    got = [(r.rank, r.period) for r in stats.top_periods(spark.createDataFrame(rows, "object_id long, period double, power double")).orderBy("rank").collect()]
    assert got == [(1, 5.0), (2, 7.0), (3, 2.0)]


@pytest.mark.parametrize("block", [7, 64, 65_536])
def test_summits_give_the_same_peaks(spark, monkeypatch, block):
    """tasks give back the rows that the highest peaks follow from, not all powers."""
    monkeypatch.setattr(periods, "GRID_BLOCK", block)
    rng = random.Random(block)
    rows = [(o, rng.choice("ab"), rng.uniform(0, 5), rng.gauss(0, 1), 0.1, i) for o in range(12) for i in range(o * 3)]
    obs = spark.createDataFrame(rows, "object_id long, band string, time double, flux double, flux_err double, tie long")
    every, few = periods.span_periodogram(obs).collect(), periods.span_periodogram(obs, keep=3).collect()
    if block > 1_000:
        assert len(few) * 4 < len(every)
    found = []
    for rows in (every, few):
        powers = spark.createDataFrame(rows, "object_id long, period double, power double")
        found.append([sorted(map(tuple, t.collect())) for t in (stats.top_periods(powers, 3), stats.best_period(powers, "object_id"))])
    assert found[0] == found[1] and len(found[0][0]) > 20


def test_summits_of_any_powers():
    """Also with plateaus, gaps and blocks of a row or two."""
    rng = np.random.default_rng(6)

    def peaks(power):
        at = np.flatnonzero(~np.isnan(power))[::-1]
        own = np.concatenate([[-np.inf], power[at], [-np.inf]])
        top = [(-own[i + 1], j, int(k)) for i, (j, k) in enumerate(enumerate(at)) if own[i + 1] > own[i] and own[i + 1] >= own[i + 2]]
        return [k for _, _, k in sorted(top)[:4]]

    for _ in range(300):
        power = rng.integers(0, 6, rng.integers(1, 60)).astype(float)
        power[rng.random(len(power)) < 0.2] = np.nan
        blocks = np.array_split(np.arange(len(power)), rng.integers(1, 4))
        left = np.full(len(power), np.nan)
        for b in blocks:
            kept = b[periods._summits(power[b], 4)] if len(b) else b
            left[kept] = power[kept]
        assert peaks(left) == peaks(power)
