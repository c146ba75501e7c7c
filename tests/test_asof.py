"""Windows around the point nearest to a request, against windows around every point and plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import asof, curves, stats
from cadenza.operators.asof import SIDES, nearest_windows
from cadenza.operators.joins import closest_points, coverage
from cadenza.operators.windows import surroundings
from cadenza.plans import features, pairs

OBS = "object_id long, band string, time double, flux double, flux_err double, detected int, tie long"


def _observations(spark, rng, n):
    """Curves with repeated times, times closer than the bias, and bands without points."""
    times = [0.0, 1.0, 1.0 + 1e-9, 2.5, 2.5, 4.0, 7.0, 7.5]
    rows = []
    for i in range(n):
        t = rng.choice(times) if rng.random() < 0.5 else round(rng.uniform(0, 9), 2)
        rows.append((rng.randrange(6), rng.choice("abc") if rng.random() < 0.9 else "zz", t, rng.gauss(0, 1), 0.1, 1, i))
    return spark.createDataFrame(rows, OBS).repartition(3)


def _by_all_points(obs, asks, n, bands):
    carry = ("time", "flux", *SIDES, "before_padding", "after_padding")
    near = closest_points(surroundings(obs, n), asks, bands, carry)
    empty = F.array_repeat(F.lit(0.0), n)
    return near.select(
        "object_id", "request_time", "band", "label", *(F.coalesce(f"closest_{c}", empty).alias(c) for c in SIDES),
        *(F.coalesce(f"closest_{c}", F.lit(n)).alias(c) for c in ("before_padding", "after_padding")),
        F.col("closest_time").alias("closest_time_in_band"), F.col("closest_flux").alias("closest_flux_in_band"), "closest_time_diff",
    )


def _rows(table):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in table.collect())


@pytest.mark.parametrize(("n", "rows", "batch"), [(1, 150, 10), (3, 300, 50_000), (6, 80, 25)])
def test_windows_equal_those_around_every_point(spark, monkeypatch, n, rows, batch):
    rng = random.Random(rows)
    monkeypatch.setattr(asof, "BATCH_ROWS", batch)
    monkeypatch.setattr(asof, "ASKS", 7)
    obs = _observations(spark, rng, rows)
    asks = spark.createDataFrame([(rng.randrange(8), rng.choice([0.0, 1.0, 2.5, 3.25, 9.5, round(rng.uniform(-1, 10), 2)]), f"x{i}") for i in range(60)], "object_id long, request_time double, label string")
    bands = ["c", "a", "b"]
    got = nearest_windows(obs, asks, n, bands)
    want = _by_all_points(obs, asks, n, bands)
    as_text = lambda t: _rows(t.select(*want.columns).withColumns({c: F.col(c).cast("string") for c in ("closest_time_in_band", "closest_flux_in_band", "closest_time_diff")}).fillna("none"))
    assert as_text(got) == as_text(want) and got.count() == 180


def test_other_keys_and_columns(spark):
    points = spark.createDataFrame([(1, "left", "a", 1.0, 5.0, 0), (1, "left", "a", 2.0, 6.0, 1), (1, "right", "a", 1.5, 7.0, 0), (None, "left", "a", 9.0, 9.0, 3)], "pair_id long, side string, band string, time double, flux double, tie long")
    asks = spark.createDataFrame([(1, "left", 1.9, [1, 2]), (1, "right", 0.0, None), (2, "left", 0.0, []), (None, "left", 8.0, None), (1, "left", None, [3])], "pair_id long, side string, request_time double, more array<int>")
    got = {(r.pair_id, r.side): r for r in nearest_windows(points, asks, 2, ["a", "b"], keys=("pair_id", "side")).where("band = 'a'").collect()}
    assert len(got) == 4
    one = got[1, "left"]
    assert (one.closest_flux_in_band, one.before_flux, one.before_padding, one.after_padding, one.more) == (6.0, [0.0, 5.0], 1, 2, [1, 2])
    assert got[1, "right"].closest_time_diff == 1.5 and got[None, "left"].closest_flux_in_band == 9.0
    assert got[2, "left"].closest_time_in_band is None and got[2, "left"].before_flux == [0.0, 0.0]


def test_nothing(spark):
    obs = _observations(spark, random.Random(0), 30)
    asks = spark.createDataFrame([], "object_id long, request_time double")
    assert nearest_windows(obs, asks, 2, ["a"]).count() == 0
    one = spark.createDataFrame([(1, 2.0)], asks.schema)
    assert [r.before_padding for r in nearest_windows(obs.limit(0), one, 2, ["a"]).collect()] == [2]


def test_curves_are_not_copied_for_pairs(spark):
    """Points enter one shuffle, keyed by object, and join no pairs before it."""
    rng = random.Random(4)
    obs = _observations(spark, rng, 60)
    meta = spark.createDataFrame([(i, i % 3) for i in range(6)], "object_id long, target int")
    made = pairs.negative_features(obs, meta, 5, 2, ["a", "b"], 1)
    assert {r.pair_id for r in made.collect()} == set(range(5)) and made.count() == 5 * 2 * 2
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Union")]
    assert "Join" not in top and "MapInArrow" in top


def own_curves(spark, n=400):
    rng = random.Random(5)
    bands = ["a", "b", "other", None]
    rows = [(rng.randrange(12), rng.choice(bands), round(rng.uniform(0, 9), 1), rng.choice([rng.uniform(0, 5), 1.0, None]), i) for i in range(n)]
    return spark.createDataFrame([*rows, (3, "a", None, 1.0, n)], "object_id long, band string, time double, flux double, tie long")


def test_own_windows_are_those_of_a_table_of_requests_and_need_one_shuffle(spark):
    obs = own_curves(spark)
    asks = obs.select("object_id", F.col("time").alias("request_time")).distinct()
    got, wanted = features.point_features(obs, 2, ["b", "a", "none"]), nearest_windows(obs, asks, 2, ["b", "a", "none"])
    assert got.columns == wanted.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    again = features.point_features(obs, 2, ["b", "a", "none"])
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_cutoffs_learned_in_the_tasks_are_those_of_the_values(spark):
    """the values don't go back to Spark before they are counted."""
    obs = own_curves(spark).where("flux is not null")
    for padding in (True, False):
        values = features.layer_values(features.window_columns(features.point_features(obs, 2, ["a", "b"]), 2, 1.5), padding)
        wanted = stats.percentile_cutoffs(values, 3, "band", "column")
        got = features.learn_cutoffs(obs, 2, ["a", "b"], 3, 1.5, padding)
        assert sorted(map(repr, got.select("band", "column", "cutoffs").collect())) == sorted(map(repr, wanted.collect()))
        plan = features.Made(features.own_points(obs), features._own_values(2, ["a", "b"], 1.5, padding), "band string, column string, value array<double>").table()
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_bins_made_with_the_windows(spark):
    """the same cells as of the feature table."""
    rows = [(b, c, s, [-x, x]) for b in "ab" for c, s, x in (("dflux_dt", 2.0, 1.0), ("dflux", 0.0, 0.5), ("dtime", 4.0, 2.0))]
    cut, obs = spark.createDataFrame(rows, "band string, column string, median_scale double, cutoffs array<double>"), own_curves(spark)
    cells = lambda t: {(r.object_id, r.band, r.request_time): [None if x is None else round(x, 9) for s in r.binned for c in s for x in c] for r in t.collect()}
    got = cells(features.point_bins(obs, cut, 2, ["a", "b", "uncut"], 1.5))
    wanted = cells(features.binned_features(features.point_features(obs, 2, ["a", "b", "uncut"]), cut, 2, 1.5))
    assert list(map(repr, sorted(got.items()))) == list(map(repr, sorted(wanted.items())))


def test_windows_are_dealt_by_the_number_of_points(spark, monkeypatch):
    """F8: a task's share of the points doesn't grow with the table; what it gives is the same."""
    obs = _observations(spark, random.Random(8), 300)
    whole = _rows(surroundings(obs, 2).drop("flux_err", "detected"))
    monkeypatch.setattr(curves, "TASK_ROWS", 10)
    cut = surroundings(obs, 2).drop("flux_err", "detected")
    assert cut.rdd.getNumPartitions() >= 30
    assert _rows(cut) == whole


def test_nearest_points_are_dealt_by_the_number_of_points(spark, monkeypatch):
    """likewise points and requests."""
    obs = _observations(spark, random.Random(9), 300)
    whole = _rows(coverage(obs, [0.5, 2.0]))
    monkeypatch.setattr(curves, "TASK_ROWS", 10)
    asks = obs.select("object_id", F.col("time").alias("request_time")).distinct()
    assert closest_points(obs, asks, carry=("time",)).rdd.getNumPartitions() >= 30
    assert _rows(coverage(obs, [0.5, 2.0])) == whole
