"""Known values of curve operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import columns as C
from cadenza.operators import curves, joins, lookups, stats, windows
from cadenza.plans import align, features, pairs

OBS = "object_id long, band string, time double, flux double, flux_err double, detected int, tie long"


@pytest.fixture
def two_points(spark):
    return spark.createDataFrame([(1, "b", 2.0, 5.0, 1.0, 1, 0), (1, "b", 3.0, 6.0, 1.0, 1, 1)], OBS)


@pytest.mark.parametrize(("at", "before", "after"), [(1.5, [], [5, 6]), (2.5, [5], [6]), (3.5, [5, 6], [])])
def test_before_and_after(two_points, at, before, after):
    assert [r.flux for r in curves.before_time(two_points, at).orderBy("time").collect()] == before
    assert [r.flux for r in curves.after_time(two_points, at).orderBy("time").collect()] == after


def test_closest_point(spark, two_points):
    asks = spark.createDataFrame([(1, 2.1), (1, 2.7), (1, 2.5)], "object_id long, request_time double")
    got = {r.request_time: (r.closest_time, r.closest_flux) for r in joins.closest_points(two_points, asks).collect()}
    assert got == {2.1: (2.0, 5.0), 2.7: (3.0, 6.0), 2.5: (2.0, 5.0)}


def test_closest_point_of_an_empty_band_is_null(spark, two_points):
    asks = spark.createDataFrame([(1, 2.1)], "object_id long, request_time double")
    got = {r.band: r.closest_time for r in joins.closest_points(two_points, asks, ["b", "c"]).collect()}
    assert got == {"b": 2.0, "c": None}


def test_linear_transform(two_points):
    got = curves.linear_transform(two_points, 1.0, 2.0, 3.0, 4.0).orderBy("time").collect()
    assert [(r.time, r.flux, r.flux_err) for r in got] == [(9, 28, 2), (12, 32, 2)]


def test_transform_needs_positive_stretch(two_points):
    with pytest.raises(ValueError):
        curves.linear_transform(two_points, dilate_time=0.0)
    with pytest.raises(Exception, match="positive"):
        curves.linear_transform(two_points, dilate_time=F.lit(-1.0)).collect()


def test_transform_and_back(two_points):
    there = curves.linear_transform(two_points, 1.0, 2.0, 4.0, 0.5)
    back = curves.linear_transform(curves.linear_transform(there, 0, 0, 0.25, 2.0), -1.0, -2.0)
    assert [(r.time, r.flux) for r in back.orderBy("time").collect()] == [(2, 5), (3, 6)]


def test_transform_without_parameters_fails(spark, two_points):
    x = spark.createDataFrame([("c", 0.0, 0.0, 1.0, 1.0)], "band string, translate_time double, translate_flux double, dilate_time double, dilate_flux double")
    with pytest.raises(Exception, match="no transform for b"):
        curves.transform_by(two_points, x, "band").collect()


def test_arc_length(spark):
    t = spark.range(226).select(F.lit(1).cast("long").alias("object_id"), F.lit("b").alias("band"), F.col("id").cast("double").alias("time"), F.lit(0.0).alias("flux_err"), F.lit(1).alias("detected"), F.col("id").alias("tie"))
    gauss = t.withColumn("flux", 1.5 * F.exp(-0.5 * F.pow((F.col("time") - 20) / 7, 2)))
    assert curves.arc_lengths(gauss).first().arc_length == pytest.approx(225.14157021861462, abs=1e-4)


def test_arc_length_skips_undetected_and_counts_lone_points(spark):
    rows = [(1, "a", 0.0, 0.0, 1.0, 1, 0), (1, "a", 1.0, 9.0, 1.0, 0, 1), (1, "a", 3.0, 4.0, 1.0, 1, 2), (1, "b", 0.0, 1.0, 1.0, 1, 3), (2, "a", 0.0, 1.0, 1.0, 0, 4)]
    got = {(r.object_id, r.band): r.arc_length for r in curves.band_arc_lengths(spark.createDataFrame(rows, OBS)).collect()}
    assert got == {(1, "a"): 5.0, (1, "b"): 0.0, (2, "a"): 0.0}


def test_merge_is_a_bag_union(spark, two_points):
    both = curves.merge(two_points, two_points)
    assert both.count() == 4
    assert sorted(both.collect()) == sorted(curves.merge(two_points, two_points.limit(2)).collect())


def test_range_index(spark):
    rows = [(g, "b", float(i), 0.0, 0.0, 1, i) for g, n in enumerate((2, 1, 2, 2)) for i in range(n)]
    got = windows.range_index(spark.createDataFrame(rows, OBS), "object_id").orderBy("object_id").collect()
    assert [(r.start, r.end) for r in got] == [(0, 2), (2, 3), (3, 5), (5, 7)]


def test_run_index_refuses_broken_runs(spark):
    t = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "k string, pos long")
    with pytest.raises(Exception, match="several pieces"):
        windows.run_index(t, "k").collect()


def test_window_padding(two_points):
    f = {r.request_time: r for r in features.point_features(two_points, 4, ["b"]).collect()}
    assert (f[2.0].before_padding, f[2.0].after_padding, f[3.0].before_padding, f[3.0].after_padding) == (4, 3, 3, 4)
    assert f[2.0].after_flux == [6, 0, 0, 0]
    assert f[3.0].before_flux == [0, 0, 0, 5]


def test_soft_maximum(two_points):
    s = {r.request_time: r.score for r in features.maximum_scores(features.point_features(two_points, 4, ["b"]), 4, 0.5).collect()}
    assert s[2.0] == pytest.approx(0.1192029, abs=1e-6)
    assert s[3.0] == pytest.approx(0.8807970, abs=1e-6)


@pytest.mark.parametrize(("tolerance", "kept"), [(0.2, 2), (0.01, 1)])
def test_slopes_and_masks(spark, two_points, tolerance, kept):
    asks = spark.createDataFrame([(1, 1.9), (1, 3.0)], "object_id long, request_time double")
    w = features.window_columns(features.window_features(two_points, asks, 4, ["b"]), 4, tolerance, clip=7.0)
    got = {r.request_time: r for r in w.select("*", C.masked(F.col("dflux_dt"), F.col("mask"), 0.0).alias("m")).collect()}
    assert got[1.9].dflux_dt == [2.5, 2.5, 2.5, 2.5, 1.0, 2.5, 2.5, 2.5]
    assert got[3.0].dflux_dt == [2, 2, 2, 1, 2, 2, 2, 2]
    assert got[3.0].m == [0, 0, 0, 1, 0, 0, 0, 0]
    assert sum(map(sum, (r.m for r in got.values()))) == kept


def test_slope_without_time_is_clipped(spark):
    t = spark.createDataFrame([([1.0, -1.0, 0.0, 5.0], [0.0, 0.0, 0.0, 1.0])], "f array<double>, t array<double>")
    assert t.select(C.slopes(F.col("f"), F.col("t"), 3.0).alias("s")).first().s == [3.0, -3.0, None, 3.0]


def test_soft_onehot_is_monotone(spark):
    t = spark.createDataFrame([([0.0, 1.0, 2.0],)], "v array<double>")
    s = t.select(C.soft_onehot(F.col("v"), F.array(*map(F.lit, (0.0, 0.5, 3.0))), F.lit(0.7)).alias("s")).first().s
    assert all(a[i] < b[i] for a, b in zip(s, s[1:], strict=False) for i in range(3))
    assert all(x > y for row in s for x, y in zip(row, row[1:], strict=False))


GAPS = [0, 1, 2, 3, 4, 10, 11, 12, 12, 13, 14]


@pytest.mark.parametrize(("size", "starts"), [(1, list(range(11))), (3, [0, 1, 2, 5, 8]), (4, [0, 1])])
def test_valid_windows(spark, size, starts):
    t = spark.createDataFrame([(1, "b", float(x), 0.0, 0.0, 1, i) for i, x in enumerate(GAPS)], OBS)
    assert sorted(r.pos for r in windows.valid_windows(t, size, 0.8, 1.2).collect()) == starts


def test_a_curve_without_a_valid_window_can_be_an_error(spark):
    t = spark.createDataFrame([(1, "b", float(x), 0.0, 0.0, 1, i) for i, x in enumerate(GAPS)], OBS)
    assert windows.valid_windows(t, 3, 0.8, 1.2, missing="error").count() == 5
    with pytest.raises(Exception, match="no valid window: 1 b"):
        windows.valid_windows(t, 9, 0.8, 1.2, missing="error").collect()


def test_windows_at_repeated_times(spark):
    times = [0.0, 1.0, 1.0, 1.0, 2.0, 5.0, 5.0]
    t = spark.createDataFrame([(1, "b", x, float(i), 0.0, 1, i) for i, x in enumerate(times)], OBS)
    got = {r.tie: (list(r.before_flux), list(r.after_flux), r.before_padding, r.after_padding) for r in windows.surroundings(t, 2).collect()}
    for i, x in enumerate(times):
        before, after = [float(j) for j, y in enumerate(times) if y < x][-2:], [float(j) for j, y in enumerate(times) if y > x][:2]
        assert got[i] == ([0.0] * (2 - len(before)) + before, after + [0.0] * (2 - len(after)), 2 - len(before), 2 - len(after))


def test_coverage_of_all_radii(spark):
    rows = [(o, "abc"[i % 3], float(i * i % 17) + 0.1 * o, 1.0, 0.1, 1, i) for o in (1, 2) for i in range(12)]
    got = {tuple(r) for r in joins.coverage(spark.createDataFrame(rows, OBS), [0.5, 2.0, 40.0]).collect()}
    want = {}
    for radius in (0.5, 2.0, 40.0):
        for o, at in {(r[0], r[2]) for r in rows}:
            seen = len({r[1] for r in rows if r[0] == o and abs(r[2] - at) < radius})
            want[radius, seen] = want.get((radius, seen), 0) + 1
    assert got == {(r, n, c) for (r, n), c in want.items()}


def test_chunks_drop_the_incomplete_one(spark):
    got = windows.chunks(spark.range(11).withColumnRenamed("id", "step"), 3).orderBy("step").collect()
    assert [(r.step, r.chunk) for r in got] == [(i, i // 3) for i in range(9)]


def test_rotation_is_one_lap(spark):
    ids = spark.range(10, 47).withColumnRenamed("id", "object_id")
    got = sorted((r.step, r.object_id) for r in windows.rotation(ids, 5).collect())
    assert [s for s, _ in got] == list(range(37))
    assert sorted(i for _, i in got) == list(range(10, 47))
    assert all((b - a) % 37 == 1 for (_, a), (_, b) in zip(got, got[1:], strict=False))


def test_vector_scores(spark):
    rows = [([1.0, 2.0, 0.0], [1.0, 2.0, 0.0]), ([-0.1, -0.2, -0.3], [-0.1, -0.2, -0.3])]
    t = spark.createDataFrame(rows, "left array<double>, right array<double>").withColumn("score", C.pair_score("left", "right"))
    one = t.withColumn("label", F.lit(1))
    half = t.withColumn("label", (F.col("left")[0] < 0).cast("int"))
    assert stats.mean_log_loss(one).first().loss == pytest.approx(0.0, abs=1e-4)
    assert stats.accuracy(one).first().accuracy == 1.0
    assert stats.mean_log_loss(half).first().loss == pytest.approx(5.75, abs=0.02)
    assert stats.accuracy(half).first().accuracy == 0.5
    assert stats.norm_loss(one).first().aux_loss == pytest.approx(0.96, abs=0.01)


def test_per_band_columns_and_back(spark):
    rows = [(1, "a", 4.0, 5.0), (1, "b", 2.0, 3.0)]
    t = spark.createDataFrame(rows, "object_id long, band string, first_flux double, first_err double")
    wide = features.per_band_wide(t, ["a", "b"], ["first_flux", "first_err"], "object_id")
    r = wide.first()
    assert (r.band_a_first_flux, r.band_a_first_err, r.band_b_first_flux, r.band_b_first_err) == (4, 5, 2, 3)
    assert sorted(map(tuple, features.per_band_long(wide, ["a", "b"], ["first_flux", "first_err"], "object_id").collect())) == rows
    with pytest.raises(ValueError):
        features.join_features(t, t, "object_id")


def test_band_names_and_wavelengths(spark, two_points):
    with pytest.raises(ValueError):
        curves.wavelengths(two_points, {"a": 1.0}, ["b"])
    with pytest.raises(ValueError):
        curves.wavelengths(two_points, {"a": 2.0, "b": 1.0}, ["a", "b"])
    assert curves.two_dimensional(curves.wavelengths(two_points, {"b": 9.0}, ["b"])).first().invars == [9.0, 2.0]


def test_dense_points_need_three_columns(spark):
    t = spark.createDataFrame([(1, "b", [[1.0, 2.0]])], "object_id long, band string, points array<array<double>>")
    with pytest.raises(Exception, match="3 columns"):
        curves.from_arrays(t).collect()


def test_missing_id_is_an_error(spark, two_points):
    meta = spark.createDataFrame([(1, 7)], "object_id long, target int")
    with pytest.raises(Exception, match="no points of 2"):
        lookups.curves_of_ids(two_points, meta, lookups.id_table(spark, [1, 2])).collect()
    assert lookups.curves_of_ids(two_points, meta, lookups.id_table(spark, [1, 2]), missing="skip").count() == 2
    assert lookups.curve(two_points, 1, missing="error").count() == 2
    with pytest.raises(Exception, match="no points of 5"):
        lookups.curve(two_points, 5, missing="error").collect()
    assert lookups.curves_of_ids(two_points, meta, lookups.id_table(spark, [])).count() == 0
    assert lookups.curves_of_class(two_points, meta, 99).count() == 0


def test_phase_is_never_negative(spark):
    t = spark.createDataFrame([(-1.0,), (5.5,)], "time double")
    assert [r.p for r in t.select(C.phase("time", F.lit(2.0)).alias("p")).collect()] == [1.0, 1.5]


def test_pairs_of_all_classes(spark):
    meta = spark.createDataFrame([(i, i % 3) for i in range(12)], "object_id long, target int")
    got = joins.different_class_pairs(meta, 200, 1).collect()
    assert len(got) == 200
    assert {(r.left_target, r.right_target) for r in got} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert all(r.left_id % 3 == r.left_target and r.right_id % 3 == r.right_target for r in got)


def test_subsample_keeps_the_region(spark):
    rows = [(1, "left", "b", float(i), 50.0, i) for i in range(115)]
    t = spark.createDataFrame(rows, "object_id long, side string, band string, time double, pair_time double, tie long")
    for seed in range(5):
        got = {r.time for r in pairs.subsample(t, seed).collect()}
        assert {47.0, 48.0, 49.0, 50.0, 51.0, 52.0, 53.0} <= got
        assert 7 + 54 <= len(got) <= 115


def test_transforms_stay_in_bounds(spark):
    made = pairs.transforms(spark.range(2000).withColumnRenamed("id", "object_id"), 3)
    r = made.agg(F.max("dilate_time"), F.min("dilate_time"), F.max("dilate_flux"), F.stddev("translate_time"), F.avg("translate_time")).first()
    bound = (math.log(6) - math.log(1.1)) * math.log(1.1)
    assert math.exp(-bound) <= r[1] < 1 < r[0] <= math.exp(bound)
    assert r[2] <= math.exp((math.log(16) - math.log(1.5)) * math.log(1.5))
    assert r[3] == pytest.approx(1.0, abs=0.1) and abs(r[4]) < 0.1


def test_alignment_beats_identity(spark):
    rows = [(o, "b", float(i) + 0.3 * o, math.sin(i / 3.0), 0.1, 1, i) for o in (1, 2) for i in range(40)]
    obs = spark.createDataFrame(rows, OBS)
    p = spark.createDataFrame([(1, 1, 2)], "pair_id long, left_id long, right_id long")
    same = align.align_grid(p, obs, align.candidate_grid(spark)).first().arc_length
    grid = align.align_grid(p, obs, align.candidate_grid(spark, translate_time=[-0.6, -0.3, 0.0, 0.3])).first()
    fine = align.align_simplex(p, obs).first()
    assert grid.arc_length <= same and fine.arc_length <= same + 1e-9
    assert grid.translate_time == -0.3


def test_stacks_hold_all_curves_of_a_class(spark):
    rows = [(o, "b", float(i) + 0.1 * o, math.sin(i / 3.0), 0.1, 1, i) for o in range(7) for i in range(15)]
    meta = spark.createDataFrame([(o, o % 2) for o in range(7)] + [(99, None)], "object_id long, target int")
    got = align.stack_classes(spark.createDataFrame(rows, OBS), meta).collect()
    assert sorted((r.target, r.object_id, r.level) for r in got) == [(0, 0, None), (0, 2, 0), (0, 4, 1), (0, 6, 0), (1, 1, None), (1, 3, 0), (1, 5, 1)]
    assert all(r.converged for r in got if r.level is not None)
    short = align.align_simplex(spark.createDataFrame([(1, 1, 2)], "pair_id long, left_id long, right_id long"), spark.createDataFrame(rows, OBS), rounds=2).first()
    assert not short.converged


def test_matrix_of_all_pairs(spark):
    rows = [(o, "b", float(i) + 0.1 * o, math.sin(i / 3.0 + o), 0.1, 1, i) for o in range(4) for i in range(6)]
    obs, meta = spark.createDataFrame(rows, OBS), spark.createDataFrame([(o, o % 2) for o in range(4)], "object_id long, target int")
    grid = align.candidate_grid(spark, translate_time=[0.0, 1.0])
    every, own = align.alignment_matrix(meta, obs, grid).collect(), align.alignment_matrix(meta, obs, grid, same_class=True).collect()
    assert {(r.left_id, r.right_id) for r in every} == {(a, b) for a in range(4) for b in range(4) if a != b}
    assert {tuple(r) for r in own} == {tuple(r) for r in every if r.left_target == r.right_target}


def test_any_partitioning_gives_the_same(spark):
    rows = [(i % 7, "ab"[i % 2], float(i * 37 % 101), float(i % 13), 0.5, int(i % 4 != 0), i) for i in range(400)]
    obs = spark.createDataFrame(rows, OBS)
    found = []
    for n in ("1", "4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append((sorted(map(tuple, curves.arc_lengths(obs).select("object_id", F.round("arc_length", 6)).collect())), sorted(map(tuple, windows.range_index(obs, "object_id", "band").collect())), sorted(map(str, features.point_features(obs, 2, ["a", "b"]).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2]


def test_pairs_of_a_class_are_made_by_many_tasks(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    meta = spark.createDataFrame([(i, None if i == 7 else 1 if i < 60 else 2) for i in range(64)], "object_id long, target int").coalesce(1)
    made = joins.same_class_pairs(meta, block=8).withColumn("part", F.spark_partition_id()).collect()
    classes = [[i for i in range(60) if i != 7], [60, 61, 62, 63]]
    assert sorted((r.left_id, r.right_id) for r in made) == sorted((a, b) for c in classes for a in c for b in c if a != b)
    tasks = Counter(r.part for r in made)
    assert len(tasks) > 2 and max(tasks.values()) < 0.6 * len(made)
    obs = spark.createDataFrame([(i, t) for i in range(64) if i != 5 for t in range(i % 3 + 1)], "object_id long, time int")
    got = {(r.left_id, r.right_id): (r.left_n, r.right_n) for r in joins.pair_counts(meta, obs).collect()}
    assert got == {(a, b): (a % 3 + 1, b % 3 + 1) for c in classes for a in c for b in c if a < b and 5 not in (a, b)}


@pytest.mark.parametrize(("tile", "batch"), [(3, 1), (3, 40), (100, 1 << 17)])
def test_points_of_pairs_are_made_and_counted_by_tiles(spark, monkeypatch, tile, batch):
    """all points of both sides of each pair, no pair shuffled; ids beyond base share pair_ids."""
    from collections import Counter

    monkeypatch.setattr(joins, "PAIR_POINTS", batch)
    monkeypatch.setattr(joins, "COUNTED", 5)
    rng, base = random.Random(tile), 10
    classes = [(i, None if i == 7 else rng.choice([1, 1, 2])) for i in [-13, -4, *range(48), 95, 1000] if i != 20] + [(30, 2), (30, 2)]
    n = {i: 0 if i in (5, 95) else i % 4 + 1 for i, _ in classes}
    obs = spark.createDataFrame([(i, "ab"[t % 2], float(t)) for i in n for t in range(n[i])] + [(20, "a", 0.0)], "object_id long, band string, time double")
    meta = spark.createDataFrame(classes, "object_id long, target int").repartition(3)
    points = joins.class_curves(meta, obs, base, ("band", "time"), tile)
    pairs = [(a, b) for a, c in classes for b, d in classes if a < b and c is not None and c == d]
    want = Counter((a * base + b, i == a, i, "ab"[t % 2], float(t)) for a, b in pairs for i in (a, b) for t in range(n[i]))
    assert len({a * base + b for a, b in pairs}) < len(set(pairs))
    assert Counter(map(tuple, points.table().collect())) == want
    sums = Counter()
    for row, k in want.items():
        sums[row[:2]] += k
    counted = joins.counted_sides(points)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert sorted(map(tuple, counted.collect())) == sorted((*k, m) for k, m in sums.items())


def test_query_of_pair_curves_makes_the_points_of_pairs(spark, monkeypatch):
    """points are counted where the pairs have them, not before objects are paired."""
    from cadenza import queries

    made, make = [], joins.class_curves
    monkeypatch.setattr(joins, "pair_counts", None)
    monkeypatch.setattr(joins, "class_curves", lambda *a: made.append(make(*a)) or made[-1])
    got = queries.queries()["pair_curves"](spark, "/root/testdata/sf0.001")
    assert got.agg({"n": "sum"}).first()[0] == made[0].table().count() > 0
    assert joins.class_curves(*(t.limit(0) for t in (queries.metadata(spark, "/root/testdata/sf0.001"), queries.observations(spark, "/root/testdata/sf0.001"))), 100).table().count() == 0


def test_refined_periods_search_once_and_deal_blocks(spark, monkeypatch):
    from cadenza.plans import periods

    rows = [(o, "ab"[i % 2], 0.37 * i + 0.01 * (i * i % 7), math.sin(0.37 * i * (1 + o)) + o, 0.1, 1, i) for o in range(5) for i in range(24)]
    obs = spark.createDataFrame(rows, "object_id long, band string, time double, flux double, flux_err double, detected int, tie long")
    top = stats.top_periods(periods.span_periodogram(obs))
    fine = periods.refined(obs, top)
    plan = fine._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and plan.count("MapInArrow") == 1  # the peaks are not searched for again
    whole = sorted(map(tuple, fine.collect()))
    assert len(whole) == top.count() and len(whole) >= 5
    monkeypatch.setattr(periods, "POINTS", 30)
    monkeypatch.setattr(periods, "POWERS", 100)
    cut = sorted(map(tuple, periods.refined(obs, top).collect()))
    assert [r[:2] for r in cut] == [r[:2] for r in whole]
    for one, other in zip(cut, whole, strict=True):
        assert one[2:] == pytest.approx(other[2:], abs=1e-9)
