"""The pair classifier: vectors, a separable set, and metrics on objects that were not trained on."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions.hashing import id_split
from cadenza.plans import pairs

OBS = "object_id long, band string, time double, flux double, flux_err double, detected int, tie long"


def test_pair_vectors(spark):
    """Differences of both sides' window values, band by band; a band without points counts zeros."""
    schema = "pair_id long, side string, band string, label int, before_time array<double>, before_flux array<double>, after_time array<double>, after_flux array<double>, closest_time_in_band double, closest_flux_in_band double"
    rows = [
        (1, "left", "a", 1, [0.0], [2.0], [3.0], [5.0], 1.0, 4.0),
        (1, "right", "a", 1, [1.0], [2.5], [2.0], [9.0], 1.5, 3.0),
        (1, "left", "b", 1, [0.0], [0.0], [0.0], [0.0], None, None),
    ]
    (row,) = pairs.pair_vectors(spark.createDataFrame(rows, schema), ["a", "b"], 1).collect()
    left, right = [2.0 - 4, 5.0 - 4, 0.0 - 1, 3.0 - 1], [2.5 - 3, 9.0 - 3, 1.0 - 1.5, 2.0 - 1.5]
    assert row.x == pytest.approx([abs(x - y) for x, y in zip(left, right, strict=True)] + [0.0] * 4)


def test_metrics_of_given_scores(spark):
    scored = spark.createDataFrame([("x", 1, 0.9), ("x", 1, 0.4), ("x", 0, 0.8), ("x", 0, 0.1), ("y", 0, 0.2)], "part string, label int, score double")
    got = {r.part: r for r in pairs.pair_metrics(scored, "part").collect()}
    x, y = got["x"], got["y"]
    loss = lambda label, p: -math.log((p if label else 1 - p) + 1e-5)
    assert (x.n, x.positives, x.accuracy, x.precision, x.recall) == (4, 2, 0.5, 0.5, 0.5)
    assert x.loss == pytest.approx((loss(1, 0.9) + loss(1, 0.4) + loss(0, 0.8) + loss(0, 0.1)) / 4)
    assert (y.n, y.positives, y.accuracy, y.precision, y.recall) == (1, 0, 1.0, None, None)


@pytest.fixture(scope="module")
def separable(spark):
    """Classes that rise at very different rates, so that only pairs of one curve look alike."""
    rng, rows, meta = random.Random(6), [], []
    for o in range(120):
        target = o % 3
        meta.append((o, target))
        for i in range(16):
            t = i + rng.uniform(0, 0.3)
            rows.append((o, "ab"[i % 2], t, (1.0, 60.0, -40.0)[target] * (t / 4) ** 2 + rng.gauss(0, 0.1), 0.1, 1, i))
    return spark.createDataFrame(rows, OBS).repartition(4), spark.createDataFrame(meta, "object_id long, target int")


def test_a_separable_set_is_learned(spark, separable):
    obs, meta = separable
    quiet = {"time_factor": 1.0, "flux_factor": 1.0}
    assert pairs.transforms(meta, 1, **quiet).where("dilate_flux <> 1").count() == 0
    report = {r.split: r for r in pairs.held_out_report(obs, meta, 3, ["a", "b"], 5).collect()}
    assert report.keys() == {"TRAIN", "TUNE"}
    ids = {r.s: r["count"] for r in meta.groupBy(id_split(F.col("object_id")).alias("s")).count().collect()}
    assert all(report[s].positives == ids[s] and report[s].n == 2 * ids[s] for s in ids)
    assert report["TUNE"].accuracy > 0.8 and report["TRAIN"].accuracy > 0.85
    assert report["TUNE"].loss < math.log(2)


def test_no_object_is_on_both_sides(spark, separable):
    obs, meta = separable
    seen = {}
    for split in ("TRAIN", "TUNE"):
        ids = meta.where(id_split(F.col("object_id")) == split)
        made = pairs.negative_pairs(obs.join(ids.select("object_id"), "object_id", "left_semi"), ids, None, 5)
        seen[split] = {r.object_id for r in made.collect()}
    assert seen["TRAIN"] and seen["TUNE"] and not seen["TRAIN"] & seen["TUNE"]


def test_subsampling_is_dealt_to_all_tasks(spark):
    """few bytes aren't gathered in one task."""
    rows = [(o, s, b, float(t), 2.0, o * 100 + t) for o in range(40) for s in ("left", "right") for b in "ab" for t in range(12)]
    points = spark.createDataFrame(rows, "object_id long, side string, band string, time double, pair_time double, tie long")
    few = pairs.subsample(points, 1)
    assert few.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
