"""Layouts that save work: places, buckets, counted ranks; and what their plans leave out."""

from __future__ import annotations

import math
import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import joins, lookups, stats
from cadenza.operators.ranks import value_at
from cadenza.sources import placed, tables

OBS = "object_id long, band string, time double, flux double, flux_err double, detected int, tie long"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _observations(spark, n=600):
    rng = random.Random(n)
    return spark.createDataFrame([(rng.randrange(40), rng.choice("ab"), rng.uniform(0, 9), rng.gauss(0, 1), 0.1, 1, i) for i in range(n)], OBS).repartition(5)


# ---------------------------------------------------------------- places
def test_places_of_a_stored_order(spark, tmp_path):
    obs = _observations(spark)
    placed.write_placed(obs, str(tmp_path), "object_id", "band", "time", "tie", files=7)
    order = [tuple(r) for r in sorted(obs.collect(), key=lambda r: (r.object_id, r.band, r.time, r.tie))]
    index = spark.read.parquet(f"{tmp_path}/index").orderBy("first").collect()
    assert len(index) == 7 and index[0].first == 0 and index[-1].last == 599
    assert all(a.last + 1 == b.first for a, b in zip(index, index[1:], strict=False))
    for start, end in ((0, 1), (250, 256), (590, 700), (0, 600), (600, 610)):
        got = placed.placed_slice(spark, str(tmp_path), start, end).orderBy("pos").collect()
        assert [r.pos for r in got] == list(range(start, min(end, 600))) and [tuple(r)[:-1] for r in got] == order[start:end]
    one = placed.placed_row(spark, str(tmp_path), 300)
    assert len(one.inputFiles()) == 1 and "PushedFilters: [IsNotNull(pos), GreaterThanOrEqual(pos,300), LessThan(pos,301)]" in _plan(one)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_row_at_counts_and_sorts_nothing(spark, kind):
    rng = random.Random(1)
    ids = rng.sample(range(-5000, 10**15), 300) + [2**62, -(2**62)]
    table = spark.createDataFrame([(i, i % 7) for i in ids], "object_id long, x long").withColumn("object_id", F.col("object_id").cast(kind)).repartition(4)
    order = sorted(table.collect(), key=lambda r: r.object_id)
    for at in (0, 1, 150, 300, 301):
        found = lookups.row_at(table, at)
        assert [tuple(r) for r in found.collect()] == [tuple(order[at])]
        assert "Window" not in _plan(found) and "rangepartitioning" not in _plan(found)
    assert lookups.row_at(table, 302).count() == 0 and lookups.row_at(table, -1).count() == 0
    assert value_at(table.limit(0), "object_id", 0) is None


def test_row_at_of_repeated_values(spark):
    table = spark.createDataFrame([(5, "c"), (5, "a"), (1, "z"), (5, "b"), (9, "y")], "object_id int, x string")
    assert [lookups.row_at(table, i).first().x for i in range(5)] == ["z", "a", "b", "c", "y"]


# ---------------------------------------------------------------- buckets
@pytest.fixture
def bucketed(spark, tmp_path):
    obs, meta = _observations(spark), spark.createDataFrame([(i, i % 3) for i in range(40)], "object_id long, target int")
    names = [f"t{uuid.uuid4().hex}" for _ in range(2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield obs, meta, *(tables.write_bucketed(t, n, f"{tmp_path}/{n}", 4) for t, n in zip((obs, meta), names, strict=True))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_bucketed_tables_meet_without_an_exchange(spark, bucketed):
    obs, meta, own, own_meta = bucketed
    joined = lookups.with_metadata(own, own_meta)
    assert "Exchange" not in _plan(joined) and "Exchange" in _plan(lookups.with_metadata(obs, meta))
    counted = joined.groupBy("object_id", "target").agg(F.count("*").alias("n"))
    assert "Exchange" not in _plan(counted)
    want = lookups.with_metadata(obs, meta).groupBy("object_id", "target").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))
    stepped = own.withColumn("dt", F.col("time") - F.lag("time").over(Window.partitionBy("object_id", "band").orderBy("time", "tie")))
    assert "Exchange" not in _plan(stepped)


def test_a_lookup_reads_one_bucket(bucketed):
    obs, _, own, _ = bucketed
    found = own.where("object_id = 17")
    assert found._jdf.queryExecution().executedPlan().collectLeaves().head().optionalBucketSet().isDefined()
    assert found.count() == obs.where("object_id = 17").count()


def test_data_sets_by_name(spark, bucketed, tmp_path):
    """A path of the given map, a table of the catalog, and neither."""
    obs, _, own, _ = bucketed
    obs.write.parquet(f"{tmp_path}/obs")
    name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("t") and "flux" in spark.table(t.name).columns)
    assert tables.open_dataset(spark, "x", {"x": f"{tmp_path}/obs"}).count() == tables.open_dataset(spark, name, {"x": ""}).count() == own.count()
    with pytest.raises(KeyError):
        tables.open_dataset(spark, "nowhere", {})


# ---------------------------------------------------------------- cost flat in the radius, and in the positions
@pytest.mark.parametrize("radius", [0.01, 1.5, 9.0, 1000.0])
def test_region_bands_of_any_radius(spark, radius):
    obs = _observations(spark, 200)
    asks = obs.select("object_id", (F.col("time") + 0.05).alias("request_time")).limit(60)
    rows, want = obs.collect(), {}
    for r in asks.collect():
        bands = sorted({o.band for o in rows if o.object_id == r.object_id and r.request_time - radius < o.time < r.request_time + radius})
        if bands:
            want[r.object_id, r.request_time] = bands
    found = joins.region_bands(obs, asks, radius)
    assert {(r.object_id, r.request_time): r.bands for r in found.collect()} == want


def test_density_1d(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), rng.choice([None, rng.gauss(0, 2)])) for _ in range(300)]
    positions = [-1.0, 0.0, 2.5]
    got = {(r.k, r.place): (r.x, r.density) for r in stats.density_1d(spark.createDataFrame(rows, "k string, v double").repartition(3), "v", positions, "k", bandwidth=0.7).collect()}
    for k in ("a", None):
        own = [v for g, v in rows if g == k and v is not None]
        for i, x in enumerate(positions):
            want = sum(math.exp(-0.5 * ((x - v) / 0.7) ** 2) for v in own) / len(own) / (0.7 * math.sqrt(2 * math.pi))
            assert got[k, i][0] == x and got[k, i][1] == pytest.approx(want)
    assert stats.density_1d(spark.createDataFrame(rows, "k string, v double"), "v", positions).count() == 3
