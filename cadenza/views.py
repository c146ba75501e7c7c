"""Light-curve views over event, customer, embedding and line-item tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days from the epoch to 2024-01-01.
DAY0 = 19723
EVENT_BANDS = ("click", "error", "purchase", "signup", "view")
EVENT_WAVELENGTHS = {"click": 368.55, "error": 484.45, "purchase": 622.95, "signup": 753.55, "view": 868.65}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(ts) -> F.Column:
    """Days from 2024-01-01 of a timestamp without zone, taken as UTC whatever the session says."""
    return F.unix_micros(F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone())) / F.lit(8.64e10) - F.lit(float(DAY0))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as objects, event types as bands."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("object_id"),
        F.col("event_type").alias("band"),
        (F.array_position(F.array(*map(F.lit, EVENT_BANDS)), F.col("event_type")) - 1).cast("int").alias("passband"),
        days("ts").alias("time"),
        F.col("value").alias("flux"),
        (F.col("value") * 0.05 + 0.1).alias("flux_err"),
        (F.col("event_id") % 4 != 0).cast("int").alias("detected"),
        F.col("event_id").alias("tie"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that are objects: target is the nation."""
    c = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("object_id"), F.col("c_nationkey").alias("target"), (F.col("c_custkey") % 2).cast("int").alias("ddf"),
            F.col("c_acctbal").alias("distmod"), F.col("c_mktsegment").alias("segment")
    )
    ids = read(spark, sf_dir, "events").select(F.col("user_id").alias("object_id")).distinct()
    return c.join(ids, "object_id", "left_semi")


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 2k and 2k + 1 side by side; label: same class."""
    e = read(spark, sf_dir, "embeddings").withColumn("pair_id", F.floor(F.col("vec_id") / 2).cast("long"))
    vector = F.col("embedding").cast("array<double>")
    sides = e.groupBy("pair_id").agg(
        *(F.max(F.when(F.col("vec_id") % 2 == n, vector)).alias(side) for n, side in ((0, "left"), (1, "right"))),
        *(F.max(F.when(F.col("vec_id") % 2 == n, F.col("label"))).alias(f"{side}_label") for n, side in ((0, "left"), (1, "right"))),
    )
    return sides.where("left is not null and right is not null").withColumn("label", (F.col("left_label") == F.col("right_label")).cast("int"))


def line_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as objects, return flags as bands: many points, times tie."""
    t = read(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_suppkey").alias("object_id"),
        F.col("l_returnflag").alias("band"),
        (F.array_position(F.array(*map(F.lit, "ANR")), F.col("l_returnflag")) - 1).cast("int").alias("passband"),
        days("l_shipdate").alias("time"),
        F.col("l_extendedprice").alias("flux"),
        (F.col("l_discount") + 0.01).alias("flux_err"),
        (F.col("l_linenumber") % 4 != 0).cast("int").alias("detected"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tie"),
    )


#: The same views in SQL, as named queries to put after WITH.
OBS_SQL = """obs AS (SELECT user_id AS object_id, event_type AS band, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS passband,
  epoch_us(ts) / 8.64e10 - 19723.0 AS time, value AS flux, value * 0.05 + 0.1 AS flux_err, CAST(event_id % 4 <> 0 AS INTEGER) AS detected, event_id AS tie FROM events)"""
META_SQL = """meta AS (SELECT c_custkey AS object_id, c_nationkey AS target, CAST(c_custkey % 2 AS INTEGER) AS ddf, c_acctbal AS distmod, c_mktsegment AS segment
  FROM customer WHERE c_custkey IN (SELECT user_id FROM events))"""
PAIRS_SQL = """pairs AS (SELECT l.vec_id // 2 AS pair_id, CAST(l.embedding AS DOUBLE[]) AS "left", CAST(r.embedding AS DOUBLE[]) AS "right", CAST(l.label = r.label AS INTEGER) AS label
  FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1 WHERE l.vec_id % 2 = 0)"""
LINES_SQL = """obs AS (SELECT l_suppkey AS object_id, l_returnflag AS band, CAST(list_position(['A','N','R'], l_returnflag) - 1 AS INTEGER) AS passband, epoch_us(l_shipdate) / 8.64e10 - 19723.0 AS time,
  l_extendedprice AS flux, l_discount + 0.01 AS flux_err, CAST(l_linenumber % 4 <> 0 AS INTEGER) AS detected, l_orderkey * 8 + l_linenumber AS tie FROM lineitem)"""
