"""Tables: observation and metadata files, narrow columnar storage, indices and catalogues."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.lookups import numbered
from cadenza.schemas import CURVE_CSV, CUTOFF, META, PERIODS, RAW_OBS, BandSpec

#: Limits within which a narrow type holds a value safely.
FLOAT_LIMIT, INT_LIMIT, BYTE_LIMIT = 1e37, 2e9, 128


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "FAILFAST").csv(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation files with a header line."""
    return read_csv(spark, path, RAW_OBS)


def read_metadata(spark: SparkSession, path: str, with_target: bool = True) -> DataFrame:
    """Metadata files; those without a target column get a null one."""
    schema = META if with_target else T.StructType([f for f in META.fields if f.name != "target"])
    table = read_csv(spark, path, schema)
    return table if with_target else table.withColumn("target", F.lit(None).cast("int"))


def stacked_metadata(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test, allowMissingColumns=True)


def drop_header_rows(table: DataFrame, name: str = "target", numeric: tuple[str, ...] = ("object_id", "target")) -> DataFrame:
    """Rows of a text table that repeat the header are left out, and columns made numbers."""
    kept = table.where(F.col(name).isNull() | (F.col(name).cast("string") != name))
    return kept.withColumns({c: F.col(c).cast("long") for c in numeric})


def with_bands(obs: DataFrame, spec: BandSpec) -> DataFrame:
    """Long observations from raw ones: band names, time for mjd, a tie from the row's own values."""
    named = obs.withColumn("band", F.get(F.array(*map(F.lit, spec.bands)), F.col("passband"))).withColumnRenamed("mjd", "time")
    return named.withColumn("tie", F.xxhash64("flux", "flux_err"))


def narrowed(table: DataFrame) -> DataFrame:
    """double to float, long to int, flags to byte; a value out of range is an error of the job."""
    out = []
    for field in table.schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            value = value.cast("int")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            kind, limit = "float", FLOAT_LIMIT
        elif field.name == "detected" or isinstance(field.dataType, (T.BooleanType, T.ByteType)):
            kind, limit = "tinyint", BYTE_LIMIT
        elif isinstance(field.dataType, (T.LongType, T.IntegerType, T.ShortType)):
            kind, limit = "int", INT_LIMIT
        else:
            raise TypeError(f"{field.name}: {field.dataType.simpleString()} has no narrow form")
        wrong = F.raise_error(F.concat(F.lit(f"{field.name} doesn't fit {kind}: "), value.cast("string"))).cast(kind)
        fits = value.isNull() | (F.abs(value.cast("double")) < limit)
        out.append(F.when(fits, value.cast(kind)).otherwise(wrong).alias(field.name))
    return table.select(*out)


def write_table(obs: DataFrame, path: str, *order: str) -> None:
    """Parquet, rows of an object together and in order, so that lookups by object read few row groups."""
    order = order or ("object_id", "passband", "mjd")
    obs.repartitionByRange(order[0]).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def open_dataset(spark: SparkSession, name: str, paths: Mapping[str, str]) -> DataFrame:
    """A data set by name: a registered table, or a path from the given map."""
    if name in paths:
        return spark.read.parquet(paths[name])
    if spark.catalog.tableExists(name):
        return spark.table(name)
    raise KeyError(name)


def read_curve_csv(spark: SparkSession, path: str, least: int = 100, most: int = 10**9) -> DataFrame:
    """Head-less files time,value,error, one per curve: object named after the file. A curve with
    too few or too many rows is an error."""
    rows = spark.read.schema(CURVE_CSV).option("header", False).option("mode", "FAILFAST").csv(path)
    return checked_curves(rows.withColumn("name", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")), least, most)


def checked_curves(named: DataFrame, least: int = 100, most: int = 10**9) -> DataFrame:
    """Rows of curves by name; a curve with too few or too many is an error of the job."""
    counts = named.groupBy("name").agg(F.count("*").alias("_n"))
    wrong = F.raise_error(F.concat(F.lit("unlikely number of rows: "), F.col("name"))).cast("boolean")
    fine = counts.where(F.when((F.col("_n") > least) & (F.col("_n") < most), F.lit(True)).otherwise(wrong)).drop("_n")
    return named.join(fine, "name")


def sorted_source(table: DataFrame, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """Rows in key order with their place (pos), and (key, min_row, max_row) of every key."""
    placed = numbered(table.withColumns({c: F.col(c).cast("double") for c in ("time", "flux", "flux_error") if c in table.columns}), key, "time")
    return placed, placed.groupBy(key).agg(F.min("pos").alias("min_row"), F.max("pos").alias("max_row"))


def write_bucketed(table: DataFrame, name: str, path: str, buckets: int, key: str = "object_id", *order: str) -> DataFrame:
    """The table as catalog table `name` with its files under path, in buckets of the key, each sorted by the
    key (and `order`). Tables in equally many buckets join on the key, and windows inside the key run, without
    an exchange; a lookup by key reads one bucket. Dealt by the key first, so a bucket is one file."""
    dealt = table.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key, *order).option("path", path).mode("errorifexists").saveAsTable(name)
    return table.sparkSession.table(name)


def write_periods(catalogue: DataFrame, path: str) -> None:
    catalogue.select(*PERIODS.names).write.option("header", True).csv(path)


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PERIODS)


def write_cutoffs(cutoffs: DataFrame, path: str) -> None:
    """A small model: one JSON row per band and column."""
    cutoffs.select(*CUTOFF.names).coalesce(1).write.json(path)


def read_cutoffs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CUTOFF).json(path)


def packed(obs: DataFrame) -> DataFrame:
    """One row per (object, band) with its points in order."""
    point = F.struct("time", "tie", "flux", "flux_err", "detected")
    return obs.groupBy("object_id", "band").agg(F.array_sort(F.collect_list(point)).alias("points"))


def unpacked(curves: DataFrame) -> DataFrame:
    """The way back to long observations."""
    return curves.select("object_id", "band", F.inline("points"))
