"""Tables written once in an order, so that a place or a slice of places opens only the files that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.lookups import numbered


def write_placed(table: DataFrame, path: str, *order: str, files: int | None = None) -> None:
    """The table under <path>/rows with pos, its place from 0 in the order, each file a run of places in order;
    and under <path>/index the first and last place of every file. Sorted by ranges, never in one task."""
    n = files or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered(table, *order).repartitionByRange(n, "pos").sortWithinPartitions("pos").write.parquet(f"{path}/rows")
    rows = table.sparkSession.read.parquet(f"{path}/rows")
    rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("pos").alias("first"), F.max("pos").alias("last")).coalesce(1).write.parquet(f"{path}/index")


def placed_slice(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Rows at places start to end - 1. The index (a row per file) names the files; inside them the places are
    pushed down to the row groups."""
    index = spark.read.schema("file string, first long, last long").parquet(f"{path}/index")
    files = [r.file for r in index.where((F.col("first") < end) & (F.col("last") >= start)).collect()]
    if not files:
        return spark.read.parquet(f"{path}/rows").limit(0)
    return spark.read.parquet(*files).where((F.col("pos") >= start) & (F.col("pos") < end))


def placed_row(spark: SparkSession, path: str, position: int) -> DataFrame:
    """The row at a place."""
    return placed_slice(spark, path, position, position + 1)
