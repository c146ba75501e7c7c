"""Point, list, class and sample lookups of curves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.hashing import uniform
from cadenza.operators.ranks import value_at
from cadenza.storage import stored

OBS_ORDER = ("object_id", "band", "time", "tie")


def curve(obs: DataFrame, object_id: int, band: str | None = None, missing: str = "empty") -> DataFrame:
    """The points of one object, of one band if given, in order. An object without any is an empty table
    or, with missing="error", an error of the job."""
    found = obs.where(F.col("object_id") == object_id)
    found = (found if band is None else found.where(F.col("band") == band)).orderBy("band", "time", "tie")
    if missing != "error":
        return found
    none = F.raise_error(F.lit(f"no points of {object_id}")).cast("boolean")
    asked = found.sparkSession.range(1).select(F.lit(object_id).cast("long").alias("_asked"))
    joined = asked.join(found, F.col("_asked") == F.col("object_id"), "left")
    return joined.where(F.when(F.col("object_id").isNotNull(), F.lit(True)).otherwise(none)).drop("_asked")


def curves_of_class(obs: DataFrame, meta: DataFrame, target: int) -> DataFrame:
    """Curves of all objects of a class; none if the class is unknown."""
    return obs.join(meta.where(F.col("target") == target).select("object_id"), "object_id", "left_semi")


def id_table(spark: SparkSession, ids: Iterable[int]) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in set(ids)], "object_id long")


def curves_of_ids(obs: DataFrame, meta: DataFrame, ids: DataFrame, missing: str = "error") -> DataFrame:
    """Curves with their metadata for a table of ids (repeats count once). An id without points is an
    error of the job, or is left out with missing="skip". Ids may be many: the join is Spark's choice."""
    wanted = ids.select("object_id").distinct()
    found = obs.join(wanted, "object_id", "left_semi").join(meta, "object_id", "left")
    if missing == "skip":
        return found
    there = obs.select("object_id", F.lit(True).alias("_there")).distinct()
    lacking = F.raise_error(F.concat(F.lit("no points of "), F.col("object_id").cast("string"))).cast("boolean")
    gone = wanted.join(there, "object_id", "left").where(F.when(F.col("_there"), F.lit(False)).otherwise(lacking)).drop("_there")
    return found.unionByName(gone, allowMissingColumns=True)


def with_metadata(obs: DataFrame, meta: DataFrame, how: str = "inner") -> DataFrame:
    return obs.join(meta, "object_id", how)


def object_ids(obs: DataFrame) -> DataFrame:
    return obs.select("object_id").distinct()


#: Rows that monotonically_increasing_id() counts in a partition before its partition number.
_IN_PARTITION = 33


def in_ranges(table: DataFrame, *order: str) -> DataFrame:
    """The table in order, cut into ranges: _part numbers the ranges, _nth the rows of each.

    Every evaluation of a range exchange draws its own bounds, so that counts of one say nothing of
    another. The cut table is therefore stored, and whoever numbers it reads that one cut.
    """
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: never merged at run time
    cut = table.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    mask = F.lit((1 << _IN_PARTITION) - 1)
    return stored(cut.withColumns({"_part": F.shiftright("_id", _IN_PARTITION), "_nth": F.col("_id").bitwiseAND(mask)}).drop("_id"), "ranges")


def before_parts(sizes: DataFrame, total: str) -> DataFrame:
    """_part and _base: the sum of a total over the ranges before. sizes has a row for each range."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias("_base"))


def numbered(table: DataFrame, *order: str) -> DataFrame:
    """pos: place from 0 in the order of the columns, by counts of range partitions and no single task."""
    cut = in_ranges(table, *order)
    before = before_parts(cut.groupBy("_part").agg(F.count("*").alias("_n")), "_n")
    return cut.join(F.broadcast(before), "_part").withColumn("pos", (F.col("_base") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_base")


def numbered_within(table: DataFrame, group: str, *order: str) -> DataFrame:
    """pos: place from 0 inside the group, and n: size of the group. Numbered over range partitions, so
    that a group of very many rows isn't sorted in one task."""
    placed = numbered(table, group, *order)
    sizes = placed.groupBy(group).agg(F.min("pos").alias("_first"), F.count("*").alias("n"))
    return placed.join(sizes, group).withColumn("pos", F.col("pos") - F.col("_first")).drop("_first")


def outside(ids: DataFrame, others: DataFrame, key: str = "object_id") -> DataFrame:
    """Ids that the other table lacks: none if it holds them all."""
    return ids.select(key).distinct().join(others, key, "left_anti")


def row_at(table: DataFrame, position: int, order: str = "object_id") -> DataFrame:
    """The row at a place of the order (a numeric column without nulls; rows of one value in order of their
    other columns). Its value is found by counting, and only rows that have it are read: nothing is written or
    sorted. For many places of one table see sources.placed."""
    found = value_at(table, order, position)
    if found is None:
        return table.limit(0)
    value, smaller = found
    rest = [c for c in table.columns if c != order]
    return table.where(F.col(order) == F.lit(value)).orderBy(*rest).offset(position - smaller).limit(1)


def sample(ids: DataFrame, n: int, seed: int, key: str = "object_id") -> DataFrame:
    """Exactly n rows (or all), chosen by hash of the key."""
    return ids.orderBy(uniform(seed, F.col(key)), key).limit(n)


def answered(meta: DataFrame, unknown: int = -9) -> DataFrame:
    """Ids whose class is known."""
    return meta.where(F.col("target") != unknown).select("object_id").distinct()


def ids_by(meta: DataFrame, column: str) -> DataFrame:
    """Sorted ids of each value of a column."""
    return meta.groupBy(column).agg(F.array_sort(F.collect_set("object_id")).alias("ids"))


def with_prefix(rows: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    """Rows whose id starts with the prefix."""
    return rows.where(F.col(key).startswith(prefix))


def slice_of(points: DataFrame, index: DataFrame, inclusive: bool = False, width: int = 1024) -> DataFrame:
    """Points (pos) of the ranges [start, end) of an index table; end included on demand. An equi-join:
    each range is listed once for every stretch of `width` places that it touches."""
    last = F.col("end") if inclusive else F.col("end") - 1
    touched = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width)))
    ranges = index.where(F.col("start") <= last).withColumn("_stretch", touched)
    stop = F.col("pos") <= F.col("end") if inclusive else F.col("pos") < F.col("end")
    joined = points.withColumn("_stretch", F.floor(F.col("pos") / width)).join(ranges, "_stretch")
    return joined.where((F.col("pos") >= F.col("start")) & stop).drop("_stretch")


def ids_in_every_band(points: DataFrame, bands: Iterable[str], key: str = "object_id") -> DataFrame:
    """Ids that have points in all of the bands."""
    wanted = list(dict.fromkeys(bands))
    own = points.where(F.col("band").isin(*wanted)).groupBy(key).agg(F.count_distinct("band").alias("_n"))
    return own.where(F.col("_n") == len(wanted)).select(key)


def ordered(obs: DataFrame) -> DataFrame:
    return obs.orderBy(*OBS_ORDER)


def first_curves(obs: DataFrame, k: int) -> DataFrame:
    """Curves of the k smallest ids."""
    ids = obs.select("object_id").distinct().orderBy("object_id").limit(k)
    return obs.join(ids, "object_id", "left_semi")
