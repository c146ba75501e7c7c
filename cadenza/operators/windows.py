"""Window functions over curves and over tables of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.hashing import integer
from cadenza.operators.curves import KEY, along, by_object, by_object_sized, differences
from cadenza.operators.lookups import numbered


def padded(values: Column, n: int, left: bool) -> Column:
    """The array brought to n values with zeros at its outer end."""
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(n) - F.size(values)))
    return F.concat(zeros, values) if left else F.concat(values, zeros)


def surroundings(obs: DataFrame, n: int, bias: float = 1e-8) -> DataFrame:
    """The n points before and after each one: before_time, before_flux, before_padding, after_...

    Points of one time (within the bias of the one before them) have the same surroundings: what lies
    before the first and after the last of them. Points are counted first: rows with windows are wide, and a task
    sorts them twice.
    """
    back, forth = along().rowsBetween(-n, -1), along().rowsBetween(1, n)
    point = F.struct("time", "flux")
    step = F.col("time") - F.lag("time").over(along())
    moment = F.sum(F.when(step <= bias, 0).otherwise(1)).over(along().rowsBetween(Window.unboundedPreceding, 0))
    framed = by_object_sized(obs, obs.count()).withColumns({"_first": F.collect_list(point).over(back), "_last": F.collect_list(point).over(forth), "_moment": moment})
    whole, place = Window.partitionBy(*KEY, "_moment"), F.struct("time", "tie")
    shared = framed.withColumns({"_before": F.min_by("_first", place).over(whole), "_after": F.max_by("_last", place).over(whole)})
    out = {}
    for side, left in (("before", True), ("after", False)):
        for field in ("time", "flux"):
            out[f"{side}_{field}"] = padded(F.col(f"_{side}")[field], n, left)  # the field of every point
        out[f"{side}_padding"] = (F.lit(n) - F.size(f"_{side}")).cast("int")
    return shared.withColumns(out).drop("_before", "_after", "_first", "_last", "_moment")


def runs(obs: DataFrame, lower, upper) -> DataFrame:
    """run: number of consecutive gaps so far that lie strictly between the bounds (0 after others)."""
    stepped = differences(by_object(obs)).withColumn("ok", (F.col("dt") > lower) & (F.col("dt") < upper))
    island = F.sum(F.when(F.coalesce("ok", F.lit(False)), 0).otherwise(1)).over(along())
    lettered = stepped.withColumn("_i", island)
    return lettered.withColumn("run", (F.row_number().over(Window.partitionBy(*KEY, "_i").orderBy("time", "tie")) - 1).cast("long")).drop("_i", "ok")


def valid_windows(obs: DataFrame, size: int, lower, upper, missing: str = "skip") -> DataFrame:
    """Points that start a window of `size` points whose gaps all lie strictly between the bounds:
    pos is the point's place from 0 in its band. A curve without one has no rows or, with
    missing="error", is an error of the job."""
    stepped = differences(by_object(obs)).withColumn("ok", F.when((F.col("dt") > lower) & (F.col("dt") < upper), 1).otherwise(0))
    placed = stepped.withColumns({"pos": (F.row_number().over(along()) - 1).cast("long"), "_left": F.count("*").over(along().rowsBetween(0, size - 1))})
    if size > 1:
        good = F.min("ok").over(along().rowsBetween(1, size - 1))
        placed = placed.withColumn("_good", good)
    else:
        placed = placed.withColumn("_good", F.lit(1))
    fits = (F.col("_left") == size) & (F.col("_good") == 1)
    if missing == "error":
        none = F.raise_error(F.concat(F.lit("no valid window: "), F.concat_ws(" ", *(F.col(k).cast("string") for k in KEY)))).cast("boolean")
        placed = placed.withColumn("_any", F.max(fits).over(Window.partitionBy(*KEY)))
        fits = F.when(F.col("_any"), fits).otherwise(none)
    return placed.where(fits).drop("ok", "_left", "_good", "_any", "dt", "df", "slope")


def every_nth(obs: DataFrame, per_day: float = 1.6) -> DataFrame:
    """Every n-th point of each band, n = ceil(time span / 1.6) (at least 1)."""
    whole = Window.partitionBy(*KEY)
    n = F.greatest(F.lit(1), F.ceil((F.max("time").over(whole) - F.min("time").over(whole)) / per_day))
    numbered_points = by_object(obs).withColumns({"_n": n, "_pos": F.row_number().over(along()) - 1})
    return numbered_points.where(F.col("_pos") % F.col("_n") == 0).drop("_n", "_pos")


def range_index(obs: DataFrame, *keys: str) -> DataFrame:
    """[start, end) of every group when the points are laid out in order of the keys: sums over the
    table of groups, not over the points."""
    groups = numbered(obs.groupBy(*keys).agg(F.count("*").alias("n")), *keys)
    part = groups.withColumn("_b", F.floor(F.col("pos") / 10_000))
    inner = Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blocks = part.groupBy("_b").agg(F.sum("n").alias("_s"))  # one row per 10,000 groups
    base = blocks.withColumn("_base", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    placed = part.withColumn("_in", F.sum("n").over(inner)).join(base, "_b")
    return placed.select(*keys, (F.col("_base") + F.col("_in") - F.col("n")).alias("start"), (F.col("_base") + F.col("_in")).alias("end"))


def run_index(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """start and end of every key in a stored order; a key that isn't in one piece is an error."""
    found = rows.groupBy(key).agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.count("*").alias("_n"))
    broken = F.raise_error(F.concat(F.lit(f"{key} in several pieces: "), F.col(key).cast("string"))).cast("long")
    return found.select(key, "start", F.when(F.col("end") - F.col("start") == F.col("_n"), F.col("end")).otherwise(broken).alias("end"))


def rotation(ids: DataFrame, seed: int, key: str = "object_id") -> DataFrame:
    """One lap over the ids from a seeded start: step 0, 1, ..."""
    placed = numbered(ids.select(key), key)
    count = ids.agg(F.count("*").alias("_n"))  # one row
    start = integer(F.col("_n"), seed, "rotation")
    return placed.join(F.broadcast(count), how="cross").select(key, F.pmod(F.col("pos") - start, F.col("_n")).alias("step"))


def chunks(steps: DataFrame, size: int, step: str = "step") -> DataFrame:
    """chunk and place in it; an incomplete last chunk is left out."""
    count = steps.agg(F.count("*").alias("_n"))  # one row
    cut = steps.withColumns({"chunk": F.floor(F.col(step) / size), "place": (F.col(step) % size).cast("int")})
    return cut.join(F.broadcast(count), how="cross").where((F.col("chunk") + 1) * size <= F.col("_n")).drop("_n")
