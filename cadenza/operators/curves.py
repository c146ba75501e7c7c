"""Points and curves: transforms, cuts, merges, checks and lengths.

Observations are long rows (object_id, band, time, flux, flux_err, detected, tie). Windows over a
curve start from object_id, so that one shuffle by object serves bands and objects alike.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import column, moved_flux, moved_flux_err, moved_time

KEY = ("object_id", "band")


def along(*keys: str) -> Window:
    """The points of a curve in order."""
    return Window.partitionBy(*(keys or KEY)).orderBy("time", "tie")


def by_object(obs: DataFrame) -> DataFrame:
    """One shuffle by object: later windows and sums by (object, band) and object need none."""
    return obs.repartition("object_id")


#: Points (and requests) of a task whose windows keep wide rows.
TASK_ROWS = 200_000


def by_object_sized(rows: DataFrame, count: int) -> DataFrame:
    """by_object in so many partitions that each has some TASK_ROWS of the points counted: the memory of a task
    doesn't grow with the table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-count // TASK_ROWS)), "object_id")


# ---------------------------------------------------------------- transforms
def with_detected(obs: DataFrame) -> DataFrame:
    """Missing detection flags count as detected."""
    flag = F.coalesce("detected", F.lit(1)) if "detected" in obs.columns else F.lit(1)
    return obs.withColumn("detected", flag)


def linear_transform(obs: DataFrame, translate_time=0.0, translate_flux=0.0, dilate_time=1.0, dilate_flux=1.0) -> DataFrame:
    """Shift, then stretch; parameters are numbers or columns. Stretches must be positive."""
    return obs.withColumns(
        {"time": moved_time("time", translate_time, dilate_time), "flux": moved_flux("flux", translate_flux, dilate_flux), "flux_err": moved_flux_err("flux_err", dilate_flux)}
    )


def transform_columns(obs: DataFrame, time: Callable[[Column], Column] | None = None, flux: Callable[[Column], Column] | None = None,
    flux_err: Callable[[Column], Column] | None = None) -> DataFrame:
    """Any function of each column; detection flags stay."""
    given = {"time": time, "flux": flux, "flux_err": flux_err}
    return obs.withColumns({c: f(F.col(c)) for c, f in given.items() if f})


def transform_by(obs: DataFrame, transforms: DataFrame, *keys: str) -> DataFrame:
    """linear_transform with a parameter row per key (band, object, ...); a key without one is an error."""
    parameters = ["translate_time", "translate_flux", "dilate_time", "dilate_flux"]
    joined = obs.join(transforms.select(*keys, *parameters), list(keys), "left")
    missing = F.raise_error(F.concat(F.lit("no transform for "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))
    checked = joined.withColumns({p: F.when(F.col(p).isNotNull(), F.col(p)).otherwise(missing.cast("double")) for p in parameters})
    return linear_transform(checked, *parameters).drop(*parameters)


def transform_label(translate_time=0.0, translate_flux=0.0, dilate_time=1.0, dilate_flux=1.0) -> Column:
    """A readable name of a linear transform."""
    return F.format_string("t + %.4f, f + %.4f, t * %.4f, f * %.4f", *(column(x) for x in (translate_time, translate_flux, dilate_time, dilate_flux)))


def transform_all(obs: DataFrame, translate_time=0.0, translate_flux=0.0, dilate_time=1.0, dilate_flux=1.0) -> DataFrame:
    """One transform for all bands, noted in last_transform."""
    label = transform_label(translate_time, translate_flux, dilate_time, dilate_flux)
    return linear_transform(obs, translate_time, translate_flux, dilate_time, dilate_flux).withColumn("last_transform", label)


# ---------------------------------------------------------------- cuts and projections
def before_time(obs: DataFrame, time, bias: float = 1e-8) -> DataFrame:
    return obs.where(F.col("time") + bias < column(time))


def after_time(obs: DataFrame, time, bias: float = 1e-8) -> DataFrame:
    return obs.where(F.col("time") > column(time) + bias)


def one_band(obs: DataFrame, band: str) -> DataFrame:
    return obs.where(F.col("band") == band)


def detected_points(obs: DataFrame, detected: bool = True) -> DataFrame:
    return obs.where(F.col("detected") == int(detected))


def band_names(obs: DataFrame, bands: Sequence[str]) -> DataFrame:
    """band from the passband number (a place in the list)."""
    return obs.withColumn("band", F.get(F.array(*map(F.lit, bands)), F.col("passband")))


def wavelengths(obs: DataFrame, by_band: Mapping[str, float], bands: Sequence[str]) -> DataFrame:
    """pwav: the band's wavelength. Names must match the bands and rise in their order."""
    if set(by_band) != set(bands):
        raise ValueError(f"wavelengths for {sorted(by_band)}, bands {sorted(bands)}")
    values = [by_band[b] for b in bands]
    if any(a >= b for a, b in zip(values, values[1:], strict=False)):
        raise ValueError("wavelengths must rise in band order")
    table = F.create_map(*(F.lit(x) for b in bands for x in (b, float(by_band[b]))))
    return obs.withColumn("pwav", F.element_at(table, F.col("band")))


def two_dimensional(obs: DataFrame) -> DataFrame:
    """invars [pwav, time], outvars [flux, flux_err] and detected of each point."""
    return obs.select("object_id", "band", F.array("pwav", "time").alias("invars"), F.array("flux", "flux_err").alias("outvars"), "detected", "tie")


def from_arrays(rows: DataFrame, points: str = "points") -> DataFrame:
    """Rows (object_id, band, points: array of [time, flux, flux_err]) as observations."""
    exploded = rows.select("object_id", "band", F.posexplode(points).alias("tie", "p"))
    three = F.when(F.size("p") == 3, F.col("p")).otherwise(F.raise_error(F.lit("points need 3 columns")).cast("array<double>"))
    return exploded.withColumn("p", three).select("object_id", "band", F.col("p")[0].alias("time"), F.col("p")[1].alias("flux"),
        F.col("p")[2].alias("flux_err"), F.lit(1).alias("detected"), F.col("tie").cast("long").alias("tie"))


def display_names(objects: DataFrame) -> DataFrame:
    """name: "Object <id>[, target <t>][ after <last_transform>]"."""
    part = lambda c, lead: F.when(F.col(c).isNotNull(), F.concat(F.lit(lead), F.col(c).cast("string"))).otherwise("") if c in objects.columns else F.lit("")
    return objects.withColumn("name", F.concat(F.lit("Object "), F.col("object_id").cast("string"), part("target", ", target "), part("last_transform", " after ")))


# ---------------------------------------------------------------- merges and checks
def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """All points of both, duplicates too; order is that of (time, tie)."""
    columns = [c for c in a.columns if c in b.columns]
    return a.select(*columns).unionByName(b.select(*columns))


def band_mismatches(obs: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Objects whose bands aren't exactly these."""
    found = obs.groupBy("object_id").agg(F.array_sort(F.collect_set("band")).alias("bands"))
    return found.where(F.col("bands") != F.array(*map(F.lit, sorted(bands))))


def duplicate_points(obs: DataFrame) -> DataFrame:
    """(object_id, band, time) that stand more than once."""
    return obs.groupBy("object_id", "band", "time").agg(F.count("*").alias("n")).where("n > 1")


def sanity(obs: DataFrame, arrival: str = "tie") -> DataFrame:
    """is_sane per object: times rise strictly in every band, in order of arrival."""
    w = Window.partitionBy(*KEY).orderBy(arrival)
    steps = by_object(obs).withColumn("rises", F.coalesce(F.col("time") > F.lag("time").over(w), F.lit(True)))
    return steps.groupBy("object_id").agg(F.bool_and("rises").alias("is_sane"))


# ---------------------------------------------------------------- measures
def differences(obs: DataFrame) -> DataFrame:
    """dt, df and slope from the point before (null for the first, slope null if dt is 0)."""
    dt, df = (F.col(c) - F.lag(c).over(along()) for c in ("time", "flux"))
    return obs.withColumns({"dt": dt, "df": df}).withColumn("slope", F.try_divide("df", "dt"))


def band_arc_lengths(obs: DataFrame) -> DataFrame:
    """arc_length per (object, band): the path over detected points; 0 with fewer than two."""
    # undetected points are skipped without losing bands that have no other
    last = lambda c: F.last(F.when(F.col("detected") == 1, F.col(c)), ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, -1))
    steps = by_object(obs).withColumns({"_t": last("time"), "_f": last("flux")})
    length = F.sqrt(F.pow(F.col("time") - F.col("_t"), 2) + F.pow(F.col("flux") - F.col("_f"), 2))
    return steps.groupBy("object_id", "band").agg(F.coalesce(F.sum(F.when(F.col("detected") == 1, length)), F.lit(0.0)).alias("arc_length"))


def arc_lengths(obs: DataFrame) -> DataFrame:
    """arc_length per object, summed over bands."""
    return band_arc_lengths(obs).groupBy("object_id").agg(F.sum("arc_length").alias("arc_length"))


def point_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("object_id").agg(F.count("*").alias("n_points"), F.count_distinct("band").alias("n_bands"))


def distinct_times(obs: DataFrame) -> DataFrame:
    return obs.select("object_id", "time").distinct()


def time_spans(obs: DataFrame, *keys: str) -> DataFrame:
    return obs.groupBy(*(keys or ("object_id",))).agg((F.max("time") - F.min("time")).alias("span"))
