"""Text layouts: tagged supernova files with truth keys, and per-band magnitude files with a star table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.columns import magnitude_flux, magnitude_flux_err
from cadenza.operators.joins import override, strict_join
from cadenza.operators.lookups import ids_in_every_band
from cadenza.operators.windows import range_index

#: Tags that a supernova file has exactly once, and its point columns.
SINGLE_TAGS = ("SNTYPE", "SNID", "VARLIST")
POINT_TAG = "OBS"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file (its name) and path of every line."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))


def read_supernova(spark: SparkSession, path: str) -> DataFrame:
    """Points of tagged files: id, type, file, band, time, flux, flux_err."""
    return supernova_points(read_lines(spark, path))


def supernova_points(text: DataFrame) -> DataFrame:
    """The points in the lines (file, value) of tagged files, in any order.

    Lines are "TAG: values"; blank ones and comments are skipped. OBS values are named by the file's
    VARLIST. A file without exactly one SNTYPE, SNID and VARLIST is an error.
    """
    lines = text.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#") & F.col("value").contains(":"))
    tagged = lines.select("file", F.trim(F.split("value", ":", 2)[0]).alias("tag"), F.trim(F.split("value", ":", 2)[1]).alias("rest"))
    one = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("rest")))
    heads = tagged.where(F.col("tag").isin(*SINGLE_TAGS)).groupBy("file").agg(
        *(F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in SINGLE_TAGS), one("SNID").alias("id"), one("SNTYPE").alias("type"),
            F.split(F.trim(one("VARLIST")), r"\s+").alias("names")
    )
    points = tagged.where(F.col("tag") == POINT_TAG).select("file", F.split("rest", r"\s+").alias("values"))
    joined = points.join(heads, "file", "left")
    single = F.lit(True)
    for t in SINGLE_TAGS:
        single = single & (F.coalesce(F.col(f"n_{t}"), F.lit(0)) == 1)
    broken = F.raise_error(F.concat(F.col("file"), F.lit(" needs one each of " + ", ".join(SINGLE_TAGS)))).cast("array<string>")
    fields = joined.withColumn("m", F.map_from_arrays(F.when(single, F.col("names")).otherwise(broken), "values"))
    number = lambda c: F.element_at("m", F.lit(c)).cast("double")
    return fields.select(
        F.split("id", r"\s+")[0].cast("long").alias("id"), F.split("type", r"\s+")[0].cast("int").alias("type"), "file", F.element_at("m", F.lit("FLT")).alias("band"),
        number("MJD").alias("time"), number("FLUXCAL").alias("flux"), number("FLUXCALERR").alias("flux_err"),
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """file and type of the lines that name a .DAT file."""
    return truth_keys(read_lines(spark, path))


def truth_keys(text: DataFrame) -> DataFrame:
    """file and type of those lines (value) that name a .DAT file."""
    parts = text.where(F.col("value").contains(".DAT")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    return parts.select(F.col("p")[0].alias("file"), F.col("p")[1].cast("int").alias("type"))


def supernova_table(points: DataFrame, truth: DataFrame) -> DataFrame:
    """Long observations with the true class where it is known."""
    typed = override(points, truth, "file", "type")
    return typed.select(F.col("id").alias("object_id"), "band", "time", "flux", "flux_err", F.lit(1).alias("detected"), F.xxhash64("flux", "flux_err").alias("tie"), "type", "file")


def supernova_index(table: DataFrame) -> DataFrame:
    """[start, end) of every object's bands when the points are laid out in order."""
    return range_index(table, "object_id", "type", "file", "band")


def supernova_lookup(table: DataFrame, object_id: int) -> DataFrame:
    """One row per band with its points in order. A band that the object has in more than one file, or
    with more than one class, is an error of the job."""
    own = table.where(F.col("object_id") == object_id)
    found = own.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("time", "tie", "flux", "flux_err"))).alias("points"), F.count_distinct("type", "file").alias("_n"))
    several = F.raise_error(F.concat(F.lit(f"{object_id} has several curves in band "), F.col("band"))).cast("boolean")
    return found.where(F.when(F.col("_n") <= 1, F.lit(True)).otherwise(several)).drop("_n")


def read_magnitudes(spark: SparkSession, root: str, bands: Sequence[str]) -> DataFrame:
    """Files <root>/<band>/<id>.dat of "time mag mag_err": id, band, time, flux, flux_err. Only
    objects that every band's directory has; it is an error of the job if there are none."""
    return magnitude_points(read_lines(spark, f"{root.rstrip('/')}/*/*.dat"), bands)


def magnitude_points(text: DataFrame, bands: Sequence[str]) -> DataFrame:
    """The points in the lines (value, file, path) of per-band files."""
    parts = text.select(
        F.regexp_extract("file", r"^(.+)\.dat$", 1).alias("id"), F.element_at(F.split("path", "/"), -2).alias("band"), F.split(F.trim("value"), r"\s+").alias("p")
    ).where((F.col("id") != "") & (F.size("p") >= 3) & F.col("band").isin(*bands))
    number = lambda i: F.col("p")[i].cast("double")
    points = parts.select("id", "band", number(0).alias("time"), magnitude_flux(number(1)).alias("flux"), magnitude_flux_err(number(1), number(2)).alias("flux_err"))
    everywhere = ids_in_every_band(points, bands, "id")
    none = F.raise_error(F.lit("no object is in all bands: " + ", ".join(bands))).cast("boolean")
    checked = everywhere.agg(F.count("*").alias("_n")).where(F.when(F.col("_n") > 0, F.lit(False)).otherwise(none)).drop("_n")
    return points.join(everywhere, "id", "left_semi").unionByName(checked, allowMissingColumns=True)


def read_stars(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated star table with a header; all columns as text."""
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def magnitude_table(points: DataFrame, stars: DataFrame | None, columns: Sequence[str] = ("Field", "StarID", "Type", "Subtype")) -> DataFrame:
    """Points with the star table's columns; a star that the table lacks is an error."""
    if stars is None:
        return points
    return strict_join(points, stars.select(F.col("ID").alias("id"), *columns), "id")


def magnitude_lookup(table: DataFrame, star: str, prefix: str = "OGLE") -> DataFrame:
    """The points of one star; its id must start with the survey's prefix."""
    if not star.startswith(prefix):
        raise ValueError(f"{star}: ids start with {prefix}")
    return table.where(F.col("id") == star)
