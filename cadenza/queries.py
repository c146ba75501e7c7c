"""Registered queries of the operators over the driver's tables, each with the SQL of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import columns as C
from cadenza.functions.hashing import id_split, uniform
from cadenza.operators import curves, joins, lookups, stats, windows
from cadenza.plans import align, features, pairs, partners, periods
from cadenza.schemas import BandSpec
from cadenza.sources import placed, tables, text
from cadenza.storage import shared_path
from cadenza.views import EVENT_BANDS, EVENT_WAVELENGTHS, LINES_SQL, META_SQL, OBS_SQL, PAIRS_SQL, line_curves, metadata, observations, read, vector_pairs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SEED = 828372
#: A registered query's window: points on either side, days within which a band counts as seen.
N, RADIUS = 3, 2.0


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(table: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return table.withColumns({c: F.round(c, digits) for c in names})


def U(seed: object, *keys: str) -> str:
    """uniform() in SQL."""
    return f"(CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def WITH(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------- sources
@query("scan_narrow_types", WITH(OBS_SQL) + "SELECT CAST(object_id AS INTEGER) AS object_id, CAST(time AS FLOAT) AS mjd, CAST(passband AS INTEGER) "
    "AS passband, CAST(flux AS FLOAT) AS flux, CAST(flux_err AS FLOAT) AS flux_err, CAST(detected AS TINYINT) AS detected FROM obs")
def scan_narrow_types(spark, d):
    raw = observations(spark, d).select("object_id", F.col("time").alias("mjd"), "passband", "flux", "flux_err", "detected")
    return tables.narrowed(raw)


@query("metadata_union", "SELECT c_custkey AS object_id, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS target FROM customer")
def metadata_union(spark, d):
    c = read(spark, d, "customer")
    train = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("object_id"), F.col("c_nationkey").alias("target"))
    test = c.where("c_custkey % 2 <> 0").select(F.col("c_custkey").alias("object_id"))
    return tables.stacked_metadata(train, test)


@query("drop_header_rows", "SELECT c_custkey AS object_id, CAST(c_nationkey AS BIGINT) AS target FROM customer")
def drop_header_rows(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("object_id"), F.col("c_nationkey").cast("string").alias("target"))
    header = c.agg(F.lit("object_id").alias("object_id"), F.lit("target").alias("target"))
    return tables.drop_header_rows(c.unionByName(header))


@query("passband_names", WITH(OBS_SQL) + "SELECT object_id, band, count(*) AS n FROM obs GROUP BY 1, 2")
def passband_names(spark, d):
    raw = observations(spark, d).select("object_id", F.col("time").alias("mjd"), "passband", "flux", "flux_err", "detected")
    return tables.with_bands(raw, BandSpec("events", EVENT_BANDS)).groupBy("object_id", "band").agg(F.count("*").alias("n"))


@query("packed_curves", WITH(OBS_SQL) + "SELECT object_id, band, len(list(tie)) AS n, round(list_sum(list(flux)), 6) AS flux_sum, first(tie ORDER BY "
    "time, tie) AS first_tie FROM obs GROUP BY 1, 2")
def packed_curves(spark, d):
    p = tables.packed(observations(spark, d))
    back = tables.unpacked(p).groupBy("object_id", "band").agg(F.count("*").alias("n"), F.round(F.sum("flux"), 6).alias("flux_sum"))
    return back.join(p.select("object_id", "band", F.col("points")[0]["tie"].alias("first_tie")), ["object_id", "band"])


def _raw(spark, d):
    return observations(spark, d).select("object_id", F.col("time").alias("mjd"), "passband", "flux", "flux_err", "detected")


_RAW_SQL = WITH(OBS_SQL) + "SELECT object_id, passband, round(time, 6) AS mjd, flux, round(flux_err, 6) AS flux_err, detected FROM obs"


@query("observation_csv", WITH(OBS_SQL) + "SELECT object_id, band, round(time, 6) AS time, flux, round(flux_err, 6) AS flux_err, detected FROM obs")
def observation_csv(spark, d):
    path = shared_path(spark, "observations")
    _raw(spark, d).write.option("header", True).csv(path)
    found = tables.with_bands(tables.read_observations(spark, path), BandSpec("events", EVENT_BANDS))
    return rounded(found.select("object_id", "band", "time", "flux", "flux_err", "detected"), "time", "flux_err")


@query("observation_table", _RAW_SQL)
def observation_table(spark, d):
    path = shared_path(spark, "observations")
    tables.write_table(_raw(spark, d), path)
    return rounded(tables.open_dataset(spark, "observations", {"observations": path}), "mjd", "flux_err")


def _tagged_lines(spark, d):
    """The observations as lines of tagged files, one file an object, with what such files have besides."""
    o = observations(spark, d)
    file = F.concat(F.lit("SN_"), F.col("object_id"), F.lit(".DAT")).alias("file")
    head = F.array(
        F.lit("SURVEY: EVENTS"), F.lit("# a comment"), F.concat(F.lit("SNID:   "), F.col("object_id")), F.concat(F.lit("SNTYPE: "), F.col("object_id") % 7, F.lit(" (class)")),
        F.lit("VARLIST:  MJD FLT FIELD FLUXCAL FLUXCALERR"), F.lit(""), F.lit("DETECTION: 1"), F.lit("END:"),
    )
    points = o.select(file, F.concat_ws(" ", F.lit("OBS: "), "time", "band", F.lit("F1"), "flux", "flux_err").alias("value"))
    return points.unionByName(o.select("object_id").distinct().select(file, F.explode(head).alias("value")))


def _truth_lines(spark, d):
    ids = observations(spark, d).select("object_id").distinct()
    named = ids.where("object_id % 2 = 0").select(F.concat(F.lit(" SN_"), F.col("object_id"), F.lit(".DAT   "), F.col("object_id") % 5 + 20).alias("value"))
    return named.unionByName(ids.select(F.concat(F.lit("# no key "), F.col("object_id")).alias("value")))


def _supernovae(spark, d):
    return text.supernova_table(text.supernova_points(_tagged_lines(spark, d)), text.truth_keys(_truth_lines(spark, d)))


_TYPE = "CAST(CASE WHEN object_id % 2 = 0 THEN object_id % 5 + 20 ELSE object_id % 7 END AS INTEGER)"


@query("truth_keys", WITH(OBS_SQL) + "SELECT DISTINCT 'SN_' || object_id || '.DAT' AS file, CAST(object_id % 5 + 20 AS INTEGER) AS type FROM obs WHERE object_id % 2 = 0")
def truth_keys(spark, d):
    return text.truth_keys(_truth_lines(spark, d))


@query("supernova_table", WITH(OBS_SQL) + f"SELECT object_id, band, round(time, 6) AS time, flux, round(flux_err, 6) AS flux_err, 1 AS detected, {_TYPE} AS type, 'SN_' || object_id || '.DAT' AS file FROM obs")
def supernova_table(spark, d):
    return rounded(_supernovae(spark, d).drop("tie"), "time", "flux_err")


@query("supernova_index", WITH(OBS_SQL) + f"SELECT object_id, {_TYPE} AS type, band, CAST(sum(n) OVER (ORDER BY object_id, band) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY object_id, band) AS BIGINT) AS \"end\" FROM (SELECT object_id, band, count(*) AS n FROM obs GROUP BY 1, 2)")
def supernova_index(spark, d):
    return text.supernova_index(_supernovae(spark, d)).drop("file")


@query("supernova_lookup", WITH(OBS_SQL) + "SELECT band, count(*) AS n, round(min(time), 6) AS first_time, round(sum(flux), 6) AS flux FROM obs WHERE object_id = 7 GROUP BY 1")
def supernova_lookup(spark, d):
    own = text.supernova_lookup(_supernovae(spark, d), 7)
    total = F.aggregate(F.transform("points", lambda p: p["flux"]), F.lit(0.0), lambda a, x: a + x)
    return own.select("band", F.size("points").cast("long").alias("n"), F.round(F.col("points")[0]["time"], 6).alias("first_time"), F.round(total, 6).alias("flux"))


@query("star_table", WITH(META_SQL) + "SELECT 'S-' || object_id AS \"ID\", segment AS \"Field\", CAST(target AS VARCHAR) AS \"StarID\" FROM meta")
def star_table(spark, d):
    path = shared_path(spark, "stars")
    stars = metadata(spark, d).select(F.concat(F.lit("S-"), F.col("object_id")).alias("ID"), F.col("segment").alias("Field"), F.col("target").alias("StarID"))
    stars.write.option("header", True).option("sep", "\t").csv(path)
    return text.read_stars(spark, path)


@query(
    "magnitude_table",
    WITH(OBS_SQL, META_SQL, "mags AS (SELECT object_id, band, time, 15 + flux / 100 AS mag, flux_err FROM obs WHERE band IN ('click', 'view') AND "
        "NOT (band = 'view' AND object_id % 4 = 0))")
    + "SELECT 'S-' || object_id AS id, band, round(time, 6) AS time, round(1e23 * pow(10, -0.4 * (mag + 48.6)) * 1e6, 6) AS flux, round(flux_err / "
        "mag * 1e23 * pow(10, -0.4 * (mag + 48.6)) * 1e6, 6) AS flux_err, segment AS \"Field\" FROM mags JOIN meta USING (object_id) WHERE object_id "
        "IN (SELECT object_id FROM mags GROUP BY 1 HAVING count(DISTINCT band) = 2)",
)
def magnitude_table(spark, d):
    o = observations(spark, d).where("not (band = 'view' and object_id % 4 = 0)")
    file = F.concat(F.lit("S-"), F.col("object_id"), F.lit(".dat"))
    lines = o.select(F.concat_ws(" ", "time", 15 + F.col("flux") / 100, "flux_err").alias("value"), file.alias("file"), F.concat(F.lit("/survey/"),
        F.col("band"), F.lit("/"), file).alias("path"))
    stars = metadata(spark, d).select(F.concat(F.lit("S-"), F.col("object_id")).alias("ID"), F.col("segment").alias("Field"))
    found = text.magnitude_table(text.magnitude_points(lines, ("click", "view")), stars, ("Field",))
    return found.select("id", "band", F.round("time", 6).alias("time"), F.round(F.col("flux") * 1e6, 6).alias("flux"), F.round(F.col("flux_err") * 1e6,
        6).alias("flux_err"), "Field")


@query("checked_curves", WITH(LINES_SQL) + "SELECT CAST(object_id AS VARCHAR) AS name, round(time, 6) AS time, flux AS value, round(flux_err, 6) AS error FROM obs")
def checked_curves(spark, d):
    named = line_curves(spark, d).select(F.col("object_id").cast("string").alias("name"), "time", F.col("flux").alias("value"), F.col("flux_err").alias("error"))
    return rounded(tables.checked_curves(named), "time", "error")


@query("sorted_source", WITH(OBS_SQL) + "SELECT object_id AS source_id, tie, row_number() OVER (ORDER BY object_id, time) - 1 AS pos, (SELECT "
    "count(*) FROM obs b WHERE b.object_id < a.object_id) AS min_row, (SELECT count(*) - 1 FROM obs b WHERE b.object_id <= a.object_id) AS max_row "
    "FROM obs a")
def sorted_source(spark, d):
    rows = observations(spark, d).select(F.col("object_id").alias("source_id"), "time", "flux", F.col("flux_err").alias("flux_error"), "tie")
    placed, index = tables.sorted_source(rows)
    return placed.join(index, "source_id").select("source_id", "tie", "pos", "min_row", "max_row")


# ---------------------------------------------------------------- projections and filters
@query("mag_to_flux", WITH(OBS_SQL) + "SELECT tie, round(flux, 6) AS mag, round(1e23 * pow(10, -0.4 * (flux + 48.6)) * 1000, 6) AS flux, "
    "round(flux_err / flux * 1e23 * pow(10, -0.4 * (flux + 48.6)) * 1000, 6) AS flux_err FROM obs WHERE flux > 5")
def mag_to_flux(spark, d):
    o = observations(spark, d).where("flux > 5")
    return o.select("tie", F.round("flux", 6).alias("mag"), F.round(C.magnitude_flux("flux") * 1000, 6).alias("flux"),
        F.round(C.magnitude_flux_err("flux", "flux_err") * 1000, 6).alias("flux_err"))


@query("linear_xform", WITH(OBS_SQL) + "SELECT object_id, band, tie, round(3 * (time + 1), 6) AS time, round(4 * (flux + 2), 6) AS flux, "
    "round(sqrt(4.0) * flux_err, 6) AS flux_err FROM obs")
def linear_xform(spark, d):
    o = curves.linear_transform(observations(spark, d), 1.0, 2.0, 3.0, 4.0)
    return rounded(o.select("object_id", "band", "tie", "time", "flux", "flux_err"), "time", "flux", "flux_err")


@query("column_xform", WITH(OBS_SQL) + "SELECT tie, round(time / 2, 6) AS time, round(ln(1 + flux), 6) AS flux, detected FROM obs")
def column_xform(spark, d):
    o = curves.transform_columns(observations(spark, d), time=lambda t: t / 2, flux=lambda f: F.log(1 + f))
    return rounded(o.select("tie", "time", "flux", "detected"), "time", "flux")


_BAND_XF = "x(band, tt, tf, dt, df) AS (VALUES ('click', 0.1, 1.0, 1.0, 2.0), ('error', 0.2, 2.0, 1.5, 1.0), ('purchase', 0.3, 3.0, 2.0, 0.5), ('signup', 0.4, 4.0, 2.5, 4.0), ('view', 0.5, 5.0, 3.0, 1.0))"


@query("independent_band_xform", WITH(OBS_SQL, _BAND_XF) + "SELECT tie, band, round(dt * (time + tt), 6) AS time, round(df * (flux + tf), 6) AS "
    "flux, round(sqrt(df) * flux_err, 6) AS flux_err FROM obs JOIN x USING (band)")
def independent_band_xform(spark, d):
    rows = [("click", 0.1, 1.0, 1.0, 2.0), ("error", 0.2, 2.0, 1.5, 1.0), ("purchase", 0.3, 3.0, 2.0, 0.5), ("signup", 0.4, 4.0, 2.5, 4.0), ("view", 0.5, 5.0, 3.0, 1.0)]
    x = spark.createDataFrame(rows, "band string, translate_time double, translate_flux double, dilate_time double, dilate_flux double")
    return rounded(curves.transform_by(observations(spark, d), x, "band").select("tie", "band", "time", "flux", "flux_err"), "time", "flux", "flux_err")


@query("same_xform_label", WITH(OBS_SQL) + "SELECT DISTINCT object_id, 't + 1.0000, f + 0.5000, t * 2.0000, f * 1.0000' AS last_transform FROM obs")
def same_xform_label(spark, d):
    return curves.transform_all(observations(spark, d), 1.0, 0.5, 2.0, 1.0).select("object_id", "last_transform").distinct()


@query("before_after_time", WITH(OBS_SQL) + "SELECT object_id, count(*) FILTER (WHERE time + 1e-8 < 10) AS n_before, count(*) FILTER (WHERE time > "
    "20 + 1e-8) AS n_after FROM obs GROUP BY 1")
def before_after_time(spark, d):
    o = observations(spark, d)
    before = curves.before_time(o, 10.0).groupBy("object_id").agg(F.count("*").alias("n_before"))
    after = curves.after_time(o, 20.0).groupBy("object_id").agg(F.count("*").alias("n_after"))
    both = curves.by_object(o.select("object_id")).distinct().join(before, "object_id", "left").join(after, "object_id", "left")
    return both.na.fill(0)


#: Every three days of an object as an object of its own, so that some lack a band.
_STRETCHES_SQL = "(SELECT object_id * 1000 + CAST(floor(time / 3) AS BIGINT) AS object_id, band FROM obs)"


def _stretches(spark, d):
    return observations(spark, d).withColumn("object_id", F.col("object_id") * 1000 + F.floor(F.col("time") / 3))


@query("band_set_validation", WITH(OBS_SQL) + "SELECT object_id, array_to_string(list_sort(list(DISTINCT band)), ',') AS bands FROM " + _STRETCHES_SQL + " GROUP BY 1 HAVING count(DISTINCT band) <> 5")
def band_set_validation(spark, d):
    return curves.band_mismatches(_stretches(spark, d), EVENT_BANDS).select("object_id", F.array_join("bands", ",").alias("bands"))


@query("duplicate_points", WITH("obs AS (SELECT l_suppkey AS object_id, l_returnflag AS band, l_shipdate FROM lineitem)") + "SELECT object_id, band, count(*) AS "
    "n_times, CAST(sum(n) AS BIGINT) AS n_points FROM (SELECT object_id, band, l_shipdate, count(*) AS n FROM obs GROUP BY 1, 2, 3 HAVING count(*) > "
    "1) GROUP BY 1, 2")
def duplicate_points(spark, d):
    return curves.duplicate_points(line_curves(spark, d)).groupBy("object_id", "band").agg(F.count("*").alias("n_times"), F.sum("n").alias("n_points"))


_PWAV = "CASE band WHEN 'click' THEN 368.55 WHEN 'error' THEN 484.45 WHEN 'purchase' THEN 622.95 WHEN 'signup' THEN 753.55 ELSE 868.65 END"


@query("lc2d_pwav", WITH(OBS_SQL) + f"SELECT tie, CAST({_PWAV} AS DOUBLE) AS pwav, round(time, 6) AS time, flux, round(flux_err, 6) AS flux_err, detected FROM obs")
def lc2d_pwav(spark, d):
    two = curves.two_dimensional(curves.wavelengths(observations(spark, d), EVENT_WAVELENGTHS, EVENT_BANDS))
    return two.select("tie", F.col("invars")[0].alias("pwav"), F.round(F.col("invars")[1], 6).alias("time"), F.col("outvars")[0].alias("flux"),
        F.round(F.col("outvars")[1], 6).alias("flux_err"), "detected")


@query("dense_array_points", WITH(OBS_SQL) + "SELECT object_id, band, count(*) AS n, round(sum(time), 6) AS time_sum, round(sum(flux), 6) AS "
    "flux_sum, round(sum(flux_err), 6) AS err_sum FROM obs GROUP BY 1, 2")
def dense_array_points(spark, d):
    dense = observations(spark, d).groupBy("object_id", "band").agg(F.collect_list(F.array("time", "flux", "flux_err")).alias("points"))
    return curves.from_arrays(dense).groupBy("object_id", "band").agg(F.count("*").alias("n"), F.round(F.sum("time"), 6).alias("time_sum"),
        F.round(F.sum("flux"), 6).alias("flux_sum"), F.round(F.sum("flux_err"), 6).alias("err_sum"))


@query("phase_fold", WITH(OBS_SQL) + "SELECT tie, round(time - 2.5 * floor(time / 2.5), 6) AS phase FROM obs")
def phase_fold(spark, d):
    return observations(spark, d).select("tie", F.round(C.phase("time", F.lit(2.5)), 6).alias("phase"))


@query("display_name", WITH(META_SQL) + "SELECT object_id, 'Object ' || object_id || CASE WHEN target % 2 = 0 THEN ', target ' || target ELSE '' END AS name FROM meta")
def display_name(spark, d):
    m = metadata(spark, d).select("object_id", F.when(F.col("target") % 2 == 0, F.col("target")).alias("target"))
    return curves.display_names(m).select("object_id", "name")


@query("detected_split", WITH(OBS_SQL) + "SELECT object_id, band, count(*) FILTER (WHERE detected = 1) AS n_detected, count(*) FILTER (WHERE "
    "detected = 0) AS n_undetected FROM obs GROUP BY 1, 2")
def detected_split(spark, d):
    o = curves.with_detected(observations(spark, d))
    return o.groupBy("object_id", "band").agg(F.count_if(F.col("detected") == 1).alias("n_detected"), F.count_if(F.col("detected") == 0).alias("n_undetected"))


@query("detected_default", WITH(OBS_SQL) + "SELECT tie, CASE WHEN tie % 3 = 0 THEN 1 ELSE detected END AS detected, 1 AS absent FROM obs")
def detected_default(spark, d):
    o = observations(spark, d)
    some = curves.with_detected(o.withColumn("detected", F.when(F.col("tie") % 3 != 0, F.col("detected"))))
    none = curves.with_detected(o.drop("detected")).select("tie", F.col("detected").alias("absent"))
    return some.select("tie", "detected").join(none, "tie")


@query("one_band", WITH(OBS_SQL) + "SELECT object_id, tie, round(time, 6) AS time, flux FROM obs WHERE band = 'purchase' AND detected = 1")
def one_band(spark, d):
    return rounded(curves.detected_points(curves.one_band(observations(spark, d), "purchase")).select("object_id", "tie", "time", "flux"), "time")


# ---------------------------------------------------------------- lookups
@query("lookup_by_id", WITH(OBS_SQL) + "SELECT object_id, band, tie, round(time, 6) AS time, flux FROM obs WHERE object_id = 7")
def lookup_by_id(spark, d):
    return rounded(lookups.curve(observations(spark, d), 7, missing="error").select("object_id", "band", "tie", "time", "flux"), "time")


@query("lookup_by_target", WITH(OBS_SQL, META_SQL) + "SELECT object_id, band, tie, flux FROM obs WHERE object_id IN (SELECT object_id FROM meta WHERE target = 3)")
def lookup_by_target(spark, d):
    return lookups.curves_of_class(observations(spark, d), metadata(spark, d), 3).select("object_id", "band", "tie", "flux")


@query("lookup_by_id_list", WITH(OBS_SQL, META_SQL) + "SELECT o.object_id, band, tie, flux, target FROM obs o LEFT JOIN meta USING (object_id) WHERE o.object_id IN (1, 5, 9)")
def lookup_by_id_list(spark, d):
    return lookups.curves_of_ids(observations(spark, d), metadata(spark, d), lookups.id_table(spark, [1, 5, 9, 5])).select("object_id", "band", "tie", "flux", "target")


@query("curves_with_metadata", WITH(OBS_SQL, META_SQL) + "SELECT object_id, target, segment, count(*) AS n, round(sum(flux), 6) AS flux FROM obs "
    "JOIN meta USING (object_id) GROUP BY 1, 2, 3")
def curves_with_metadata(spark, d):
    return lookups.with_metadata(observations(spark, d), metadata(spark, d)).groupBy("object_id", "target", "segment").agg(F.count("*").alias("n"),
        F.round(F.sum("flux"), 6).alias("flux"))


@query("all_object_ids", WITH(OBS_SQL) + "SELECT DISTINCT object_id FROM obs")
def all_object_ids(spark, d):
    return lookups.object_ids(observations(spark, d))


@query("row_by_position", "SELECT object_id, target FROM (SELECT c_custkey AS object_id, c_nationkey AS target, row_number() OVER (ORDER BY "
    "c_custkey) - 1 AS pos FROM customer) WHERE pos = 100")
def row_by_position(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), F.col("c_nationkey").alias("target"))
    return lookups.row_at(c, 100)


@query("placed_slice", WITH(OBS_SQL) + "SELECT object_id, band, tie, pos FROM (SELECT *, row_number() OVER (ORDER BY object_id, band, time, tie) - 1 "
    "AS pos FROM obs) WHERE pos >= 700 AND pos < 950")
def placed_slice(spark, d):
    path = shared_path(spark, "placed")
    placed.write_placed(observations(spark, d), path, "object_id", "band", "time", "tie")
    return placed.placed_slice(spark, path, 700, 950).select("object_id", "band", "tie", "pos")


@query("bucketed_join", WITH(OBS_SQL, META_SQL) + "SELECT object_id, target, segment, count(*) AS n, round(sum(flux), 6) AS flux FROM obs JOIN meta "
    "USING (object_id) GROUP BY 1, 2, 3")
def bucketed_join(spark, d):
    opened = []
    for name, table in (("curves", observations(spark, d)), ("objects", metadata(spark, d))):
        path = shared_path(spark, name)
        known = path.rsplit("/", 1)[-1].replace("-", "_")
        tables.write_bucketed(table, known, path, 8)
        opened.append(tables.open_dataset(spark, known, {}))
    joined = lookups.with_metadata(*opened)
    return joined.groupBy("object_id", "target", "segment").agg(F.count("*").alias("n"), F.round(F.sum("flux"), 6).alias("flux"))


@query("magnitude_lookup", "SELECT c_name AS id, c_custkey FROM customer WHERE c_name = 'Customer#000000101'")
def magnitude_lookup(spark, d):
    return text.magnitude_lookup(read(spark, d, "customer").select(F.col("c_name").alias("id"), "c_custkey"), "Customer#000000101", "Customer")


@query("random_sample", f"SELECT c_custkey AS object_id FROM customer ORDER BY {U(SEED, 'c_custkey')}, c_custkey LIMIT 20")
def random_sample(spark, d):
    return lookups.sample(read(spark, d, "customer").select(F.col("c_custkey").alias("object_id")), 20, SEED)


@query("answered_ids", "SELECT DISTINCT c_custkey AS object_id FROM customer WHERE c_nationkey <> 9")
def answered_ids(spark, d):
    return lookups.answered(read(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), F.col("c_nationkey").alias("target")), 9)


@query("ids_by_subtype", WITH(META_SQL) + "SELECT segment, array_to_string(list_sort(list(DISTINCT object_id)), ',') AS ids FROM meta GROUP BY 1")
def ids_by_subtype(spark, d):
    return lookups.ids_by(metadata(spark, d), "segment").select("segment", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("prefixed_ids", "SELECT c_name, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefixed_ids(spark, d):
    return lookups.with_prefix(read(spark, d, "customer"), "Customer#00000001", "c_name").select("c_name", "c_custkey")


@query("ids_outside", "SELECT c_custkey AS object_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def ids_outside(spark, d):
    return lookups.outside(read(spark, d, "customer").select(F.col("c_custkey").alias("object_id")), lookups.object_ids(observations(spark, d)))


@query("first_curves", WITH(OBS_SQL) + "SELECT object_id, tie FROM obs WHERE object_id IN (SELECT DISTINCT object_id FROM obs ORDER BY 1 LIMIT 3)")
def first_curves(spark, d):
    return lookups.first_curves(observations(spark, d), 3).select("object_id", "tie")


# ---------------------------------------------------------------- joins
@query("truth_override", WITH(META_SQL) + "SELECT object_id, CASE WHEN object_id % 3 = 0 THEN target + 100 ELSE target END AS target FROM meta")
def truth_override(spark, d):
    m = metadata(spark, d)
    truth = m.where("object_id % 3 = 0").select("object_id", (F.col("target") + 100).alias("target"))
    return joins.override(m.select("object_id", "target"), truth, "object_id", "target")


@query("strict_join", WITH(OBS_SQL, META_SQL) + "SELECT segment, count(*) AS n FROM obs JOIN meta USING (object_id) GROUP BY 1")
def strict_join(spark, d):
    return joins.strict_join(observations(spark, d), metadata(spark, d).select("object_id", "segment"), "object_id").groupBy("segment").agg(F.count("*").alias("n"))


_ASKS = "asks AS (SELECT object_id, CAST(k AS DOUBLE) AS request_time FROM (SELECT DISTINCT object_id FROM obs), (VALUES (0.0), (7.3), (15.0), (29.9)) AS v(k))"
_NEAR = """near AS (SELECT a.object_id, o.band, a.request_time, o.time, o.flux, o.detected, abs(o.time - a.request_time) AS diff,
  row_number() OVER (PARTITION BY a.object_id, o.band, a.request_time ORDER BY abs(o.time - a.request_time), o.time, o.tie) AS nth FROM asks a JOIN obs o USING (object_id))"""


def requests(obs: DataFrame, times=(0.0, 7.3, 15.0, 29.9)) -> DataFrame:
    return obs.select("object_id").distinct().withColumn("request_time", F.explode(F.array(*map(F.lit, times))))


@query("closest_point", WITH(OBS_SQL, _ASKS, _NEAR) + "SELECT object_id, band, request_time, round(time, 6) AS closest_time, flux AS closest_flux, "
    "detected AS closest_detected, round(diff, 6) AS closest_time_diff FROM near WHERE nth = 1")
def closest_point(spark, d):
    o = observations(spark, d)
    near = joins.closest_points(o, requests(o), carry=("time", "flux", "detected"))
    return rounded(near, "closest_time", "closest_time_diff")


@query("densify_bands", WITH(OBS_SQL, "asks AS (SELECT DISTINCT object_id, time AS request_time FROM obs WHERE band = 'click')",
    _NEAR) + "SELECT object_id, round(request_time, 6) AS time, " + ", ".join(f"max(flux) FILTER (WHERE band = '{b}') AS flux_{b}" for b in EVENT_BANDS) + " FROM near WHERE nth = 1 GROUP BY object_id, request_time")
def densify_bands(spark, d):
    dense = joins.densify(observations(spark, d), EVENT_BANDS)
    return rounded(dense.select("object_id", "time", *(f"flux_{b}" for b in EVENT_BANDS)), "time")


@query("band_region_join", WITH(OBS_SQL, _ASKS) + "SELECT a.object_id, a.request_time, array_to_string(list_sort(list(DISTINCT o.band)), ',') AS "
    "bands FROM asks a JOIN obs o ON o.object_id = a.object_id AND a.request_time - 1.5 < o.time AND o.time < a.request_time + 1.5 GROUP BY 1, 2")
def band_region_join(spark, d):
    o = observations(spark, d)
    return joins.region_bands(o, requests(o), 1.5).select("object_id", "request_time", F.array_join("bands", ",").alias("bands"))


@query(
    "band_coverage_histogram",
    WITH(OBS_SQL, "t AS (SELECT DISTINCT object_id, time AS request_time FROM obs)")
    + "SELECT radius, n_bands, count(*) AS n_times FROM (SELECT CAST(r AS DOUBLE) AS radius, a.object_id, a.request_time, CAST(count(DISTINCT "
        "o.band) AS INTEGER) AS n_bands FROM t a, (VALUES (1), (2), (4), (8), (16), (32), (64), (128)) AS v(r), obs o WHERE o.object_id = "
        "a.object_id AND a.request_time - r < o.time AND o.time < a.request_time + r GROUP BY 1, 2, 3) GROUP BY 1, 2",
)
def band_coverage_histogram(spark, d):
    return joins.coverage(observations(spark, d), [2.0**i for i in range(8)])


_RANKED = f"""ranked AS (SELECT target, object_id, row_number() OVER (PARTITION BY target ORDER BY {U(SEED, 'object_id')}, object_id) - 1 AS pos, count(*) OVER (PARTITION BY target) AS n FROM meta WHERE target IS NOT NULL),
classes AS (SELECT target, row_number() OVER (ORDER BY target) - 1 AS c, count(*) OVER () AS k FROM (SELECT DISTINCT target FROM ranked))"""


def _drawn(n: str = "SELECT count(*) FROM meta") -> str:
    return f"""drawn AS (SELECT pair_id, cl, (cl + 1 + CAST(floor({U(SEED, "'r'", 'pair_id')} * (k - 1)) AS BIGINT)) % k AS cr FROM (
  SELECT pair_id, k, CAST(floor({U(SEED, "'l'", 'pair_id')} * k) AS BIGINT) AS cl FROM (SELECT unnest(range(n)) AS pair_id FROM (SELECT ({n}) AS n)), (SELECT max(k) AS k FROM classes))),
used AS (SELECT pair_id, side, c, row_number() OVER (PARTITION BY c ORDER BY pair_id, side) - 1 AS use FROM (SELECT pair_id, 'left' AS side, cl AS c FROM drawn UNION ALL SELECT pair_id, 'right', cr FROM drawn)),
chosen AS (SELECT u.pair_id, u.side, r.object_id, r.target FROM used u JOIN classes USING (c) JOIN ranked r ON r.target = classes.target AND r.pos = u.use % r.n)"""


@query("negative_pairs", WITH(OBS_SQL, META_SQL, _RANKED, _drawn()) + "SELECT pair_id, max(object_id) FILTER (WHERE side = 'left') AS left_id, "
    "max(object_id) FILTER (WHERE side = 'right') AS right_id, max(target) FILTER (WHERE side = 'left') AS left_target, max(target) FILTER (WHERE "
    "side = 'right') AS right_target FROM chosen GROUP BY 1")
def negative_pairs(spark, d):
    return joins.different_class_pairs(metadata(spark, d), None, SEED)


@query("same_class_pairs", WITH(META_SQL) + "SELECT a.target, a.object_id AS left_id, b.object_id AS right_id FROM meta a JOIN meta b ON a.target = "
    "b.target AND a.object_id <> b.object_id")
def same_class_pairs(spark, d):
    return joins.same_class_pairs(metadata(spark, d))


@query("pair_curves", WITH(OBS_SQL, META_SQL) + "SELECT a.object_id * 100000 + b.object_id AS pair_id, o.object_id = a.object_id AS is_left, "
    "count(*) AS n FROM meta a JOIN meta b ON a.target = b.target AND a.object_id < b.object_id JOIN obs o ON o.object_id IN (a.object_id, "
    "b.object_id) GROUP BY 1, 2")
def pair_curves(spark, d):
    return joins.counted_sides(joins.class_curves(metadata(spark, d), observations(spark, d), 100_000))


# ---------------------------------------------------------------- aggregates
_STEPS = """steps AS (SELECT object_id, band, sqrt(pow(time - lag(time) OVER w, 2) + pow(flux - lag(flux) OVER w, 2)) AS step FROM obs WHERE detected = 1 WINDOW w AS (PARTITION BY object_id, band ORDER BY time, tie)),
band_arcs AS (SELECT b.object_id, b.band, coalesce(sum(step), 0.0) AS arc_length FROM (SELECT DISTINCT object_id, band FROM obs) b LEFT JOIN steps s ON s.object_id = b.object_id AND s.band = b.band GROUP BY 1, 2)"""


@query("arc_length_band", WITH(OBS_SQL, _STEPS) + "SELECT object_id, band, round(arc_length, 6) AS arc_length FROM band_arcs")
def arc_length_band(spark, d):
    return rounded(curves.band_arc_lengths(observations(spark, d)), "arc_length")


@query("arc_length_object", WITH(OBS_SQL, _STEPS) + "SELECT object_id, round(sum(arc_length), 6) AS arc_length FROM band_arcs GROUP BY 1")
def arc_length_object(spark, d):
    return rounded(curves.arc_lengths(observations(spark, d)), "arc_length")


@query("arc_length_by_class", WITH(OBS_SQL, META_SQL, _STEPS) + "SELECT target, count(*) AS n_objects, round(avg(arc_length), 6) AS mean_arc_length "
    "FROM (SELECT object_id, sum(arc_length) AS arc_length FROM band_arcs GROUP BY 1) JOIN meta USING (object_id) GROUP BY 1")
def arc_length_by_class(spark, d):
    arcs = lookups.with_metadata(curves.arc_lengths(observations(spark, d)), metadata(spark, d))
    return arcs.groupBy("target").agg(F.count("*").alias("n_objects"), F.round(F.avg("arc_length"), 6).alias("mean_arc_length"))


@query("point_counts", WITH(OBS_SQL) + "SELECT object_id, count(*) AS n_points, count(DISTINCT band) AS n_bands FROM obs GROUP BY 1")
def point_counts(spark, d):
    return curves.point_counts(observations(spark, d))


@query("is_sane", WITH(OBS_SQL) + "SELECT object_id, bool_and(coalesce(time > prev, true)) AS is_sane FROM (SELECT object_id, time, lag(time) OVER "
    "(PARTITION BY object_id, band ORDER BY (tie * 7919) % 10007, tie) AS prev FROM (SELECT *, tie AS t FROM obs WHERE object_id % 2 = 1 ) UNION ALL "
    "SELECT object_id, time, lag(time) OVER (PARTITION BY object_id, band ORDER BY tie) FROM obs WHERE object_id % 2 = 0) GROUP BY 1")
def is_sane(spark, d):
    o = observations(spark, d)
    arrival = F.when(F.col("object_id") % 2 == 1, (F.col("tie") * 7919) % 10007).otherwise(F.col("tie"))
    return curves.sanity(o.withColumn("arrival", F.struct(arrival.alias("a"), F.col("tie").alias("b"))), "arrival")


@query("all_times_unique", WITH(OBS_SQL) + "SELECT object_id, count(DISTINCT time) AS n_times, round(min(time), 6) AS first_time, round(max(time), "
    "6) AS last_time FROM obs GROUP BY 1")
def all_times_unique(spark, d):
    t = curves.distinct_times(observations(spark, d))
    return t.groupBy("object_id").agg(F.count("*").alias("n_times"), F.round(F.min("time"), 6).alias("first_time"), F.round(F.max("time"), 6).alias("last_time"))


@query("time_span", WITH(OBS_SQL) + "SELECT object_id, band, round(max(time) - min(time), 6) AS span FROM obs GROUP BY 1, 2")
def time_span(spark, d):
    return rounded(curves.time_spans(observations(spark, d), "object_id", "band"), "span")


@query("target_breakdown", WITH(META_SQL) + "SELECT target, count(*) AS n FROM meta GROUP BY 1")
def target_breakdown(spark, d):
    return stats.class_counts(metadata(spark, d))


_MOMENTS = "n, least, most, round(mean, 6) AS mean, round(variance, 6) AS variance, round((m3 - 3 * mean * m2 + 2 * pow(mean, 3)) / pow(m2 - mean * mean, 1.5), 5) AS skewness, round((m4 - 4 * mean * m3 + 6 * mean * mean * m2 - 3 * pow(mean, 4)) / pow(m2 - mean * mean, 2) - 3, 5) AS kurtosis"


@query("describe", WITH(OBS_SQL) + f"SELECT band, {_MOMENTS} FROM (SELECT band, count(*) AS n, min(flux) AS least, max(flux) AS most, avg(flux) AS mean, var_samp(flux) AS variance, avg(flux * flux) AS m2, avg(pow(flux, 3)) AS m3, avg(pow(flux, 4)) AS m4 FROM obs GROUP BY 1)")
def describe(spark, d):
    t = stats.describe(observations(spark, d), "flux", "band")
    return rounded(rounded(t, "mean", "variance"), "skewness", "kurtosis", digits=5)


@query("median_dt", WITH(OBS_SQL) + "SELECT round(quantile_cont(dt, 0.5), 6) AS median_dt FROM (SELECT time - lag(time) OVER (PARTITION BY "
    "object_id, band ORDER BY time, tie) AS dt FROM obs)")
def median_dt(spark, d):
    return rounded(stats.median_interval(observations(spark, d)), "median_dt")


def _grid_sql(n: int, extra: int, value: str, keys: str, source: str) -> str:
    """percentile_cutoffs() in SQL: cuts(keys, cutoffs)."""
    quant = lambda m: f"list_sort(list_distinct(quantile_cont({value}, [{', '.join(repr(i / (m + 1)) for i in range(1, m + 1))}])))"
    grids = ", ".join(f"{quant(m)} AS g{m}" for m in range(n, n + extra + 1))
    pick = " ".join(f"WHEN len(g{m}) >= {n} THEN g{m}[1:{n}]" for m in range(n, n + extra + 1))
    last = f"g{n + extra}"
    return f"grids AS (SELECT {keys}, {grids} FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}), cuts AS (SELECT {keys}, CASE {pick} ELSE list_concat({last}, [{last}[len({last})] FOR i IN range({n})])[1:{n}] END AS cutoffs FROM grids)"


_CUT_COLUMNS = ", ".join(f"round(cutoffs[{i + 1}], 6) AS c{i}" for i in range(8))


@query("cutoff_percentiles", WITH(OBS_SQL, _grid_sql(8, 8, "flux", "band", "obs")) + f"SELECT band, {_CUT_COLUMNS} FROM cuts")
def cutoff_percentiles(spark, d):
    cuts = stats.percentile_cutoffs(observations(spark, d), 8, "band", value="flux")
    return cuts.select("band", *(F.round(F.col("cutoffs")[i], 6).alias(f"c{i}") for i in range(8)))


@query("cutoff_file", WITH(OBS_SQL, _grid_sql(8, 8, "flux", "band", "obs"), "scales AS (SELECT band, median(step) AS median_scale FROM (SELECT band, "
    "unnest([cutoffs[i + 1] - cutoffs[i] FOR i IN range(1, 8)]) AS step FROM cuts) GROUP BY 1)") + f"SELECT band, 'flux' AS \"column\", round(median_scale, 6) AS median_scale, {_CUT_COLUMNS} FROM cuts JOIN scales USING (band)")
def cutoff_file(spark, d):
    cuts = stats.percentile_cutoffs(observations(spark, d), 8, "band", value="flux")
    model = cuts.join(stats.cutoff_scales(cuts, "band"), "band").withColumn("column", F.lit("flux"))
    path = shared_path(spark, "cutoffs")
    tables.write_cutoffs(model, path)
    return tables.read_cutoffs(spark, path).select("band", "column", F.round("median_scale", 6).alias("median_scale"), *(F.round(F.col("cutoffs")[i],
        6).alias(f"c{i}") for i in range(8)))


@query("cutoff_scale", WITH(OBS_SQL, _grid_sql(8, 8, "flux", "band", "obs")) + "SELECT band, round(median(step), 6) AS median_scale FROM (SELECT "
    "band, unnest([cutoffs[i + 1] - cutoffs[i] FOR i IN range(1, 8)]) AS step FROM cuts) GROUP BY 1")
def cutoff_scale(spark, d):
    return rounded(stats.cutoff_scales(stats.percentile_cutoffs(observations(spark, d), 8, "band", value="flux"), "band"), "median_scale")


@query(
    "histogram_density",
    WITH(OBS_SQL, "lim AS (SELECT band, min(flux) AS lo, max(flux) AS hi, count(*) AS total FROM obs GROUP BY 1)")
    + "SELECT band, bin, count(*) AS n, round(count(*) / (max(total) * max((hi - lo) / 50)), 6) AS density FROM (SELECT o.band, CAST(CASE WHEN hi > "
        "lo THEN least(floor((flux - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS INTEGER) AS bin, total, hi, lo FROM obs o JOIN lim USING (band)) "
        "GROUP BY 1, 2",
)
def histogram_density(spark, d):
    return rounded(stats.histogram(observations(spark, d), "flux", 50, "band"), "density")


@query("kde_1d", WITH(OBS_SQL) + "SELECT band, CAST(place AS INTEGER) AS place, round(sum(exp(-0.5 * pow(x - flux, 2))) / count(*) / sqrt(2 * pi()), "
    "6) AS density FROM obs, (SELECT place, pow(10, -1 + place * (4.0 / 49)) AS x FROM range(50) AS r(place)) GROUP BY 1, 2")
def kde_1d(spark, d):
    return rounded(stats.density_1d(observations(spark, d), "flux", stats.log_positions(0.1, 1000.0, 50), "band").drop("x"), "density")


@query(
    "kde_2d",
    WITH(OBS_SQL, "s AS (SELECT count(*) AS n, min(time) AS la, max(time) AS ha, min(flux) AS lb, max(flux) AS hb, var_samp(time) * pow(count(*), "
        "-1.0 / 3) AS caa, var_samp(flux) * pow(count(*), -1.0 / 3) AS cbb, covar_samp(time, flux) * pow(count(*), -1.0 / 3) AS cab FROM obs)",
        "g AS (SELECT CAST(i AS INTEGER) AS ia, CAST(j AS INTEGER) AS ib, la + (ha - la) * i / 99 AS xa, lb + (hb - lb) * j / 99 AS xb, caa, cbb, "
        "cab, n FROM range(100) AS a(i), range(100) AS b(j), s)")
    + "SELECT ia, ib, round(sum(exp(-0.5 * (cbb * pow(xa - time, 2) - 2 * cab * (xa - time) * (xb - flux) + caa * pow(xb - flux, 2)) / (caa * cbb - "
        "cab * cab))) / (max(n) * 2 * pi() * sqrt(max(caa * cbb - cab * cab))), 8) AS density FROM obs, g GROUP BY 1, 2",
)
def kde_2d(spark, d):
    return rounded(stats.density_2d(observations(spark, d), "time", "flux", 100).drop("xa", "xb"), "density", digits=8)


# ---------------------------------------------------------------- pair scores
_SCORED = """scored AS (SELECT pair_id, label, 0.5 * (list_dot_product("left", "right") / (greatest(1e-6, sqrt(list_dot_product("left", "left"))) * greatest(1e-6, sqrt(list_dot_product("right", "right")))) + 1) AS score,
  sqrt(list_dot_product("left", "left")) AS nl, sqrt(list_dot_product("right", "right")) AS nr FROM pairs)"""


def _scored(spark, d):
    return vector_pairs(spark, d).withColumn("score", C.pair_score("left", "right"))


@query("pair_score", WITH(PAIRS_SQL, _SCORED) + "SELECT pair_id, label, round(score, 6) AS score FROM scored")
def pair_score(spark, d):
    return rounded(_scored(spark, d).select("pair_id", "label", "score"), "score")


@query("pair_log_loss", WITH(PAIRS_SQL, _SCORED) + "SELECT round(avg(-label * ln(score + 1e-5) - (1 - label) * ln(1 - score + 1e-5)), 6) AS loss FROM scored")
def pair_log_loss(spark, d):
    return rounded(stats.mean_log_loss(_scored(spark, d)), "loss")


@query("pair_accuracy", WITH(PAIRS_SQL, _SCORED) + "SELECT round(avg(CAST(CAST(score > 0.5 AS INTEGER) = label AS INTEGER)), 6) AS accuracy FROM scored")
def pair_accuracy(spark, d):
    return rounded(stats.accuracy(_scored(spark, d)), "accuracy")


@query("pair_aux_loss", WITH(PAIRS_SQL, _SCORED) + "SELECT round(avg(pow(n - 1, 2)), 6) AS aux_loss FROM (SELECT nl AS n FROM scored UNION ALL SELECT nr FROM scored)")
def pair_aux_loss(spark, d):
    return rounded(stats.norm_loss(vector_pairs(spark, d)), "aux_loss")


@query("pair_mse", WITH(PAIRS_SQL, _SCORED) + "SELECT round(avg(pow(label - (2 * score - 1), 2)), 6) AS mse FROM scored")
def pair_mse(spark, d):
    return rounded(stats.squared_error(vector_pairs(spark, d).withColumn("cos", C.cosine("left", "right")), "label", "cos"), "mse")


@query("similarity_report", WITH(PAIRS_SQL, _SCORED, "r AS (SELECT count(*) AS n, avg(-label * ln(score + 1e-5) - (1 - label) * ln(1 - score + "
    "1e-5)) AS loss, avg(CAST(CAST(score > 0.5 AS INTEGER) = label AS INTEGER)) AS accuracy, avg((pow(nl - 1, 2) + pow(nr - 1, 2)) / 2) AS aux FROM "
    "scored)") + "SELECT n, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy, round(aux, 6) AS aux_loss, round(loss + 0.1 * aux, 6) AS "
    "total_loss FROM r")
def similarity_report(spark, d):
    return rounded(pairs.similarity_report(vector_pairs(spark, d)), "loss", "accuracy", "aux_loss", "total_loss")


@query("dataset_weights", "SELECT dataset, n, round(n / sum(n) OVER (), 6) AS weight FROM (SELECT 'train' AS dataset, count(*) AS n FROM customer "
    "WHERE c_custkey % 4 = 0 UNION ALL SELECT 'test', count(*) FROM customer WHERE c_custkey % 4 <> 0)")
def dataset_weights(spark, d):
    c = read(spark, d, "customer")
    return rounded(stats.mixing_weights({"train": c.where("c_custkey % 4 = 0"), "test": c.where("c_custkey % 4 <> 0")}), "weight")


_SPLIT = "CASE WHEN CAST(('0x' || substr(sha1('train_tune_20181210' || {key}), 1, 12)) AS BIGINT) <= 253327479039589 THEN 'TRAIN' ELSE 'TUNE' END"


@query("split_kl", "SELECT round(sum(n / t * ln((n / t) / CASE split WHEN 'TRAIN' THEN 0.9 ELSE 0.1 END)), 6) AS kl, CAST(sum(n) AS BIGINT) AS n "
    "FROM (SELECT split, count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT " + _SPLIT.format(key="c_custkey") + " AS split FROM customer) GROUP BY 1)")
def split_kl(spark, d):
    s = read(spark, d, "customer").select(id_split(F.col("c_custkey")).alias("split"))
    return rounded(stats.split_divergence(s, {"TRAIN": 0.9, "TUNE": 0.1}), "kl")


@query("match_values", WITH(PAIRS_SQL, _SCORED, "m AS (SELECT s.score, l.label AS a, r.label AS b FROM scored s JOIN embeddings l ON l.vec_id = 2 * "
    "s.pair_id JOIN embeddings r ON r.vec_id = 2 * s.pair_id + 1)") + "SELECT CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE 'mismatch' END AS "
    "\"match\", count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS most FROM m GROUP BY 1")
def match_values(spark, d):
    return rounded(stats.match_values(_scored(spark, d), "left_label", "right_label", "score"), "mean", "least", "most")


@query("match_lists", WITH(PAIRS_SQL, _SCORED, "m AS (SELECT s.pair_id, s.score, l.label AS a, r.label AS b FROM scored s JOIN embeddings l ON "
    "l.vec_id = 2 * s.pair_id JOIN embeddings r ON r.vec_id = 2 * s.pair_id + 1)") + "SELECT CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE 'mismatch' "
    "END AS \"match\", pair_id, round(score, 6) AS score FROM m")
def match_lists(spark, d):
    return rounded(stats.match_lists(_scored(spark, d), "left_label", "right_label", "pair_id", "score"), "score")


# ---------------------------------------------------------------- windows
_FRAMES = f"""framed AS (SELECT *, list(time) OVER b AS bt, list(flux) OVER b AS bf, list(time) OVER a AS ta, list(flux) OVER a AS fa FROM obs
  WINDOW b AS (PARTITION BY object_id, band ORDER BY time, tie ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY object_id, band ORDER BY time, tie ROWS BETWEEN 1 FOLLOWING AND {N} FOLLOWING)),
padded AS (SELECT object_id, band, time, flux, tie, list_concat([0.0 FOR i IN range({N} - coalesce(len(bt), 0))], coalesce(bt, [])) AS before_time, list_concat([0.0 FOR i IN range({N} - coalesce(len(bf), 0))], coalesce(bf, [])) AS before_flux,
  list_concat(coalesce(ta, []), [0.0 FOR i IN range({N} - coalesce(len(ta), 0))]) AS after_time, list_concat(coalesce(fa, []), [0.0 FOR i IN range({N} - coalesce(len(fa), 0))]) AS after_flux,
  CAST({N} - coalesce(len(bt), 0) AS INTEGER) AS before_padding, CAST({N} - coalesce(len(ta), 0) AS INTEGER) AS after_padding FROM framed)"""


def _cells(table: str = "") -> str:
    return ", ".join(f"round({table}{c}[{i + 1}], 6) AS {c}_{i}" for c in ("before_time", "before_flux", "after_time", "after_flux") for i in range(N))


def _cell_columns():
    return [F.round(F.col(c)[i], 6).alias(f"{c}_{i}") for c in ("before_time", "before_flux", "after_time", "after_flux") for i in range(N)]


@query("window_before_after", WITH(OBS_SQL, _FRAMES) + f"SELECT tie, before_padding, after_padding, {_cells()} FROM padded")
def window_before_after(spark, d):
    return windows.surroundings(observations(spark, d), N).select("tie", "before_padding", "after_padding", *_cell_columns())


_TIED = """placed AS (SELECT *, row_number() OVER (PARTITION BY object_id, band ORDER BY time, tie) AS pos FROM obs),
moments AS (SELECT object_id, band, time, min(pos) AS lo, max(pos) AS hi FROM placed GROUP BY 1, 2, 3),
near_by AS (SELECT m.object_id, m.band, m.time, count(*) FILTER (WHERE p.pos < lo) AS n_before, count(*) FILTER (WHERE p.pos > hi) AS n_after, coalesce(sum(p.flux) FILTER (WHERE p.pos < lo), 0) AS before_sum, coalesce(sum(p.flux) FILTER (WHERE p.pos > hi), 0) AS after_sum
  FROM moments m LEFT JOIN placed p ON p.object_id = m.object_id AND p.band = m.band AND (p.pos BETWEEN lo - 3 AND lo - 1 OR p.pos BETWEEN hi + 1 AND hi + 3) GROUP BY 1, 2, 3)"""


@query("window_ties", WITH(LINES_SQL, _TIED) + "SELECT o.tie, CAST(3 - n_before AS INTEGER) AS before_padding, CAST(3 - n_after AS INTEGER) AS "
    "after_padding, round(before_sum, 4) AS before_sum, round(after_sum, 4) AS after_sum FROM obs o JOIN near_by USING (object_id, band, time)")
def window_ties(spark, d):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    w = windows.surroundings(line_curves(spark, d), 3)
    return w.select("tie", "before_padding", "after_padding", total("before_flux").alias("before_sum"), total("after_flux").alias("after_sum"))


_DIFFS = "diffs AS (SELECT *, time - lag(time) OVER w AS dt, flux - lag(flux) OVER w AS df FROM obs WINDOW w AS (PARTITION BY object_id, band ORDER BY time, tie))"


@query("consecutive_diffs", WITH(OBS_SQL, _DIFFS) + "SELECT tie, round(dt, 6) AS dt, round(df, 6) AS df, round(df / nullif(dt, 0), 3) AS slope FROM diffs")
def consecutive_diffs(spark, d):
    return rounded(rounded(curves.differences(curves.by_object(observations(spark, d))).select("tie", "dt", "df", "slope"), "dt", "df"), "slope", digits=3)


_RUNS = """marked AS (SELECT *, coalesce(dt > 0.5 AND dt < 3.0, false) AS ok FROM diffs),
islands AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY object_id, band ORDER BY time, tie) AS i FROM marked)"""


@query("contiguous_runs", WITH(OBS_SQL, _DIFFS, _RUNS) + "SELECT tie, row_number() OVER (PARTITION BY object_id, band, i ORDER BY time, tie) - 1 AS run FROM islands")
def contiguous_runs(spark, d):
    return windows.runs(observations(spark, d), 0.5, 3.0).select("tie", "run")


@query("valid_windows", WITH(OBS_SQL, _DIFFS, _RUNS) + "SELECT tie, pos FROM (SELECT tie, row_number() OVER (PARTITION BY object_id, band ORDER BY "
    "time, tie) - 1 AS pos, bool_and(ok) OVER f AS good, count(*) OVER f AS n FROM marked WINDOW f AS (PARTITION BY object_id, band ORDER BY time, "
    "tie ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) WHERE good AND n = 2")
def valid_windows(spark, d):
    return windows.valid_windows(observations(spark, d), 3, 0.5, 3.0).select("tie", "pos")


_THIN = "thin AS (SELECT object_id, band, time, flux, flux_err, tie FROM (SELECT *, row_number() OVER (PARTITION BY object_id, band ORDER BY time, tie) - 1 AS pos, greatest(1, CAST(ceil((max(time) OVER p - min(time) OVER p) / {rate}) AS BIGINT)) AS n FROM obs WINDOW p AS (PARTITION BY object_id, band)) WHERE pos % n = 0)"


@query("downsample_nth", WITH(OBS_SQL, _THIN.format(rate="8.0")) + "SELECT object_id, band, tie FROM thin")
def downsample_nth(spark, d):
    return windows.every_nth(observations(spark, d), 8.0).select("object_id", "band", "tie")


@query("prefix_index", WITH(OBS_SQL) + "SELECT object_id, band, CAST(sum(n) OVER (ORDER BY object_id, band) - n AS BIGINT) AS start, CAST(sum(n) "
    "OVER (ORDER BY object_id, band) AS BIGINT) AS \"end\" FROM (SELECT object_id, band, count(*) AS n FROM obs GROUP BY 1, 2)")
def prefix_index(spark, d):
    return windows.range_index(observations(spark, d), "object_id", "band")


@query("run_index", "SELECT o_orderkey, min(pos) AS start, max(pos) + 1 AS \"end\" FROM (SELECT l_orderkey AS o_orderkey, row_number() OVER (ORDER "
    "BY l_orderkey, l_linenumber) - 1 AS pos FROM lineitem) GROUP BY 1")
def run_index(spark, d):
    placed = lookups.numbered(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), "o_orderkey", "l_linenumber")
    return windows.run_index(placed, "o_orderkey")


@query("index_slices", WITH(OBS_SQL) + "SELECT object_id, n, CAST(sum(n) OVER (ORDER BY object_id) - n AS BIGINT) AS first_pos, CAST(sum(n) OVER "
    "(ORDER BY object_id) - 1 AS BIGINT) AS last_pos FROM (SELECT object_id, count(*) AS n FROM obs GROUP BY 1)")
def index_slices(spark, d):
    o = observations(spark, d)
    points = lookups.numbered(o.select("object_id", "tie"), "object_id", "tie").select("pos", "tie")
    sliced = lookups.slice_of(points, windows.range_index(o, "object_id"))
    return sliced.groupBy("object_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def _rotation(source: str) -> str:
    return f"laps AS (SELECT object_id, (pos - CAST(floor({U(SEED, chr(39) + 'rotation' + chr(39))} * n) AS BIGINT) + n) % n AS step FROM (SELECT object_id, row_number() OVER (ORDER BY object_id) - 1 AS pos, count(*) OVER () AS n FROM {source}))"


@query("seeded_rotation", WITH("ids AS (SELECT c_custkey AS object_id FROM customer)", _rotation("ids")) + "SELECT object_id, step FROM laps")
def seeded_rotation(spark, d):
    return windows.rotation(read(spark, d, "customer").select(F.col("c_custkey").alias("object_id")), SEED)


@query("chunk_ids", WITH("ids AS (SELECT c_custkey AS object_id FROM customer)", _rotation("ids")) + "SELECT object_id, step, step // 7 AS chunk, "
    "CAST(step % 7 AS INTEGER) AS place FROM laps WHERE (step // 7 + 1) * 7 <= (SELECT count(*) FROM customer)")
def chunk_ids(spark, d):
    return windows.chunks(windows.rotation(read(spark, d, "customer").select(F.col("c_custkey").alias("object_id")), SEED), 7)


@query("first_after_rotation", WITH("ids AS (SELECT c_custkey AS object_id FROM customer)", _rotation("ids")) + "SELECT object_id, step FROM laps WHERE " + _SPLIT.format(key="object_id") + " = 'TUNE' ORDER BY step LIMIT 3")
def first_after_rotation(spark, d):
    laps = windows.rotation(read(spark, d, "customer").select(F.col("c_custkey").alias("object_id")), SEED)
    return laps.where(id_split(F.col("object_id")) == "TUNE").orderBy("step").limit(3)


# ---------------------------------------------------------------- sets and splits
@query("merge_curves", WITH(OBS_SQL) + "SELECT object_id, band, count(*) AS n, round(sum(time), 6) AS time_sum FROM (SELECT object_id, band, time "
    "FROM obs UNION ALL SELECT object_id - object_id % 2, band, time + 1 FROM obs WHERE object_id % 2 = 1) GROUP BY 1, 2")
def merge_curves(spark, d):
    o = observations(spark, d)
    other = curves.linear_transform(o.where("object_id % 2 = 1").withColumn("object_id", F.col("object_id") - F.col("object_id") % 2), translate_time=1.0)
    return curves.merge(o, other).groupBy("object_id", "band").agg(F.count("*").alias("n"), F.round(F.sum("time"), 6).alias("time_sum"))


@query("class_set_algebra", WITH(META_SQL) + "SELECT object_id, target, target IN (1, 2, 3, 5, 8) OR target IN (2, 4, 6, 8) AS in_any, target IN (2, "
    "8) AS in_both, target IN (1, 3, 5) AS only_first FROM meta")
def class_set_algebra(spark, d):
    flags = periods.class_table(spark, first=(1, 2, 3, 5, 8), second=(2, 4, 6, 8))
    joined = metadata(spark, d).select("object_id", "target").join(F.broadcast(flags), "target", "left").na.fill(False)  # flags: a literal list
    return joined.select("object_id", "target", (F.col("first") | F.col("second")).alias("in_any"),
        (F.col("first") & F.col("second")).alias("in_both"), (F.col("first") & ~F.col("second")).alias("only_first"))


@query("ids_in_all_bands", WITH(OBS_SQL) + "SELECT object_id FROM " + _STRETCHES_SQL + " GROUP BY 1 HAVING count(DISTINCT band) = 5")
def ids_in_all_bands(spark, d):
    return lookups.ids_in_every_band(_stretches(spark, d), EVENT_BANDS)


@query("id_split", "SELECT c_custkey AS object_id, " + _SPLIT.format(key="c_custkey") + " AS split FROM customer")
def id_split_query(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), id_split(F.col("c_custkey")).alias("split"))


@query(
    "weighted_mix",
    WITH(
        f"draws AS (SELECT draw, CASE WHEN {U(SEED, chr(39) + 'source' + chr(39), 'draw')} < 0.25 THEN 'a' ELSE 'b' END AS source FROM range(1000) AS r(draw))",
        "nth AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw) - 1 AS use FROM draws)",
        f"a AS (SELECT c_custkey AS object_id, row_number() OVER (ORDER BY {U(SEED, chr(39) + 'a' + chr(39), 'c_custkey')}, c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer WHERE c_nationkey < 5)",
        f"b AS (SELECT c_custkey AS object_id, row_number() OVER (ORDER BY {U(SEED, chr(39) + 'b' + chr(39), 'c_custkey')}, c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer WHERE c_nationkey >= 5)",
    )
    + "SELECT draw, source, object_id FROM nth JOIN a ON source = 'a' AND pos = use % n UNION ALL SELECT draw, source, object_id FROM nth JOIN b ON source = 'b' AND pos = use % n",
)
def weighted_mix(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), "c_nationkey")
    sources = {"a": c.where("c_nationkey < 5").drop("c_nationkey"), "b": c.where("c_nationkey >= 5").drop("c_nationkey")}
    return pairs.mixed(sources, {"a": 0.25, "b": 0.75}, 1000, SEED).select("draw", "source", "object_id")


# ---------------------------------------------------------------- features
_POINT = f"""asks AS (SELECT DISTINCT object_id, time AS request_time FROM obs),
near AS (SELECT a.object_id, o.band, a.request_time, o.tie, abs(o.time - a.request_time) AS diff, row_number() OVER (PARTITION BY a.object_id, o.band, a.request_time ORDER BY abs(o.time - a.request_time), o.time, o.tie) AS nth FROM asks a JOIN obs o USING (object_id)),
feat AS (SELECT n.object_id, n.band, n.request_time, n.diff, p.time AS ct, p.flux AS cf, p.* EXCLUDE (object_id, band, time, flux, tie) FROM near n JOIN padded p USING (tie) WHERE nth = 1)"""
_WINDOW = f"""win AS (SELECT *, diff < {RADIUS} AS in_window, [x - ct FOR x IN list_concat(before_time, after_time)] AS dtime, [x - cf FOR x IN list_concat(before_flux, after_flux)] AS dflux,
  [CASE WHEN i <= {N} THEN i - 1 >= before_padding ELSE i - {N} - 1 < {N} - after_padding END AND diff < {RADIUS} FOR i IN range(1, {2 * N + 1})] AS mask FROM feat),
layer AS (SELECT *, [CASE WHEN dtime[i] = 0 THEN CASE WHEN dflux[i] > 0 THEN 10.0 WHEN dflux[i] < 0 THEN -10.0 END ELSE greatest(-10.0, least(10.0, dflux[i] / dtime[i])) END FOR i IN range(1, {2 * N + 1})] AS dflux_dt FROM win)"""
_ALL = (OBS_SQL, _FRAMES, _POINT, _WINDOW)


@query("per_point_features", WITH(*_ALL[:3]) + f"SELECT object_id, band, round(request_time, 6) AS request_time, before_padding, after_padding, round(ct, 6) AS closest_time_in_band, cf AS closest_flux_in_band, round(diff, 6) AS closest_time_diff, {_cells()} FROM feat")
def per_point_features(spark, d):
    f = features.point_features(observations(spark, d), N, EVENT_BANDS)
    kept = ["object_id", "band", F.round("request_time", 6).alias("request_time"), "before_padding", "after_padding", F.round("closest_time_in_band",
        6).alias("closest_time_in_band"), "closest_flux_in_band", F.round("closest_time_diff", 6).alias("closest_time_diff")]
    return f.select(*kept, *_cell_columns())


def _windows(spark, d):
    return features.window_columns(features.point_features(observations(spark, d), N, EVENT_BANDS), N, RADIUS)


@query("window_mask", WITH(*_ALL) + f"SELECT object_id, band, round(request_time, 6) AS request_time, in_window, array_to_string([CASE WHEN m THEN '1' ELSE '0' END FOR m IN mask], '') AS mask FROM layer")
def window_mask(spark, d):
    w = _windows(spark, d)
    return w.select("object_id", "band", F.round("request_time", 6).alias("request_time"), "in_window", F.array_join(F.transform("mask",
        lambda m: F.when(m, "1").otherwise("0")), "").alias("mask"))


@query("dflux_dt", WITH(*_ALL) + "SELECT object_id, band, round(request_time, 6) AS request_time, " + ", ".join(f"round(CASE WHEN mask[{i + 1}] THEN coalesce(dflux_dt[{i + 1}], 0.0) ELSE 0.0 END, 5) AS s{i}" for i in range(2 * N)) + " FROM layer")
def dflux_dt(spark, d):
    w = _windows(spark, d).withColumn("v", C.masked(F.col("dflux_dt"), F.col("mask"), 0.0))
    return w.select("object_id", "band", F.round("request_time", 6).alias("request_time"), *(F.round(F.col("v")[i], 5).alias(f"s{i}") for i in range(2 * N)))


@query("initial_layer", WITH(*_ALL) + "SELECT object_id, band, round(request_time, 6) AS request_time, " + ", ".join(f"round({c}[{i + 1}], 5) AS {c}_{i}" for i in (0,
    2 * N - 1) for c in features.COLUMNS) + " FROM layer")
def initial_layer(spark, d):
    w = _windows(spark, d).withColumn("layer", C.initial_layer(F.col("dflux"), F.col("dtime")))
    return w.select("object_id", "band", F.round("request_time", 6).alias("request_time"), *(F.round(F.col("layer")[i][j],
        5).alias(f"{c}_{i}") for i in (0, 2 * N - 1) for j, c in enumerate(features.COLUMNS)))


@query("soft_onehot", WITH(OBS_SQL) + "SELECT tie, " + ", ".join(f"round(1 / (1 + exp(-(flux - {c}.0) / 25.0)), 6) AS b{i}, round(exp(-pow((flux - {c}.0) / 25.0, 2)), 6) AS g{i}" for i,
    c in enumerate((0, 50, 100, 200))) + " FROM obs")
def soft_onehot(spark, d):
    cut, scale = F.array(*(F.lit(float(x)) for x in (0, 50, 100, 200))), F.lit(25.0)
    s, g = C.soft_onehot(F.array("flux"), cut, scale)[0], C.soft_onehot(F.array("flux"), cut, scale, C.gaussian)[0]
    return observations(spark, d).select("tie", *(F.round(x[i], 6).alias(f"{n}{i}") for n, x in (("b", s), ("g", g)) for i in range(4)))


@query(
    "is_max_soft",
    WITH(*_ALL[:3]) + f"SELECT object_id, band, round(request_time, 6) AS request_time, round(list_product([CASE WHEN i > before_padding THEN 1 / (1 + exp(-(cf - before_flux[i]) / 50.0)) ELSE 1.0 END FOR i IN range(1, {N + 1})]) * list_product([CASE WHEN i <= {N} - after_padding THEN 1 / (1 + exp(-(cf - after_flux[i]) / 50.0)) ELSE 1.0 END FOR i IN range(1, {N + 1})]), 6) AS score FROM feat",
)
def is_max_soft(spark, d):
    s = features.maximum_scores(features.point_features(observations(spark, d), N, EVENT_BANDS), N, 50.0)
    return rounded(s, "request_time", "score")


_VALUES = f"vals AS (SELECT band, unnest(['dflux_dt', 'dflux', 'dtime']) AS col, unnest([CASE WHEN m THEN coalesce(a, 0.0) ELSE 0.0 END, CASE WHEN m THEN b ELSE 0.0 END, CASE WHEN m THEN c ELSE 0.0 END]) AS v FROM (SELECT band, unnest(mask) AS m, unnest(dflux_dt) AS a, unnest(dflux) AS b, unnest(dtime) AS c FROM layer WHERE in_window))"
_LEARNED = (*_ALL, _VALUES, _grid_sql(4, 8, "v", "band, col", "vals"))
_SCALES = "scales AS (SELECT band, col, median(step) AS median_scale FROM (SELECT band, col, unnest([cutoffs[i + 1] - cutoffs[i] FOR i IN range(1, 4)]) AS step FROM cuts) GROUP BY 1, 2)"


@query("learn_cutoffs", WITH(*_LEARNED, _SCALES) + "SELECT band, col AS \"column\", round(median_scale, 5) AS median_scale, " + ", ".join(f"round(cutoffs[{i + 1}], 5) AS c{i}" for i in range(4)) + " FROM cuts JOIN scales USING (band, col)")
def learn_cutoffs(spark, d):
    found = features.learn_cutoffs(observations(spark, d), N, EVENT_BANDS, 4, RADIUS)
    return found.select("band", "column", F.round("median_scale", 5).alias("median_scale"), *(F.round(F.col("cutoffs")[i], 5).alias(f"c{i}") for i in range(4)))


_BINS = "CASE WHEN mask[{s}] THEN 1 / (1 + exp(greatest(-700.0, least(700.0, -({c}[{s}] - {c}_cut[{e}]) / nullif({c}_scale, 0))))) ELSE 0.0 END"
_FIXED = "fixed AS (SELECT *, [-1.0, 1.0] AS dflux_dt_cut, 2.0 AS dflux_dt_scale, [-50.0, 50.0] AS dflux_cut, 100.0 AS dflux_scale, [-2.0, 2.0] AS dtime_cut, 4.0 AS dtime_scale FROM layer)"


@query("dense_features", WITH(*_ALL, _FIXED) + "SELECT object_id, band, round(request_time, 6) AS request_time, " + ", ".join(f"round({_BINS.format(s=s, c=c, e=e)}, 5) AS {c}_{s - 1}_{e - 1}" for s in (1,
    2 * N) for c in features.COLUMNS for e in (1, 2)) + " FROM fixed")
def dense_features(spark, d):
    rows = [(b, c, s, [-x, x]) for b in EVENT_BANDS for c, s, x in (("dflux_dt", 2.0, 1.0), ("dflux", 100.0, 50.0), ("dtime", 4.0, 2.0))]
    cut = spark.createDataFrame(rows, "band string, column string, median_scale double, cutoffs array<double>")
    b = features.point_bins(observations(spark, d), cut, N, EVENT_BANDS, RADIUS)
    cells = [F.round(F.col("binned")[s - 1][i][e - 1], 5).alias(f"{c}_{s - 1}_{e - 1}") for s in (1, 2 * N) for i, c in enumerate(features.COLUMNS) for e in (1, 2)]
    return b.select("object_id", "band", F.round("request_time", 6).alias("request_time"), *cells)


@query("per_band_pivot", WITH(OBS_SQL) + "SELECT object_id, " + ", ".join(f"count(*) FILTER (WHERE band = '{b}') AS band_{b}_n, round(sum(flux) FILTER (WHERE band = '{b}'), 6) AS band_{b}_flux" for b in EVENT_BANDS) + " FROM obs GROUP BY 1")
def per_band_pivot(spark, d):
    per = observations(spark, d).groupBy("object_id", "band").agg(F.count("*").alias("n"), F.round(F.sum("flux"), 6).alias("flux"))
    return features.per_band_wide(per, EVENT_BANDS, ("n", "flux"), "object_id")


@query("per_band_unpivot", WITH(OBS_SQL) + "SELECT object_id, band, count(*) AS n FROM obs GROUP BY 1, 2")
def per_band_unpivot(spark, d):
    per = observations(spark, d).groupBy("object_id", "band").agg(F.count("*").alias("n"))
    wide = features.per_band_wide(per, EVENT_BANDS, ("n",), "object_id")
    return features.per_band_long(wide, EVENT_BANDS, ("n",), "object_id").where("n is not null")


@query("stack_bands", WITH(OBS_SQL) + "SELECT object_id, array_to_string(list(n ORDER BY passband), ',') AS counts FROM (SELECT object_id, passband, "
    "count(*) AS n FROM obs GROUP BY 1, 2) GROUP BY 1")
def stack_bands(spark, d):
    per = observations(spark, d).groupBy("object_id", "band").agg(F.count("*").alias("n"))
    return features.stack_bands(per, "n", EVENT_BANDS, "object_id").select("object_id", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("counts"))


@query("join_features", WITH(OBS_SQL, _STEPS) + "SELECT object_id, count(*) AS n_points, count(DISTINCT band) AS n_bands, round(max(a.arc), 6) AS "
    "arc_length FROM obs JOIN (SELECT object_id, sum(arc_length) AS arc FROM band_arcs GROUP BY 1) a USING (object_id) GROUP BY 1")
def join_features(spark, d):
    o = observations(spark, d)
    return rounded(features.join_features(curves.point_counts(o), curves.arc_lengths(o), "object_id"), "arc_length")


# ---------------------------------------------------------------- pairs
def _normal(seed: str, *keys: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {U(seed + '.r', *keys)})) * cos(2.0 * pi() * {U(seed + '.a', *keys)}))"


def _stretch(name: str, factor: float, most: float) -> str:
    bound = f"(ln({most}) - ln({factor}))"
    draws = ", ".join(f"CASE WHEN abs({_normal(f'{SEED}.{name}.{i}', 'object_id')}) <= {bound} THEN {_normal(f'{SEED}.{name}.{i}', 'object_id')} END" for i in range(8))
    return f"exp(coalesce({draws}, 0.0) * ln({factor}))"


_MADE = f"""made AS (SELECT object_id, {_normal(f'{SEED}.tt', 'object_id')} AS tt, {_normal(f'{SEED}.tf', 'object_id')} * 0.01 AS tf, {_stretch('dt', 1.1, 6.0)} AS dt, {_stretch('df', 1.5, 16.0)} AS df FROM (SELECT DISTINCT object_id FROM obs)),
moment AS (SELECT object_id, arg_min(time, u) AS pair_time FROM (SELECT object_id, time, {U(SEED, 'object_id', 'CAST(round(time * 1e6) AS BIGINT)')} AS u FROM (SELECT DISTINCT object_id, time FROM obs)) GROUP BY 1),
both_sides AS (SELECT object_id, band, tie, 'left' AS side, time, flux, flux_err, pair_time FROM obs JOIN moment USING (object_id)
  UNION ALL SELECT object_id, band, tie, 'right', dt * (time + tt), df * (flux + tf), sqrt(df) * flux_err, dt * (pair_time + tt) FROM obs JOIN moment USING (object_id) JOIN made USING (object_id))"""


@query("positive_pairs", WITH(OBS_SQL, _MADE) + "SELECT object_id, side, tie, round(time, 6) AS time, round(flux, 6) AS flux, round(flux_err, 6) AS "
    "flux_err, round(pair_time, 6) AS pair_time FROM both_sides")
def positive_pairs(spark, d):
    p = pairs.positive_pairs(observations(spark, d), SEED)
    return rounded(p.select("object_id", "side", "tie", "time", "flux", "flux_err", "pair_time"), "time", "flux", "flux_err", "pair_time")


_SAMPLED = f"""near_marked AS (SELECT *, abs(time - pair_time) < 4.0 AS near FROM both_sides),
sized AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY object_id, side, band) AS n FROM near_marked),
ranges AS (SELECT *, greatest(least(n, 2), floor(n * 0.5)) AS low, ceil(n * 1.0) AS high FROM sized),
cut AS (SELECT *, CASE WHEN low >= high THEN low ELSE low + floor({U(SEED, chr(39) + 'k' + chr(39), 'object_id', 'side', 'band')} * (high - low)) END AS k,
  row_number() OVER (PARTITION BY object_id, side, band, near ORDER BY {U(SEED, 'object_id', 'side', 'band', 'tie')}, tie) AS nth FROM ranges)"""


@query("subsample_pairs", WITH(OBS_SQL, _MADE, _SAMPLED) + "SELECT object_id, side, tie FROM cut WHERE near OR nth <= k")
def subsample_pairs(spark, d):
    return pairs.subsample(pairs.positive_pairs(observations(spark, d), SEED), SEED).select("object_id", "side", "tie")


_NEGATIVE = f"negative AS (SELECT pair_id, side, object_id, target, arg_min(time, u) AS time FROM (SELECT c.*, o.time, {U(SEED, 'pair_id', 'side', 'CAST(round(o.time * 1e6) AS BIGINT)')} AS u FROM chosen c JOIN (SELECT DISTINCT object_id, time FROM obs) o USING (object_id)) GROUP BY 1, 2, 3, 4)"


@query("negative_pair_times", WITH(OBS_SQL, META_SQL, _RANKED, _drawn(), _NEGATIVE) + "SELECT pair_id, side, object_id, target, round(time, 6) AS time FROM negative")
def negative_pair_times(spark, d):
    return rounded(pairs.negative_pairs(observations(spark, d), metadata(spark, d), None, SEED), "time")


_PAIR_FEATURES = f"""pframed AS (SELECT p.*, list(flux) OVER b AS bf, list(flux) OVER a AS af FROM (SELECT n.pair_id, n.side, o.band, o.time, o.flux, o.tie, n.time AS request_time FROM negative n JOIN obs o USING (object_id)) p
  WINDOW b AS (PARTITION BY pair_id, side, band ORDER BY time, tie ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY pair_id, side, band ORDER BY time, tie ROWS BETWEEN 1 FOLLOWING AND {N} FOLLOWING)),
pnear AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, band ORDER BY abs(time - request_time), time, tie) AS nth FROM pframed)"""


@query("pair_features", WITH(OBS_SQL, META_SQL, _RANKED, _drawn(), _NEGATIVE, _PAIR_FEATURES) + f"SELECT pair_id, side, band, 0 AS label, round(time, 6) AS closest_time_in_band, flux AS closest_flux_in_band, CAST({N} - coalesce(len(bf), 0) AS INTEGER) AS before_padding, CAST({N} - coalesce(len(af), 0) AS INTEGER) AS after_padding, round(coalesce(list_sum(bf), 0), 6) AS before_sum, round(coalesce(list_sum(af), 0), 6) AS after_sum FROM pnear WHERE nth = 1")
def pair_features(spark, d):
    f = pairs.negative_features(observations(spark, d), metadata(spark, d), None, N, EVENT_BANDS, SEED)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return f.where("closest_time_in_band is not null").select("pair_id", "side", "band", "label", F.round("closest_time_in_band",
        6).alias("closest_time_in_band"), "closest_flux_in_band", "before_padding", "after_padding", total("before_flux").alias("before_sum"),
        total("after_flux").alias("after_sum"))


@query("lr_pivot", WITH(OBS_SQL, META_SQL, _RANKED, _drawn(), _NEGATIVE) + "SELECT pair_id, max(target) FILTER (WHERE side = 'left') AS left_target, "
    "max(target) FILTER (WHERE side = 'right') AS right_target, round(max(time) FILTER (WHERE side = 'left'), 6) AS left_time, round(max(time) "
    "FILTER (WHERE side = 'right'), 6) AS right_time FROM negative GROUP BY 1")
def lr_pivot(spark, d):
    n = pairs.negative_pairs(observations(spark, d), metadata(spark, d), None, SEED)
    return rounded(features.left_right(n, ("target", "time"), "pair_id"), "left_time", "right_time")


_TRAIN_META = META_SQL[:-1] + " AND " + _SPLIT.format(key="c_custkey") + " = 'TRAIN')"
_BOTH_KINDS = f"""kinds AS (SELECT 0 AS label, n.pair_id, n.side, o.band, o.time, o.flux, o.tie, n.time AS request_time FROM negative n JOIN obs o USING (object_id)
  UNION ALL SELECT 1, object_id, side, band, time, flux, tie, pair_time FROM cut WHERE (near OR nth <= k) AND object_id IN (SELECT object_id FROM meta)),
kframed AS (SELECT *, list(flux) OVER b AS bf, list(flux) OVER a AS af FROM kinds
  WINDOW b AS (PARTITION BY label, pair_id, side, band ORDER BY time, tie ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING), a AS (PARTITION BY label, pair_id, side, band ORDER BY time, tie ROWS BETWEEN 1 FOLLOWING AND {N} FOLLOWING)),
knear AS (SELECT *, row_number() OVER (PARTITION BY label, pair_id, side, band ORDER BY abs(time - request_time), time, tie) AS nth FROM kframed)"""


@query(
    "training_set",
    WITH(OBS_SQL, _TRAIN_META, _RANKED, _drawn(), _NEGATIVE, _MADE, _SAMPLED.replace("n * 0.5", "n * 0.7"), _BOTH_KINDS)
    + f"SELECT label, side, band, count(*) AS n, CAST(sum({N} - coalesce(len(bf), 0)) AS BIGINT) AS before_padding, CAST(sum({N} - coalesce(len(af), 0)) AS BIGINT) AS after_padding, round(sum(time), 3) AS times, round(sum(flux), 3) AS fluxes, round(sum(coalesce(list_sum(bf), 0)), 3) AS before_sum, round(sum(coalesce(list_sum(af), 0)), 3) AS after_sum FROM knear WHERE nth = 1 GROUP BY 1, 2, 3",
)
def training_set(spark, d):
    rows = pairs.training_set(observations(spark, d), metadata(spark, d), N, EVENT_BANDS, SEED).where("closest_time_in_band is not null")
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    sums = {"times": F.sum("closest_time_in_band"), "fluxes": F.sum("closest_flux_in_band"), "before_sum": total("before_flux"), "after_sum": total("after_flux")}
    return rows.groupBy("label", "side", "band").agg(F.count("*").alias("n"), F.sum("before_padding").alias("before_padding"),
        F.sum("after_padding").alias("after_padding"), *(F.round(x, 3).alias(c) for c, x in sums.items()))


_REGULAR = """gaps AS (SELECT *, time - lag(time) OVER (PARTITION BY object_id, band ORDER BY time, tie) AS dt FROM thin),
mid AS (SELECT quantile_cont(dt, 0.5) AS m FROM gaps),
regular AS (SELECT g.*, coalesce(dt > m * 0.8 AND dt < m * 1.2, false) AS ok FROM gaps g, mid),
starts AS (SELECT object_id, band, pos, pts FROM (SELECT object_id, band, tie, row_number() OVER (PARTITION BY object_id, band ORDER BY time, tie) - 1 AS pos, bool_and(ok) OVER f AS good, count(*) OVER f AS n,
  list({'t': time, 'f': flux}) OVER (PARTITION BY object_id, band ORDER BY time, tie ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS pts FROM regular WINDOW f AS (PARTITION BY object_id, band ORDER BY time, tie ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) WHERE good AND n = 2)"""
_RATE = 40.0


@query("regular_windows", WITH(OBS_SQL, _THIN.format(rate=_RATE), _REGULAR) + "SELECT object_id, band, pos, round(pts[1].t, 6) AS t0, pts[1].f AS f0, pts[3].f AS f2 FROM starts")
def regular_windows(spark, d):
    w = pairs.regular_windows(observations(spark, d), 3, _RATE)
    return w.select("object_id", "band", "pos", F.round(F.col("points")[0]["time"], 6).alias("t0"), F.col("points")[0]["flux"].alias("f0"), F.col("points")[2]["flux"].alias("f2"))


_WINDOW_PAIRS = f"""wcurves AS (SELECT object_id, band, n_windows, row_number() OVER (ORDER BY object_id, band) - 1 AS c, count(*) OVER () AS k FROM (SELECT object_id, band, count(*) AS n_windows FROM starts GROUP BY 1, 2)),
wdrawn AS (SELECT pair_id, label, lc, CASE WHEN label = 1 THEN lc ELSE (lc + 1 + CAST(floor({U(SEED, chr(39) + 'other' + chr(39), 'pair_id')} * greatest(k - 1, 1)) AS BIGINT)) % k END AS rc FROM (
  SELECT pair_id, CAST(pair_id < k AS INTEGER) AS label, k, CAST(floor({U(SEED, chr(39) + 'curve' + chr(39), 'pair_id')} * k) AS BIGINT) AS lc FROM (SELECT unnest(range(2 * k)) AS pair_id, k FROM (SELECT max(k) AS k FROM wcurves)))),
wsides AS (SELECT pair_id, label, side, c.object_id, c.band, CAST(floor({U(SEED, chr(39) + 'window' + chr(39), 'pair_id', 'side')} * n_windows) AS BIGINT) AS w FROM (SELECT pair_id, label, 'left' AS side, lc AS c FROM wdrawn UNION ALL SELECT pair_id, label, 'right', rc FROM wdrawn) s JOIN wcurves c USING (c)),
wranked AS (SELECT *, row_number() OVER (PARTITION BY object_id, band ORDER BY pos) - 1 AS w FROM starts),
wpairs AS (SELECT s.pair_id, s.label, s.side, r.pts FROM wsides s JOIN wranked r USING (object_id, band, w)),
wslopes AS (SELECT pair_id, label, side, [coalesce((pts[i + 1].f - pts[i].f) / nullif(pts[i + 1].t - pts[i].t, 0), 0.0) FOR i IN range(1, 3)] AS v FROM wpairs)"""


@query("contiguous_window_pairs", WITH(OBS_SQL, _THIN.format(rate=_RATE), _REGULAR, _WINDOW_PAIRS) + "SELECT pair_id, label, max(pts[1].f) FILTER "
    "(WHERE side = 'left') AS left_f0, max(pts[1].f) FILTER (WHERE side = 'right') AS right_f0 FROM wpairs GROUP BY 1, 2")
def contiguous_window_pairs(spark, d):
    p = pairs.window_pairs(pairs.regular_windows(observations(spark, d), 3, _RATE), None, SEED)
    return p.select("pair_id", "label", F.col("left")[0]["flux"].alias("left_f0"), F.col("right")[0]["flux"].alias("right_f0"))


@query("window_slope_similarity", WITH(OBS_SQL, _THIN.format(rate=_RATE), _REGULAR, _WINDOW_PAIRS) + "SELECT l.pair_id, l.label, "
    "round(list_dot_product(l.v, r.v) / nullif(sqrt(list_dot_product(l.v, l.v)) * sqrt(list_dot_product(r.v, r.v)), 0), 6) AS cosine FROM wslopes l "
    "JOIN wslopes r USING (pair_id) WHERE l.side = 'left' AND r.side = 'right'")
def window_slope_similarity(spark, d):
    return rounded(pairs.slope_similarity(pairs.window_pairs(pairs.regular_windows(observations(spark, d), 3, _RATE), None, SEED)), "cosine")


# ---------------------------------------------------------------- alignment
_GRID = dict(translate_time=(-1.0, 0.0, 1.0), translate_flux=(0.0,), dilate_time=(1.0, 1.1), dilate_flux=(0.5, 1.0))
_GRID_SQL = "grid AS (SELECT CAST(row_number() OVER (ORDER BY tt, dt, df) - 1 AS INTEGER) AS candidate, tt, 0.0 AS tf, dt, df FROM (VALUES (-1.0), (0.0), (1.0)) AS a(tt), (VALUES (1.0), (1.1)) AS b(dt), (VALUES (0.5), (1.0)) AS c(df))"


def _costs_sql(pair_source: str) -> str:
    return f"""apairs AS ({pair_source}),
moved AS (SELECT p.pair_id, g.candidate, 'left' AS side, o.band, o.time, o.flux, o.tie FROM apairs p JOIN obs o ON o.object_id = p.left_id, grid g WHERE o.detected = 1
  UNION ALL SELECT p.pair_id, g.candidate, 'right', o.band, dt * (o.time + tt), df * (o.flux + tf), o.tie FROM apairs p JOIN obs o ON o.object_id = p.right_id, grid g WHERE o.detected = 1),
costs AS (SELECT pair_id, candidate, coalesce(sum(step), 0) AS arc_length FROM (SELECT pair_id, candidate, sqrt(pow(time - lag(time) OVER w, 2) + pow(flux - lag(flux) OVER w, 2)) AS step FROM moved WINDOW w AS (PARTITION BY pair_id, candidate, band ORDER BY time, side, tie)) GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(arc_length, 6), candidate) AS nth FROM costs) WHERE nth = 1)"""


def _next_pairs(spark, d):
    m = metadata(spark, d)
    return m.select(F.col("object_id").alias("pair_id"), F.col("object_id").alias("left_id"),
        (F.col("object_id") + 1).alias("right_id")).join(m.select(F.col("object_id").alias("right_id")), "right_id", "left_semi")


_NEXT = "SELECT object_id AS pair_id, object_id AS left_id, object_id + 1 AS right_id FROM meta WHERE object_id + 1 IN (SELECT object_id FROM meta)"


@query("align_grid", WITH(OBS_SQL, META_SQL, _GRID_SQL, _costs_sql(_NEXT)) + "SELECT pair_id, candidate, round(arc_length, 6) AS arc_length FROM best")
def align_grid(spark, d):
    found = align.align_grid(_next_pairs(spark, d), observations(spark, d), align.candidate_grid(spark, **_GRID))
    return rounded(found.select("pair_id", "candidate", "arc_length"), "arc_length")


@query("align_matrix", WITH(OBS_SQL, META_SQL, _GRID_SQL, _costs_sql("SELECT a.object_id * 1000000 + b.object_id AS pair_id, a.object_id AS left_id, "
    "b.object_id AS right_id, a.target AS lt, b.target AS rt FROM meta a JOIN meta b ON a.object_id <> b.object_id")) + "SELECT left_id, right_id, lt AS "
    "target, candidate, round(arc_length, 6) AS arc_length FROM best JOIN apairs USING (pair_id)")
def align_matrix(spark, d):
    found = align.alignment_matrix(metadata(spark, d), observations(spark, d), align.candidate_grid(spark, **_GRID))
    return rounded(found.select("left_id", "right_id", F.col("left_target").alias("target"), "candidate", "arc_length"), "arc_length")


_EVERY = "SELECT a.object_id * 1000000 + b.object_id AS pair_id, a.object_id AS left_id, b.object_id AS right_id FROM meta a JOIN meta b ON a.object_id <> b.object_id"


@query(
    "nearest_partners",
    WITH(OBS_SQL, META_SQL, _GRID_SQL, _costs_sql(_EVERY))
    + "SELECT left_id, CAST(rank AS INTEGER) AS rank, right_id, candidate, round(arc_length, 6) AS arc_length FROM (SELECT *, row_number() OVER "
        "(PARTITION BY left_id ORDER BY round(arc_length, 6), right_id) AS rank FROM best JOIN apairs USING (pair_id)) WHERE rank <= 3",
)
def nearest_partners(spark, d):
    own = observations(spark, d).join(metadata(spark, d).select("object_id"), "object_id", "left_semi")
    return partners.nearest_partners(own, align.candidate_grid(spark, **_GRID), 3)[0]


@query("align_simplex")
def align_simplex(spark, d):
    return align.align_simplex(_next_pairs(spark, d), observations(spark, d))


@query("stack_class")
def stack_class(spark, d):
    return align.stack_classes(observations(spark, d), metadata(spark, d))


# ---------------------------------------------------------------- periods
_POWER = """grid AS (SELECT object_id, low, step, CAST(floor((1 / 0.1::DOUBLE - low) / step) AS BIGINT) + 1 AS n FROM (SELECT object_id, 1 / span AS low, 1 / (5.0::DOUBLE * span) AS step FROM (SELECT object_id, max(time) - min(time) AS span FROM obs GROUP BY 1) WHERE span > 0.1)),
freqs AS (SELECT object_id, low + step * k AS f FROM (SELECT object_id, low, step, unnest(range(n)) AS k FROM grid)),
sums AS (SELECT object_id, 1 / f AS period, band, sum(w) AS w, sum(w*y)/sum(w) AS y, sum(w*c)/sum(w) AS c, sum(w*s)/sum(w) AS s, sum(w*y*y)/sum(w) AS yy, sum(w*c*c)/sum(w) AS cc, sum(w*s*s)/sum(w) AS ss, sum(w*c*s)/sum(w) AS cs, sum(w*y*c)/sum(w) AS yc, sum(w*y*s)/sum(w) AS ys
  FROM (SELECT object_id, band, f, 1/(flux_err*flux_err) AS w, flux AS y, cos(2*pi()*time*f) AS c, sin(2*pi()*time*f) AS s FROM obs JOIN freqs USING (object_id)) GROUP BY object_id, f, band),
v AS (SELECT object_id, period, w, yy-y*y AS vyy, cc-c*c AS vcc, ss-s*s AS vss, cs-c*s AS vcs, yc-y*c AS vyc, ys-y*s AS vys FROM sums),
p AS (SELECT *, vcc*vss-vcs*vcs AS d FROM v),
parts AS (SELECT object_id, period, CASE WHEN d > 1e-6 AND vyy > 1e-6 THEN (vss*vyc*vyc + vcc*vys*vys - 2*vcs*vyc*vys)/(vyy*d) END AS part, w*vyy AS chi FROM p),
powers AS (SELECT object_id, period, sum(chi*part) FILTER (WHERE part IS NOT NULL) / nullif(sum(chi) FILTER (WHERE part IS NOT NULL), 0) AS power FROM parts GROUP BY 1, 2)"""
_TOP = """peaks AS (SELECT object_id, period, power, lag(power) OVER w AS l, lead(power) OVER w AS r FROM powers WHERE power IS NOT NULL WINDOW w AS (PARTITION BY object_id ORDER BY period)),
top AS (SELECT * FROM (SELECT object_id, period, power, row_number() OVER (PARTITION BY object_id ORDER BY power DESC, period) AS nth FROM peaks WHERE (l IS NULL OR power > l) AND (r IS NULL OR power >= r)) WHERE nth <= 5)"""


def _powers(spark, d):
    return periods.span_periodogram(observations(spark, d))


def _summits(spark, d):
    return periods.span_periodogram(observations(spark, d), keep=5)


@query("periodogram", WITH(OBS_SQL, _POWER) + "SELECT object_id, round(period, 6) AS period, round(power, 6) AS power FROM powers")
def periodogram(spark, d):
    return rounded(_powers(spark, d), "period", "power")


@query("top5_periods", WITH(OBS_SQL, _POWER, _TOP) + "SELECT object_id, CAST(nth AS INTEGER) AS rank, round(period, 6) AS period, round(power, 6) AS score FROM top")
def top5_periods(spark, d):
    return rounded(stats.top_periods(_summits(spark, d)), "period", "score")


@query("best_period", WITH(OBS_SQL, _POWER) + "SELECT object_id, round(period, 6) AS period, round(1 / period, 6) AS frequency FROM (SELECT *, "
    "row_number() OVER (PARTITION BY object_id ORDER BY power DESC, period) AS nth FROM powers WHERE power IS NOT NULL) WHERE nth = 1")
def best_period(spark, d):
    return rounded(stats.best_period(_summits(spark, d), "object_id"), "period", "frequency")


_CATALOGUE = "catalogue AS (SELECT object_id, ddf, target, " + ", ".join(f"max(period) FILTER (WHERE nth = {i}) AS period{i}, max(power) FILTER (WHERE nth = {i}) AS score{i}" for i in range(1,
    6)) + " FROM meta JOIN top USING (object_id) GROUP BY 1, 2, 3)"


@query("period_catalogue", WITH(OBS_SQL, META_SQL, _POWER, _TOP, _CATALOGUE) + "SELECT object_id, ddf, target, " + ", ".join(f"round({c}{i}, 6) AS {c}{i}" for c in ("period",
    "score") for i in range(1, 6)) + " FROM catalogue")
def period_catalogue(spark, d):
    return rounded(_catalogue(spark, d), *(f"{n}{i}" for n in ("period", "score") for i in range(1, 6)))


def _catalogue(spark, d):
    return periods.period_catalogue(metadata(spark, d), _summits(spark, d))


@query("period_file", WITH(OBS_SQL, META_SQL, _POWER, _TOP, _CATALOGUE) + "SELECT object_id, CAST(ddf AS INTEGER) AS ddf, CAST(target AS INTEGER) AS "
    "target, round(period1, 6) AS period1, round(score5, 6) AS score5 FROM catalogue")
def period_file(spark, d):
    path = shared_path(spark, "periods")
    tables.write_periods(_catalogue(spark, d), path)
    return rounded(tables.read_periods(spark, path).select("object_id", "ddf", "target", "period1", "score5"), "period1", "score5")


@query(
    "period_report",
    WITH(OBS_SQL, META_SQL, _POWER, _TOP, _CATALOGUE, "about AS (SELECT *, avg(period1) OVER (PARTITION BY target) AS mid FROM catalogue)")
    + """SELECT target, count(*) AS n, round(min(period1), 6) AS least, round(max(period1), 6) AS most, round(avg(period1), 6) AS mean, round(var_samp(period1), 6) AS variance,
  round(sqrt(count(*)) * sum(pow(period1 - mid, 3)) / nullif(pow(sum(pow(period1 - mid, 2)), 1.5), 0), 5) AS skewness,
  round(count(*) * sum(pow(period1 - mid, 4)) / nullif(pow(sum(pow(period1 - mid, 2)), 2), 0) - 3, 5) AS kurtosis FROM about GROUP BY 1""",
)
def period_report(spark, d):
    report = rounded(periods.period_report(_catalogue(spark, d))["describe"], "least", "most", "mean", "variance")
    return rounded(report, "skewness", "kurtosis", digits=5)


@query(
    "period_histogram",
    WITH(OBS_SQL, META_SQL, _POWER, _TOP, _CATALOGUE, "lim AS (SELECT target, min(period1) AS lo, max(period1) AS hi, count(*) AS total FROM catalogue GROUP BY 1)")
    + "SELECT target, bin, count(*) AS n, round(count(*) / nullif(max(total) * max((hi - lo) / 10), 0), 6) AS density FROM (SELECT c.target, "
        "CAST(CASE WHEN hi > lo THEN least(floor((period1 - lo) / ((hi - lo) / 10)), 9) ELSE 0 END AS INTEGER) AS bin, total, hi, lo FROM catalogue "
        "c JOIN lim USING (target)) GROUP BY 1, 2",
)
def period_histogram(spark, d):
    return rounded(periods.period_report(_catalogue(spark, d), bins=10)["histogram"], "density")


@query("period_density", WITH(OBS_SQL, META_SQL, _POWER, _TOP, _CATALOGUE) + "SELECT target, CAST(place AS INTEGER) AS place, round(sum(exp(-0.5 * "
    "pow(x - period1, 2))) / count(*) / sqrt(2 * pi()), 6) AS density FROM catalogue, (SELECT place, pow(10, -1 + place * (2.5 / 19)) AS x FROM "
    "range(20) AS r(place)) GROUP BY 1, 2")
def period_density(spark, d):
    positions = [10 ** (-1 + i * (2.5 / 19)) for i in range(20)]
    return rounded(periods.period_report(_catalogue(spark, d), positions=positions)["density"].drop("x"), "density")


_ZOOMED = """zoomed AS (SELECT object_id, nth, 1 / period - step AS low, step / 100 AS zstep FROM top JOIN grid USING (object_id)),
zfreqs AS (SELECT object_id, nth, k, low + zstep * k AS f FROM zoomed, range(201) AS r(k) WHERE low > 0),
zsums AS (SELECT object_id, nth, k, f, band, sum(w) AS w, sum(w*y)/sum(w) AS y, sum(w*c)/sum(w) AS c, sum(w*s)/sum(w) AS s, sum(w*y*y)/sum(w) AS yy,
    sum(w*c*c)/sum(w) AS cc, sum(w*s*s)/sum(w) AS ss, sum(w*c*s)/sum(w) AS cs, sum(w*y*c)/sum(w) AS yc, sum(w*y*s)/sum(w) AS ys
  FROM (SELECT object_id, nth, k, f, band, 1/(flux_err*flux_err) AS w, flux AS y, cos(2*pi()*time*f) AS c, sin(2*pi()*time*f) AS s FROM obs JOIN zfreqs USING (object_id))
  GROUP BY object_id, nth, k, f, band),
zv AS (SELECT object_id, nth, k, f, w, yy-y*y AS vyy, cc-c*c AS vcc, ss-s*s AS vss, cs-c*s AS vcs, yc-y*c AS vyc, ys-y*s AS vys FROM zsums),
zp AS (SELECT *, vcc*vss-vcs*vcs AS d FROM zv),
zparts AS (SELECT object_id, nth, k, f, w*vyy AS chi,
    CASE WHEN d > 1e-6 AND vyy > 1e-6 THEN (vss*vyc*vyc + vcc*vys*vys - 2*vcs*vyc*vys)/(vyy*d) END AS part FROM zp),
zpowers AS (SELECT object_id, nth, k, f, sum(chi*part) FILTER (WHERE part IS NOT NULL) / nullif(sum(chi) FILTER (WHERE part IS NOT NULL), 0) AS power
  FROM zparts GROUP BY object_id, nth, k, f),
zbest AS (SELECT object_id, nth, 1 / f AS fine, power AS fine_power FROM
  (SELECT *, row_number() OVER (PARTITION BY object_id, nth ORDER BY power DESC, k) AS r FROM zpowers WHERE power IS NOT NULL) WHERE r = 1)"""


@query(
    "refined_periods",
    WITH(OBS_SQL, _POWER, _TOP, _ZOOMED)
    + "SELECT object_id, CAST(nth AS INTEGER) AS rank, round(coalesce(fine, period), 6) AS period, round(coalesce(fine_power, power), 6) AS score "
    "FROM top LEFT JOIN zbest USING (object_id, nth)",
)
def refined_periods(spark, d):
    o = observations(spark, d)
    return rounded(periods.refined(o, stats.top_periods(_summits(spark, d))), "period", "score")


@query("phase_folded_best", WITH(OBS_SQL, _POWER, _TOP) + "SELECT tie, round(period, 6) AS period_best, round(time - period * floor(time / period), "
    "6) AS phase FROM obs JOIN top USING (object_id) WHERE nth = 1")
def phase_folded_best(spark, d):
    f = periods.phase_folded(observations(spark, d), stats.top_periods(_summits(spark, d)))
    return rounded(f.select("tie", "period_best", "phase"), "period_best", "phase")


@query("pair_classifier")
def pair_classifier(spark, d):
    """Scores within each split by a classifier that has seen the training split's objects only."""
    return pairs.held_out_report(observations(spark, d), metadata(spark, d), N, EVENT_BANDS, SEED)


_SCORED = """scored AS (SELECT label, 1 / (1 + exp(-list_dot_product("left", "right") / sqrt(list_dot_product("left", "left") * list_dot_product("right", "right")))) AS score FROM pairs)"""


@query(
    "pair_metrics",
    WITH(PAIRS_SQL, _SCORED) + """SELECT CAST(label AS INTEGER) AS kind, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives, round(avg(-label * ln(score + 1e-5) - (1 - label) * ln(1 - score + 1e-5)), 6) AS loss,
  round(avg(CAST((score > 0.5) = (label = 1) AS DOUBLE)), 6) AS accuracy, round(count(*) FILTER (WHERE score > 0.5 AND label = 1) / nullif(count(*) FILTER (WHERE score > 0.5), 0), 6) AS precision,
  round(count(*) FILTER (WHERE score > 0.5 AND label = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 6) AS recall FROM scored GROUP BY GROUPING SETS ((), (label))""",
)
def pair_metrics(spark, d):
    p = vector_pairs(spark, d)
    scored = p.select("label", (1.0 / (1.0 + F.exp(-C.cosine("left", "right")))).alias("score"), F.explode(F.array(F.col("label"), F.lit(None).cast("int"))).alias("kind"))
    return rounded(pairs.pair_metrics(scored, "kind"), "loss", "accuracy", "precision", "recall")


@query("uniform_hash", f"SELECT c_custkey AS object_id, {U(SEED, 'c_custkey')} AS u FROM customer")
def uniform_hash(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("object_id"), uniform(SEED, F.col("c_custkey")).alias("u"))
