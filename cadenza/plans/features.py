"""Feature jobs: windows around points, per-point tables, cutoffs and binned features."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from cadenza.functions import columns as C
from cadenza.operators.asof import Windows, nearest_windows, own_points, own_windows, windows_at_points
from cadenza.operators.batches import Made
from cadenza.operators.stats import cutoff_scales, percentile_cutoffs

COLUMNS = ("dflux_dt", "dflux", "dtime")


def window_features(obs: DataFrame, requests: DataFrame, n: int, bands: Sequence[str], bias: float = 1e-8, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """For each request (object_id or other keys, request_time) and band: the closest point and the n points
    before and after it. Bands without points have full padding and null closest fields."""
    return nearest_windows(obs, requests, n, bands, bias, keys)


def point_features(obs: DataFrame, n: int, bands: Sequence[str]) -> DataFrame:
    """Window features at every distinct time of every object."""
    return windows_at_points(obs, n, bands)


def window_columns(features: DataFrame, n: int, band_time_diff: float = 4.0, clip: float = 10.0) -> DataFrame:
    """dtime, dflux, dflux_dt and mask (filled slots of bands in the window) of each feature row."""
    dtime, dflux = C.deltas("before_time", "after_time", "closest_time_in_band"), C.deltas("before_flux", "after_flux", "closest_flux_in_band")
    seen = F.coalesce(C.in_window("closest_time_diff", band_time_diff), F.lit(False))
    first = features.withColumns({"dtime": dtime, "dflux": dflux, "mask": C.both(C.window_mask("before_padding", "after_padding", n), seen), "in_window": seen})
    return first.withColumn("dflux_dt", C.slopes(F.col("dflux"), F.col("dtime"), clip))


def maximum_scores(features: DataFrame, n: int, epsilon: float) -> DataFrame:
    """score per (object, time, band): near 1 where the closest point tops its window."""
    score = C.soft_maximum("before_flux", "after_flux", "before_padding", "after_padding", "closest_flux_in_band", n, epsilon)
    return features.select("object_id", "request_time", "band", score.alias("score"))


def layer_values(windows: DataFrame, include_padding: bool = True) -> DataFrame:
    """band, column, value (an array) of the slots of in-window points. Padded slots count as 0 (as they
    enter the model) or, with include_padding off, are null."""
    other = 0.0 if include_padding else None
    value = lambda c: F.zip_with(F.col("mask"), F.col(c), lambda m, v: F.when(m, F.coalesce(v, F.lit(0.0))).otherwise(F.lit(other)))
    columns = F.array(*(F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in COLUMNS))
    return windows.where("in_window").select("band", F.explode(columns).alias("v")).select("band", "v.*")


def slots(windows: Windows, band_time_diff: float = 4.0, clip: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What window_columns makes of windows, as arrays: in_window, mask, and the slots' values of each of COLUMNS, 0
    where the mask is off or the value is null."""
    seen = windows.some & (windows.diff < band_time_diff)
    mask = windows.filled & seen[:, None]
    dflux, dtime = windows.flux - windows.closest_flux[:, None], windows.time - windows.closest_time[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.fmax(-clip, np.fmin(clip, dflux / dtime))  # NaN is largest, as for Spark
    edge = np.where((dflux > 0) | np.isnan(dflux), clip, np.where(dflux < 0, -clip, 0.0))
    every = np.stack([np.where(dtime == 0, edge, slope), dflux, dtime])
    return seen, mask, np.where(mask, every, 0.0)


def _own_values(n: int, bands: Sequence[str], band_time_diff: float, include_padding: bool) -> Callable:
    """layer_values of each curve's own windows: band, column and an array of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, codes, windows in own_windows(batches, n, bands):
            seen, mask, every = slots(windows, band_time_diff)
            for b, band in enumerate(bands):
                own = seen & (codes == b)
                for c, values in zip(COLUMNS, every, strict=True):
                    flat = values[own].ravel() if include_padding else values[own][mask[own]]
                    one = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array([band]), pa.array([c]), one], names=["band", "column", "value"])

    return run


def learn_cutoffs(obs: DataFrame, n: int, bands: Sequence[str], cutoffs: int, band_time_diff: float = 4.0, include_padding: bool = True, exact: bool = True) -> DataFrame:
    """band, column, median_scale and cutoffs from all points of the given curves. Values go from the windows to the
    counts of their cells in one task: none is stored or given back to Spark."""
    schema = "band string, column string, value array<double>"
    values = Made(own_points(obs), _own_values(n, bands, band_time_diff, include_padding), schema)
    found = percentile_cutoffs(values, cutoffs, "band", "column", exact=exact)
    return found.join(cutoff_scales(found, "band", "column"), ["band", "column"]).select("band", "column", "median_scale", "cutoffs")


def cutoffs_by_band(cutoffs: DataFrame) -> DataFrame:
    """One row per band: scale and cutoffs of each column."""
    pick = lambda c, name: F.max(F.when(F.col("column") == c, F.col(name)))
    return cutoffs.groupBy("band").agg(*(pick(c, "median_scale").alias(f"{c}_scale") for c in COLUMNS), *(pick(c, "cutoffs").alias(f"{c}_cutoffs") for c in COLUMNS))


def binned_features(features: DataFrame, cutoffs: DataFrame, n: int, band_time_diff: float = 4.0, kind=C.sigmoid) -> DataFrame:
    """binned: [2n][3][E] soft one-hot values per (object, time, band), masked slots 0.

    The cutoff table has a row per band and is broadcast. The arrays are large: don't shuffle them.
    """
    joined = window_columns(features, n, band_time_diff).join(F.broadcast(cutoffs_by_band(cutoffs)), "band")

    def binned(c: str) -> Column:
        own = C.soft_onehot(F.transform(C.masked(F.col(c), F.col("mask"), 0.0), lambda x: x), F.col(f"{c}_cutoffs"), F.col(f"{c}_scale"), kind)
        zero = F.transform(F.col(f"{c}_cutoffs"), lambda _: F.lit(0.0))
        return F.zip_with(F.col("mask"), own, lambda m, v: F.when(m, v).otherwise(zero))

    stacked = F.transform(F.arrays_zip(*(binned(c).alias(c) for c in COLUMNS)), lambda s: F.array(*(s[c] for c in COLUMNS)))
    return joined.select("object_id", "request_time", "band", stacked.alias("binned"))


def point_bins(obs: DataFrame, cutoffs: DataFrame, n: int, bands: Sequence[str], band_time_diff: float = 4.0) -> DataFrame:
    """binned_features of point_features: the windows of each curve are binned where they are made. The cutoff table
    has a row per band and column; bands without cutoffs have no rows."""
    known: dict[str, dict] = {}
    for r in cutoffs.select("band", "column", "median_scale", "cutoffs").collect():
        known.setdefault(r.band, {})[r.column] = r.median_scale, r.cutoffs
    kept = [b for b in bands if b in known]
    ordered = own_points(obs)
    schema = StructType([ordered.schema["object_id"], StructField("request_time", DoubleType()), StructField("band", StringType()),
        StructField("binned", ArrayType(ArrayType(ArrayType(DoubleType()))))])
    arrow = to_arrow_schema(schema)

    def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, time, codes, windows in own_windows(batches, n, kept):
            _, mask, every = slots(windows, band_time_diff)
            for b, band in enumerate(kept):
                own = np.flatnonzero(codes == b)
                cells, void = [], []
                for c, values in zip(COLUMNS, every, strict=True):
                    scale, cut = known[band].get(c, (None, ()))
                    cut = np.array([np.nan if x is None else x for x in cut or ()])
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = 1.0 / (1.0 + np.exp(-((values[own][:, :, None] - cut) / (scale or 1.0))))
                    cells.append(np.where(mask[own][:, :, None], x, 0.0))
                    void.append(mask[own][:, :, None] & (np.isnan(cut) | (not scale)))  # nothing is divided by 0 or null
                flat, null = np.concatenate(cells, axis=2), np.concatenate(void, axis=2)
                inner = np.tile([c.shape[2] for c in cells], len(own) * 2 * n)
                whole = lists(lists(lists(pa.array(flat.ravel(), mask=null.ravel()), inner), np.full(len(own) * 2 * n, len(COLUMNS))), np.full(len(own), 2 * n))
                made = [ids.take(pa.array(own)), pa.array(time[own]), pa.array([band] * len(own), pa.string()), whole]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def stack_bands(rows: DataFrame, value: str, bands: Sequence[str], *keys: str) -> DataFrame:
    """One array of the bands' values in band order per key."""
    place = F.array_position(F.array(*map(F.lit, bands)), F.col("band"))
    gathered = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(gathered, lambda x: x["v"]).alias(value))


def per_band_wide(rows: DataFrame, bands: Sequence[str], values: Sequence[str], *keys: str) -> DataFrame:
    """Columns band_<b>_<value> per key."""
    cells = [F.max(F.when(F.col("band") == b, F.col(v))).alias(f"band_{b}_{v}") for b in bands for v in values]
    return rows.groupBy(*keys).agg(*cells)


def per_band_long(wide: DataFrame, bands: Sequence[str], values: Sequence[str], *keys: str) -> DataFrame:
    """The way back: band and the values from columns band_<b>_<value>."""
    parts = F.array(*(F.struct(F.lit(b).alias("band"), *(F.col(f"band_{b}_{v}").alias(v) for v in values)) for b in bands))
    return wide.select(*keys, F.explode(parts).alias("b")).select(*keys, "b.*")


def left_right(rows: DataFrame, values: Sequence[str], *keys: str) -> DataFrame:
    """Columns left_<value> and right_<value> per key, from rows with a side."""
    cells = [F.max(F.when(F.col("side") == side, F.col(v))).alias(f"{side}_{v}") for v in values for side in ("left", "right")]
    return rows.groupBy(*keys).agg(*cells)


def join_features(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Two feature tables by key; a feature in both is an error."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    if shared:
        raise ValueError(f"features in both tables: {sorted(shared)}")
    return left.join(right, list(keys))
