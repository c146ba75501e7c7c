"""The n points on either side of the point nearest to a request, in one pass over curves and requests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from cadenza.operators.batches import whole_groups

#: Rows of curves and requests that are worked on together, and requests whose windows are made together.
BATCH_ROWS, ASKS = 50_000, 8_192
SIDES = ("before_time", "before_flux", "after_time", "after_flux")
_OUT = [
    StructField("request_time", DoubleType()), StructField("band", StringType()), *(StructField(c, ArrayType(DoubleType())) for c in SIDES),
    *(StructField(c, IntegerType()) for c in ("before_padding", "after_padding")),
    *(StructField(c, DoubleType()) for c in ("closest_time_in_band", "closest_flux_in_band", "closest_time_diff")),
]


class _Points:
    """The points of some objects by group, band, time and tie."""

    def __init__(self, curve: np.ndarray, time: np.ndarray, flux: np.ndarray, bias: float):
        self.curve, self.time, self.flux = curve, time, flux
        n = len(time)
        new = np.ones(n, bool)
        new[1:] = curve[1:] != curve[:-1]
        other_time, apart = new.copy(), new.copy()
        other_time[1:] |= time[1:] != time[:-1]
        apart[1:] |= time[1:] - time[:-1] > bias
        self.first_of_time = np.flatnonzero(other_time)[np.cumsum(other_time) - 1] if n else np.zeros(0, np.int64)
        moments = np.flatnonzero(apart)
        of = np.cumsum(apart) - 1
        self.first_of_moment = moments[of] if n else self.first_of_time
        self.after_moment = np.append(moments[1:], n)[of] if n else self.first_of_time

    def bounds(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, reached: bool) -> np.ndarray:
        """The first place in [low, high) whose time is at least (`reached`) or beyond `at`, else high."""
        if not len(self.time):
            return high
        low, high, last = low.copy(), high.copy(), len(self.time) - 1
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            time = self.time[np.minimum(middle, last)]
            on = (middle < high) & ((time < at) if reached else (time <= at))
            low, high = np.where(on, middle + 1, low), np.where(on, high, middle)
        return low

    def closest(self, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of the point nearest to `at` in [low, high): the earlier on ties, of one time the one with
        the smallest tie; -1 without points."""
        last = len(self.time) - 1
        later, beyond = self.bounds(low, high, at, True), self.bounds(low, high, at, False)
        has_before, has_after = beyond > low, later < high
        if last < 0:
            return np.full(len(at), -1)
        before, after = self.first_of_time[np.maximum(beyond - 1, 0)], np.minimum(later, last)
        nearer = has_before & (~has_after | (at - self.time[before] <= self.time[after] - at))
        return np.where(nearer, before, np.where(has_after, after, -1))


def _lists(values: np.ndarray) -> pa.Array:
    rows, n = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n), pa.array(values.ravel()))


class Windows:
    """Windows and closest points of requests (each one's curve and time): times and fluxes of the n slots before and
    after, outer ones 0 where `filled` is false, and of the closest point, if there is `some`."""

    def __init__(self, points: _Points, curve: np.ndarray, at: np.ndarray, n: int):
        low, high = np.searchsorted(points.curve, curve, "left"), np.searchsorted(points.curve, curve, "right")
        found = points.closest(low, high, at)
        self.n, self.some, last = n, found >= 0, max(len(points.time) - 1, 0)
        time, flux = (points.time, points.flux) if len(points.time) else (np.zeros(1), np.zeros(1))
        first, after = (points.first_of_moment[found], points.after_moment[found]) if len(points.time) else (found, found)
        place = np.concatenate([first[:, None] + np.arange(-n, 0), after[:, None] + np.arange(n)], axis=1)
        self.filled = np.concatenate([place[:, :n] >= low[:, None], place[:, n:] < high[:, None]], axis=1) & self.some[:, None]
        rows = np.clip(place, 0, last)
        self.time, self.flux = (np.where(self.filled, values.take(rows), 0.0) for values in (time, flux))
        rows = np.clip(found, 0, last)
        self.closest_time, self.closest_flux = time[rows], flux[rows]
        self.diff = np.abs(self.closest_time - at)

    def arrays(self) -> list[pa.Array]:
        """The columns from before_time to closest_time_diff."""
        n = self.n
        lists = [_lists(values[:, side]) for side in (slice(0, n), slice(n, None)) for values in (self.time, self.flux)]
        padding = [pa.array((n - self.filled[:, side].sum(axis=1)).astype(np.int32)) for side in (slice(0, n), slice(n, None))]
        return [*lists, *padding, *(pa.array(v, mask=~self.some) for v in (self.closest_time, self.closest_flux, self.diff))]


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys, in the session's number of partitions however few bytes they are: windows cost time, not bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def nearest_windows(obs: DataFrame, requests: DataFrame, n: int, bands: Sequence[str], bias: float = 1e-8, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """For each request (the keys, request_time) and each of the bands: the point nearest in time (the earlier
    on ties) and the n points before and after it: before_time, before_flux, after_time, after_flux (filled up
    with zeros at their outer ends), before_padding, after_padding, closest_time_in_band,
    closest_flux_in_band, closest_time_diff. Further columns of the requests are carried along.

    Points of one time (within the bias of the one before them) have the same surroundings: what lies before
    the first and after the last of them. A band without points has full padding and null closest fields.

    Curves and requests meet in one shuffle by the keys; a task takes whole objects in turn, finds the nearest
    points by halving, and gathers windows by place: no window is made for a point that nobody asks for, and
    nothing grows with points times requests. Points and requests without a time are left out.
    """
    extra = [c for c in requests.columns if c not in (*keys, "request_time", "band")]
    band = F.col("band").cast("string")
    points = obs.where(band.isin(list(bands)) & F.col("time").isNotNull()).select(
        *keys, F.lit(0).alias("_ask"), band.alias("_band"), F.col("time").cast("double").alias("_at"), F.col("tie").alias("_tie"), F.col("flux").cast("double").alias("_flux")
    )
    asks = requests.where("request_time is not null").select(*keys, F.lit(1).alias("_ask"), F.lit(None).cast("string").alias("_band"),
        F.col("request_time").cast("double").alias("_at"), *extra)
    both = points.unionByName(asks, allowMissingColumns=True)
    ordered = _dealt(both, *keys).sortWithinPartitions(*keys, "_ask", "_band", "_at", "_tie").drop("_tie")
    schema = StructType([*(both.schema[c] for c in (*keys, *extra)), *_OUT])
    arrow = to_arrow_schema(schema)
    names = sorted(set(bands))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys, BATCH_ROWS):
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            ask = np.flatnonzero(table["_ask"].to_numpy())
            if not len(ask):
                continue
            own = np.setdiff1d(np.arange(table.num_rows), ask, assume_unique=True)
            time, flux = table["_at"].to_numpy(), table["_flux"].to_numpy()
            band = np.searchsorted(names, table["_band"].take(pa.array(own)).to_numpy().astype(str)) if len(own) else own
            known = _Points(group[own] * len(names) + band, time[own], flux[own], bias)
            for i in range(0, len(ask), ASKS):
                part = np.repeat(ask[i : i + ASKS], len(bands))
                codes = np.tile([names.index(b) for b in bands], len(part) // len(bands))
                carried = table.select([*keys, *extra]).take(pa.array(part))
                made = [*(c.combine_chunks() for c in carried.columns), pa.array(time[part]), pa.array(np.array(names, object)[codes], pa.string()),
                    *Windows(known, group[part] * len(names) + codes, time[part], n).arrays()]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, schema)


def own_windows(batches: Iterator[pa.RecordBatch], n: int, bands: Sequence[str], bias: float = 1e-8) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, Windows]]:
    """The windows of whole objects (rows of own_points) at their own distinct times: for some requests and each of
    the bands the object, the time, the band's number in `bands`, and the windows."""
    names = np.array(sorted(set(bands)))
    number = np.searchsorted(names, list(bands))
    for table, starts in whole_groups(batches, ("object_id",), BATCH_ROWS):
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        time, band = table["_at"].to_numpy() + 0.0, table["_band"].combine_chunks().dictionary_encode()
        known = np.array([*(np.searchsorted(names, b) if b in names else -1 for b in band.dictionary.to_pylist()), -1], np.int64)
        code = known[band.indices.fill_null(len(known) - 1).to_numpy()]
        own = np.flatnonzero(code >= 0)
        own = own[np.argsort(group[own] * len(names) + code[own], kind="stable")]  # in order of time and tie already
        points = _Points(group[own] * len(names) + code[own], time[own], table["_flux"].to_numpy()[own], bias)
        new = np.ones(len(time), bool)
        new[1:] = (group[1:] != group[:-1]) | ((time[1:] != time[:-1]) & ~(np.isnan(time[1:]) & np.isnan(time[:-1])))
        ask, ids = np.flatnonzero(new), table["object_id"].combine_chunks()
        for i in range(0, len(ask), ASKS):
            part = np.repeat(ask[i : i + ASKS], len(bands))
            codes = np.tile(np.arange(len(bands)), len(part) // len(bands))
            yield ids.take(pa.array(part)), time[part], codes, Windows(points, group[part] * len(names) + number[codes], time[part], n)


def own_points(obs: DataFrame) -> DataFrame:
    """The points of all bands, an object's together and in order of time and tie, for own_windows: one shuffle."""
    points = obs.where("time is not null").select("object_id", F.col("time").cast("double").alias("_at"), F.col("tie").alias("_tie"),
        F.col("band").cast("string").alias("_band"), F.col("flux").cast("double").alias("_flux"))
    return _dealt(points, "object_id").sortWithinPartitions("object_id", "_at", "_tie").drop("_tie")


def windows_at_points(obs: DataFrame, n: int, bands: Sequence[str], bias: float = 1e-8) -> DataFrame:
    """nearest_windows at every distinct time of every object, without a table of requests: a curve asks for itself."""
    ordered = own_points(obs)
    schema = StructType([ordered.schema["object_id"], *_OUT])
    arrow, names = to_arrow_schema(schema), np.array(list(bands), object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, time, codes, windows in own_windows(batches, n, bands, bias):
            made = [ids, pa.array(time), pa.array(names[codes], pa.string()), *windows.arrays()]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, schema)
