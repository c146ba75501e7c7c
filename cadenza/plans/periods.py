"""Period search: a weighted floating-mean periodogram over all bands, catalogues and reports.

Periods are those of a list, or follow each object's time span: frequencies from one cycle in the span
to one in the shortest period, so closely spaced that no peak is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import phase
from cadenza.operators.batches import whole_groups
from cadenza.operators.stats import best_of, density_1d, describe, histogram, top_periods
from cadenza.storage import stored


def period_grid(spark, periods: Sequence[float]) -> DataFrame:
    """A list of periods in the plan."""
    return spark.createDataFrame([(float(p),) for p in periods], "period double")


def frequency_periods(shortest: float, longest: float, n: int) -> list[float]:
    """n periods of evenly spaced frequencies from 1 / longest to 1 / shortest."""
    low, high = 1.0 / longest, 1.0 / shortest
    return [1.0 / (low + (high - low) * i / (n - 1)) for i in range(n)]


#: Moments of a band at a period: names and what they are the weighted mean of.
_PRODUCTS = {"y": "y", "c": "c", "s": "s", "yy": "y*y", "cc": "c*c", "ss": "s*s", "cs": "c*s", "yc": "y*c", "ys": "y*s"}
#: Bands whose phases or fluxes vary less than this have no power at a period.
_LEAST_SPREAD = 1e-6


def _powers(sums: DataFrame, *keys: str) -> DataFrame:
    """power per keys from the weighted sums of each band: the fit of a sinusoid with floating mean,
    bands weighted by their chi^2 about the mean."""
    m = sums.select(*keys, "w", *((F.col(f"s_{k}") / F.col("w")).alias(k) for k in _PRODUCTS))
    v = m.selectExpr(*keys, "w", "yy - y*y AS vyy", "cc - c*c AS vcc", "ss - s*s AS vss", "cs - c*s AS vcs", "yc - y*c AS vyc", "ys - y*s AS vys")
    d = F.expr("vcc*vss - vcs*vcs")
    part = F.when((d > _LEAST_SPREAD) & (F.col("vyy") > _LEAST_SPREAD), F.expr("vss*vyc*vyc + vcc*vys*vys - 2*vcs*vyc*vys") / (F.col("vyy") * d))
    chi = F.when(part.isNotNull(), F.col("w") * F.col("vyy"))
    return v.groupBy(*keys).agg(F.try_divide(F.sum(chi * part), F.sum(chi)).alias("power"))


def periodogram(obs: DataFrame, grid: DataFrame) -> DataFrame:
    """power per (object_id, period) of a list of periods, points weighted by 1 / err^2.

    One row per point and period meets partial sums before any shuffle. Power is null if no band has
    three distinct phases and a varying flux.
    """
    w = 1.0 / (F.col("flux_err") * F.col("flux_err"))
    angle = 2.0 * math.pi * F.col("time") / F.col("period")
    terms = obs.where(F.col("flux_err") > 0).select("object_id", "band", "time", "flux", "flux_err").join(F.broadcast(grid), how="cross")  # the grid is a literal list
    at = terms.select("object_id", "band", "period", w.alias("w"), F.col("flux").alias("y"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    sums = at.groupBy("object_id", "period", "band").agg(F.sum("w").alias("w"), *(F.sum(F.expr(f"w*{e}")).alias(f"s_{k}") for k, e in _PRODUCTS.items()))
    return _powers(sums, "object_id", "period")


# ---------------------------------------------------------------- grids that follow the data
def span_grids(obs: DataFrame, shortest: float = 0.1, oversampling: float = 5.0) -> DataFrame:
    """object_id, grid, low, step, n: n frequencies low + k step from 1 / span to 1 / shortest, with
    `oversampling` steps to a peak's width. An object seen for no longer than `shortest` has none."""
    spans = obs.where(F.col("flux_err") > 0).groupBy("object_id").agg((F.max("time") - F.min("time")).alias("_span")).where(F.col("_span") > shortest)
    low, step = 1.0 / F.col("_span"), 1.0 / (oversampling * F.col("_span"))
    return spans.select("object_id", F.lit(0).alias("grid"), low.alias("low"), step.alias("step"), (F.floor((1.0 / F.lit(shortest) - low) / step) + 1).cast("int").alias("n"))


#: Points of a band up to which its sums are taken term by term, which is cheaper and exact; more are
#: transformed. Frequencies that are worked on together, and of one group.
DIRECT, FREQUENCIES, GRID_BLOCK = 48, 8192, 65_536
#: Grid places that a point is spread over, and the shape of its kernel (about 13 digits at twofold sampling).
_WIDTH, _BETA = 14, 2.3 * 14


def _kernel(x: np.ndarray) -> np.ndarray:
    """What a point at 0 gives to the grid place x."""
    inside = 1.0 - (2.0 * x / _WIDTH) ** 2
    return np.where(inside > 0, np.exp(_BETA * (np.sqrt(np.maximum(inside, 0.0)) - 1.0)), 0.0)


@lru_cache(maxsize=16)
def _correction(size: int) -> np.ndarray:
    """1 / the kernel's own transform at the size's frequencies, from -size / 2 on a grid twice as fine."""
    node, weight = np.polynomial.legendre.leggauss(80)
    x = (node + 1.0) * _WIDTH / 4.0  # one half of the kernel
    at = np.arange(-size // 2, size // 2) / (2.0 * size)
    return 1.0 / (np.cos(2.0 * math.pi * at[:, None] * x) @ (weight * _kernel(x)) * _WIDTH / 2.0)


def transform(cycles: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """sum_j weights[:, j] exp(2 pi i k cycles[j]) for k = 0 to size - 1 (size a power of two), irregular
    places: points are spread over a grid twice as fine, the grid is transformed at once, and the kernel's
    own transform is divided out. Points x width + size log size steps, whatever the frequencies."""
    fine = 2 * size
    place = (cycles % 1.0) * fine
    nearest = np.ceil(place - _WIDTH / 2).astype(np.int64)
    to = nearest[:, None] + np.arange(_WIDTH)
    share = _kernel(to - place[:, None])
    to = (to % fine).ravel()
    centred = weights * np.exp(2j * math.pi * (cycles * (size // 2) % 1.0))
    out = np.empty((len(weights), size), complex)
    for i, own in enumerate(centred):
        spread = own[:, None] * share
        grid = np.bincount(to, spread.real.ravel(), fine) + 1j * np.bincount(to, spread.imag.ravel(), fine)
        found = np.fft.ifft(grid) * fine
        out[i] = np.concatenate([found[-(size // 2) :], found[: size - size // 2]]) * _correction(size)
    return out


def _waves(time: np.ndarray, low: float, step: float, n: int) -> np.ndarray:
    """exp(2 pi i time (low + k step)) for k = 0 to n - 1, as products of two short lists."""
    short = min(64, n)
    fine = np.exp(2j * math.pi * (step * time)[:, None] * np.arange(short))
    coarse = np.exp(2j * math.pi * time[:, None] * (low + step * short * np.arange(-(-n // short))))
    return (coarse[:, :, None] * fine[:, None, :]).reshape(len(time), -1)[:, :n]


def band_sums(time: np.ndarray, flux: np.ndarray, err: np.ndarray, low: float, step: float, n: int, direct: int = DIRECT) -> np.ndarray:
    """The weight and the nine weighted sums of a band at each of n frequencies low + k step, by blocks of
    frequencies. Squares and products of the waves are sums at twice the frequency."""
    w = 1.0 / (err * err)
    both = np.stack([w, w * flux])
    out = np.empty((1 + len(_PRODUCTS), n))
    out[0], out[1], out[4] = w.sum(), (w * flux).sum(), (w * flux * flux).sum()
    for at in range(0, n, FREQUENCIES):
        part, size, start = slice(at, min(n, at + FREQUENCIES)), min(n - at, FREQUENCIES), low + step * at
        if len(time) <= direct:
            waves = _waves(time, start, step, size)
            once, twice = both @ waves, w @ (waves * waves)
        else:
            whole = max(2, 1 << (size - 1).bit_length())
            once = transform(step * time, both * np.exp(2j * math.pi * (start * time % 1.0)), whole)[:, :size]
            twice = transform(2.0 * step * time, (w * np.exp(2j * math.pi * (2.0 * start * time % 1.0)))[None], whole)[0, :size]
        out[2, part], out[3, part], out[8, part], out[9, part] = once[0].real, once[0].imag, once[1].real, once[1].imag
        out[5, part], out[6, part], out[7, part] = (out[0, 0] + twice.real) / 2, (out[0, 0] - twice.real) / 2, twice.imag / 2
    return out


_SUMS = ("w", *(f"s_{k}" for k in _PRODUCTS))
_AT = "object_id long, grid int, k int, period double"
_PART = f"{_AT}, band string, " + ", ".join(f"{c} double" for c in _SUMS)


def _grid_sums(table: pa.Table) -> tuple[dict, list[str], list[np.ndarray]]:
    """What identifies the rows of a group, its bands, and the sums of each."""
    one = {c: table[c][0].as_py() for c in ("object_id", "grid", "low", "step", "first", "n")}
    n = one["n"]
    k = one["first"] + np.arange(n)
    band = table["band"].to_numpy()
    time, flux, err = (table[c].to_numpy() for c in ("time", "flux", "flux_err"))
    names = sorted(set(band.tolist()))
    low = one["low"] + one["step"] * one["first"]
    ids = {"object_id": np.full(n, one["object_id"]), "grid": np.full(n, one["grid"], np.int32), "k": k.astype(np.int32), "period": 1.0 / (one["low"] + one["step"] * k)}
    return ids, names, [band_sums(time[band == b], flux[band == b], err[band == b], low, one["step"], n) for b in names]


def _sum_rows(table: pa.Table) -> pa.Table:
    ids, names, sums = _grid_sums(table)
    return pa.concat_tables([pa.table({**ids, "band": [b] * len(ids["k"]), **dict(zip(_SUMS, own, strict=True))}) for b, own in zip(names, sums, strict=True)])


def _summits(power: np.ndarray, keep: int) -> np.ndarray:
    """Of a block's powers by rising frequency the rows that decide its share of the `keep` highest peaks: its own
    highest peaks, their neighbours, and two rows at either end, which meet the next block's. A row that looks like a
    peak only because rows beside it are left out is lower than a peak of them, and so than the block's `keep` best."""
    at = np.flatnonzero(~np.isnan(power))[::-1]  # by rising period, as peaks are defined
    own = power[at]
    peaks = np.flatnonzero((own[1:-1] > own[:-2]) & (own[1:-1] >= own[2:])) + 1
    best = peaks[np.argsort(-own[peaks], kind="stable")[:keep]]
    ends = np.array([0, 1, len(own) - 2, len(own) - 1])
    kept = np.unique(np.concatenate([best - 1, best, best + 1, ends[(ends >= 0) & (ends < len(own))]]))
    return np.sort(at[kept])


def _power_rows(table: pa.Table, keep: int | None = None) -> pa.Table:
    ids, _, sums = _grid_sums(table)
    top, all_chi = np.zeros(len(ids["k"])), np.zeros(len(ids["k"]))
    for own in sums:
        y, c, s, yy, cc, ss, cs, yc, ys = own[1:] / own[0]
        vyy, vcc, vss, vcs, vyc, vys = yy - y * y, cc - c * c, ss - s * s, cs - c * s, yc - y * c, ys - y * s
        d = vcc * vss - vcs * vcs
        fits = (d > _LEAST_SPREAD) & (vyy > _LEAST_SPREAD)
        part = (vss * vyc * vyc + vcc * vys * vys - 2 * vcs * vyc * vys) / np.where(fits, vyy * d, 1.0)
        top += np.where(fits, own[0] * vyy * part, 0.0)
        all_chi += np.where(fits, own[0] * vyy, 0.0)
    power = np.where(all_chi > 0, top / np.where(all_chi > 0, all_chi, 1.0), np.nan)
    if keep is not None:
        kept = _summits(power, keep)
        ids, power = {c: v[kept] for c, v in ids.items()}, power[kept]
    return pa.table({**ids, "power": pa.array(power, from_pandas=True)})


_BLOCK = ("object_id", "grid", "first")
#: Points that are taken from Spark together, and powers that are given back together.
POINTS, POWERS = 50_000, 200_000


def _block_powers(keep: int | None):
    """Powers of many blocks in turn, or their summits: small blocks share their Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, _BLOCK, POINTS):
            table, made, rows = table.combine_chunks(), [], 0
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                made.append(_power_rows(table.slice(a, b - a), keep))
                rows += made[-1].num_rows
                if rows >= POWERS:
                    yield from pa.concat_tables(made).combine_chunks().to_batches()
                    made, rows = [], 0
            if made:
                yield from pa.concat_tables(made).combine_chunks().to_batches()

    return run


def _blocks(grids: DataFrame) -> DataFrame:
    """A row for each block of a grid's frequencies: first and n are of the block."""
    count = F.ceil(F.col("n") / GRID_BLOCK).cast("int")
    each = grids.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("_block"))
    first = (F.col("_block") * GRID_BLOCK).cast("int")
    return each.select("object_id", "grid", "low", "step", first.alias("first"), F.least(F.col("n") - first, F.lit(GRID_BLOCK)).cast("int").alias("n"))


def grid_powers(obs: DataFrame, grids: DataFrame, chunk: int = 50_000, keep: int | None = None) -> DataFrame:
    """object_id, grid, k, period and power of each object's own frequency grids (see span_grids).

    A curve meets GRID_BLOCK frequencies at a time, as arrays. One of more than `chunk` points is dealt to
    several groups, whose sums are added up by Spark: no group grows with the table or with the time span. keep: only powers that
    best_period and top_periods up to that rank need (see _summits), and all of curves that are dealt.
    """
    points = obs.where(F.col("flux_err") > 0).select("object_id", "band", "time", "flux", "flux_err", "tie")
    counts = points.groupBy("object_id").agg(F.count("*").alias("_points"))
    asked = points.join(_blocks(grids).join(counts, "object_id"), "object_id")
    small = asked.where(F.col("_points") <= chunk).select(*_BLOCK, "low", "step", "n", "band", "time", "flux", "flux_err")
    parts = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # however few bytes: searches cost time
    whole = small.repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(_block_powers(keep), f"{_AT}, power double")
    share = F.pmod(F.xxhash64("tie", "time", "band"), F.ceil(F.col("_points") / chunk))
    dealt = asked.where(F.col("_points") > chunk).withColumn("_chunk", share).groupBy("object_id", "grid", "first", "_chunk").applyInArrow(_sum_rows, _PART)
    summed = dealt.groupBy("object_id", "grid", "k", "period", "band").agg(*(F.sum(c).alias(c) for c in _SUMS))
    return whole.unionByName(_powers(summed, "object_id", "grid", "k", "period"))


def span_periodogram(obs: DataFrame, shortest: float = 0.1, oversampling: float = 5.0, chunk: int = 50_000, keep: int | None = None) -> DataFrame:
    """power per (object_id, period), periods from the shortest to each object's time span; with `keep` only what the
    `keep` highest peaks of each object follow from."""
    return grid_powers(obs, span_grids(obs, shortest, oversampling), chunk, keep).select("object_id", "period", "power")


def refined(obs: DataFrame, top: DataFrame, oversampling: float = 5.0, zoom: int = 100) -> DataFrame:
    """object_id, rank, period and score of the peaks (as of top_periods), each searched again between
    its neighbours of the span's grid, `zoom` times as closely. Peaks keep their rank. The peaks are
    stored: they are asked for twice, and the search behind them is the dear part."""
    top = stored(top.select("object_id", "rank", "period", "score"), "period-peaks")
    span = obs.where(F.col("flux_err") > 0).groupBy("object_id").agg((F.max("time") - F.min("time")).alias("_span"))
    step = 1.0 / (oversampling * F.col("_span"))
    grids = top.join(span, "object_id").select("object_id", F.col("rank").alias("grid"), (1.0 / F.col("period") - step).alias("low"),
        (step / zoom).alias("step"), F.lit(2 * zoom + 1).alias("n"))
    found = grid_powers(obs, grids.where("low > 0")).where("power is not null")
    best = found.groupBy("object_id", F.col("grid").alias("rank")).agg(F.max_by(F.struct("period", "power"), F.struct("power", -F.col("k"))).alias("b"))
    joined = top.join(best, ["object_id", "rank"], "left")
    return joined.select("object_id", "rank", F.coalesce("b.period", "period").alias("period"), F.coalesce("b.power", "score").alias("score"))


def period_catalogue(meta: DataFrame, powers: DataFrame, k: int = 5) -> DataFrame:
    """object_id, ddf, target, period1..k, score1..k of every object with metadata."""
    return catalogue_of(meta, top_periods(powers, k), k)


def catalogue_of(meta: DataFrame, top: DataFrame, k: int = 5) -> DataFrame:
    """The catalogue of given top periods."""
    cells = [F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"{c}{i}") for c in ("period", "score") for i in range(1, k + 1)]
    return meta.select("object_id", "ddf", "target").join(top.groupBy("object_id").agg(*cells), "object_id")


def phase_folded(obs: DataFrame, top: DataFrame) -> DataFrame:
    """Observations with the phase in the object's best period."""
    return obs.join(best_of(top), "object_id").withColumn("phase", phase("time", "period_best"))


def class_table(spark, **sets: Sequence[int]) -> DataFrame:
    """target and a flag per named set of classes (lists in the plan)."""
    targets = sorted({t for s in sets.values() for t in s})
    return spark.createDataFrame([(t, *(t in s for s in sets.values())) for t in targets], "target int, " + ", ".join(f"{name} boolean" for name in sets))


def period_report(catalogue: DataFrame, bins: int = 50, positions: Sequence[float] = ()) -> dict[str, DataFrame]:
    """Per class: description and histogram of the best period, and its kernel density."""
    best = catalogue.select("object_id", "target", F.col("period1").alias("period")).where("period is not null")
    report = {"describe": describe(best, "period", "target"), "histogram": histogram(best, "period", bins, "target")}
    if positions:
        report["density"] = density_1d(best, "period", positions, "target")
    return report

