"""Aggregates over curves, classes, periods and pair scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from cadenza.functions.columns import column, log_loss, norm
from cadenza.operators.batches import Made
from cadenza.operators.curves import by_object, differences
from cadenza.operators.lookups import before_parts, in_ranges
from cadenza.operators.ranks import group_codes, narrowed_percentiles


def class_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("target").agg(F.count("*").alias("n"))


def describe(table: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, least, most, mean, variance (n - 1), skewness and excess kurtosis (population)."""
    v = F.col(value)
    return table.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"),
            F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis")
    )


def percentiles(values: DataFrame | Made, fractions: Sequence[float], *keys: str, value: str = "value") -> DataFrame:
    """at: the exact percentiles of the fractions (linear between ranks) per group, in their order. `value` may
    be an array, whose values all count.

    Brackets around the wanted ranks are narrowed in a few passes over the values, of which nothing is
    shuffled but counts (see ranks). Groups too many for that are ranked by ranges.
    """
    found = narrowed_percentiles(values, fractions, *keys, value=value)
    if found is not None:
        return found
    if isinstance(values, Made):
        values = values.table()
    if isinstance(values.schema[value].dataType, ArrayType):
        values = values.select(*keys, F.explode(value).alias(value))
    return percentiles_by_ranges(values, fractions, *keys, value=value)


def percentiles_by_ranges(values: DataFrame, fractions: Sequence[float], *keys: str, value: str = "value") -> DataFrame:
    """The same for any number of groups.

    Equal values are counted before any shuffle, the distinct ones are placed by range partitions, and
    only the rows at wanted ranks go on: no group is held or sorted in one task.
    """
    some = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    cut = in_ranges(some, *keys, "_v")
    base = before_parts(cut.groupBy("_part").agg(F.sum("_c").alias("_s")), "_s")
    # a group lies in one stretch of each range: where its first value stands follows from the stretches
    stretches = cut.groupBy("_part", *keys).agg(F.sum("_c").alias("_s"), F.min("_nth").alias("_f"))
    earlier = Window.partitionBy("_part").orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    began = stretches.withColumn("_o", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).join(F.broadcast(base), "_part")
    groups = began.groupBy(*keys).agg(F.min(F.col("_base") + F.col("_o")).alias("_began"), F.sum("_s").alias("_n"))
    inside = F.sum("_c").over(Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(base), "_part")
    joined = placed.join(groups, list(keys)) if keys else placed.join(F.broadcast(groups), how="cross")  # one row without keys
    start = F.col("_base") + F.col("_in") - F.col("_began")
    ranked = joined.select(*keys, "_v", start.alias("_from"), (start + F.col("_c")).alias("_to"), (F.col("_n") - 1).alias("_last"))
    wanted = F.transform(F.array(*(F.lit(float(q)) for q in fractions)), lambda q, i: F.struct(i.alias("i"), (q * F.col("_last")).alias("h")))
    here = F.filter(wanted, lambda x: (F.floor(x["h"]) < F.col("_to")) & (F.ceil(x["h"]) >= F.col("_from")))
    hits = ranked.select(*keys, "_v", "_from", "_to", F.explode(here).alias("_x")).select(*keys, "_v", "_from", "_to", "_x.*")
    low, high = F.floor("h"), F.ceil("h")
    ends = hits.groupBy(*keys, "i").agg(
        F.first("h").alias("h"), F.max(F.when((low >= F.col("_from")) & (low < F.col("_to")), F.col("_v"))).alias("_lo"),
            F.max(F.when((high >= F.col("_from")) & (high < F.col("_to")), F.col("_v"))).alias("_hi")
    )
    between = F.when(low == high, F.col("_lo")).otherwise((high - F.col("h")) * F.col("_lo") + (F.col("h") - low) * F.col("_hi"))
    found = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", between.alias("v")))).alias("_a"))
    return found.select(*keys, F.transform("_a", lambda x: x["v"]).alias("at"))


def median_interval(obs: DataFrame) -> DataFrame:
    """Median of all gaps, pooled over curves and bands."""
    return percentiles(differences(by_object(obs)), [0.5], value="dt").select(F.get("at", F.lit(0)).alias("median_dt"))


def percentile_cutoffs(values: DataFrame | Made, n: int, *keys: str, value: str = "value", extra: int = 8, exact: bool = True) -> DataFrame:
    """cutoffs: n rising percentiles of the values per group.

    Grids of n, n + 1, ... n + extra percentiles are taken in one pass; the first with n distinct
    values gives them (its first n). If none has, the distinct values of the last are filled up with
    its largest. exact=False uses approximate percentiles.
    """
    grids = [[i / (m + 1) for i in range(1, m + 1)] for m in range(n, n + extra + 1)]
    fractions = sorted({q for grid in grids for q in grid})
    if exact:
        found = percentiles(values, fractions, *keys, value=value)
    else:
        values = values.table() if isinstance(values, Made) else values
        single = values.select(*keys, F.explode(value).alias(value)) if isinstance(values.schema[value].dataType, ArrayType) else values
        found = single.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.percentile_approx(value, fractions).alias("at"))
    cells = [F.array_distinct(F.array(*(F.col("at")[fractions.index(q)] for q in grid))) for grid in grids]
    filled = F.slice(F.concat(cells[-1], F.array_repeat(F.element_at(cells[-1], -1), n)), 1, n)
    chosen = F.coalesce(*(F.when(F.size(cell) >= n, F.slice(cell, 1, n)) for cell in cells), filled)
    return found.select(*keys, chosen.alias("cutoffs"))


def cutoff_scales(cutoffs: DataFrame, *keys: str) -> DataFrame:
    """median_scale: median of the steps between consecutive cutoffs."""
    steps = cutoffs.select(*keys, "cutoffs", F.explode(F.zip_with(F.slice("cutoffs", 2, F.greatest(F.lit(0), F.size("cutoffs") - 1)),
        F.slice("cutoffs", 1, F.greatest(F.lit(0), F.size("cutoffs") - 1)), lambda b, a: b - a)).alias("_d"))
    return steps.groupBy(*keys).agg(F.median("_d").alias("median_scale"))


def histogram(table: DataFrame, value: str, bins: int, *keys: str) -> DataFrame:
    """bin (from 0), n and density over equal bins from least to most; the right edge is in the last."""
    v = F.col(value)
    some = table.where(v.isNotNull())
    limits = some.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("_n"))
    joined = some.join(limits, list(keys)) if keys else some.join(F.broadcast(limits), how="cross")  # one row without keys
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return joined.groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first(width).alias("width"), F.first("_n").alias("_n")).select(
        *keys, "bin", "n", F.try_divide(F.col("n").cast("double"), F.col("_n") * F.col("width")).alias("density")
    )


def log_positions(low: float, high: float, n: int) -> list[float]:
    step = (math.log10(high) - math.log10(low)) / (n - 1)
    return [10 ** (math.log10(low) + i * step) for i in range(n)]


def _line_sums(keys: int, x: np.ndarray, bandwidth: float, types: list[pa.DataType], names: list[str]):
    """Kernel sums of a task's values at the positions, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            code, groups = group_codes(batch, keys)
            values = batch.column(keys).to_numpy(zero_copy_only=False)
            for g, name in enumerate(groups if batch.num_rows else ()):
                own, total = values[code == g], sums.setdefault(name, np.zeros(len(x) + 1))
                for at in range(0, len(own), 1024):
                    z = (x[:, None] - own[at : at + 1024]) / bandwidth
                    total[:-1] += np.exp(-0.5 * z * z).sum(axis=1)
                total[-1] += len(own)
        for name, total in sums.items():
            own = [pa.array([v] * len(x), t) for v, t in zip(name, types, strict=True)]
            columns = [*own, pa.array(np.arange(len(x), dtype=np.int32)), pa.array(total[:-1]), pa.array(np.full(len(x), int(total[-1])))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def density_1d(table: DataFrame, value: str, positions: Sequence[float], *keys: str, bandwidth: float = 1.0) -> DataFrame:
    """Gaussian kernel density at fixed positions: the keys, place, x, density. Every task sums its values for
    all positions; only these sums are shuffled."""
    x = np.array(positions, float)
    some = table.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    schema = StructType([*(some.schema[k] for k in keys), *StructType.fromDDL("place int, _s double, _n long")])
    summed = some.mapInArrow(_line_sums(len(keys), x, bandwidth, [to_arrow_type(some.schema[k].dataType) for k in keys], schema.names), schema)
    at = summed.groupBy(*keys, "place").agg((F.sum("_s") / F.sum("_n") / (bandwidth * math.sqrt(2 * math.pi))).alias("density"))
    return at.select(*keys, "place", F.get(F.array(*map(F.lit, x.tolist())), F.col("place")).alias("x"), "density")


_BOX = ("lo_a", "hi_a", "lo_b", "hi_b", "caa", "cbb", "cab", "det")


def _kernel_sums(n: int):
    """Sums of the kernel over a task's points, for each cell of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        some = False
        for batch in batches:
            if not batch.num_rows:
                continue
            some = True
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lo_a, hi_a, lo_b, hi_b, caa, cbb, cab, det = (batch.column(2 + i)[0].as_py() for i in range(len(_BOX)))
            if det is None or not det > 0:
                total += np.nan
                continue
            xa, xb = lo_a + (hi_a - lo_a) * np.arange(n) / (n - 1), lo_b + (hi_b - lo_b) * np.arange(n) / (n - 1)
            for at in range(0, len(a), 64):
                da, db = xa[:, None, None] - a[at : at + 64], xb[None, :, None] - b[at : at + 64]
                total += np.exp(-0.5 * (cbb * da * da - 2.0 * cab * da * db + caa * db * db) / det).sum(axis=2)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n, dtype=np.int32)), pa.array(total.ravel(), from_pandas=True)], names=["cell", "s"])

    return run


def density_2d(table: DataFrame, a: str, b: str, n: int = 100) -> DataFrame:
    """Gaussian kernel density on an n x n grid over the data's box: ia, ib, xa, xb, density.

    The kernel has the data's covariance times Scott's factor n ** (-1/6) squared; the density is null
    if that is singular. Every task sums its points for all cells; only these sums are shuffled.
    """
    some = table.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    s = some.agg(F.count("*").alias("n"), *(f(c).alias(f"{name}_{c}") for c in "ab" for name, f in (("lo", F.min), ("hi", F.max), ("var",
        F.var_samp))), F.covar_samp("a", "b").alias("cov"))
    factor = F.pow(F.col("n").cast("double"), -1.0 / 3.0)
    box = s.select("*", (F.col("var_a") * factor).alias("caa"), (F.col("var_b") * factor).alias("cbb"), (F.col("cov") * factor).alias("cab"))
    box = box.withColumn("det", F.col("caa") * F.col("cbb") - F.col("cab") * F.col("cab"))  # one row
    sums = some.join(F.broadcast(box.select(*_BOX)), how="cross").select("a", "b", *_BOX).mapInArrow(_kernel_sums(n), "cell int, s double")
    at = sums.groupBy("cell").agg(F.sum("s").alias("s")).join(F.broadcast(box), how="cross")
    ia, ib = F.floor(F.col("cell") / n).cast("int"), (F.col("cell") % n).cast("int")
    place = lambda c, i: F.col(f"lo_{c}") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * i / (n - 1)
    density = F.col("s") / (F.col("n") * 2.0 * math.pi * F.sqrt("det"))
    return at.select(ia.alias("ia"), ib.alias("ib"), place("a", ia).alias("xa"), place("b", ib).alias("xb"), density.alias("density"))


def best_period(powers: DataFrame, *keys: str) -> DataFrame:
    """Period of the largest power (NaN and null left out; the shorter on ties) and its frequency."""
    some = powers.where(F.col("power").isNotNull() & ~F.isnan("power"))
    return some.groupBy(*keys).agg(F.max_by("period", F.struct("power", -F.col("period"))).alias("period")).withColumn("frequency", 1.0 / F.col("period"))


def top_periods(powers: DataFrame, k: int = 5) -> DataFrame:
    """The k highest local maxima of each object: object_id, rank (1..k), period, score."""
    w = Window.partitionBy("object_id").orderBy("period")
    some = powers.where(F.col("power").isNotNull() & ~F.isnan("power")).withColumns({"_l": F.lag("power").over(w), "_r": F.lead("power").over(w)})
    peak = (F.col("_l").isNull() | (F.col("power") > F.col("_l"))) & (F.col("_r").isNull() | (F.col("power") >= F.col("_r")))
    nth = F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("power"), "period"))
    return some.where(peak).withColumn("rank", nth).where(F.col("rank") <= k).select("object_id", "rank", "period", F.col("power").alias("score"))


def best_of(top: DataFrame) -> DataFrame:
    """The period of the highest score of each object."""
    return top.groupBy("object_id").agg(F.max_by("period", F.struct("score", -F.col("rank"))).alias("period_best"))


def mean_log_loss(pairs: DataFrame, label: str = "label", score: str = "score", epsilon: float = 1e-5) -> DataFrame:
    return pairs.agg(F.avg(log_loss(label, score, epsilon)).alias("loss"))


def accuracy(pairs: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return pairs.agg(F.avg(((column(score) > 0.5).cast("int") == column(label)).cast("double")).alias("accuracy"))


def norm_loss(pairs: DataFrame, weight: bool = True) -> DataFrame:
    """Mean over both sides of (norm - 1) squared; 0 if norms aren't used."""
    if not weight:
        return pairs.agg(F.lit(0.0).alias("aux_loss"))
    sides = pairs.select(F.explode(F.array("left", "right")).alias("v"))
    return sides.agg(F.avg(F.pow(norm("v") - 1.0, 2)).alias("aux_loss"))


def squared_error(pairs: DataFrame, goal: str, score: str) -> DataFrame:
    return pairs.agg(F.avg(F.pow(column(goal) - column(score), 2)).alias("mse"))


def mixing_weights(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each data set and its share of all."""
    out = None
    for name, table in datasets.items():
        one = table.agg(F.lit(name).alias("dataset"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(out.agg(F.sum("n").alias("_all"))), how="cross").select("dataset", "n", (F.col("n") / F.col("_all")).alias("weight"))  # a row per data set


def split_divergence(splits: DataFrame, shares: Mapping[str, float], name: str = "split") -> DataFrame:
    """Kullback-Leibler divergence of the observed split from the wanted shares."""
    total = sum(shares.values())
    wanted = F.create_map(*(F.lit(x) for k, v in shares.items() for x in (k, v / total)))
    counts = splits.groupBy(name).agg(F.count("*").alias("n"))
    counts = counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all"))), how="cross")  # a row per bucket
    p = F.col("n") / F.col("_all")
    return counts.agg(F.sum(p * F.log(p / F.element_at(wanted, F.col(name)))).alias("kl"), F.sum("n").alias("n"))


def match_lists(pairs: DataFrame, left: str, right: str, *values: str) -> DataFrame:
    """match and the values of every pair: the class of equal pairs, "mismatch" for all others. The
    lists stay rows, since that of the mismatches is as long as the table."""
    group = F.when(F.col(left) == F.col(right), F.col(left).cast("string")).otherwise("mismatch")
    return pairs.select(group.alias("match"), *values)


def match_values(pairs: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """Summary of pair values by class of equal pairs, and of all others as "mismatch"."""
    return match_lists(pairs, left, right, value).groupBy("match").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
