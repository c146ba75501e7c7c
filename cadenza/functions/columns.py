"""Scalar and array functions of curves, windows and vectors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


# ---------------------------------------------------------------- scalars
def magnitude_flux(mag) -> Column:
    """Flux of a magnitude: 1e23 * 10 ** (-0.4 (mag + 48.6))."""
    return F.lit(1e23) * F.pow(F.lit(10.0), F.lit(-0.4) * (column(mag) + 48.6))


def magnitude_flux_err(mag, mag_err) -> Column:
    return column(mag_err) / column(mag) * magnitude_flux(mag)


def phase(time, period) -> Column:
    """Time within the period, never negative; null without a period."""
    p = column(period)
    return F.when(p != 0, F.pmod(column(time), p))


def moved_time(time, translate, dilate) -> Column:
    """dilate * (time + translate)."""
    return _positive(dilate, "dilate_time") * (column(time) + column(translate))


def moved_flux(flux, translate, dilate) -> Column:
    return _positive(dilate, "dilate_flux") * (column(flux) + column(translate))


def moved_flux_err(flux_err, dilate) -> Column:
    return F.sqrt(_positive(dilate, "dilate_flux")) * column(flux_err)


def _positive(x, name: str) -> Column:
    if isinstance(x, (int, float)):
        if not x > 0:
            raise ValueError(f"{name} must be positive")
        return F.lit(float(x))
    return F.when(column(x) > 0, column(x)).otherwise(F.raise_error(F.lit(f"{name} must be positive")).cast("double"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def gaussian(x: Column) -> Column:
    return F.exp(-x * x)


# ---------------------------------------------------------------- windows around a point
def window_mask(before_padding, after_padding, n: int) -> Column:
    """Which of the 2n slots hold points: padding is at the outer ends."""
    left = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i >= column(before_padding))
    right = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.lit(n) - column(after_padding))
    return F.concat(left, right)


def deltas(before, after, centre) -> Column:
    """Values of all slots less the centre's."""
    return F.transform(F.concat(column(before), column(after)), lambda x: x - column(centre))


def in_window(time_diff, most: float) -> Column:
    return column(time_diff) < most


def both(mask: Column, flag: Column) -> Column:
    return F.transform(mask, lambda m: m & flag)


def slopes(dflux: Column, dtime: Column, clip: float | None = 10.0) -> Column:
    """dflux / dtime, clipped. Where dtime is 0: the clip with dflux's sign, null for 0 / 0 (or unclipped)."""

    def one(f: Column, t: Column) -> Column:
        ratio = F.try_divide(f, t)
        if clip is None:
            return ratio
        edge = F.when(f > 0, F.lit(float(clip))).when(f < 0, F.lit(-float(clip)))
        return F.when(t == 0, edge).otherwise(F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), ratio)))

    return F.zip_with(dflux, dtime, one)


def masked(values: Column, mask: Column, fill: float) -> Column:
    """Values where the mask holds, the fill elsewhere (and for null values)."""
    return F.zip_with(mask, values, lambda m, x: F.when(m, F.coalesce(x, F.lit(float(fill)))).otherwise(F.lit(float(fill))))


def initial_layer(dflux: Column, dtime: Column, clip: float = 10.0) -> Column:
    """For each slot [slope, dflux, dtime]."""
    return F.transform(F.arrays_zip(slopes(dflux, dtime, clip).alias("s"), dflux.alias("f"), dtime.alias("t")), lambda x: F.array(x["s"], x["f"], x["t"]))


def soft_onehot(values: Column, cutoffs: Column, scale: Column, kind=sigmoid) -> Column:
    """For each value, kind((value - cutoff) / scale) for every cutoff."""
    return F.transform(values, lambda x: F.transform(cutoffs, lambda c: kind(F.try_divide(x - c, scale))))


def soft_maximum(before_flux, after_flux, before_padding, after_padding, closest_flux, n: int, epsilon: float) -> Column:
    """Product over filled slots of sigmoid((closest - flux) / epsilon): near 1 at a local maximum."""
    scores = F.transform(F.concat(column(before_flux), column(after_flux)), lambda f: sigmoid((column(closest_flux) - f) / epsilon))
    kept = F.zip_with(window_mask(before_padding, after_padding, n), scores, lambda m, s: F.when(m, s).otherwise(F.lit(1.0)))
    return F.aggregate(kept, F.lit(1.0), lambda a, x: a * x)


# ---------------------------------------------------------------- vectors
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(column(a), column(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def pair_score(left, right, normalise: bool = True) -> Column:
    """(cosine + 1) / 2, norms floored at 1e-6; without normalising (dot + 1) / 2."""
    product = dot(left, right)
    if normalise:
        product = product / (F.greatest(F.lit(1e-6), norm(left)) * F.greatest(F.lit(1e-6), norm(right)))
    return 0.5 * (product + 1.0)


def cosine(left, right) -> Column:
    """Cosine without a floor: null for a zero vector."""
    return F.try_divide(dot(left, right), norm(left) * norm(right))


def log_loss(label, score, epsilon: float = 1e-5) -> Column:
    """-y ln(p + e) - (1 - y) ln(1 - p + e)."""
    y, p = column(label).cast("double"), column(score)
    return -y * F.log(p + epsilon) - (1.0 - y) * F.log(1.0 - p + epsilon)
