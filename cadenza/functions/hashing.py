"""Randomness and splits from hashes: the same on any partitioning, retry and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def uniform(seed: int | str, *keys) -> Column:
    """A number in [0, 1) from 13 hex digits of md5(seed:key:...)."""
    digest = F.md5(F.concat_ws(":", _text(seed), *map(_text, keys)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def integer(n: int | Column, seed: int | str, *keys) -> Column:
    """A whole number in [0, n)."""
    return F.floor(uniform(seed, *keys) * n).cast("long")


def normal(seed: int | str, *keys) -> Column:
    """A standard normal number (Box-Muller on two uniforms)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(f"{seed}.r", *keys)))
    return radius * F.cos(2.0 * math.pi * uniform(f"{seed}.a", *keys))


def bounded_normal(bound: float, seed: int | str, *keys, tries: int = 8) -> Column:
    """The first of some standard normal draws within the bound, 0 if none is."""
    draws = [normal(f"{seed}.{i}", *keys) for i in range(tries)]
    return F.coalesce(*(F.when(F.abs(d) <= bound, d) for d in draws), F.lit(0.0))


#: Hex digits of the split hash and the split of object ids.
SPLIT_DIGITS = 12
SPLITS = {"TRAIN": 0.9, "TUNE": 0.1}
SPLIT_SALT = "train_tune_20181210"


def split_bounds(splits: dict[str, float]) -> dict[str, int]:
    """Largest hash value of each bucket; the last is the largest there is."""
    top, total, at, out = 16**SPLIT_DIGITS - 1, sum(splits.values()), 0, {}
    for name, share in splits.items():
        at += int(share * top / total)
        out[name] = at
    out[name] = top
    return out


def id_split(key, splits: dict[str, float] | None = None, salt: str = SPLIT_SALT) -> Column:
    """Bucket of an id by the first hex digits of sha1(salt + id)."""
    x = F.conv(F.substring(F.sha1(F.concat(F.lit(salt), _text(key)).cast("binary")), 1, SPLIT_DIGITS), 16, 10).cast("long")
    bounds = list(split_bounds(SPLITS if splits is None else splits).items())
    out = F.lit(bounds[-1][0])
    for name, most in reversed(bounds[:-1]):
        out = F.when(x <= most, F.lit(name)).otherwise(out)
    return out
