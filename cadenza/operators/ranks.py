"""Exact percentiles of groups without a sort: repeated narrowing of brackets around the wanted ranks.

Doubles are taken as whole numbers in the same order. The first pass counts each group's values by their
leading bits; a wanted rank lies in one cell, whose least and largest value bracket it. Every further pass
looks only at values inside brackets, by finer cells, until a bracket holds one value or so few values are
left inside that all are counted one by one. Each task counts its own values; counts of cells are all that
is shuffled, at most CELLS of them reach the driver, and no value is sorted by Spark or stored. A bracket
loses at least four bits in a pass, whatever the values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegralType, LongType, StructField, StructType

from cadenza.operators.batches import Made

#: Cells of all groups together, rows of cells that a task holds, and values inside brackets that are counted singly.
CELLS, HELD, SINGLE = 1 << 20, 1 << 18, 1 << 18
#: Leading bits of the first pass: sign, exponent and eight bits more.
LEADING = 20


def in_order(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles: -0.0 as 0.0, NaN largest."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))


def as_doubles(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))).view(np.float64)


class _Brackets:
    """Disjoint brackets [low, high] of a group in order, and how far their values are shifted to a cell."""

    def __init__(self, low: np.ndarray, high: np.ndarray, shift: np.ndarray):
        self.low, self.high, self.shift = low, high, shift

    def cells(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the (sorted) keys lie in brackets, and their bracket and cell."""
        of = np.searchsorted(self.low, keys, "right") - 1
        inside = np.flatnonzero((of >= 0) & (keys <= self.high[np.maximum(of, 0)]))
        of = of[inside]
        offset = keys[inside].view(np.uint64) - self.low[of].view(np.uint64)
        return inside, of, (offset >> self.shift[of]).astype(np.int64)


def _counted(group, bracket, cell, n, low, high) -> list[np.ndarray]:
    """One row for each group, bracket and cell."""
    order = np.lexsort((cell, bracket, group))
    group, bracket, cell = group[order], bracket[order], cell[order]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (bracket[1:] != bracket[:-1]) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(new)
    return [group[at], bracket[at], cell[at], np.add.reduceat(n[order], at), np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)]


def group_codes(batch: pa.RecordBatch, keys: int) -> tuple[np.ndarray, list[tuple]]:
    """A number for the keys of each row, and what it stands for."""
    if not keys:
        return np.zeros(batch.num_rows, np.int64), [()]
    code, sizes = np.zeros(batch.num_rows, np.int64), []
    for i in range(keys):
        own = batch.column(i).dictionary_encode(null_encoding="encode")
        sizes.append(own.dictionary)
        code = code * len(own.dictionary) + own.indices.to_numpy()
    found, code = np.unique(code, return_inverse=True)
    names = []
    for x in found.tolist():
        parts = []
        for values in reversed(sizes):
            x, at = divmod(x, len(values))
            parts.append(values[at].as_py())
        names.append(tuple(reversed(parts)))
    return code, names


def _count(keys: int, brackets: dict[tuple, _Brackets] | None, types: list[pa.DataType], names: list[str], make=None):
    """Counts of cells of a task's values (doubles or whole numbers); brackets None: by leading bits. make: what
    makes the values of the task's batches, if anything does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple, int] = {}
        held: list[list[np.ndarray]] = []
        cells = 0
        for batch in make(batches) if make else batches:
            code, groups = group_codes(batch, keys)
            values = batch.column(keys)
            if pa.types.is_list(values.type):
                code, values = code[pc.list_parent_indices(values).to_numpy()], pc.list_flatten(values)
            if values.null_count:
                some = values.is_valid().to_numpy(zero_copy_only=False)
                code, values = code[some], values.drop_null()
            given = values.to_numpy(zero_copy_only=False)
            key = given if given.dtype == np.int64 else in_order(given)
            if len(groups) > 1:
                code = code.astype(np.min_scalar_type(len(groups)))
                order = np.argsort(code, kind="stable")
                key, code = key[order], code[order]
            starts = np.searchsorted(code, np.arange(len(groups) + 1))
            for g, name in enumerate(groups):
                own = np.sort(key[starts[g] : starts[g + 1]])
                if brackets is None:
                    inside, of, cell = slice(None), np.zeros(len(own), np.int64), own >> (64 - LEADING)
                elif name in brackets:
                    inside, of, cell = brackets[name].cells(own)
                else:
                    continue
                own = own[inside]
                if not len(own):
                    continue
                new = np.ones(len(own), bool)
                new[1:] = (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])
                at = np.flatnonzero(new)
                ends = np.append(at[1:], len(own))
                number = numbers.setdefault(name, len(numbers))
                held.append([np.full(len(at), number), of[at], cell[at], ends - at, own[at], own[ends - 1]])
                cells += len(at)
            if cells > HELD and len(held) > 1:
                held = [_counted(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                cells = len(held[0][0]) // 2  # if most cells stay apart, as many again come in first
        if held:
            group, *rest = _counted(*(np.concatenate(c) for c in zip(*held, strict=True)))
            known = list(numbers)
            own = [pa.array([known[g][i] for g in group.tolist()], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in rest)], names=names)

    return run


_CELL = ("_bracket", "_cell", "_n", "_low", "_high")


def _cells(values: DataFrame | Made, keys: Sequence[str], brackets: dict[tuple, _Brackets] | None, most: int) -> dict[tuple, list[np.ndarray]] | None:
    """Per group: bracket, cell, n, low, high of the cells with values, in order; None if more than `most`."""
    from pyspark.sql.pandas.types import to_arrow_type

    given = values.table() if isinstance(values, Made) else values
    types = [to_arrow_type(given.schema[k].dataType) for k in keys]
    schema = StructType([*(given.schema[k] for k in keys), *(StructField(c, LongType()) for c in _CELL)])
    rows, make = (values.rows, values.make) if isinstance(values, Made) else (values, None)
    counted = rows.mapInArrow(_count(len(keys), brackets, types, schema.names, make), schema)
    summed = counted.groupBy(*keys, "_bracket", "_cell").agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    table = summed.limit(most + 1).toArrow()
    if table.num_rows > most:
        return None
    code, names = group_codes(table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema), len(keys))
    columns = [table[c].to_numpy() for c in _CELL]
    out = {}
    for g, name in enumerate(names if table.num_rows else []):
        at = np.flatnonzero(code == g)
        at = at[np.lexsort((columns[1][at], columns[0][at]))]
        out[name] = [c[at] for c in columns]
    return out


def _under(bracket: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many values lie below each cell, given how many lie below its bracket."""
    begun = np.cumsum(n) - n
    return starts[bracket] + begun - begun[np.searchsorted(bracket, np.arange(len(starts)))[bracket]]


class _Ranks:
    """The wanted ranks of a group, and of each the cell it is known to lie in: its least and largest value and
    how many values lie below it."""

    def __init__(self, n: int, fractions: Sequence[float], wanted: np.ndarray | None = None):
        self.at = [q * (n - 1) for q in fractions]
        self.wanted = wanted if wanted is not None else np.unique(np.array([[np.floor(h), np.ceil(h)] for h in self.at], np.int64).ravel())

    def place(self, under: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> None:
        to = np.searchsorted(under, self.wanted, "right") - 1
        self.under, self.low, self.high, self.n = under[to], low[to], high[to], n[to]
        first = np.append(True, to[1:] != to[:-1])[: len(to)]
        self.open, self.known = np.flatnonzero(first & (self.low < self.high)), np.flatnonzero(first & (self.low == self.high))

    def narrow(self, bracket: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """From the cells of the open brackets; what is known stays."""
        own = lambda new, old: np.concatenate([new, old[self.known]])
        under = own(_under(bracket, n, self.under[self.open]), self.under)
        order = np.argsort(under)
        self.place(under[order], own(low, self.low)[order], own(high, self.high)[order], own(n, self.n)[order])

    def brackets(self, bits: int) -> _Brackets:
        low, high = self.low[self.open], self.high[self.open]
        width = high.view(np.uint64) - low.view(np.uint64)
        length = np.array([w.bit_length() for w in width.tolist()], np.int64)
        return _Brackets(low, high, np.maximum(length - bits, 0).astype(np.uint64))

    def values(self) -> list[float]:
        value = dict(zip(self.wanted.tolist(), as_doubles(self.low).tolist(), strict=True))
        out = []
        for h in self.at:
            low, high = int(np.floor(h)), int(np.ceil(h))
            out.append(value[low] if low == high else (high - h) * value[low] + (h - low) * value[high])
        return out


def _settled(read: DataFrame, keys: Sequence[str], found: dict[tuple, list[np.ndarray]], wanted, cells: int, single: int) -> dict[tuple, _Ranks]:
    """Narrow the cells of the first pass until every wanted rank has its value. wanted(n): the ranks of a group."""
    ranks: dict[tuple, _Ranks] = {}
    for name, (bracket, _, n, low, high) in found.items():
        ranks[name] = wanted(int(n.sum()))
        ranks[name].place(_under(bracket, n, np.zeros(1, np.int64)), low, high, n)
    while open_ := {name: r for name, r in ranks.items() if len(r.open)}:
        brackets, inside = sum(len(r.open) for r in open_.values()), sum(int(r.n[r.open].sum()) for r in open_.values())
        bits = 64 if inside <= single else max(4, (cells // brackets).bit_length() - 1)
        for name, (bracket, _, n, low, high) in _cells(read, keys, {name: r.brackets(bits) for name, r in open_.items()}, max(cells, single, brackets << 4)).items():
            ranks[name].narrow(bracket, n, low, high)
    return ranks


def value_at(table: DataFrame, column: str, position: int, cells: int = 1 << 14) -> tuple[float | int, int] | None:
    """The value at a place (from 0) of a numeric column in order, nulls left out, and how many are smaller;
    None if there are fewer. Counted as the percentiles are: nothing is sorted, shuffled or stored."""
    whole = isinstance(table.schema[column].dataType, IntegralType)
    read = table.where(F.col(column).isNotNull()).select(F.col(column).cast("long" if whole else "double").alias("_v"))
    found = _cells(read, (), None, CELLS)
    if not found or not 0 <= position < int(found[()][2].sum()):
        return None
    r = _settled(read, (), found, lambda n: _Ranks(n, (), np.array([position])), cells, cells)[()]
    return (int(r.low[0]) if whole else float(as_doubles(r.low)[0])), int(r.under[0])


def narrowed_percentiles(values: DataFrame | Made, fractions: Sequence[float], *keys: str, value: str = "value", cells: int = CELLS, single: int = SINGLE) -> DataFrame | None:
    """at: the exact percentiles of the fractions (linear between ranks) per group, in their order; nulls are
    left out. `value` may be an array, whose values all count. None if the groups' cells are too many for
    the driver (some hundred groups of values of many sizes), however many values there are. Rows still to be made
    hold the keys and doubles or arrays of them, in that order."""
    if isinstance(values, Made):
        read, values = values, values.table()
    else:
        kind = ArrayType(DoubleType()) if isinstance(values.schema[value].dataType, ArrayType) else DoubleType()
        read = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast(kind).alias("_v"))
    found = _cells(read, keys, None, cells)
    if found is None:
        return None
    ranks = _settled(read, keys, found, lambda n: _Ranks(n, fractions), cells, single)
    schema = StructType([*(values.schema[k] for k in keys), StructField("at", ArrayType(DoubleType()))])
    return values.sparkSession.createDataFrame([(*name, r.values()) for name, r in ranks.items()], schema)
