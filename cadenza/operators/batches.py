"""Arrow batches of a sorted partition, taken in tables that cut no group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from cadenza.storage import stored


@dataclass
class Made:
    """Rows that tasks make of a table's batches. Kept apart from the table: a task that only counts them needn't
    give them to Spark and take them back."""

    rows: DataFrame
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: str

    def table(self) -> DataFrame:
        return self.rows.mapInArrow(self.make, self.schema)


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows at which a group (equal values of the keys, null equal to null) of the sorted table begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in keys:
        codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by their keys in tables of some `least` rows, whole groups each, and where the groups begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_starts(table, keys)


def packed(rows: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One stored row for each group of the keys (a tile): them, and as `packed` the columns of the group's rows in
    their order, an Arrow stream. A tile has a file of its own, so that tiles are dealt to as many tasks as Spark likes."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys, 1):
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                own, sink = table.slice(a, b - a), pa.BufferOutputStream()
                kept = pa.table({c: own[c] for c in columns}).combine_chunks()  # all may be null, whatever the plan knows
                with pa.ipc.new_stream(sink, kept.schema) as stream:
                    stream.write_table(kept)
                data = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(own[k].chunk(0).slice(0, 1) for k in keys), data], names=[*keys, "packed"])

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), "packed binary"])
    return stored(ordered.mapInArrow(run, schema), name, maxRecordsPerFile=1)


def unpacked(column: pa.Array, row: int) -> pa.Table:
    """The rows of one tile."""
    return pa.ipc.open_stream(column[row].as_buffer()).read_all()


def met(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Every left tile beside every right one for which the condition holds.

    A task reads some tiles of both sides where they are stored: they are neither shuffled nor copied on disk, however
    many tiles each of them meets. Arrow takes as many pairs of tiles at once as make 64 MB.
    """
    return left.join(right.hint("shuffle_replicate_nl"), condition)
