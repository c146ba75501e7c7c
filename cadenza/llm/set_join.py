"""Exact links between sets that share much: a prefix join in bounded blocks.

Every set is put into one order of all shingles, rare ones first; two sets at the threshold share a
shingle among their first few, and the first they share leaves enough of either set to reach it. Sets of
different parts meet at that shingle, in blocks of bounded size, and are compared whole inside the task.
Only links that join two parts are looked for: one is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.storage import dropped, stored

#: Rows of either side that are compared together; classes of the order of shingles.
BLOCK, CLASSES = 1000, 1 << 20


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall into each class."""
    total = np.zeros(CLASSES, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy() & (CLASSES - 1), minlength=CLASSES)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["class", "n"])


def _leading(load: np.ndarray, percent: int):
    """The first shingles of each set in the order (load of the class, hash). Sets at the threshold share
    one of them; the first they share is `short` in the smaller set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(3).value_lengths()).astype(np.int64)
            h = batch.column(3).flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((h, load[h & (CLASSES - 1)], row))
            n = sizes[row]
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = np.flatnonzero(place <= n + (-percent * n) // 100)
            short = place <= n + (-2 * percent * n) // (100 + percent)
            index = pa.array(row[kept])
            given = [batch.column(i).take(index) for i in (0, 1, 2, 4)]
            made = [pa.array(n[kept]), pa.array(place[kept]), pa.array(short[kept])]
            yield pa.RecordBatch.from_arrays([pa.array(h[order][kept]), *given, *made], names=["h", "doc", "part", "mass", "tag", "n", "place", "short"])

    return run


def _met(left: tuple, right: tuple, percent: int) -> list[tuple[int, int]]:
    """Links between rows (doc, part, n, place, values, first) of one shingle that join different parts."""
    docs, parts, n, place, values, first = right
    out, parts = [], parts.copy()
    own_parts = left[1].copy()
    for i, (doc, size, at) in enumerate(zip(left[0].tolist(), left[2].tolist(), left[3].tolist(), strict=True)):
        need = -((-percent * (n + size)) // (100 + percent))
        asked = np.flatnonzero((parts != own_parts[i]) & (np.minimum(n - place, size - at) >= need))
        if not len(asked):
            continue
        own = np.sort(left[4][left[5][i] : left[5][i + 1]])
        lengths = n[asked]
        ends = np.cumsum(lengths)
        theirs = values[np.arange(ends[-1]) + np.repeat(first[asked] - (ends - lengths), lengths)]
        held = own[np.minimum(np.searchsorted(own, theirs), size - 1)] == theirs
        shared = np.add.reduceat(held, ends - lengths, dtype=np.int64)
        for j in asked[100 * shared >= percent * (lengths + size - shared)].tolist():
            if parts[j] != own_parts[i]:  # one link joins the parts
                out.append((int(docs[j]), doc))
                old = parts[j]
                parts[parts == old] = own_parts[i]
                own_parts[own_parts == old] = own_parts[i]
    return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int, int]]]]:
    """Rows (h, s, r, own, ...) sorted so that own rows lead a block, in tables of whole blocks, with
    (start, end of the own rows, stop) of each block that has both sides."""

    def cut(waiting: list[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int, int]]]:
        table = pa.Table.from_batches(waiting).combine_chunks()
        block = np.stack([table[c].to_numpy() for c in ("h", "s", "r")])
        cuts = np.concatenate([[0], np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
        middle = cuts[:-1] + np.add.reduceat(table["own"].to_numpy(), cuts[:-1], dtype=np.int64)
        some = (middle > cuts[:-1]) & (middle < cuts[1:])
        return table, list(zip(cuts[:-1][some].tolist(), middle[some].tolist(), cuts[1:][some].tolist(), strict=True))

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = np.stack([batch.column(i).to_numpy() for i in range(3)])
        change = np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1
        same = waiting and tuple(waiting[-1].column(i)[-1].as_py() for i in range(3)) == tuple(block[:, 0].tolist())
        at = int(change[-1]) if len(change) else 0
        if at or (waiting and not same):  # all blocks but the last are complete
            yield cut([*waiting, batch.slice(0, at)])
            waiting = [batch.slice(at)]
        else:
            waiting.append(batch)
    if waiting:
        yield cut(waiting)


_ROW = "h long, s int, r int, own boolean, doc long, part long, tag long, n long, place long"


def _partnered(percent: int):
    """The rows of a block for which a row of another part and the other side leaves room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, blocks in _by_block(batches):
            part, n, place = (table[c].to_numpy() for c in ("part", "n", "place"))
            kept = np.zeros(table.num_rows, bool)
            for a, m, b in blocks:
                need = -((-percent * (n[a:m, None] + n[None, m:b])) // (100 + percent))
                ok = (part[a:m, None] != part[None, m:b]) & ((n - place)[a:m, None] >= need) & ((n - place)[None, m:b] >= need)
                kept[a:m], kept[m:b] = ok.any(axis=1), ok.any(axis=0)
            yield from table.filter(pa.array(kept)).combine_chunks().to_batches()

    return run


def _block_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, blocks in _by_block(batches):
            columns = [table[c].to_numpy() for c in ("doc", "part", "n", "place")]
            held = table["shingles"].combine_chunks()
            values = held.flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(np.asarray(held.value_lengths()).astype(np.int64))])
            found = []
            for a, m, b in blocks:
                left = (*(c[a:m] for c in columns), values, first[a : m + 1])
                found += _met(left, (*(c[m:b] for c in columns), values, first[m : b + 1]), percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def exact_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all parts with sets at the threshold. sets: doc, part, mass, shingles."""
    # a row for each class reaches the driver and goes back: 4 MB, whatever the sets
    loads = sets.select("shingles").mapInArrow(_loads, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    load = np.zeros(CLASSES, np.uint32)
    load[loads["class"].to_numpy()] = np.minimum(loads["n"].to_numpy(), 2**32 - 1)
    # with doc the tag names a set, even if ids repeat
    sets = sets.select("doc", "part", "mass", "shingles", F.xxhash64("shingles").alias("tag"))
    schema = "h long, doc long, part long, mass long, tag long, n long, place long, short boolean"
    rows = stored(sets.mapInArrow(_leading(load, percent), schema), "leading")
    # shingles at which parts differ; each pair has a short row and one outside the main part
    main = F.max_by("part", F.struct("mass", "part")).alias("main")
    grouped = rows.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high"), main, F.max("short").alias("any"))
    shared = stored(grouped.where("any and low <> high").select("h", "main"), "shared")
    met = stored(rows.join(shared, "h").drop("mass"), "met")
    other = F.col("part") != F.col("main")
    load_of = met.groupBy("h").agg(F.count("*").alias("all"), F.count_if(other).alias("others"), F.count_if("short").alias("shorts"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    least = F.least("shorts", "others")
    sizes = stored(load_of.select("h", (F.col("shorts") <= F.col("others")).alias("by_short"), blocks(least).alias("ns"), blocks(F.col("all")).alias("nr")), "sizes")
    slot = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = met.join(sizes, "h")
    kept = ("h", "doc", "part", "tag", "n", "place")
    asking = F.when(F.col("by_short"), F.col("short")).otherwise(other)
    left = placed.where(asking).select(*kept, slot(F.col("ns")).alias("s"), every("nr").alias("r"), F.lit(True).alias("own"))
    right = placed.select(*kept, every("ns").alias("s"), slot(F.col("nr")).alias("r"), F.lit(False).alias("own"))
    dealt = lambda rows: rows.repartition("h", "s", "r").sortWithinPartitions("h", "s", "r", F.desc("own"))
    names = [x.split()[0] for x in _ROW.split(", ")]
    both = dealt(left.select(*names).unionByName(right.select(*names)))
    asked = stored(both.mapInArrow(_partnered(percent), _ROW), "asked")
    held = asked.join(sets.select("doc", "tag", "shingles").hint("merge"), ["doc", "tag"]).select(*names, "shingles")
    links = stored(dealt(held).mapInArrow(_block_links(percent), "a long, b long").distinct(), "exact")
    dropped(rows, shared, met, sizes, asked)
    return links
