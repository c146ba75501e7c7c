"""Packing by cutting-stock column generation.

A document's tokens (its ids and one end id) are cut at multiples of the capacity; full pieces are
sequences of their own, the rest of each document is an item. Items are counted in classes of
`STEP` tokens. A linear program over filling patterns of these classes is solved by column
generation: a knapsack dynamic program prices the next patterns from the dual values, one for each class a round, until the value is within GAP of the bound that they give. Rounded-down
patterns are dealt out to the items by their rank in the class; the few items that rounding leaves
are packed first-fit by size.

Only the histogram (at most capacity / STEP classes) reaches the driver, and only the patterns go
back, both bounded by the capacity, not by the documents. Ranks come from counts by class and hash
chunk, so that no class is numbered in one task.

Defined cases: a null or empty text is the end id alone; rows are packed each by itself, so rows
that repeat a doc_id are packed as often; a null doc_id is kept; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.bpe import encoder, vocabulary
from cadenza.llm.common import slices
from cadenza.storage import stored

CAPACITY, END, STEP = 2048, 1, 8
#: Pieces that one rank chunk numbers, about.
CHUNK = 5_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in slices(batch.column(1)):
                ids, first = encoder(path).encode(data, bounds)
                doc, start, length, crc, total = [], [], [], [], []
                for i, key in enumerate(batch.column(0).slice(at, to - at).to_pylist()):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(end)).astype("<u4")
                    for a in range(0, len(own), capacity):
                        part = own[a : a + capacity]
                        doc.append(key), start.append(a), length.append(len(part)), crc.append(zlib.crc32(part.tobytes())), total.append(len(own))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


#: The linear program ends when its value is this near to the bound that the dual values give.
GAP = 1e-4
#: Share of the best dual values so far in those that are priced.
SMOOTH = 0.9


def best_patterns(value: np.ndarray, demand: np.ndarray, size: int) -> tuple[list[np.ndarray], float]:
    """Knapsack by dynamic program: for each class the counts of classes 1..size of most value within size
    units that hold it, the best first, and the value of the best."""
    classes = np.flatnonzero((value > 1e-12) & (demand > 0)) + 1
    worth = value[classes - 1]
    best, taken = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    if not len(classes):
        return [], 0.0
    upto = np.searchsorted(classes, np.arange(size + 1), side="right").tolist()
    for c in range(int(classes[0]), size + 1):
        n = upto[c]
        sums = worth[:n] + best[c - classes[:n]]
        j = int(sums.argmax())
        best[c] = best[c - 1]
        if sums[j] > best[c]:
            best[c], taken[c] = sums[j], classes[j]
    out, steps = [], taken.tolist()
    totals = worth + best[size - classes]
    for first in classes[np.argsort(-totals, kind="stable")].tolist():
        counts, c = np.zeros(size, np.int64), size - first
        counts[first - 1] = 1
        while c > 0:
            if steps[c]:
                counts[steps[c] - 1] += 1
                c -= steps[c]
            else:
                c -= 1
        out.append(counts)
    return out, float(best[size])


def _inverse(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchanges. Plain sums: a BLAS that starts threads has no place in a driver."""
    n = len(basis)
    both = np.concatenate([basis.astype(float), np.eye(n)], axis=1)
    for i in range(n):
        j = i + int(np.abs(both[i:, i]).argmax())
        both[[i, j]] = both[[j, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0
        both -= factor[:, None] * both[i]
    return both[:, n:]


def _greedy(rows: np.ndarray, wanted: np.ndarray, size: int) -> list[np.ndarray]:
    """A pattern for each class to begin with, filled up with smaller classes while they last: used as often
    as the larger ones leave of the class, they hold just what is wanted."""
    left = np.zeros(size)
    left[rows] = wanted
    patterns = []
    for r in rows[::-1].tolist():
        counts = np.zeros(size, np.int64)
        counts[r] = size // (r + 1)
        room, used = size - (r + 1) * int(counts[r]), left[r] / counts[r]
        for c in range(min(room, r), 0, -1):
            k = min(room // c, int(left[c - 1] / used) if used > 0 else 0)
            if k > 0:
                counts[c - 1] = k
                left[c - 1] -= k * used
                room -= k * c
        patterns.append(counts)
    return patterns[::-1]


def solve(demand: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in the relaxed optimum. demand[c-1]: items of c units."""
    size = len(demand)
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    # a little more of each class, of each another share: so that no two ratios tie
    wanted = demand[rows] * (1 + 1e-5 * (1 + (rows * 0.6180339887) % 1))
    patterns = _greedy(rows, wanted, size)
    basis = lambda: np.array([p[rows] for p in patterns]).T
    inverse = _inverse(basis())
    used = (inverse * wanted).sum(axis=1)
    pivots, idle, bound, centre, share = 0, 0, 0.0, None, SMOOTH
    while idle < 300:  # the value falls to the bound, or neither moves any more
        dual, total = inverse.sum(axis=0), float(used.sum())
        asked = dual if centre is None else share * centre + (1 - share) * dual
        value = np.zeros(size)
        value[rows] = asked
        columns, worth = best_patterns(value, demand, size)
        under = float((asked * wanted).sum()) / max(1.0, worth)
        idle = 0 if under > bound * (1 + 1e-6) else idle + 1
        if under > bound:  # the best dual values so far: later ones are drawn towards them
            bound, centre = under, asked / max(1.0, worth)
        if total - bound <= max(0.5, GAP * total):
            break
        moved = False
        for counts in columns:
            own = counts[rows]
            gain = float((dual * own).sum()) - 1
            if gain <= 1e-6:
                continue  # no longer of use after the columns before it
            moved = True
            column = (inverse * own).sum(axis=1)
            ratio = np.divide(used, column, out=np.full(len(rows), np.inf), where=column > 1e-7)
            near = np.flatnonzero(ratio <= ratio.min() * (1 + 1e-9))
            out = int(near[column[near].argmax()])
            amount = ratio[out]
            if not np.isfinite(amount):
                continue
            patterns[out] = counts
            used = np.maximum(used - amount * column, 0)
            used[out] = amount
            line = inverse[out] / column[out]
            inverse -= column[:, None] * line
            inverse[out] = line
            dual = dual - gain * line
            pivots += 1
            if pivots % 100 == 0:  # against rounding
                inverse = _inverse(basis())
                used, dual = np.maximum((inverse * wanted).sum(axis=1), 0), inverse.sum(axis=0)
        if not moved and (centre is None or share == 0.0):
            break  # no pattern prices out at the dual values themselves
        share = SMOOTH if moved else 0.0
    return list(zip(patterns, used.tolist(), strict=True))


def plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold exactly the demanded items."""
    left = demand.copy()
    out: list[tuple[np.ndarray, int]] = []
    for counts, used in solve(demand):
        n = int(np.floor(used + 1e-6))
        if counts.any():
            n = min(n, int((left[counts > 0] // counts[counts > 0]).min()))
        if n and counts.any():
            out.append((counts, n))
            left = left - counts * n
    while left.any():  # as full as can be, largest first, whole numbers of equal patterns
        counts, room = np.zeros(len(left), np.int64), len(left)
        for c in range(len(left), 0, -1):
            k = int(min(left[c - 1], room // c))
            counts[c - 1] = k
            room -= k * c
        n = int((left[counts > 0] // counts[counts > 0]).min())
        out.append((counts, n))
        left = left - counts * n
    return out


def slots(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, last rank, items in a sequence, first sequence, first slot) of each use."""
    out, sequence = [], 0
    taken: dict[int, int] = {}
    for counts, n in patterns:
        slot = 0
        for c in np.flatnonzero(counts)[::-1].tolist():
            k = int(counts[c])
            begin = taken.get(c + 1, 0)
            out.append((c + 1, begin, begin + k * n, k, sequence, slot))
            taken[c + 1] = begin + k * n
            slot += k
        sequence += n
    return out


_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"


def _placed(uses: np.ndarray, most: int):
    """The sequence and the slot of each ranked piece. uses: rows of slots(), `most` above all ranks. Its use
    is found by the class and the rank where uses end."""
    uses = uses[np.lexsort((uses[:, 2], uses[:, 0]))]
    ends = uses[:, 0] * most + uses[:, 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 6))
            _, begin, _, k, sequence, slot = uses[np.searchsorted(ends, size * most + rank, side="right")].T
            nth = rank - begin
            made = [pa.array(sequence + nth // np.maximum(k, 1)), pa.array(slot + nth % np.maximum(k, 1))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *made], names=[x.split()[0] for x in _PLACED.split(", ")])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocab: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity % STEP:
        raise ValueError(f"capacity: a multiple of {STEP}")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(vocab or vocabulary(), capacity, end), PIECES)
    size = F.ceil(F.col("length") / STEP).cast("int")
    pieces = stored(cut.withColumn("size", size), "pieces")
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # capacity / STEP rows at most
    demand = np.array([counts.get(c, 0) for c in range(1, capacity // STEP + 1)], np.int64)
    uses = np.array(slots(plan(demand)), np.int64).reshape(-1, 6)
    # rank in the class: chunks are numbered by their counts, items within their chunk
    chunks = max(1, int(demand.sum()) // CHUNK)
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    before = Window.partitionBy("size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("size", "chunk").agg(F.count("*").alias("n")).select("size", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("size", "chunk").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(inside) - 1).join(offsets, ["size", "chunk"])
    given = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("base") + F.col("nth")).alias("rank"))
    # patterns of the linear program and of what rounding leaves: bounded by the classes
    there = given.mapInArrow(_placed(uses, int(demand.sum()) + 1), _PLACED)
    along = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return there.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0))).drop("slot")
