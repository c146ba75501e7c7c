"""The k best aligned partners of every curve, by tiles of curves and a lower bound of the merged arc length.

A merged curve passes through all points of either curve in order, so in each band it is at least as long as
either of them: the sum over bands of max(left's length, right's least length under any candidate) bounds the
merged length from below. Curves are numbered by their least length and cut into tiles; every curve meets the
shortest ones first, which gives an upper bound for its k-th best partner; after that a pair of tiles is
looked at only if its bound is below that of some curve in it, and in a tile a pair only if its own is.

Tiles are stored once, and a task reads some tiles that meet some others and holds two at a time: curves are not
shuffled for the tiles they meet. The k best that a tile has found in a task bound the tiles it meets there next, and
what goes on is at most k partners of a curve from each task, and k in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.batches import group_starts, met, packed, unpacked
from cadenza.operators.lookups import numbered
from cadenza.plans.align import PARAMETERS
from cadenza.plans.tiles import Points, best_candidates, merged_lengths
from cadenza.storage import dropped, stored

#: Curves of a tile.
TILE = 256
_FOUND = "left_id long, right_id long, candidate int, arc_length double, n_tried long"


def _lengths(curves: DataFrame, grid: np.ndarray) -> DataFrame:
    """Per curve and band: its length, and the least of its lengths under the candidates' stretches."""
    w = Window.partitionBy("object_id", "band").orderBy("time", "tie")
    steps = curves.withColumns({"_dt": F.col("time") - F.lag("time").over(w), "_df": F.col("flux") - F.lag("flux").over(w)})
    size = lambda t, f: F.coalesce(F.sum(F.sqrt(F.pow(F.col("_dt") * t, 2) + F.pow(F.col("_df") * f, 2))), F.lit(0.0))
    stretches = sorted({(float(t), float(f)) for t, f in grid[:, 2:].tolist()})
    least = F.least(*(size(t, f) for t, f in stretches), F.lit(float("inf")))
    return steps.groupBy("object_id", "band").agg(size(1.0, 1.0).alias("own"), least.alias("least"))


def _best(table: pa.Table, grid: np.ndarray, k: int) -> tuple[dict[str, list], int, int]:
    """The k best partners of each left curve among the right ones of two tiles; pairs tried, and pairs there are."""
    side = table["side"].to_numpy()
    starts = group_starts(table, ("side", "object_id"))
    counts = np.diff(np.append(starts, table.num_rows))
    ids, sides = table["object_id"].to_numpy()[starts], side[starts]
    bound = table["bound"].to_numpy()[starts]
    names, band = np.unique(table["band"].to_numpy().astype(str), return_inverse=True)
    time, flux = table["time"].to_numpy(), table["flux"].to_numpy()
    of = np.repeat(np.arange(len(starts)), counts)
    length = np.zeros((len(starts), len(names)))
    length[of, band] = table["length"].to_numpy()
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    least = np.maximum(length[left][:, None, :], length[right][None, :, :]).sum(axis=2)
    other = ids[left][:, None] != ids[right][None, :]
    wanted = other & (least <= bound[left][:, None] + 1e-6)
    sides = [Points(counts[x], band[own], time[own], flux[own]) for x, own in ((left, side == 0), (right, side == 1))]
    length_of, which_of = np.empty(wanted.shape), np.empty(wanted.shape, np.int64)
    positive = (grid[:, 2] > 0) & (grid[:, 3] > 0)
    for l, r, lengths in merged_lengths(*sides, grid, len(names), wanted):
        lengths[~positive] = np.inf
        which_of[l, r] = best_candidates(lengths)
        length_of[l, r] = np.round(lengths.min(axis=0), 6)
    a, b = np.nonzero(wanted)
    cost, which = length_of[a, b], which_of[a, b]
    order = np.lexsort((ids[right][b], cost, a))
    nth = np.arange(len(order)) - np.searchsorted(a[order], a[order])
    top = order[nth < k]
    out = {"left_id": ids[left][a[top]], "right_id": ids[right][b[top]], "candidate": which[top].astype(np.int32), "arc_length": cost[top]}
    return out, len(a), int(other.sum())


def _sides(left: pa.Table, right: pa.Table) -> pa.Table:
    """The points of two tiles below each other, as _best reads them."""
    each = []
    for side, tile, length in ((0, left, "own"), (1, right, "least")):
        bound = tile["bound"] if "bound" in tile.column_names else pa.array(np.full(tile.num_rows, np.inf))
        each.append(pa.table({"side": np.full(tile.num_rows, side), **{c: tile[c] for c in ("object_id", "band", "time", "flux")}, "length": tile[length], "bound": bound}))
    return pa.concat_tables(each).combine_chunks()


def _nth(sorted_ids: np.ndarray) -> np.ndarray:
    return np.arange(len(sorted_ids)) - np.searchsorted(sorted_ids, sorted_ids)


def _joined(held: dict[str, np.ndarray], found: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The k best of the partners held and found, in order of the left curves."""
    both = {c: np.concatenate([held[c], found[c]]) for c in found}
    order = np.lexsort((both["right_id"], both["arc_length"], both["left_id"]))
    order = order[_nth(both["left_id"][order]) < k]
    return {c: v[order] for c, v in both.items()}


def _tightened(left: pa.Table, held: dict[str, np.ndarray], k: int) -> pa.Table:
    """The tile, its curves bound by the k-th best partner held."""
    kth = _nth(held["left_id"]) == k - 1
    ids, cost = held["left_id"][kth], held["arc_length"][kth]
    if not len(ids):
        return left
    own = left["object_id"].to_numpy()
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    bound = left["bound"].to_numpy() if "bound" in left.column_names else np.full(len(own), np.inf)
    bound = np.where(ids[at] == own, np.minimum(bound, cost[at]), bound)
    return left.select([c for c in left.column_names if c != "bound"]).append_column("bound", pa.array(bound))


def _met(left: DataFrame, right: DataFrame, condition: Column, grid: np.ndarray, k: int) -> DataFrame:
    """Partners found where tiles meet. left, right: tile and packed, of left with bounds if there are any."""
    renamed = right.withColumnsRenamed({"tile": "_tile", "packed": "other"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, tried = None, None, 0
        for batch in batches:
            for row, now in enumerate(batch["tile"].to_pylist()):
                if held is None or now != tile:
                    if held is not None:
                        yield _record(held, tried)
                    tile, held, tried, own = now, None, 0, unpacked(batch["packed"], row)
                table = _sides(own if held is None else _tightened(own, held, k), unpacked(batch["other"], row))
                found, n, _ = _best(table, grid, k)
                found = {c: np.asarray(v) for c, v in found.items()}
                held, tried = found if held is None else _joined(held, found, k), tried + n
        if held is not None:
            yield _record(held, tried)

    return met(left, renamed, condition).select("tile", "packed", "other").mapInArrow(run, _FOUND)


def _record(held: dict[str, np.ndarray], tried: int) -> pa.RecordBatch:
    first = np.arange(len(held["left_id"])) == 0
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (*held.values(), np.where(first, tried, 0))], names=_NAMES)


_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def nearest_partners(obs: DataFrame, grid: DataFrame, k: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(partners, work). partners: left_id, rank (from 1), right_id, candidate and arc_length of the k curves that,
    moved by their best candidate of the grid (a list, as of align.candidate_grid), merge with each curve to the
    least arc length (rounded to 6 digits; of equal ones the smaller id). work: n_pairs, the pairs there are, and
    n_tried, those whose merged length was taken.

    Only detected points count; an object without them is no curve.
    """
    parameters = np.array([tuple(r)[1:] for r in grid.orderBy("candidate").select("candidate", *PARAMETERS).collect()], float)
    seen = obs.where("detected = 1").select(F.col("object_id").cast("long").alias("object_id"), F.col("band").cast("string").alias("band"),
        F.col("time").cast("double").alias("time"), F.col("flux").cast("double").alias("flux"), "tie")
    curves = stored(seen.join(_lengths(seen, parameters), ["object_id", "band"]), "partner-curves")
    bands = curves.select("object_id", "band", "own", "least").distinct()
    totals = bands.groupBy("object_id").agg(F.sum("least").alias("total"))
    placed = stored(numbered(totals, "total", "object_id").select("object_id", "pos", F.floor(F.col("pos") / tile).alias("tile")), "partner-tiles")
    columns, inside = ("object_id", "band", "time", "flux", "own", "least"), ("object_id", "band", "time", "tie")
    cut = curves.join(placed, "object_id")
    tiles = packed(cut, "partner-points", ("tile",), inside, columns)
    # every curve meets the shortest ones: a bound for its k-th best
    short = packed(cut.where(F.col("pos") <= k).withColumn("tile", F.lit(-1).cast("long")), "partner-short", ("tile",), inside, columns)  # k + 1 curves
    begun = stored(_met(tiles, short, F.lit(True), parameters, k), "partners")
    order = Window.partitionBy("left_id").orderBy("arc_length", "right_id")
    bound = begun.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select(F.col("left_id").alias("object_id"), F.col("arc_length").alias("bound"))
    bounded = placed.join(bound, "object_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    # tiles that can hold a better one: sum over bands of the larger of both tiles' least lengths
    of_tile = bands.join(bounded, "object_id").groupBy("tile", "band").agg(F.count("*").alias("_n"), F.min("own").alias("_own"), F.min("least").alias("_least"))
    sizes = placed.groupBy("tile").agg(F.count("*").alias("_size"))
    all_of = lambda c: F.when(F.col("_n") == F.col("_size"), F.col(c)).otherwise(0.0)  # noqa: E731  a curve without the band has length 0
    lows = of_tile.join(sizes, "tile").select("tile", "band", all_of("_own").alias("_own"), all_of("_least").alias("_least"))
    total = bounded.groupBy("tile").agg(F.max("bound").alias("_bound"))
    mine = lows.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("band", "_own"))).alias("_a")).join(total, "tile")
    theirs = lows.groupBy("tile").agg(F.map_from_entries(F.collect_list(F.struct("band", "_least"))).alias("_b"), F.sum("_least").alias("_sum")).withColumnRenamed("tile", "other")
    greater = F.map_zip_with("_a", "_b", lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    least = F.aggregate(F.map_values(greater), F.lit(0.0), lambda s, x: s + x)
    asks = packed(curves.join(bounded, "object_id"), "partner-asks", ("tile",), inside, (*columns, "bound")).join(F.broadcast(mine), "tile")  # one row per tile
    answers = tiles.withColumnRenamed("tile", "other").join(F.broadcast(theirs), "other").withColumnRenamed("other", "tile")
    meeting = (F.col("_sum") <= F.col("_bound") + 1e-6) & (least <= F.col("_bound") + 1e-6)
    found = stored(_met(asks, answers, meeting, parameters, k), "partners")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    count = placed.agg((F.count("*") * (F.count("*") - 1)).alias("n_pairs"))
    tried = found.agg(F.coalesce(F.sum("n_tried"), F.lit(0)).alias("_t")).join(begun.agg(F.coalesce(F.sum("n_tried"), F.lit(0)).alias("_f")), how="cross")  # one row each
    work = count.join(tried, how="cross").select("n_pairs", (F.col("_t") + F.col("_f")).alias("n_tried"))
    return ranked.select("left_id", "rank", "right_id", "candidate", "arc_length"), work
