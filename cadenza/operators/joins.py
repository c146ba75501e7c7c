"""Joins inside and between curves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.hashing import integer, uniform
from cadenza.operators.batches import Made, met, packed, unpacked
from cadenza.operators.curves import by_object_sized
from cadenza.operators.lookups import numbered, numbered_within
from cadenza.storage import stored

KEY = ("object_id", "band")


def override(table: DataFrame, truth: DataFrame, key: str, column: str) -> DataFrame:
    """column from the truth table where it has the key, else as it was."""
    other = truth.select(key, F.col(column).alias("_truth"))
    return table.join(other, key, "left").withColumn(column, F.coalesce("_truth", column)).drop("_truth")


def strict_join(table: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Inner join in which a key that the other table lacks is an error."""
    marked = other.withColumn("_there", F.lit(True))
    joined = table.join(marked, key, "left")
    lacking = F.raise_error(F.concat(F.lit(f"no {key} "), F.col(key).cast("string"))).cast("boolean")
    return joined.where(F.when(F.col("_there"), F.lit(True)).otherwise(lacking)).drop("_there")


def closest_points(obs: DataFrame, requests: DataFrame, bands: Sequence[str] | None = None, carry: Sequence[str] = ("time", "flux", "flux_err", "detected")) -> DataFrame:
    """For each request (object_id, request_time) and band the point nearest in time, the earlier on
    ties; null where the object has no point in the band.

    One pass over points and requests together: the last point before and the first after are found
    by windows, so cost doesn't grow with points times requests. With repeated times in a band the
    smallest tie stands for them. Points and requests are counted first, so that a task has some TASK_ROWS of both
    and the bands of these requests, however large the tables.
    """
    if bands is None:
        wanted = requests.join(obs.select(*KEY).distinct(), "object_id")
    else:
        wanted = requests.withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    extra = [c for c in requests.columns if c not in ("object_id", "request_time", "band")]
    point = F.struct(*(F.col(c) for c in dict.fromkeys(["time", *carry])))
    points = obs.select("object_id", "band", F.col("time").alias("_at"), F.lit(0).alias("_ask"), "tie", point.alias("_p"))
    asks = wanted.select("object_id", "band", F.col("request_time").alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast("long").alias("tie"), *extra)
    both = by_object_sized(points.unionByName(asks, allowMissingColumns=True), obs.count() + requests.count())
    upward = Window.partitionBy(*KEY).orderBy("_at", "_ask", F.desc("tie")).rowsBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy(*KEY).orderBy(F.desc("_at"), "_ask", F.desc("tie")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_b", F.last("_p", ignorenulls=True).over(upward)).withColumn("_a", F.last("_p", ignorenulls=True).over(downward)).where("_ask = 1")
    near = F.when(F.col("_a").isNull() | (F.col("_at") - F.col("_b.time") <= F.col("_a.time") - F.col("_at")), F.col("_b")).otherwise(F.col("_a"))
    return found.withColumn("_n", near).select(
        "object_id", "band", F.col("_at").alias("request_time"), *extra, *(F.col(f"_n.{c}").alias(f"closest_{c}") for c in dict.fromkeys(["time",
            *carry])), F.abs(F.col("_n.time") - F.col("_at")).alias("closest_time_diff")
    )


def densify(obs: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Values of every band at the times of the first one: object_id, time and flux_<band>, err_<band>."""
    times = obs.where(F.col("band") == bands[0]).select("object_id", F.col("time").alias("request_time")).distinct()
    near = closest_points(obs, times, bands, carry=("flux", "flux_err"))
    cells = [F.max(F.when(F.col("band") == b, F.col(f"closest_{c}"))).alias(f"{name}_{b}") for b in bands for c, name in (("flux", "flux"), ("flux_err", "err"))]
    return near.groupBy("object_id", F.col("request_time").alias("time")).agg(*cells)


def region_bands(obs: DataFrame, requests: DataFrame, radius: float) -> DataFrame:
    """For each request the bands with a point strictly within the radius: those whose nearest point is. One
    pass in order of time, so cost doesn't grow with the radius."""
    near = closest_points(obs, requests.select("object_id", "request_time").distinct(), carry=("time",))
    within = (F.col("request_time") - radius < F.col("closest_time")) & (F.col("closest_time") < F.col("request_time") + radius)
    return near.where(within).groupBy("object_id", "request_time").agg(F.array_sort(F.collect_set("band")).alias("bands"))


def coverage(obs: DataFrame, radii: Sequence[float]) -> DataFrame:
    """How many times see how many bands strictly within each radius: radius, n_bands, n_times. The
    nearest point of every band is found once for all radii; cost doesn't grow with the radius."""
    times = obs.select("object_id", F.col("time").alias("request_time")).distinct()
    near = closest_points(obs, times, carry=("time",)).where("closest_time is not null")
    seen = [F.count_if(F.col("closest_time_diff") < float(r)).alias(f"_r{i}") for i, r in enumerate(radii)]
    counts = near.groupBy("object_id", "request_time").agg(*seen)
    each = F.array(*(F.struct(F.lit(float(r)).alias("radius"), F.col(f"_r{i}").cast("int").alias("n_bands")) for i, r in enumerate(radii)))
    return counts.select(F.explode(each).alias("s")).select("s.*").where("n_bands > 0").groupBy("radius", "n_bands").agg(F.count("*").alias("n_times"))


def ranked_ids(meta: DataFrame, seed: int) -> DataFrame:
    """target, object_id, pos (from 0 in hash order inside the class) and n (size of the class)."""
    shuffled = meta.where("target is not null").select("target", "object_id", uniform(seed, F.col("object_id")).alias("_u"))
    return numbered_within(shuffled, "target", "_u", "object_id").drop("_u")


def different_class_pairs(meta: DataFrame, n: int | None, seed: int) -> DataFrame:
    """n pairs (pair_id, left_id, right_id, left_target, right_target) of distinct classes; with None as
    many as there are objects.

    Each pair draws two different classes by hash; the u-th use of a class takes its u-th id, round
    and round.
    """
    known = meta.where("target is not null")
    classes = known.select("target").distinct()
    index = classes.select("target", (F.row_number().over(Window.orderBy("target")) - 1).alias("c"))  # one row per class
    k = classes.agg(F.count("*").alias("k"))
    numbers = meta.sparkSession.range(n).select(F.col("id").alias("pair_id")) if n is not None else numbered(known.select("object_id").distinct(),
        "object_id").select(F.col("pos").alias("pair_id"))
    ask = numbers.join(F.broadcast(k), how="cross").where("k > 1")  # k: one row
    first = integer(F.col("k"), seed, "l", F.col("pair_id"))
    drawn = ask.withColumn("cl", first).withColumn("cr", F.pmod(F.col("cl") + 1 + integer(F.col("k") - 1, seed, "r", F.col("pair_id")), F.col("k")))
    uses = drawn.select("pair_id", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("cl").alias("c")),
        F.struct(F.lit("right").alias("side"), F.col("cr").alias("c")))).alias("u")).select("pair_id", "u.*")
    nth = numbered_within(uses, "c", "pair_id", "side").drop("n").withColumnRenamed("pos", "use")
    ids = ranked_ids(meta, seed)
    sized = nth.join(index, "c").join(ids.select("target", "n").distinct(), "target")
    chosen = sized.withColumn("pos", F.col("use") % F.col("n")).join(ids.select("target", "pos", "object_id"), ["target", "pos"])
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return chosen.groupBy("pair_id").agg(side("left", "object_id").alias("left_id"), side("right", "object_id").alias("right_id"), side("left",
        "target").alias("left_target"), side("right", "target").alias("right_target"))


#: Left objects that are paired with their classes together; objects of a tile.
PAIRED = 2_048


def same_class_pairs(meta: DataFrame, carry: Sequence[str] = (), block: int = PAIRED) -> DataFrame:
    """Ordered pairs of different objects of one class: target, left_id, right_id and left_<c>, right_<c> of each
    column to carry.

    Objects are dealt to as many blocks as make some `block` objects each, and a class meets its own of each block:
    a task makes the pairs of a block at most, however large or few the classes are.
    """
    known = stored(meta.where("target is not null").select("target", "object_id", *carry), "paired")
    spark = meta.sparkSession
    blocks = max(1, -(-known.count() // block))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks)
    side = lambda s: [F.col("object_id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in carry)]
    a = known.select("target", F.pmod(F.xxhash64("object_id"), F.lit(blocks)).alias("_block"), *side("left"))
    b = known.select("target", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("_block"), *side("right"))
    dealt = lambda t: t.repartition(parts, "target", "_block")
    return dealt(a).join(dealt(b).hint("merge"), ["target", "_block"]).where("left_id <> right_id").drop("_block")


def pair_counts(meta: DataFrame, obs: DataFrame) -> DataFrame:
    """Points on both sides of each unordered pair of objects of one class, smaller id left: target, left_id, right_id,
    left_n, right_n. Points are counted before objects are paired; pairs of objects without points are left out."""
    counts = obs.groupBy("object_id").agg(F.count("*").alias("n"))
    return same_class_pairs(meta.join(counts, "object_id"), carry=("n",)).where("left_id < right_id")


def pair_curves(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """The points of both sides of each pair: pair_id, side and the observation. One join for both."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left_id").alias("object_id")),
        F.struct(F.lit("right").alias("side"), F.col("right_id").alias("object_id")))).alias("s")).select("pair_id", "s.*")
    return sides.join(obs, "object_id")


#: Points of pairs that are made at once.
PAIR_POINTS = 1 << 17
#: Rows of counts that are given on at once.
COUNTED = 1 << 16


def class_curves(meta: DataFrame, obs: DataFrame, base: int, columns: Sequence[str] = (), tile: int = PAIRED) -> Made:
    """The points of both sides of each unordered pair of objects of one class, smaller id left, as pair_curves gives
    them for given pairs: pair_id (left id * base + right id), is_left, object_id and columns of the observation.

    An object's points are collected once. Objects are cut into tiles that are stored, and tasks read the tiles that
    meet: pairs and their points are made there, and neither is shuffled. Two pairs have one pair_id if their right ids
    are alike modulo base and what their left ids differ by makes up for it. So right tiles hold whole residues and left
    tiles whole ranges of left id + right id // base: the points of a pair_id come from one meeting and in one batch, in
    order of pair_id and side, and can be counted where they are made.
    """
    spark = meta.sparkSession
    key = F.col("object_id").cast("long").alias("object_id")
    known = stored(meta.where("target is not null and object_id is not null").select(key, "target", F.monotonically_increasing_id().alias("_row")), "paired")
    carried = ("object_id", *columns)
    points = obs.select(key, *columns).groupBy("object_id").agg(F.collect_list(F.struct(*carried)).alias("points"))
    curves = stored(known.join(points, "object_id", "left"), "paired-curves")
    residue = F.pmod(F.col("object_id"), F.lit(base))
    times = F.floor((F.col("object_id") - residue) / base)
    count, least, most = known.agg(F.count("*"), F.coalesce(F.min(times), F.lit(0)), F.coalesce(F.max(times), F.lit(0))).first()
    blocks = max(1, -(-count // tile))
    begins = sorted(r.object_id for r in numbered(known.select("object_id").distinct(), "object_id").where(F.col("pos") % tile == 0).collect())  # one of a tile
    lows, highs = [-(2**63), *begins[1:]], [*begins[1:], 2**63 - 1]
    ranges = spark.createDataFrame(list(zip(range(len(lows)), lows, highs, strict=True)), "tile long, low long, high long")
    inside = (F.col("object_id") + least < F.col("high")) & (F.col("object_id") + most >= F.col("low"))
    held, order = ("object_id", "target", "points"), ("object_id", "_row")
    left = packed(curves.join(F.broadcast(ranges), inside), "pair-lefts", ("tile", "low", "high"), order, held)  # one row per tile
    right = packed(curves.withColumn("tile", F.pmod(F.xxhash64(residue), F.lit(blocks))), "pair-rights", ("tile",), order, held)
    both = met(left, right.select(F.col("packed").alias("other")), F.lit(True)).select("low", "high", "packed", "other")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _paired(unpacked(batch["packed"], row), unpacked(batch["other"], row), batch["low"][row].as_py(), batch["high"][row].as_py(), base, carried)

    types = {"object_id": "bigint", **{f.name: f.dataType.simpleString() for f in obs.schema if f.name in columns}}
    return Made(both, make, ", ".join(["pair_id bigint", "is_left boolean", *(f"{c} {types[c]}" for c in carried)]))


def _paired(left: pa.Table, right: pa.Table, low: int, high: int, base: int, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Points of the pairs of a left and a right tile whose left id + right id // base is in the range."""
    n = left.num_rows
    every = pa.concat_tables([left, right]).combine_chunks()
    ids, lists = every["object_id"].to_numpy(), every["points"].chunk(0)
    group = every["target"].chunk(0).dictionary_encode().indices.to_numpy()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    first, values = np.cumsum(counts) - counts, lists.flatten()
    own, width = {c: values.field(c) for c in columns}, np.int32 if len(values) < 2**31 else np.int64
    by_class = n + np.argsort(group[n:], kind="stable")
    begin, end = (np.searchsorted(group[by_class], group[:n], side=s) for s in ("left", "right"))
    size = end - begin
    l = np.repeat(np.arange(n), size)  # noqa: E741
    r = by_class[np.arange(len(l)) + np.repeat(begin - (np.cumsum(size) - size), size)]
    place = ids[l] + ids[r] // base
    wanted = (ids[l] < ids[r]) & (low <= place) & (place < high)
    l, r = l[wanted], r[wanted]  # noqa: E741
    if not len(l):
        return
    pair = ids[l] * base + ids[r]
    order = np.argsort(pair, kind="stable")
    pair, sides = pair[order], np.stack([l[order], r[order]], axis=1)
    each = counts[sides].sum(axis=1)
    heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))  # of equal pair_ids
    before = (np.cumsum(each) - each)[heads] // PAIR_POINTS
    cuts = heads[np.append(True, before[1:] != before[:-1])]
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pair)], strict=True):
        of, is_left, name = sides[a:b].ravel(), np.tile([True, False], b - a), np.repeat(pair[a:b], 2)
        if len(name) > 2 and (name[2::2] == name[:-2:2]).any():
            turn = np.lexsort((~is_left, name))
            of, is_left, name = of[turn], is_left[turn], name[turn]
        c = counts[of]
        at = np.repeat((first[of] - (np.cumsum(c) - c)).astype(width), c)
        at += np.arange(len(at), dtype=width)
        made = [pa.array(np.repeat(name, c)), pa.array(np.repeat(is_left, c)), *(v.take(pa.array(at)) for v in own.values())]
        yield pa.RecordBatch.from_arrays(made, names=["pair_id", "is_left", *columns])


def counted_sides(points: Made) -> DataFrame:
    """How many points class_curves has made of each pair_id and side: pair_id, is_left, n. They are counted in the task
    that makes them."""
    make = points.make

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in make(batches):
            pair, is_left = batch["pair_id"].to_numpy(), batch["is_left"].to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (is_left[1:] != is_left[:-1]))[: len(pair)])
            held.append((pair[heads], is_left[heads], np.diff(np.append(heads, len(pair)))))
            rows += len(heads)
            if rows >= COUNTED:
                yield _counts(held)
                held, rows = [], 0
        if rows:
            yield _counts(held)

    return points.rows.mapInArrow(run, "pair_id long, is_left boolean, n long")


def _counts(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["pair_id", "is_left", "n"])
