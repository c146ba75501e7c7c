"""Pair jobs: positives, negatives, sub-samples, training sets, scores and a pair classifier."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import columns as C
from cadenza.functions.hashing import bounded_normal, id_split, integer, normal, uniform
from cadenza.operators import stats
from cadenza.operators.curves import KEY, along, by_object, linear_transform
from cadenza.operators.joins import different_class_pairs
from cadenza.operators.lookups import numbered, numbered_within
from cadenza.operators.windows import every_nth, valid_windows
from cadenza.plans.features import window_features
from cadenza.storage import stored

PARAMETERS = ("translate_time", "translate_flux", "dilate_time", "dilate_flux")


def transforms(ids: DataFrame, seed: int, time_sd: float = 1.0, flux_sd: float = 0.01, time_factor: float = 1.1, flux_factor: float = 1.5,
    most_time: float = 6.0, most_flux: float = 16.0, true_limits: bool = False) -> DataFrame:
    """Random transforms per object: normal shifts, truncated log-normal stretches.

    The truncation is in standard units (log most - log factor), which bounds stretches by
    exp(bound * log factor); true_limits bounds them by the most_* values themselves.
    """
    if time_factor < 1.0 or flux_factor < 1.0:
        raise ValueError("factors must be 1 or more")
    key = F.col("object_id")

    def stretch(name: str, factor: float, most: float):
        sd = math.log(factor)
        bound = math.log(most) / sd if true_limits and sd else math.log(most) - sd
        return F.exp(bounded_normal(bound, f"{seed}.{name}", key) * sd)

    return ids.select(
        "object_id",
        (normal(f"{seed}.tt", key) * time_sd).alias("translate_time"),
        (normal(f"{seed}.tf", key) * flux_sd).alias("translate_flux"),
        stretch("dt", time_factor, most_time).alias("dilate_time"),
        stretch("df", flux_factor, most_flux).alias("dilate_flux"),
    )


def random_times(obs: DataFrame, seed: int, *keys: str) -> DataFrame:
    """One distinct time per key, chosen by hash."""
    keys = keys or ("object_id",)
    times = obs.select(*keys, "time").distinct()
    return times.groupBy(*keys).agg(F.min_by("time", F.struct(uniform(seed, *map(F.col, keys), F.round(F.col("time") * 1e6).cast("long")), "time")).alias("time"))


def _moments(obs: DataFrame, seed: int, **options) -> DataFrame:
    """object_id, its random transform and pair_time, one of its times."""
    return transforms(obs.select("object_id").distinct(), seed, **options).join(random_times(obs, seed), "object_id").withColumnRenamed("time", "pair_time")


def positive_pairs(obs: DataFrame, seed: int, **options) -> DataFrame:
    """Points of both sides of a curve and its transformed copy: object_id, side, pair_time and the
    observation. pair_time is the side's time of the same moment."""
    joined = obs.join(_moments(obs, seed, **options), "object_id")
    left = joined.withColumn("side", F.lit("left")).drop(*PARAMETERS)
    right = linear_transform(joined, *PARAMETERS).withColumn("pair_time", C.moved_time("pair_time", "translate_time",
        "dilate_time")).withColumn("side", F.lit("right")).drop(*PARAMETERS)
    return left.unionByName(right)


def positive_requests(obs: DataFrame, seed: int, **options) -> DataFrame:
    """object_id, side and pair_time of positive_pairs, without their points."""
    moved = C.moved_time("pair_time", "translate_time", "dilate_time")
    sides = F.array(*(F.struct(F.lit(side).alias("side"), time.alias("pair_time")) for side, time in (("left", F.col("pair_time")), ("right", moved))))
    return _moments(obs, seed, **options).select("object_id", F.explode(sides).alias("s")).select("object_id", "s.*")


def subsample(points: DataFrame, seed: int, radius: float = 4.0, min_rate: float = 0.5, max_rate: float = 1.0, keys: Sequence[str] = ("object_id", "side", "band")) -> DataFrame:
    """Keep all points within the radius of pair_time and k of the others, by hash; k is drawn from
    [max(min(2, n), floor(min_rate n)), ceil(max_rate n)), its lower end if that is empty. Points are dealt in the
    session's number of partitions however few bytes they are: hashes and sorts cost time, not bytes."""
    points = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    near = F.abs(F.col("time") - F.col("pair_time")) < radius
    other = F.sum(F.when(near, 0).otherwise(1)).over(Window.partitionBy(*keys))
    low = F.greatest(F.least(F.col("_n"), F.lit(2)), F.floor(F.col("_n") * min_rate))
    high = F.ceil(F.col("_n") * max_rate)
    drawn = F.when(low >= high, low).otherwise(low + F.floor(uniform(seed, F.lit("k"), *map(F.col, keys)) * (high - low)))
    nth = F.row_number().over(Window.partitionBy(*keys, "_near").orderBy(uniform(seed, *map(F.col, keys), F.col("tie")), "tie"))
    marked = points.withColumns({"_near": near, "_n": other}).withColumns({"_k": drawn, "_nth": nth})
    return marked.where(F.col("_near") | (F.col("_nth") <= F.col("_k"))).drop("_near", "_n", "_k", "_nth")


def negative_pairs(obs: DataFrame, meta: DataFrame, n: int | None, seed: int) -> DataFrame:
    """n pairs (with None as many as objects) of curves of different classes with a random distinct time
    of each: pair_id, side, object_id, target, time."""
    pairs = different_class_pairs(meta, n, seed)
    sides = pairs.select("pair_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("object_id"),
        F.col(f"{s}_target").alias("target")) for s in ("left", "right")))).alias("s")).select("pair_id", "s.*")
    times = sides.join(obs.select("object_id", "time").distinct(), "object_id")
    order = F.struct(uniform(seed, F.col("pair_id"), F.col("side"), F.round(F.col("time") * 1e6).cast("long")), "time")
    return times.groupBy("pair_id", "side", "object_id", "target").agg(F.min_by("time", order).alias("time"))


def pair_features(points: DataFrame, requests: DataFrame, n: int, bands: Sequence[str], label: int) -> DataFrame:
    """Window features of both sides of pairs: pair_id, side, band, label and the features.

    points: pair_id, side and the (transformed) observation; requests: pair_id, side, time.
    """
    asks = requests.select("pair_id", "side", F.col("time").alias("request_time"))
    return window_features(points, asks, n, bands, keys=("pair_id", "side")).withColumn("label", F.lit(label))


def positive_features(obs: DataFrame, n: int, bands: Sequence[str], seed: int, sample: dict | None = None, **options) -> DataFrame:
    """Pair features of every curve with its transformed copy, label 1; pair_id is the object."""
    points = subsample(positive_pairs(obs, seed, **options), seed, **(sample or {})).withColumn("pair_id", F.col("object_id"))
    requests = positive_requests(obs, seed, **options).select(F.col("object_id").alias("pair_id"), "side", F.col("pair_time").alias("time"))
    return pair_features(points.drop("pair_time"), requests, n, bands, 1)


def negative_features(obs: DataFrame, meta: DataFrame, n_pairs: int | None, n: int, bands: Sequence[str], seed: int) -> DataFrame:
    """Pair features of curves of different classes, label 0. Each side asks at its curve, so that curves meet
    requests of a few columns and are not copied for every pair they are in."""
    asks = negative_pairs(obs, meta, n_pairs, seed).select("object_id", F.col("time").alias("request_time"), "pair_id", "side")
    return window_features(obs, asks, n, bands).drop("object_id").withColumn("label", F.lit(0))


def training_set(obs: DataFrame, meta: DataFrame, n: int, bands: Sequence[str], seed: int, split: str | None = "TRAIN", n_negatives: int | None = None) -> DataFrame:
    """Positives of all objects of a split and as many negatives (or n_negatives), with labels. The
    split holds for both kinds; None takes all objects."""
    ids = meta.select("object_id") if split is None else meta.where(id_split(F.col("object_id")) == split).select("object_id")
    own, own_meta = obs.join(ids, "object_id", "left_semi"), meta.join(ids, "object_id", "left_semi")
    positives = positive_features(own, n, bands, seed, {"min_rate": 0.7})
    return positives.unionByName(negative_features(own, own_meta, n_negatives, n, bands, seed))


def mixed(sources: dict[str, DataFrame], weights: dict[str, float], n: int, seed: int, key: str = "object_id") -> DataFrame:
    """n draws from several tables by weight: draw, source and the row. The k-th draw of a source is
    its k-th row in hash order, round and round."""
    spark = next(iter(sources.values())).sparkSession
    total, at = sum(weights.values()), 0.0
    names = list(sources)
    u = uniform(seed, F.lit("source"), F.col("draw"))
    choice = F.lit(names[-1])
    bounds = []
    for name in names[:-1]:
        at += weights[name] / total
        bounds.append((name, at))
    for name, most in reversed(bounds):
        choice = F.when(u < most, F.lit(name)).otherwise(choice)
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("source", choice)
    draws = numbered_within(draws, "source", "draw").drop("n").withColumnRenamed("pos", "use")
    out = None
    for name, table in sources.items():
        rows = numbered_within(table.withColumns({"_one": F.lit(1), "_u": uniform(seed, F.lit(name), F.col(key))}), "_one", "_u", key).drop("_one", "_u")
        size = table.agg(F.count("*").alias("n"))  # one row
        sized = draws.where(F.col("source") == name).join(F.broadcast(size), how="cross").withColumn("pos", F.col("use") % F.col("n")).drop("n")
        one = sized.join(rows.drop("n"), "pos").drop("pos", "use")
        out = one if out is None else out.unionByName(one)
    return out


def similarity_report(pairs: DataFrame, normalise: bool = True) -> DataFrame:
    """n, loss, accuracy and aux_loss of labelled vector pairs, and their total, in one pass."""
    scored = pairs.withColumn("score", C.pair_score("left", "right", normalise))
    aux = (F.pow(C.norm("left") - 1.0, 2) + F.pow(C.norm("right") - 1.0, 2)) / 2.0 if normalise else F.lit(0.0)
    report = scored.agg(F.count("*").alias("n"), F.avg(C.log_loss("label", "score")).alias("loss"),
        F.avg(((F.col("score") > 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"), F.avg(aux).alias("aux_loss"))
    return report.withColumn("total_loss", F.col("loss") + 0.1 * F.col("aux_loss"))


# ---------------------------------------------------------------- windows of regular stretches
def regular_windows(obs: DataFrame, size: int, per_day: float = 1.6) -> DataFrame:
    """Starts of valid windows of the down-sampled curves (gaps within 0.8 to 1.2 of the median), with
    the window's points. A curve without one is an error only for whoever draws from it."""
    thin = every_nth(obs, per_day)
    limit = stats.median_interval(thin)  # one row
    joined = thin.join(F.broadcast(limit), how="cross")
    framed = by_object(joined).withColumn("points", F.collect_list(F.struct("time", "flux", "flux_err")).over(along().rowsBetween(0, size - 1)))
    starts = valid_windows(framed, size, F.col("median_dt") * 0.8, F.col("median_dt") * 1.2)
    return starts.select("object_id", "band", "pos", "points")


def window_pairs(windows: DataFrame, n: int | None, seed: int) -> DataFrame:
    """n positive (two windows of one curve) and n negative pairs (windows of two curves), with None as
    many as there are curves: pair_id, label, left, right (point arrays). Curves are (object, band);
    fewer than two give no negatives."""
    spark = windows.sparkSession
    placed = numbered(windows.groupBy(*KEY).agg(F.count("*").alias("n_windows")), *KEY).withColumnRenamed("pos", "c")  # a row per curve
    k = placed.agg(F.count("*").alias("_k"))  # one row
    numbers = spark.range(n).select(F.col("id").alias("c"), F.lit(n).alias("_n")) if n is not None else placed.select("c", F.lit(None).cast("long").alias("_n"))
    both = F.explode(F.array(F.struct(F.col("c").alias("pair_id"), F.lit(1).alias("label")), F.struct((F.col("c") + F.coalesce("_n",
        "_k")).alias("pair_id"), F.lit(0).alias("label"))))
    ask = numbers.join(F.broadcast(k), how="cross").select("_k", both.alias("p")).select("_k", "p.*")
    first = integer(F.col("_k"), seed, "curve", F.col("pair_id"))
    drawn = ask.withColumn("left_c", first).withColumn("right_c", F.when(F.col("label") == 1,
        F.col("left_c")).otherwise(F.pmod(F.col("left_c") + 1 + integer(F.greatest(F.col("_k") - 1, F.lit(1)), seed, "other", F.col("pair_id")),
        F.col("_k"))))
    drawn = drawn.where((F.col("label") == 1) | (F.col("_k") > 1))
    sides = drawn.select("pair_id", "label", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_c").alias("c")) for s in ("left",
        "right")))).alias("s")).select("pair_id", "label", "s.*")
    nth = sides.join(placed, "c").withColumn("w", integer(F.col("n_windows"), seed, "window", F.col("pair_id"), F.col("side")))
    ranked = windows.withColumn("w", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")) - 1)
    chosen = nth.join(ranked.select(*KEY, "w", "points"), [*KEY, "w"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("points"))).alias(s)
    return chosen.groupBy("pair_id", "label").agg(side("left"), side("right"))


def slope_similarity(pairs: DataFrame) -> DataFrame:
    """pair_id, label and cosine of the two windows' slopes (steps of no time count 0)."""

    def slopes(points):
        later, sooner = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
        return F.zip_with(later, sooner, lambda b, a: F.coalesce(F.try_divide(b["flux"] - a["flux"], b["time"] - a["time"]), F.lit(0.0)))

    return pairs.select("pair_id", "label", C.cosine(slopes("left"), slopes("right")).alias("cosine"))


# ---------------------------------------------------------------- classifier
def pair_vectors(features: DataFrame, bands: Sequence[str], n: int) -> DataFrame:
    """One row per pair: label and the differences of its sides' window values."""
    windows = features.withColumn("v", F.concat(C.deltas("before_flux", "after_flux", F.coalesce("closest_flux_in_band", F.lit(0.0))),
        C.deltas("before_time", "after_time", F.coalesce("closest_time_in_band", F.lit(0.0)))))
    by_side = lambda s, b: F.max(F.when((F.col("side") == s) & (F.col("band") == b), F.col("v")))
    zero = F.array_repeat(F.lit(0.0), 4 * n)
    sides = windows.groupBy("label", "pair_id").agg(*(F.coalesce(by_side(s, b), zero).alias(f"{s}_{b}") for s in ("left", "right") for b in bands))
    parts = [F.zip_with(f"left_{b}", f"right_{b}", lambda x, y: F.abs(x - y)) for b in bands]
    return sides.select("label", "pair_id", F.concat(*parts).alias("x"))


def fit_pair_classifier(vectors: DataFrame, iterations: int = 20):
    """Logistic regression on pair vectors (distributed). Returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    return LogisticRegression(maxIter=iterations, regParam=0.01, standardization=True).fit(data)


def classify_pairs(model, vectors: DataFrame, *keys: str) -> DataFrame:
    """The keys, label, pair_id and score of pair vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(vectors.withColumn("features", array_to_vector("x")))
    return scored.select(*keys, F.col("label").cast("int").alias("label"), "pair_id", vector_to_array("probability")[1].alias("score"))


def pair_metrics(scored: DataFrame, *keys: str, threshold: float = 0.5) -> DataFrame:
    """n, positives, loss, accuracy, precision and recall of labelled scores, per group (null where undefined)."""
    said, true = F.col("score") > threshold, F.col("label") == 1
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(true).alias("positives"), F.avg(C.log_loss("label", "score")).alias("loss"),
        F.avg((said == true).cast("double")).alias("accuracy"),
        F.try_divide(F.count_if(said & true), F.count_if(said)).alias("precision"), F.try_divide(F.count_if(said & true), F.count_if(true)).alias("recall"),
    )


def held_out_scores(obs: DataFrame, meta: DataFrame, n: int, bands: Sequence[str], seed: int, train: str = "TRAIN", test: str = "TUNE", iterations: int = 20) -> DataFrame:
    """split, label, pair_id and score of the pairs of both splits, by a classifier fitted on the training split.

    Objects are split, not pairs: a pair is made within a split, so both its objects are on one side and no
    object of a scored pair has been trained on. The vectors are stored once; fitting reads them many times.
    """
    made = None
    for split in dict.fromkeys((train, test)):
        own = pair_vectors(training_set(obs, meta, n, bands, seed, split), bands, n).withColumn("split", F.lit(split))
        made = own if made is None else made.unionByName(own)
    vectors = stored(made, "pair-vectors")
    model = fit_pair_classifier(vectors.where(F.col("split") == train), iterations)
    return classify_pairs(model, vectors, "split")


def held_out_report(obs: DataFrame, meta: DataFrame, n: int, bands: Sequence[str], seed: int, **options) -> DataFrame:
    """The metrics of each split (see held_out_scores and pair_metrics)."""
    return pair_metrics(held_out_scores(obs, meta, n, bands, seed, **options), "split")
