"""Preference formatting: a shared prompt and two masked completions, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their turns, in order of (turn, role, text), share a
longest common prefix of equal (role, text); it is rendered once as prompt. The rest of each is a
completion. A mask lists the character spans of the completion that are trained on: the text of
assistant turns with its end mark.

A turn renders as <|im_start|>role, newline, text, <|im_end|>, newline; "<|" inside a text becomes
"< |", so that no text can forge a mark.

One shuffle brings the turns of a pair together; a conversation is rendered whole, as it must be.

Defined cases: a null role or text is empty; repeated turns are kept in order; if one side is
missing, the prompt is empty and that side's completion too; equal conversations leave two empty
completions; turns without conv_id belong to no pair; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(STOP + "\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """Spans [start, end) of trained characters in the rendered turns."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head = state["at"] + len(START) + F.char_length(turn["role"]) + 1
        tail = head + F.char_length(turn["text"]) + len(STOP)
        span = F.array(F.struct(head.cast("long").alias("start"), tail.cast("long").alias("end")))
        return F.struct((tail + 1).cast("long").alias("at"), F.when(turn["role"] == TRAINED, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step, lambda state: state["spans"])


def preference_pairs(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per pair: pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask.

    turns: conv_id, turn, role, text. pairs: pair_id, chosen, rejected (conv_ids); without it
    conversation 2k is preferred to 2k + 1 in pair k.
    """
    clean = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("< |"))
    own = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), clean("role").alias("role"), clean("text").alias("text")).alias("part"))
    if pairs is None:
        sided = own.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.pmod("conv_id", F.lit(2)).cast("int").alias("side"), "part")
    else:
        sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("chosen").cast("long").alias("conv_id"), F.lit(0).alias("side")), F.struct(F.col("rejected").cast("long").alias("conv_id"), F.lit(1).alias("side")))).alias("s")).select("pair_id", "s.*")
        sided = sides.join(own, "conv_id").select("pair_id", "side", "part")
    gathered = sided.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("side", "part"))).alias("parts"))
    of = lambda side: F.transform(F.filter("parts", lambda p: p["side"] == side), lambda p: p["part"])
    split = gathered.select("pair_id", of(0).alias("c"), of(1).alias("r"))
    equal = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differ = F.array_position(equal, F.lit(False))
    n = F.when(differ > 0, differ - 1).otherwise(F.size("c")).cast("int")
    parted = split.withColumn("n_prefix", n)
    rest = lambda side: F.filter(side, lambda _, i: i >= F.col("n_prefix"))
    cut = parted.select("pair_id", "n_prefix", F.filter("c", lambda _, i: i < F.col("n_prefix")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        "pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), _text(F.col("p")).alias("prompt"), _text(F.col("c")).alias("chosen"), _text(F.col("r")).alias("rejected"), _spans(F.col("c")).alias("chosen_mask"), _spans(F.col("r")).alias("rejected_mask")
    )
