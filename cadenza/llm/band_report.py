"""Which measure of the quality rules rejects how many documents, by language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.quality import BANDS, DEFAULT, SCRIPT_BANDS, WRITTEN, Band

#: Each measure of a band: what lies outside.
MEASURES: dict[str, Callable[[Band], Column]] = {
    "chars_per_token": lambda b: ~F.col("chars_per_token").between(b.least, b.most),
    "multi_chars_per_token": lambda b: ~F.col("multi_chars_per_token").between(b.multi_least, b.multi_most),
    "fragment_share": lambda b: F.col("fragment_share") > b.fragments,
    "token_entropy": lambda b: F.col("token_entropy") < b.entropy,
    "sign_share": lambda b: F.col("sign_share") > b.signs,
}


def outside(name: str, lang: bool, bands: dict[str, Band] = BANDS, script_bands: dict[str, Band] = SCRIPT_BANDS, default: Band = DEFAULT) -> Column:
    """Whether the measure lies outside the band that holds for the row: its language's, else its script's."""
    found = MEASURES[name](default)
    for script, band in script_bands.items():
        found = F.when(F.col("script") == script, MEASURES[name](band)).otherwise(found)
    for language, band in bands.items() if lang else ():
        written = F.col("script") == WRITTEN[language] if language in WRITTEN else F.lit(True)
        found = F.when((F.col("lang") == language) & written, MEASURES[name](band)).otherwise(found)
    return F.coalesce(found, F.lit(True))


def rejections(measured: DataFrame, *keys: str) -> DataFrame:
    """Per group of measured documents (see quality) that pass the base rules: n, rejected (by any measure), and
    of each measure how many it rejects and how many it alone rejects (only_...). A measure that can't be taken
    (no tokens) rejects."""
    lang = "lang" in measured.columns
    flags = measured.where(~F.col("base_failed")).withColumns({f"_{m}": outside(m, lang) for m in MEASURES})
    number = sum((F.col(f"_{m}").cast("int") for m in MEASURES), F.lit(0))
    counted = [F.count_if(F.col(f"_{m}")).alias(m) for m in MEASURES] + [F.count_if(F.col(f"_{m}") & (number == 1)).alias(f"only_{m}") for m in MEASURES]
    return flags.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(number > 0).alias("rejected"), *counted)
