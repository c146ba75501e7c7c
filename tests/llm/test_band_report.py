"""Rejections by measure: they add up to the verdicts, and which measures catch bad documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.llm.band_report import MEASURES, rejections
from cadenza.llm.quality import quality


def test_rejections_are_those_of_the_verdict(spark, documents):
    measured = quality(documents.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))).cache()
    got = {r.lang: r for r in rejections(measured, "lang").collect()}
    for lang in ("en", None):
        own = measured.where(F.col("lang").eqNullSafe(F.lit(lang)) & ~F.col("base_failed"))
        assert got[lang].n == own.count() and got[lang].rejected == own.where("not kept").count()
        assert max(got[lang][m] for m in MEASURES) <= got[lang].rejected <= sum(got[lang][m] for m in MEASURES)
        assert sum(got[lang][f"only_{m}"] for m in MEASURES) <= got[lang].rejected
    measured.unpersist()


def test_measures_on_labelled_documents(spark):
    """At scale 0.1: good documents pass in every language, most bad ones don't; signs decide alone most often."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id").select("doc_id", "text", "lang", "quality")
    found = {(r.lang, r.quality): r for r in rejections(quality(docs, keep_text=False), "lang", "quality").collect()}
    for lang in ("en", "de", "es", "fr"):
        good, bad = found[lang, 1], found[lang, 0]
        assert good.rejected <= 0.01 * good.n and bad.rejected >= 0.5 * bad.n
    total = {m: sum(r[m] for (_, quality_), r in found.items() if quality_ == 0) for m in MEASURES}
    alone = {m: sum(r[f"only_{m}"] for (_, quality_), r in found.items() if quality_ == 0) for m in MEASURES}
    assert total["sign_share"] > total["multi_chars_per_token"] > total["token_entropy"] > 0
    assert alone["sign_share"] > 50 and sum(alone.values()) < sum(total.values())
