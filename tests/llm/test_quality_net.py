"""The quality classifier: its parts against plain Python, held-out accuracy, and its defined cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import queries, quality_net
from cadenza.llm.common import slices, span_hashes
from cadenza.llm.quality_net import BUCKETS, DIM, index_vectors, pooled, quality_scores, word_vectors, words_and_signs

TOKEN = re.compile("[A-Za-z\x80-\U0010ffff]+|[0-9]+|[\x00-\x08\x0e-\x1f!-/:-@\\[-`{-\x7f]+")


@given(st.lists(st.text(alphabet="ab9é中!? \n\x1c", max_size=20), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_and_signs(texts):
    for at, to, data, bounds in slices(pa.array(texts, pa.string())):
        w = words_and_signs(data, bounds)
        got = [[data[w.starts[i] : w.ends[i]].tobytes().decode() for i in range(w.first[r], w.first[r + 1])] for r in range(to - at)]
        assert got == [TOKEN.findall(t) for t in texts[at:to]]


def _hash(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(data, np.array([0]), np.array([len(data)]))


def test_vectors_and_pooling_by_hand(spark, monkeypatch):
    """Sums over all texts by words and neighbours, whatever the chunks; pooled rows from them."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", "And", "!!", "12", "tion"]) for _ in range(rng.randint(0, 40))) for _ in range(30)] + [None, ""]
    total, n = defaultdict(lambda: np.zeros(DIM)), defaultdict(int)
    for t in texts:
        words = TOKEN.findall(t or "")
        for i, x in enumerate(words):
            n[x] += 1
            for y in words[max(0, i - 2) : i] + words[i + 1 : i + 3]:
                total[x] += index_vectors(_hash(y))[0]
    monkeypatch.setattr(quality_net, "CHUNK", 7)
    known = word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
    everywhere, count = sum(total.values()), sum(n.values())
    vector, weight = {}, {}
    for x in n:
        v = total[x] / n[x] - everywhere / count
        vector[x], weight[x] = v / np.linalg.norm(v), 1e-3 / (1e-3 + n[x] / count)
        at = int(_hash(x)[0] % np.uint64(BUCKETS))
        assert known.vectors[at] == pytest.approx(vector[x], abs=1e-5) and known.weight[at] == pytest.approx(weight[x], rel=1e-5)
    for chunk in (5, 10_000):
        monkeypatch.setattr(quality_net, "CHUNK", chunk)
        for at, to, data, bounds in slices(pa.array(texts, pa.string())):
            for row, t in zip(pooled(data, bounds, known), texts[at:to], strict=True):
                words = TOKEN.findall(t or "")
                if not words:
                    assert not row.any()
                    continue
                v, w = np.array([vector[x] for x in words]), np.array([weight[x] for x in words])
                mean = (v * w[:, None]).sum(0) / w.sum()
                spread = np.sqrt(np.maximum((v * v * w[:, None]).sum(0) / w.sum() - mean * mean, 0))
                alike = [sum(float(v[i] @ v[i + d]) for i in range(len(v) - d)) / max(len(v) - d, 1) for d in (1, 2)]
                assert row == pytest.approx(np.concatenate([mean, spread, alike, [np.log1p(len(v))]]), abs=2e-3)


def test_temperature_of_overconfident_logits():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    net = quality_net.Network(np.zeros(1), np.ones(1), np.array([[1e-3]]), np.zeros(1), np.array([5e3]), 0.0)
    assert quality_net.calibrated(net, z[:, None], y).temperature == pytest.approx(5, rel=0.1)


def _made(rng, i):
    """Texts of common words; bad ones carry signs, stammer or shout."""
    words = [rng.choice(["the", "river", "of", "tioned", "and", "harbour", "in", "weathered", f"x{rng.randint(0, 99)}"]) for _ in range(rng.randint(20, 90))]
    kind = i % 5
    if kind == 0:
        return " ".join(w + rng.choice(["&&&", "$$$"]) for w in words), 0
    if kind == 1:
        return " ".join(w for w in words[:12] for _ in range(6)), 0
    return " ".join(words), 1


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(9)
    rows = [(i, *_made(rng, i)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int"), {i: q for i, _, q in rows}


def test_held_out_accuracy(made):
    docs, labels, truth = made
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_labels_of_held_out_rows_are_not_learned(made, spark):
    docs, labels, _ = made
    turned = labels.withColumn("quality", queries.F.when(quality_net.fold_of(queries.F.col("doc_id")) == 0, 1 - queries.F.col("quality")).otherwise(queries.F.col("quality")))
    score = lambda x: {r.doc_id: r.score for r in quality_scores(docs, x).collect()}
    one = score(labels)
    assert one == score(turned.repartition(3))
    renamed = docs.withColumn("doc_id", queries.F.col("doc_id") + 5_000).unionByName(docs)
    assert {r.doc_id for r in quality_scores(renamed, labels).collect()} > set(one)


def test_query_on_the_given_tables(spark):
    """Held-out accuracy and calibration at scale 0.01."""
    d = "/root/testdata/sf0.01"
    got = queries.op13_quality_net(spark, d)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert len(y) > 50 and auc > 0.95 and np.mean((s >= 0.3) == y) > 0.9


def test_defined_cases(spark, odd, nothing, made):
    docs, labels, truth = made
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_scores(nothing, labels).count() == 0
    assert {r.score for r in quality_scores(odd, none).collect()} == {0.5}
    good = quality_scores(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(good) == 1 and good[0].score > 0.99
    clash = spark.createDataFrame([(None, "x", 2.0, 7), (1, None, 3.0, 8), (1, "the river", 1.0, 9), (2, "", 1.0, 1)], "doc_id long, text string, score double, extra int")
    mixed = labels.unionByName(labels.where("doc_id < 50").withColumn("quality", 1 - queries.F.col("quality"))).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema))
    got = quality_scores(clash.unionByName(docs.select("doc_id", "text", queries.F.lit(0.0).alias("score"), queries.F.lit(0).alias("extra"))), mixed)
    assert sorted(got.columns) == ["doc_id", "extra", "held_out", "predicted", "score", "text"]
    rows = got.where("extra > 0").collect()
    assert len(rows) == 4 and [r.held_out for r in rows if r.doc_id is None] == [True]
    assert len({r.score for r in rows if not r.text}) == 1


def test_very_long_text(spark, made):
    docs, labels, _ = made
    long = spark.createDataFrame([(10_000, "the river of weathered harbour and " * 60_000)], docs.schema)
    row = quality_scores(docs.unionByName(long), labels).where("doc_id = 10000").first()
    assert 0 <= row.score <= 1
