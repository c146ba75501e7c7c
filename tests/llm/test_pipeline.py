"""The pipeline's stages, each against plain Python on its own input."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np

from cadenza.llm import quality


def test_stages(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    item = " ".join((texts[30] or "").split()[:25])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = documents
    state = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert sorted({r.doc_id for r in out.collect()}) == [i for i, _ in state]
            break
        assert out.columns == documents.columns
        got = sorted((r.doc_id, r.text) for r in out.collect())
        if name == "quality_rules":
            rows = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
            kept = brute.quality_kept(rows, quality.BANDS, quality.SCRIPT_BANDS, quality.DEFAULT)
            assert got == [x for x in state if x[0] in set(kept)] and 0 < len(kept) < len(rows)
        elif name == "line_dedup":
            assert [(i, brute.sha(t)) for i, t in got] == sorted((i, h) for i, _, _, h in brute.lines(state))
        elif name == "near_dedup":
            assert [i for i, _ in got] == sorted(i for i, _, _, kept in brute.near(state, k=2) if kept)
        else:
            assert [i for i, _ in got] == sorted(i for i, *_, bad in brute.contamination(state, [(1, item)]) if not bad)
        out.write.parquet(f"{tmp_path}/{name}")
        docs, state = spark.read.parquet(f"{tmp_path}/{name}"), got


def test_run(spark, documents, tmp_path):
    """The whole pipeline against plain Python: which documents are left, with which text, and that every
    token of theirs lies in one sequence."""
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in documents.select("doc_id", "text", "lang").collect())
    item = " ".join((dict((i, t) for i, t, _ in rows)[30] or "").split()[:25])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = set(brute.quality_kept(rows, quality.BANDS, quality.SCRIPT_BANDS, quality.DEFAULT))
    left = brute.deduped_lines([(i, t) for i, t, _ in rows if i in kept])
    alone = {i for i, _, _, first in brute.near(left, k=2) if first}
    left = [(i, t) for i, t in left if i in alone]
    clean = {i for i, *_, bad in brute.contamination(left, [(1, item)]) if not bad}
    library, _ = brute.encodings()
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in left if i in clean}
    assert 0 < len(ids) < len(rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for parts, total in [*((pieces[i], len(ids[i])) for i in ids), *((x, None) for x in sequences.values())]:
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and (ends[-1] == total if total else ends[-1] <= 2048)


def test_near_copies_go(spark, documents, corpus):
    """Copies that differ in single words all along: one of each pair stays, and other documents stay."""
    rng = random.Random(11)
    base = [(i, t) for i, t in corpus if t and 40 <= len(t.split()) <= 120][:30]
    copies = []
    for i, t in base:
        words = t.split(" ")
        for at in range(rng.randrange(25), len(words), 25):
            words[at] = "swapped"
        copies.append((10_000 + i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in base + copies], documents.schema)
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    alone = {i for i, _, _, kept in brute.near(base) if kept}
    assert alone <= left and sum(i >= 10_000 for i in left) <= len(copies) / 10


def test_run_on_nothing(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
