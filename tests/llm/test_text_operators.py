"""Each text operator against a plain Python version, and its defined cases."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.llm import bpe, decontaminate, holders, html_extract, licenses, line_dedup, lsh_forest, packing, preference, quality, queries, set_join, substring_dedup, token_counts
from cadenza.llm.common import ALNUM, FOLDED, PLAIN, slices, words_of
from cadenza.llm.components import connected_components


@pytest.fixture(scope="module")
def sf_dir(documents, spark, tmp_path_factory):
    """The fixture's documents with a benchmark, as the tables of a scale factor."""
    d = tmp_path_factory.mktemp("sf")
    documents.write.parquet(f"{d}/documents.parquet")
    texts = dict(map(tuple, documents.select("doc_id", "text").collect()))
    items = [(0, " ".join((texts[20] or "").split()[:30])), (1, (texts[21] or "")[:60].upper()), (2, "one"), (3, "nowhere to be found in any of these texts at all, surely not"), (4, None), (5, ""), (None, texts[22]), (0, texts[20])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), [(i, t) for i, t in items if i is not None]


def rows(table):
    return sorted(map(tuple, table.collect()), key=str)


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- shared parts
@given(st.lists(st.text(alphabet=" \t\n\x0b\x1c\x85abZé中'-9 　", max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_of_a_slice(texts):
    for alphabet, split in ((PLAIN, brute.plain_words), (ALNUM, lambda t: brute.ALNUM.findall(t.translate(brute.FOLD))), (FOLDED, lambda t: brute.plain_words(t.translate(brute.FOLD)))):
        for at, to, data, bounds in slices(pa.array(texts, pa.string())):
            w = words_of(data, bounds, alphabet)
            for r in range(at, to):
                mine = [w.data[w.starts[i] : w.ends[i]].tobytes().decode() for i in range(w.first[r - at], w.first[r - at + 1])]
                assert mine == split(texts[r])
            h, by = w.hashes(), {}
            for i in range(len(h)):
                by.setdefault(int(h[i]), set()).add(w.data[w.starts[i] : w.ends[i]].tobytes())
            assert all(len(v) == 1 for v in by.values())


_SIGNS = list("aZé9²٣ \n\t'!?_.中😀́ 　\x85\x1c") + ["'s", "'re", "'ll", "'ve", "  ", " '", "<|endoftext|>", "\r\n"]


@given(st.lists(st.lists(st.sampled_from(_SIGNS), max_size=14).map("".join), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_tokens_equal_the_library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for at, to, data, bounds in slices(pa.array(texts, pa.string())):
        ids, first = bpe.encoder(bpe.vocabulary()).encode(data, bounds)
        assert [ids[first[i] : first[i + 1]].tolist() for i in range(to - at)] == want[at:to]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_first_holders_over_any_batches(spark, size):
    rng = random.Random(size)
    data = [(rng.randint(0, 9) if rng.random() < 0.6 else 5, rng.randint(0, 2), rng.randint(0, 20), i) for i in range(600)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    later, first = holders.first_holders(spark.createDataFrame(data, "k1 long, k2 long, doc long, tag long").repartition(3), branches=True, refs=True)
    found, branching = later.collect(), set(map(tuple, first.collect()))
    got, key = {(r.doc, r.tag) for r in found}, {(doc, tag): (k1, k2) for k1, k2, doc, tag in data}
    assert all(r.ref_doc < r.doc and key[r.ref_doc, r.ref_tag] == key[r.doc, r.tag] for r in found)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    least, kinds = {}, defaultdict(set)
    for k1, k2, doc, _ in data:
        least[k1, k2] = min(least.get((k1, k2), doc), doc)
        kinds[k1].add(k2)
    assert got == {(doc, tag) for k1, k2, doc, tag in data if least[k1, k2] < doc}
    firsts = {x for x in data if least[x[0], x[1]] == x[2]}
    assert {x for x in firsts if len(kinds[x[0]]) > 1} <= branching <= firsts


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got.get(x, x) == root(x) for x in parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 quality
def test_quality_base(documents, corpus, sf_dir, spark):
    got = queries.op1_fertility(spark, sf_dir[0])
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), brute.quality_base(corpus))


def test_quality_measures(spark, corpus, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = dict(corpus)
    for r in quality.quality(documents).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        n = len(ids)
        assert r.n_tokens == n
        if n < 2:
            continue
        bits = -sum(c / n * np.log2(c / n) for c in Counter(ids).values())
        assert r.chars_per_token == pytest.approx(len(texts[r.doc_id]) / n)
        assert r.token_entropy == pytest.approx(bits / np.log2(n))
        alone = [t for t in map(library.decode, ([i] for i in ids)) if t.isascii() and t.strip() and not any(c.isalnum() for c in t)]
        assert r.sign_share == pytest.approx(len(alone) / n)
        assert r.fragment_share == pytest.approx(sum("�" in library.decode([i]) for i in ids) / n)


def test_quality_bands(spark, documents):
    none = quality.quality(documents, bands={"en": quality.Band(99, 100, 0, 1)}).where("lang = 'en' and script = 'latin' and kept").count()
    assert none == 0
    wide = quality.Band(0, 1e9, 1, 0, 0, 1e9, 1)
    kept = quality.quality(documents, bands={}, script_bands={}, default=wide)
    assert kept.where("kept").count() == kept.where("not base_failed").count() > 0


def test_quality_verdicts_against_plain_python(documents):
    """kept is what the base rules and the band of the language or script say."""
    for r in quality.quality(documents).collect():
        band = quality.BANDS.get(r.lang) if r.script == "latin" else None
        b = band or quality.SCRIPT_BANDS.get(r.script, quality.DEFAULT)
        inside = r.n_tokens > 0 and b.least <= r.chars_per_token <= b.most and b.multi_least <= r.multi_chars_per_token <= b.multi_most
        inside = inside and r.fragment_share <= b.fragments and r.token_entropy >= b.entropy and r.sign_share <= b.signs
        assert r.kept == (not r.base_failed and inside)


def test_scripts_of_letters():
    texts = ["Plain wörds", "ελληνικά words", "слово за словом", "שלום", "हिन्दी में", "中文 字 かな", "한국어", "123 !?", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    assert quality.scripts(data, bounds) == ["latin", "greek", "cyrillic", "semitic", "indic", "cjk", "hangul", None, None]


def test_a_language_in_another_script_takes_the_scripts_band(spark):
    rows = [(1, "слово за словом " * 2 + "и так далее до конца строки", "en"), (2, "слово за словом " * 2 + "и так далее до конца строки", "ru"), (3, "слово за словом " * 2 + "и так далее до конца строки", None)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), script_bands={"cyrillic": quality.Band(0, 9, 1, 0, 0, 9, 1)}, default=quality.Band(9, 9, 0, 1))
    assert got.where("kept").count() == 3


def test_fitted_bands_hold_good_documents(documents):
    measured = quality.quality(documents)
    fitted = quality.fit_bands(measured.where("kept"))
    assert set(fitted) == {"en", "fr"}
    again = quality.quality(documents.where("lang is not null"), bands=fitted)
    assert again.where("kept").count() >= measured.where("kept and lang is not null").count()


def test_quality_cases(odd, nothing):
    got = quality.quality(odd)
    assert got.count() == 7 and got.where("text is null and not kept and chars_per_token is null").count() == 2
    assert len(got.columns) == len(set(got.columns))
    assert quality.quality(nothing).count() == 0


# ---------------------------------------------------------------- 2 lines
def test_line_dedup(spark, sf_dir, corpus):
    same(queries.op2_line_dedup(spark, sf_dir[0]), brute.lines(corpus))


def test_line_dedup_cases(odd, nothing):
    got = line_dedup.dedup_lines(odd)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in got.collect()) == [("1", 2, 0), ("1", 2, 0), ("1", 2, 0), ("2", 2, 1), ("3", 1, 0), ("None", 1, 0), ("None", 2, 0)]
    assert got.where("doc_id = 2").first().keep == "y"
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_bitmaps_name_dropped_lines(documents, corpus):
    want = {d: n for d, _, n, _ in brute.lines(corpus) if n}
    got = {r.doc: 8 * len(zlib.decompress(r.keep)) - int(np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8)).sum()) for r in line_dedup.line_keep_bitmaps(documents).collect()}
    assert got == want


# ---------------------------------------------------------------- 3 decontamination
def test_decontamination(spark, sf_dir, corpus):
    same(queries.op3_decontaminate(spark, sf_dir[0]), brute.contamination(corpus, sf_dir[1]))


def test_decontamination_by_join_is_the_same(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir[0]}/benchmark.parquet")
    one = decontaminate.find_contamination(documents, bench)
    two = decontaminate.find_contamination(documents, bench, broadcast_bytes=0)
    assert one.columns == two.columns and rows(one) == rows(two)
    assert decontaminate.find_contamination(documents, bench.limit(0), broadcast_bytes=-1).where("n_hit > 0").count() == 0


def test_decontamination_by_join_tells_texts_of_one_hash_apart(spark, sf_dir, documents, monkeypatch):
    """As if all texts and windows had one 64-bit hash: each keeps its own hits."""
    bench = spark.read.parquet(f"{sf_dir[0]}/benchmark.parquet")
    want = rows(decontaminate.find_contamination(documents, bench))
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    assert rows(decontaminate.find_contamination(documents, bench, broadcast_bytes=0)) == want


def test_windows_that_many_items_share():
    """Equal windows are held once with all their items; the arrays stay within what was reckoned."""
    items = [(i, "The shared words of all these many items are the same ones, but for " + str(i % 7)) for i in range(200)] + [(500, "a b"), (501, "A  B!")]
    w = decontaminate._Windows(items, 10)
    assert sorted(w.by_length) == [2, 10]
    hashes, at, first, item = w.by_length[2]
    assert w.items_of(2, hashes[0], 0, b"a b").tolist() == [500, 501] and not len(w.items_of(2, hashes[0], 0, b"a c"))
    hashes, at, first, item = w.by_length[10]
    assert len(set(hashes.tolist())) == len(hashes) < 40 and len(item) == first[-1]
    held = sum(x.nbytes for own in w.by_length.values() for x in own) + len(w.words) + w.starts.nbytes
    assert held <= sum(2 * len(t) + decontaminate.WINDOW_BYTES * len(brute.ALNUM.findall(t)) for _, t in items)

def test_removal_of_spans_and_documents(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir[0]}/benchmark.parquet")
    bad = decontaminate.find_contamination(documents, bench).where("n_hit > 0").count()
    assert bad > 0
    assert decontaminate.decontaminate(documents, bench).count() == documents.count() - bad
    cut = decontaminate.decontaminate(documents, bench, remove="spans")
    assert cut.count() == documents.count() and cut.columns == documents.columns
    t = spark.createDataFrame([(1, "é one two three, END")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "ONE two")], "item_id long, text string")
    assert decontaminate.decontaminate(t, b, remove="spans").first().text == "é  three, END"


def test_decontamination_cases(spark, odd, nothing):
    b = spark.createDataFrame([(1, "another"), (None, "alpha beta"), (2, None)], "item_id long, text string")
    got = decontaminate.find_contamination(odd, b)
    assert got.where("n_hit > 0").count() == 1 and got.count() == 7
    assert decontaminate.find_contamination(odd, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(nothing, b).count() == 0


# ---------------------------------------------------------------- 4 substrings
def test_substring_dedup(spark, sf_dir, corpus):
    same(queries.op4_substring_dedup(spark, sf_dir[0]), brute.substrings(corpus))


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_on_few_words(spark, seed):
    """Texts over three words repeat themselves everywhere: every factor boundary is tried."""
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice("ab" if i % 3 else "abc") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    want = brute.substrings(docs)
    assert sorted((r.doc_id, r.n_words, r.n_removed, brute.sha(r.text)) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("few", [False, True])
def test_factors_are_copies_that_cover_what_is_removed(spark, corpus, documents, few):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 50)))) for i in range(30)] if few else corpus
    words = {i: brute.plain_words(t) for i, t in docs}
    covered = defaultdict(set)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3) if few else documents
    for r in substring_dedup.factors(table).collect():
        assert r.length >= 13 and r.ref_doc < r.doc_id and r.start + r.length <= len(words[r.doc_id])
        assert words[r.doc_id][r.start : r.start + r.length] == words[r.ref_doc][r.ref_start : r.ref_start + r.length]
        covered[r.doc_id].update(range(r.start, r.start + r.length))
    assert {d: len(x) for d, x in covered.items()} == {d: n for d, _, n, _ in brute.substrings(docs) if n}
    long = [r for r in substring_dedup.factors(documents).collect() if r.length > 30] if not few else [1]
    assert long  # a copied passage of forty words is one factor, not many


def test_substring_dedup_cases(odd, nothing):
    got = {(str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(odd).collect()}
    assert ("2", 25, 20) in got and ("1", 24, 0) in got and ("None", 24, 0) in got and ("None", 0, 0) in got
    assert substring_dedup.dedup_substrings(nothing).count() == 0


# ---------------------------------------------------------------- 5 packing
def test_packing(spark, corpus, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in corpus}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(documents).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [*((pieces[i], len(ids[i])) for i in ids), *((x, None) for x in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    least = -(-sum(map(len, ids.values())) // 2048)
    assert len(sequences) <= least + 2


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    demand = np.bincount(np.minimum(256, np.ceil(rng.exponential(50, 20_000)).astype(int)), minlength=257)[1:]
    plan = packing.plan(demand)
    assert (sum(c * n for c, n in plan) == demand).all()
    assert all((c * np.arange(1, 257)).sum() <= 256 for c, _ in plan)
    assert sum(n for _, n in plan) <= np.ceil((demand * np.arange(1, 257)).sum() / 256) + 2


@pytest.mark.parametrize("kind", ["flat", "steep", "few", "large"])
def test_packing_plan_is_quick(kind):
    """A driver's work: seconds at most for any histogram, and near the bound of the linear program."""
    rng = np.random.default_rng(8)
    demand = {"flat": np.full(256, 1000), "steep": np.round(10**6 * 0.97 ** np.arange(256)).astype(int), "few": np.bincount([3, 90, 90, 100, 200, 255], minlength=256), "large": rng.integers(0, 10**7, 256)}[kind].astype(np.int64)
    began = time.thread_time()
    plan = packing.plan(demand)
    assert time.thread_time() - began < 6
    assert (sum(c * n for c, n in plan) == demand).all() and all((c * np.arange(1, 257)).sum() <= 256 for c, _ in plan)
    least = (demand * np.arange(1, 257)).sum() / 256
    lone = demand[128:].sum()  # of these no two fit
    assert sum(n for _, n in plan) <= max(least, lone) * 1.005 + 130


def test_packing_cases(odd, nothing):
    assert packing.pack(nothing).count() == 0
    got = packing.pack(odd).collect()
    assert Counter(str(r.doc_id) for r in got) == {"1": 3, "2": 1, "3": 1, "None": 2}
    assert {r.length for r in got if r.doc_id == 3} == {1}


# ---------------------------------------------------------------- 6 licences
def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit-text"]
    docs = [(1, "Some prose here.\nReleased under the MIT License.\nMore."), (2, mit), (3, f"intro\n\n{mit}\n\noutro text"), (4, "Licensed under the Apache Licence, Version 2.0!"), (5, "nothing"), (6, None), (7, ""), (8, "licensed under CC by-nc 4.0\nreleased under the mit license"), (9, "the the the"), (10, "We say that this was released under the MIT License, as all know.")]
    got = {r.doc_id: (r.licenses, r.best_license, r.best_score) for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1][:2] == (["mit"], "mit") and got[2] == (["mit"], "mit", 1.0) and got[3] == (["mit"], "mit", 1.0)
    assert got[4] == ([], None, None)  # two of seven bigrams differ: 0.71
    assert got[8][0] == ["cc-by-nc-4.0", "mit"] and got[8][2] == 1.0 and got[10] == (["mit"], "mit", 1.0)
    assert all(got[i] == ([], None, None) for i in (5, 6, 7, 9))


def _wrapped(text, width, mark):
    lines, line = [], []
    for word in text.split():
        line.append(word)
        if sum(map(len, line)) > width:
            lines.append(mark + " ".join(line))
            line = []
    return "\n".join([*lines, mark + " ".join(line)])


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found_in_a_file(name):
    """As a comment block straight before code, and in paragraphs amid prose."""
    templates = licenses._Templates(licenses.TEMPLATES)
    text = licenses.TEMPLATES[name]
    half = text.find(". ", len(text) // 3) + 1
    for made in (f"// Copyright someone\n{_wrapped(text, 60, '// ')}\nint main() {{ return 0; }}\n" * 2, f"Some words before all.\n\n{text[:half]}\n\n{text[half:]}\n\nAnd prose that goes on for a while after it, as it does."):
        data = np.frombuffer(made.encode(), np.uint8)
        (found,) = licenses._scan(templates, data, np.array([0, len(data)]), licenses.THRESHOLD)
        scores = {templates.names[t]: x[0] for t, x in found.items()}
        assert scores[name] > 0.95 and scores[name] == max(scores.values())
        assert {license for license, _ in licenses._standing(templates, found)} == {licenses.license_of(name)}  # one header, one licence


def test_license_scores_against_brute_force(spark):
    rng = random.Random(4)
    docs = []
    for i in range(60):
        words = rng.choice([t for t in licenses.TEMPLATES.values() if len(t) < 700]).split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "license", words[0]])
        docs.append((i, "before all the\n" + " ".join(words) + "\n\n after the license"))
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        words = brute.ALNUM.findall(text.translate(brute.FOLD))
        pairs, best = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)], []
        for name, template in licenses.TEMPLATES.items():
            t, windows = set(licenses.bigrams(template)), []
            for a in range(len(pairs)):
                s = set()
                for z, x in enumerate(pairs[a : a + licenses.bounds_of(len(t), licenses.THRESHOLD)[1]], a):
                    s.add(x)
                    windows.append((-2 * len(s & t) / (len(s) + len(t)), a, z))
            score, a, z = min(windows)
            if -score >= licenses.THRESHOLD:
                best.append((score, -len(t), name, a, z))
        stays = [x for x in best if not any(y < x and y[3] <= x[4] and x[3] <= y[4] for y in best)]
        assert got[i].licenses == sorted({licenses.license_of(x[2]) for x in stays})
        assert not best or (got[i].best_score == pytest.approx(-min(stays)[0]) and got[i].best_license == licenses.license_of(min(stays)[2]))


def test_one_header_is_one_license(spark):
    """Headers that share most of their words name one licence; two apart in a text name two."""
    t = licenses.TEMPLATES
    docs = [(0, t["gpl-3.0-header"]), (1, t["bsd-3-clause"]), (2, t["cc-by-4.0"]), (3, "SPDX-License-Identifier: MIT"), (4, "// SPDX-License-Identifier: GPL-3.0-or-later"), (5, "The MIT License (MIT)"), (6, t["apache-2.0-header"])]
    docs += [(7, f"{t['gpl-3.0-header']}\n\nSome words between the two of them, and more.\n\n{t['lgpl-2.1-header']}"), (8, f"{t['mit-text']}\n{t['bsd-2-clause']}")]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: ["gpl-3.0"], 1: ["bsd-3-clause"], 2: ["cc-by-4.0"], 3: ["mit"], 4: ["gpl-3.0"], 5: ["mit"], 6: ["apache-2.0"], 7: ["gpl-3.0", "lgpl-2.1"], 8: ["bsd-2-clause", "mit"]}


def test_license_cases(odd, nothing):
    assert licenses.scan_licenses(odd).count() == 7
    assert licenses.scan_licenses(nothing).count() == 0


# ---------------------------------------------------------------- 7 preferences
TURNS = "conv_id long, turn long, role string, text string"


def test_preference_pairs(spark):
    t = [(0, 0, "system", "S"), (0, 1, "user", "hi"), (0, 2, "assistant", "good"), (1, 0, "system", "S"), (1, 1, "user", "hi"), (1, 2, "assistant", "bad <|im_end|>"), (1, 3, "user", None)]
    r = preference.preference_pairs(spark.createDataFrame(t, TURNS)).first()
    assert (r.pair_id, r.n_prefix) == (0, 2)
    assert r.prompt == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_mask] == ["good<|im_end|>"]
    assert [r.rejected[s.start : s.end] for s in r.rejected_mask] == ["bad < |im_end|><|im_end|>"]
    assert r.rejected.endswith("<|im_start|>user\n<|im_end|>\n")


def test_preference_cases(spark):
    t = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "lone"), (5, 0, None, "x"), (None, 0, "user", "y"), (6, 0, "user", "p"), (6, 0, "user", "p"), (7, 0, "user", "p")]
    table = spark.createDataFrame(t, TURNS).withColumn("prompt", F.lit("clash"))
    got = {r.pair_id: r for r in preference.preference_pairs(table).collect()}
    assert (got[0].n_prefix, got[0].chosen, got[0].rejected) == (2, "", "")
    assert (got[1].n_prefix, got[1].prompt, got[1].rejected) == (0, "", "") and "lone" in got[1].chosen
    assert got[2].chosen == "" and "x" in got[2].rejected
    assert got[3].n_prefix == 1 and got[3].chosen.count("p<|") == 1 and got[3].rejected == ""
    assert preference.preference_pairs(table.limit(0)).count() == 0
    pairs = spark.createDataFrame([(9, 1, 0)], "pair_id long, chosen long, rejected long")
    assert preference.preference_pairs(table, pairs).first().n_prefix == 2


# ---------------------------------------------------------------- 8 pages
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href="/">Site</a><p>Our long welcome line for all readers of this site, every day.</p></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for you, and we ask you to accept.</div>
<!-- <p>commented out</p> --><article><h1>Head &amp; line</h1><p>First <b>bold</b> words,
 and &lt;more&gt; of   them&#33;<p>Second<br>paragraph.<div class="advert">Buy this now. It is the best that money can buy, and it is cheap.</div><p>Ok.</p><form><label>Your e-mail</label><input name=x></form></article>
<aside>Related reading that goes on for quite a while in a sidebar. It has sentences.</aside><div id="comments"><p>What a nice article, I liked it a lot and will read it again.</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Head & line\n\nFirst bold words, and <more> of them!\n\nSecond paragraph.\n\nOk."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p>", ""), ("<!-- a", ""), ("<script>x", ""), ("plain words", "plain words"), ("<p>a<p>b</div></p>c", "a\n\nb\n\nc"), ("<div><p>1 &lt; 2</p></div>", "1 < 2")])
def test_main_text_of_odd_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>One is here.</p><svg width=1 /><p>Two is here.</p></article>", "One is here.\n\nTwo is here."),
        ("<article><p>One is here.</p><iframe src=a><p>Two is here.</p></article>", "One is here.\n\nTwo is here."),
        ("<article><div><button>Buy</div><p>One is here.</p><button>Go <p>now</p></button><p>Two is here.</p></article>", "One is here.\n\nTwo is here."),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be so.</p></article>", "Let x=1 be so."),
    ],
)
def test_widgets_take_no_text_along(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize(
    ("name", "kind"),
    [("related-work", ""), ("legal-analysis", ""), ("side-effects", ""), ("head-injury", ""), ("article-body", "main"), ("entry-content", "main"), ("social-sciences", ""), ("alertness", ""), ("cookie-notice", "away"), ("relatedPosts", "away"), ("sidebar-2", "away"), ("site-footer", "away"), ("page-header", "head"), ("ad", "away"), ("post comments", "away"), ("comment_list", "away"), ("", "")],
)
def test_names_speak_as_a_whole(name, kind):
    assert html_extract.name_kind(name) == kind


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><section class="related-work"><p>Others have done this before us, in many ways.</p></section></article>', "Others have done this before us, in many ways."),
        ('<article><div id="legal-analysis"><p>The court has found that this is so.</p></div></article>', "The court has found that this is so."),
        ('<article><p>Shown <span aria-hidden="true">not</span><span hidden>nor</span><i style="color:red; display: none">this</i> text.</p></article>', "Shown text."),
        ('<article><p>One.</p><div class="cookieNotice"><p>We use cookies to make this site better, and ask you to accept.</p></div><p>Two.</p></article>', "One.\n\nTwo."),
    ],
)
def test_names_and_hidden_elements(page, text):
    assert html_extract.main_text(page) == text


def test_deep_nesting_takes_linear_time():
    deep = "<article>" + "".join(f"<div>Text number {i} is here, and it is long enough." for i in range(8000))
    began = time.thread_time()
    assert html_extract.main_text(deep).count("\n\n") == 7999
    assert html_extract.main_text("<article>" + "<b>x" * 8000).count("x") == 8000
    assert html_extract.main_text("<article>" + "<any>word " * 8000).count("word") == 8000
    assert time.thread_time() - began < 5


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        ties = [(i, j, rng.uniform(0, 1)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(labels, scores=scores, ties=ties):
            own = sum(np.log1p(np.exp(-s if keep else s)) for s, keep in zip(scores, labels, strict=True))
            return own + sum(w for a, b, w in ties if labels[a] != labels[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.content(scores, ties)) == pytest.approx(best)


def test_long_pages_take_linear_time():
    page = "<article>" + "<p>Some words of a paragraph that is long enough to count as text, surely.</p>" * 4000 + "</article>"
    assert html_extract.main_text(page).count("\n\n") == 3999
    assert html_extract.main_text("<div>" * 3000 + "deep text here") == "deep text here"


def test_pages_table(spark):
    t = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None)], "page_id long, url string, html string, n_chars long")
    got = html_extract.extract(t)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 3
    assert {r.n_chars for r in got.collect()} == {len(html_extract.main_text(PAGE)), 0}
    assert html_extract.extract(t.limit(0)).count() == 0


# ---------------------------------------------------------------- 9 near-duplicates
def test_near_duplicates(spark, sf_dir, corpus):
    same(queries.op9_minhash(spark, sf_dir[0]), brute.near(corpus))


def test_near_duplicates_in_a_large_group(spark):
    """Hundreds of near copies of one text, chains at the threshold, and look-alikes below it."""
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    docs = []
    for i in range(400):
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(120)] = f"v{i}{rng.randint(0, 9)}"
        docs.append((i, " ".join(own)))
    chain = list(base[:60]) + [f"c{i}" for i in range(60)]
    for i in range(400, 440):
        chain[(i * 7) % 120] = f"d{i}"
        docs.append((i, " ".join(chain)))
    docs += [(i, " ".join(base[:70] + [f"x{i}_{j}" for j in range(50)])) for i in range(440, 540)]
    got = lsh_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), k=2)
    same(got, brute.near(docs))


def _tree(n_docs, regions, seed=0, like=0.9):
    """Sorted rows of one tree: docs of a region agree in most bits."""
    rng = np.random.default_rng(seed)
    region = np.sort(rng.integers(0, regions, n_docs))
    keys = np.zeros((n_docs, lsh_forest._KEY), np.uint8)
    keys[:, lsh_forest._HEAD - 1] = region
    bits = rng.random((regions, lsh_forest.SKETCH))[region] < 0.5
    bits ^= rng.random(bits.shape) > like
    docs = np.arange(n_docs, dtype=np.int64) * 7 % n_docs
    order = np.lexsort((docs, region))
    return keys, docs[order], np.packbits(bits, axis=1), region


def _batches(keys, docs, bits, size):
    return [pa.RecordBatch.from_arrays([lsh_forest._binary(keys[i : i + size]), pa.array(docs[i : i + size]), lsh_forest._binary(bits[i : i + size]), pa.array(docs[i : i + size])], names=["key", "doc", "bits", "part"]) for i in range(0, len(docs), size)]


def _seen(out, kind):
    return [(a, b) for batch in out for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if k == kind]


def _groups(pairs, docs):
    parent = {int(d): int(d) for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(b)] = root(a)
    return {d: root(d) for d in parent}


@pytest.mark.parametrize("size", [1, 3, 17, 1000])
def test_regions_over_any_batches(size):
    """Every pair of a small region, and enough of a larger one to tie it together; left-out ones are named."""
    keys, docs, bits, region = _tree(300, 60)
    least = lsh_forest.least_bits(0.5)
    out = list(lsh_forest._neighbours(least)(iter(_batches(keys, docs, bits, size))))
    words = bits.view(np.uint64)
    alike = [(i, j) for i in range(300) for j in range(i) if region[i] == region[j] and lsh_forest._agreeing(words[i], words[j]) >= least]
    pairs = set(_seen(out, lsh_forest.PAIR))
    assert pairs <= {(min(docs[i], docs[j]), max(docs[i], docs[j])) for i, j in alike}
    left = {a for a, _ in _seen(out, lsh_forest.MORE)}
    assert all((min(docs[i], docs[j]), max(docs[i], docs[j])) in pairs or {docs[i], docs[j]} <= left for i, j in alike)
    few = Counter(i for i, _ in alike)
    assert all((min(docs[i], docs[j]), max(docs[i], docs[j])) in pairs for i, j in alike if few[i] <= lsh_forest.FEW)
    second = list(lsh_forest._neighbours(least, second=True)(iter(_batches(keys, docs, bits, size))))
    listed, crowd = set(_seen(second, lsh_forest.PAIR)), {a for a, _ in _seen(second, lsh_forest.CROWD)}
    assert all((min(docs[i], docs[j]), max(docs[i], docs[j])) in listed or {docs[i], docs[j]} <= crowd for i, j in alike)


@pytest.mark.parametrize("cuts", [[], [10], [100, 150], [40, 41, 199]])
def test_regions_across_partitions(monkeypatch, cuts):
    """Regions cut by a partition bound are compared as a whole; dense ones are named with all their documents."""
    monkeypatch.setattr(lsh_forest, "REGION", 40)
    monkeypatch.setattr(lsh_forest, "OVERLAP", 10)
    for regions, dense in ((1, True), (12, False)):
        keys, docs, bits, region = _tree(200, regions, seed=regions, like=0.97)
        least, bounds = lsh_forest.least_bits(0.6), [0, *cuts, 200]
        seen = [x for a, b in zip(bounds, bounds[1:], strict=False) for x in lsh_forest._neighbours(least, edges=True)(iter(_batches(keys[a:b], docs[a:b], bits[a:b], 13)))]
        edge = pa.Table.from_batches(seen).to_pandas()
        edge = edge[edge.kind.isin([lsh_forest.EDGE, lsh_forest.DENSE])].sort_values(["key", "a"], na_position="first")
        batch = pa.RecordBatch.from_arrays([pa.array(edge.key, pa.binary()), pa.array(edge.a, pa.int64(), from_pandas=True), pa.array(edge["bits"], pa.binary()), pa.array(edge.a, pa.int64(), from_pandas=True)], names=["key", "doc", "bits", "part"])
        out = seen + list(lsh_forest._neighbours(least)(iter([batch])))
        crowd = {a for a, _ in _seen(out, lsh_forest.CROWD)}
        assert crowd == (set(docs.tolist()) if dense else set())
        assert bool(_seen(out, lsh_forest.DENSE)) == dense
        found = _groups(_seen(out, lsh_forest.PAIR), docs)
        assert regions <= len({found[d] for d in docs.tolist()}) <= (len(bounds) - 1 if dense else regions)
        assert len(set(_seen(out, lsh_forest.PAIR))) < 200 * 12


def test_dense_regions_lose_no_link(spark, monkeypatch):
    """A crowd at 0.55 with pairs planted just above 0.8, most of it in regions that are too dense to compare."""
    monkeypatch.setattr(lsh_forest, "REGION", 64)
    monkeypatch.setattr(lsh_forest, "OVERLAP", 16)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(base + [f"x{i}_{j}" for j in range(34)])) for i in range(600)]
    docs += [(600 + i, " ".join(base + [f"x{i}_{j}" for j in range(23)] + [f"y{i}_{j}" for j in range(11)])) for i in range(300)]
    got = lsh_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), k=2)
    same(got, brute.near(docs))
    assert got.where("kept").count() == 600


def test_links_far_apart_in_a_dense_region(spark):
    """Pairs at 0.808 whose ends lie far apart in every order of a crowd at 0.794."""
    base = [f"w{i}" for i in range(101)]
    docs = [(i, " ".join(base + [f"x{i}_{j}" for j in range(13)])) for i in range(6000)]
    docs += [(6000 + i, " ".join(base + [f"x{i}_0"] + [f"y{i}_{j}" for j in range(12)])) for i in range(100)]
    got = lsh_forest.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), k=2)
    same(got.select("doc_id", "component_id"), [(i, i % 6000) for i, _ in docs])


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_exact_links_join_what_brute_force_joins(spark, percent, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 7)
    rng = random.Random(percent)
    sets = []
    for i in range(150):
        n = rng.randint(1, 40)
        sets.append((i, i // 2 * 2 if i < 40 else i, 1, rng.sample(range(60), n) if i % 3 else sorted(set(range(30)) - set(rng.sample(range(30), 3)))))
    got = {tuple(r) for r in set_join.exact_links(spark.createDataFrame(sets, "doc long, part long, mass long, shingles array<long>"), percent).collect()}
    want = {(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and a[1] != b[1] and 100 * len(set(a[3]) & set(b[3])) >= percent * len(set(a[3]) | set(b[3]))}
    assert {(min(x), max(x)) for x in got} <= want

    def closed(links):
        part = {x[0]: x[1] for x in sets}
        for a, b in links:
            old, new = part[b], part[a]
            part = {k: new if v == old else v for k, v in part.items()}
        groups = defaultdict(set)
        for k, v in part.items():
            groups[v].add(k)
        return sorted(map(sorted, groups.values()))

    assert closed(got) == closed(want)


def test_near_duplicate_cases(odd, nothing):
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in lsh_forest.near_duplicates(odd, k=2).collect())
    assert got == [("1", "1", True)] * 3 + [("2", "1", False), ("3", "3", True)] + [("None", "None", True)] * 2
    kept = lsh_forest.drop_near_duplicates(odd, k=2)
    assert kept.count() == 6 and kept.columns == odd.columns
    assert lsh_forest.near_duplicates(nothing).count() == 0


def test_many_rows_without_an_id_stay_as_many(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("text of"), "id").alias("text"), F.lit(1).alias("_n"))
    table = rows.unionByName(spark.createDataFrame([(5, "text of 5", 0), (5, "other text", 0)], "doc_id long, text string, _n int"))
    got = lsh_forest.near_duplicates(table, k=2)
    assert got.count() == 20_002 and got.where("kept and component_id is null").count() == 20_000


# ---------------------------------------------------------------- very long texts
def test_very_long_texts(spark):
    """Texts well beyond a slice, one of them a single word, among short ones."""
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 9999)}" + ("\n" if i % 40 == 0 else "") for i in range(500_000)]
    passage = " ".join(words[250_000:250_060])
    docs = [(0, " ".join(words)), (1, f"before {passage} after"), (2, "x" * 3_000_000), (3, "a short text"), (4, " ".join(words) + " tail"), (5, " ".join(words[:100_000]))]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    same(line_dedup.dedup_lines(table).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)), brute.lines(docs))
    same(substring_dedup.dedup_substrings(table).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)), brute.substrings(docs))
    same(lsh_forest.near_duplicates(table, k=2), brute.near(docs))
    item = spark.createDataFrame([(1, passage)], "item_id long, text string")
    for size in (128 << 20, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_contamination(table, item, broadcast_bytes=size, keep_text=False).collect()}
        assert got == {i: (n, hit, [1] if bad else []) for i, n, hit, _, _, bad in brute.contamination(docs, [(1, passage)])}
    measured = {r.doc_id: r for r in quality.quality(table, keep_text=False).collect()}
    assert [(i, measured[i].n_words, measured[i].word_chars) for i, *_ in docs] == [x[:3] for x in brute.quality_base(docs)]
    tokens = {r.doc_id: r.n for r in token_counts.section_tokens(table).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    packed = {r.doc_id: r.n for r in packing.pack(table).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert all(tokens[i] == measured[i].n_tokens == packed[i] - 1 for i, _ in docs)
    assert licenses.scan_licenses(table).where("n_licenses = 0").count() == len(docs)


# ---------------------------------------------------------------- 10 token counts
@pytest.mark.parametrize("rule", ["first", "most"])
def test_section_tokens(spark, corpus, documents, rule):
    """Every token of every document by hand."""
    encoding = bpe.encoder(bpe.vocabulary()).encoding
    want = {}
    for doc, text in corpus:
        text = text or ""
        spans, at = [], 0
        for line in text.split("\n"):
            end = at + len(line.encode()) + 1
            spans.append((at, end))
            at = end
        spans[-1] = (spans[-1][0], len(text.encode()))
        counts, at, ids = [0] * len(spans), 0, encoding.encode_ordinary(text)
        for i in ids:
            end = at + len(encoding.decode_single_token_bytes(i))
            share = [min(end, e) - max(at, s) for s, e in spans]
            own = next(k for k, (s, e) in enumerate(spans) if s <= at < e) if rule == "first" else share.index(max(share))
            counts[own] += 1
            at = end
        for k, (s, e) in enumerate(spans):
            want[doc, k] = (len(text.encode()[:s].decode()), len(text.encode()[:e].decode()), counts[k], len(ids))
    got = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens, r.doc_tokens) for r in token_counts.section_tokens(documents, rule).collect()}
    assert got == want


def test_given_sections(spark):
    t = spark.createDataFrame([(1, "Hello worldwide web", [(0, 3), (3, 12)]), (2, None, None), (3, "abc", [])], "doc_id long, text string, sections array<struct<start:int,end:int>>")
    got = sorted((r.doc_id, r.section, r.n_tokens, r.n_crossing) for r in token_counts.section_tokens(t, "most", "sections").collect())
    by = defaultdict(int)
    for doc, _, n, _ in got:
        by[doc] += n
    ids = bpe.encoder(bpe.vocabulary()).encoding.encode_ordinary
    assert by == {1: len(ids("Hello worldwide web")), 3: len(ids("abc"))}
    assert any(c for _, _, _, c in got)
    with pytest.raises(ValueError):
        token_counts.section_tokens(t, "other")


def test_token_count_cases(odd, nothing):
    got = token_counts.section_tokens(odd)
    assert got.count() == 2 * 5 + 2 and token_counts.section_tokens(nothing).count() == 0
