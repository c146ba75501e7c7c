"""Benchmark decontamination: a broadcast hash set of test windows, scanned against token windows.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A window is `n`
consecutive words of an item, or the whole item if it has fewer (but not none). A document word
inside any occurrence of a window is hit. Hash hits are verified word by word.

The windows are broadcast as flat arrays while these stay below `broadcast_bytes`, which is reckoned from
the benchmark's bytes and words before anything is gathered. A larger benchmark is matched by a shuffled
join of window hashes; its hits are verified in the same way, and the result is the same.

Defined cases: null or empty texts have no words and no hits; items without item_id or without words
match nothing; repeated items count once; rows are judged each by itself, so repeated or null
doc_ids do no harm on the broadcast path and are told apart by text hash on the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import ALNUM, covered, sequence_hashes, slices, words_of
from cadenza.storage import stored

RESULT = "_cz_found struct<n_words:bigint,n_hit:bigint,items:array<bigint>,spans:array<struct<start:int,end:int>>>"


#: Bytes that a window takes in the broadcast arrays: hash, bounds of its words, bounds and ids of its items.
WINDOW_BYTES = 40


class _Windows:
    """Test windows by length, as flat arrays: sorted hashes, where the words of each stand in one buffer of
    normalised text, and its items."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        texts = [(text or "").encode() for _, text in items]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        w = words_of(np.frombuffer(b"".join(texts), np.uint8), bounds, ALNUM)
        # the words with one blank behind each
        size = w.ends - w.starts + 1
        self.starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        place = np.arange(self.starts[-1]) - np.repeat(self.starts[:-1] - w.starts, size)
        words = np.append(w.data, np.uint8(32))[np.minimum(place, len(w.data))]
        words[self.starts[1:] - 1] = 32
        self.words = words.tobytes()
        ids = np.array([item for item, _ in items], np.int64)
        one, two, counts = w.hashes(0), w.hashes(1), w.counts
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(n, int(c)) for c in counts if c}):
            own = counts[w.row[: max(0, len(one) - k + 1)]]
            at = np.flatnonzero(w.whole(k) & ((own >= k) if k == n else (own == k)))
            h1, h2 = sequence_hashes(one, k)[at], sequence_hashes(two, k, 1)[at]
            order = np.lexsort((ids[w.row[at]], h2, h1))
            h1, h2, at = h1[order], h2[order], at[order]
            new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            item, group = ids[w.row[at]], np.cumsum(new) - 1
            fresh = new | np.append(True, item[1:] != item[:-1])  # an item once for each window
            first = np.append(np.searchsorted(group[fresh], np.arange(int(new.sum()))), int(fresh.sum()))
            self.by_length[k] = (h1[new], at[new], first, item[fresh])

    def items_of(self, k: int, h: int, place: int, words: bytes) -> np.ndarray:
        """Items with the window of these words; place: the first of the hash."""
        hashes, at, first, item = self.by_length[k]
        while place < len(hashes) and hashes[place] == h:
            if self.words[self.starts[at[place]] : self.starts[at[place] + k] - 1] == words:
                return item[first[place] : first[place + 1]]
            place += 1
        return item[:0]


def _sequence(w, i: int, k: int) -> bytes:
    return b" ".join(w.data[w.starts[j] : w.ends[j]].tobytes() for j in range(i, i + k))


def _scan(windows: _Windows, text: pa.Array) -> pa.Array:
    n_words, n_hit, items, spans = [], [], [], []
    for at, to, data, bounds in slices(text):
        w = words_of(data, bounds, ALNUM)
        codes = w.hashes()
        hit = np.zeros(len(codes), bool)
        of: dict[int, set[int]] = {}
        for k, (sorted_hashes, *_) in windows.by_length.items():
            h = sequence_hashes(codes, k)
            if not len(h):
                continue
            place = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
            starts = np.zeros(len(h), bool)
            for i in np.flatnonzero((sorted_hashes[place] == h) & w.whole(k)).tolist():
                found = windows.items_of(k, h[i], int(place[i]), _sequence(w, i, k))
                if len(found):
                    starts[i] = True
                    of.setdefault(int(w.row[i]), set()).update(found.tolist())
            if starts.any():
                hit |= covered(starts, k)
        n_words += w.counts.tolist()
        n_hit += np.bincount(w.row, hit, to - at).astype(np.int64).tolist()
        # runs of hit words in one row, as characters of the row's text
        run = hit & np.concatenate([[True], ~hit[:-1] | (w.row[1:] != w.row[:-1])]) if len(hit) else hit
        stop = hit & np.concatenate([~hit[1:] | (w.row[1:] != w.row[:-1]), [True]]) if len(hit) else hit
        by_row: dict[int, list] = {}
        if run.any():
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            for i, j in zip(np.flatnonzero(run).tolist(), np.flatnonzero(stop).tolist(), strict=True):
                base = chars[bounds[w.row[i]]]
                by_row.setdefault(int(w.row[i]), []).append({"start": int(chars[w.starts[i]] - base), "end": int(chars[w.ends[j]] - base)})
        items += [sorted(of.get(r, ())) for r in range(to - at)]
        spans += [by_row.get(r, []) for r in range(to - at)]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(span))], names=["n_words", "n_hit", "items", "spans"]
    )


def _with(batch: pa.RecordBatch, found: pa.Array, drop: set[str]) -> pa.RecordBatch:
    keep = [i for i, name in enumerate(batch.schema.names) if name not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), found], names=[*(batch.schema.names[i] for i in keep), "_cz_found"])


_WINDOW = "k int, h1 long, h2 long, place int"


def _windows_of(n: int, words: bool = False):
    """Window hashes of each row, for the shuffled join: (k, h1, h2, place), and the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in slices(batch.column(1)):
                w = words_of(data, bounds, ALNUM)
                one, two = w.hashes(0), w.hashes(1)
                key = batch.column(0).slice(at, to - at)
                lengths = batch.column(2)[0].as_py() if batch.num_columns > 2 else None
                for k in lengths or sorted({min(n, int(c)) for c in w.counts if c}):
                    h1, h2, whole = sequence_hashes(one, k), sequence_hashes(two, k, 1), w.whole(k)
                    if lengths is None and k < n:
                        whole &= w.counts[w.row[: len(whole)]] == k
                    elif lengths is None:
                        whole &= w.counts[w.row[: len(whole)]] >= k
                    i = np.flatnonzero(whole)
                    place = (i - w.first[w.row[i]]).astype(np.int32)
                    made = [key.take(pa.array(w.row[i])), np.full(len(i), k, np.int32), h1[i].view(np.int64), h2[i].view(np.int64), place]
                    made += [pa.array([_sequence(w, x, k) for x in i.tolist()], pa.binary())] if words else []
                    names = ["key", "k", "h1", "h2", "place", *(("words",) if words else ())]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=names)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = 128 << 20, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_hit, items (sorted item_ids) and spans (characters of hit runs, end
    exclusive); keep_text=False leaves the text itself out of the result."""
    known = F.col("item_id").isNotNull() & F.col("text").isNotNull()
    tests = benchmark.where(known).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    out = ["n_words", "n_hit", "items", "spans"]
    own = [c for c in docs.columns if c not in out and (keep_text or c != "text")]
    read = [*own, *(() if keep_text else ("text",))]
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    size = tests.agg(F.coalesce(F.sum(2 * F.octet_length("text") + WINDOW_BYTES * words), F.lit(0)).alias("b")).first()["b"]
    if size > broadcast_bytes:
        return _by_join(docs, tests, n, own)
    windows = docs.sparkSession.sparkContext.broadcast(_Windows([(r.item_id, r.text) for r in tests.collect()], n))
    schema = T.StructType([docs.schema[c] for c in own]).add("_cz_found", T._parse_datatype_string(RESULT.removeprefix("_cz_found ")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with(batch, _scan(windows.value, batch.column(batch.schema.get_field_index("text"))), set() if keep_text else {"text"})

    found = docs.select(*read).mapInArrow(scan, schema)
    return found.select(*own, *(F.col(f"_cz_found.{c}").alias(c) for c in out))


def _words_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text at its hits (window, place, k)."""
    for batch in batches:
        found: list[tuple] = []
        for key, text, hits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            w = words_of(data, np.array([0, len(data)]), ALNUM)
            found += [(key, x["window"], x["place"], x["k"], _sequence(w, x["place"], x["k"])) for x in hits]
        columns = list(zip(*found, strict=True)) or [[], [], [], [], []]
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["key", "window", "place", "k", "words"])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts and spans of each text from the places of its hits."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", span)])
    for batch in batches:
        found = []
        texts, places = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_cz_text", "_cz_at"))
        for text, at in zip(texts, places, strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            w = words_of(raw, np.array([0, len(raw)]), ALNUM)
            hit = np.zeros(len(w.starts), bool)
            for x in at or ():
                hit[x["place"] : x["place"] + x["k"]] = True
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            runs = zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)
            own = [{"start": int(chars[w.starts[i]]), "end": int(chars[w.ends[j - 1]])} for i, j in runs]
            found.append({"n_words": len(hit), "n_hit": int(hit.sum()), "items": [], "spans": own})
        yield _with(batch, pa.array(found, kind), {"_cz_text", "_cz_at"})


def _by_join(docs: DataFrame, tests: DataFrame, n: int, own: list[str]) -> DataFrame:
    """The same by a shuffled join on 128 bits of window hash; nothing is broadcast.

    Equal texts are looked at once; a text is known by its SHA-256, which tells all texts apart. Hits carry the
    number of their window; a text's own words at its hits then meet the window's words, row by row, so that no
    group holds more than a few numbers for each word of one text.
    """
    held = tests.select(F.col("item_id").alias("key"), "text").mapInArrow(_windows_of(n, words=True), f"key long, {_WINDOW}, words binary")
    window = F.unhex(F.md5("words")).alias("window")
    by_words = held.select("k", "h1", "h2", "words", window, F.col("key").alias("item"))
    windows = by_words.select("k", "h1", "h2", "words", "window").distinct()
    lengths = sorted(r.k for r in held.select("k").distinct().collect())  # n at most
    row = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = docs.select(row.alias("row"), F.col("text")).where(F.col("text").isNotNull()).dropDuplicates(["row"])
    given = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    seen = texts.select("row", "text", given.alias("lengths")).mapInArrow(_windows_of(n), f"key binary, {_WINDOW}")
    hit = F.struct("window", "place", "k")
    hits = seen.join(windows.select("k", "h1", "h2", "window"), ["k", "h1", "h2"]).groupBy("key").agg(F.collect_set(hit).alias("hits"))
    checked = texts.join(hits, F.col("row") == F.col("key")).select("key", "text", "hits")
    there = checked.mapInArrow(_words_at, "key binary, window binary, place int, k int, words binary")
    true = stored(there.join(windows.select("window", "words"), ["window", "words"], "left_semi").drop("words"), "hits")
    # the items of a window are told apart from its occurrences: a frequent one is listed once a text
    items = true.select("key", "window").distinct().join(by_words.select("window", "item").distinct(), "window").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    places = true.groupBy("key").agg(F.collect_set(F.struct("place", "k")).alias("_cz_at")).join(items, "key").withColumnRenamed("key", "_cz_key")
    left = docs.select(*own, F.col("text").alias("_cz_text"), row.alias("_cz_key"))
    joined = left.join(places, "_cz_key", "left").drop("_cz_key")
    found = T._parse_datatype_string(RESULT.removeprefix("_cz_found "))
    schema = T.StructType([docs.schema[c] for c in own]).add("items", T.ArrayType(T.LongType())).add("_cz_found", found)
    done = joined.select(*own, "items", "_cz_text", "_cz_at").mapInArrow(_spans, schema)
    counts = (F.col(f"_cz_found.{c}").alias(c) for c in ("n_words", "n_hit"))
    return done.select(*own, *counts, F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.col("_cz_found.spans").alias("spans"))


def remove_spans(text: str, spans: str):
    """The text without the characters of the spans."""
    start = F.concat(F.lit([0]), F.transform(spans, lambda s: s["end"]))
    stop = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    return F.array_join(F.transform(F.arrays_zip(start.alias("a"), stop.alias("b")), lambda p: F.substring(F.col(text), p["a"] + 1, p["b"] - p["a"])), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without their hit spans."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove!r}")
    marked = find_contamination(docs, benchmark, n)
    if remove == "documents":
        return marked.where("n_hit = 0").select(*docs.columns)
    return marked.withColumn("text", F.when(F.col("n_hit") > 0, remove_spans("text", "spans")).otherwise(F.col("text"))).select(*docs.columns)
