"""Substring deduplication by relative Lempel-Ziv factors over a partitioned reference index.

Every document is reference text for the documents with larger ids. The reference index holds segments
of documents with their positions: the 13-word windows of a text are cut into segments at content-defined
anchors (consecutive windows with the same smallest 6-word seed), and range partitions by seed and
segment are the index's blocks. Each document is parsed against all blocks:

* a segment that a smaller document holds word for word is a copy of the words at the first such
  position; a factor is grown greedily from it by every following segment that continues at the same
  place of the same reference document;
* at the ends of factors a document's segment differs from the reference's but shares its seed. There
  the windows across the factor's boundary are looked up one by one in an index of windows, and extend
  the factor or make one of their own.

A factor is (start, length, ref_doc, ref_start), 13 words or more; factors of different references may
overlap by less than a window. Windows are compared by 128 bits of hash. Each window is in a factor if
and only if its word sequence starts in a document with a smaller doc_id; the words that factors cover
are removed. Windows are judged on the input.

Defined cases: null and empty texts have no words; a row without doc_id loses nothing and is no
reference; rows that repeat a doc_id count as one document (never a smaller one of each other);
columns named like an output column are replaced; a text of 2**26 words or more is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import PLAIN, range_hashes, row_tag, sequence_hashes, slices, words_of
from cadenza.llm.holders import first_holders

SEED = 6
_KEYS = "k1 long, k2 long, doc long, tag long"


def _tags(row: np.ndarray, place: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Row hash, word place and number of further windows in one long."""
    if len(place) and place.max() >= 1 << 26:
        raise ValueError("a document has more than 2**26 words")
    return (row << 32) | (place << 6) | more


def segments(codes: np.ndarray, second: np.ndarray, whole: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(k1, k2, start, windows) of the segments of a slice. whole: windows that lie in one row."""
    if not whole.any():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    seeds = sequence_hashes(codes, SEED)
    span = window - SEED + 1
    anchor = np.arange(len(whole)) + sliding_window_view(seeds, span).argmin(axis=1)
    start = whole.copy()
    start[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (row[1 : len(whole)] != row[: len(whole) - 1])
    at = np.flatnonzero(start)
    stop = np.flatnonzero(whole & ~np.concatenate([whole[1:] & ~start[1:], [False]]))
    k2 = range_hashes(second, at, stop + window, 1) ^ (anchor[at] - at).astype(np.uint64)
    return seeds[anchor[at]], k2, at, stop - at + 1


def _segment_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, _, data, bounds in slices(batch.column(2)):
                w = words_of(data, bounds, PLAIN)
                k1, k2, start, n = segments(w.hashes(0), w.hashes(1), w.whole(window), w.row, window)
                row = w.row[start]
                yield _rows(k1, k2, doc[at + row], _tags(tag[at + row], start - w.first[row], n - 1))

    return run


def _rows(k1, k2, doc, tag) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k1.view(np.int64), k2.view(np.int64), doc, tag)], names=["k1", "k2", "doc", "tag"])


def _ranges(tags: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    start = (tags & 0xFFFFFFFF) >> 6
    return start, (tags & 63) + 1


def _window_rows(window: int):
    """The single windows of listed segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            listed = batch.column(3)
            sizes = np.asarray(listed.value_lengths())
            flat, ends = listed.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for at, to, data, bounds in slices(batch.column(2)):
                w = words_of(data, bounds, PLAIN)
                h1, h2 = sequence_hashes(w.hashes(0), window), sequence_hashes(w.hashes(1), window, 1)
                mine = flat[ends[at] - sizes[at] : ends[to - 1]]
                row = np.repeat(np.arange(to - at), sizes[at:to])
                start, n = _ranges(mine, window)
                row, place = np.repeat(row, n), np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i = w.first[row] + place
                yield _rows(h1[i], h2[i], doc[at + row], _tags(tag[at + row], place, np.zeros(len(place), np.int64)))

    return run


def grown(places: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(start, length, ref_doc, ref_start) of the factors that a document's copies grow to, in order."""
    start, n = _ranges(places, window)
    order = np.lexsort((ref_start, ref_doc, start))
    start, n, ref_doc, ref_start = (x[order] for x in (start, n, ref_doc, ref_start))
    new = np.ones(len(start), bool)
    on = (start[1:] == start[:-1] + n[:-1]) & (ref_doc[1:] == ref_doc[:-1]) & (ref_start[1:] - start[1:] == ref_start[:-1] - start[:-1])
    new[1:] = ~on
    first = np.flatnonzero(new)
    length = np.add.reduceat(n, first) + window - 1 if len(first) else n
    return start[first], length, ref_doc[first], ref_start[first]


def _copies_of(listed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of the rows of a list column of copies, and the copies' fields."""
    sizes = np.nan_to_num(np.asarray(listed.value_lengths().fill_null(0)).astype(np.int64))
    flat = listed.flatten()
    fields = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    return np.concatenate([[0], np.cumsum(sizes)]), *fields


def _factor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, places, ref_doc, ref_start = _copies_of(batch.column(1))
            parts = [grown(places[a:b], ref_doc[a:b], ref_start[a:b], window) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            row = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
            columns = [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", "start", "length", "ref_doc", "ref_start"])

    return run


def _remove(window: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, listed = (batch.column(batch.schema.get_field_index(c)) for c in ("_cz_text", "_cz_copies"))
            rows, places, ref_doc, ref_start = _copies_of(listed)
            n_words, n_removed, kept = [], [], []
            for at, to, data, bounds in slices(text):
                w = words_of(data, bounds, PLAIN)
                n_words += w.counts.tolist()
                for r in range(at, to):
                    words = data[bounds[r - at] : bounds[r - at + 1]].tobytes().split()
                    a, b = rows[r : r + 2]
                    start, length, *_ = grown(places[a:b], ref_doc[a:b], ref_start[a:b], window)
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + length, -1)
                    gone = np.cumsum(step)[:-1] > 0
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([x for x, out in zip(words, gone.tolist(), strict=True) if not out] if n_removed[-1] else words).decode())
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*keep, "text", "n_words", "n_removed"])

    return run


def _copies(docs: DataFrame, window: int) -> DataFrame:
    """doc, row (hash of the text) and copies: what segments and boundary windows copy from where."""
    if not SEED < window <= 64:
        raise ValueError(f"window: {SEED + 1} to 64 words")
    doc, row = F.col("doc_id").cast("long"), row_tag(F.col("text"))
    texts = docs.where(F.col("doc_id").isNotNull()).select(doc.alias("doc"), row.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    later, first = first_holders(texts.mapInArrow(_segment_rows(window), _KEYS), branches=True, refs=True, name="segments")
    low = lambda tag: F.col(tag).bitwiseAND(F.lit(0xFFFFFFFF))
    # what stands at a boundary: segments that share a seed with others
    listed = first.groupBy("doc", F.shiftright("tag", 32).alias("row")).agg(F.collect_set(low("tag")).alias("places"))
    cut = texts.join(listed, ["doc", "row"]).select("doc", "row", "text", "places").dropDuplicates(["doc", "row"])
    windows, _ = first_holders(cut.mapInArrow(_window_rows(window), _KEYS), refs=True, name="windows")
    copy = F.struct(low("tag").alias("place"), "ref_doc", F.shiftright(low("ref_tag"), 6).alias("ref_start"))
    return later.unionByName(windows).groupBy("doc", F.shiftright("tag", 32).alias("row")).agg(F.collect_set(copy).alias("copies"))


def factors(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, start, length, ref_doc, ref_start (words) of every factor."""
    schema = "doc_id long, start long, length long, ref_doc long, ref_start long"
    return _copies(docs, window).select("doc", "copies").mapInArrow(_factor_rows(window), schema)


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs with text (kept words joined by one space), n_words and n_removed."""
    own = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    copies = _copies(docs, window).select(F.col("doc").alias("_cz_doc"), F.col("row").alias("_cz_row"), F.col("copies").alias("_cz_copies"))
    left = docs.select(*own, F.col("doc_id").cast("long").alias("_cz_doc"), row_tag(F.col("text")).alias("_cz_row"), F.col("text").alias("_cz_text"))
    joined = left.join(copies, ["_cz_doc", "_cz_row"], "left")
    schema = T.StructType([docs.schema[c] for c in own]).add("text", "string").add("n_words", "long").add("n_removed", "long")
    return joined.select(*own, "_cz_text", "_cz_copies").mapInArrow(_remove(window, own), schema)
