"""Periodic runs of words inside a document, by seed and extend along diagonals.

A run of period q is a stretch of words in which words q apart are identical, so on the diagonal of lag q
it is a matching stretch of at least max(LEAST, TIMES * q) - q words. Lags are taken in classes
[Q, 3Q / 2]; the class's index holds the k-grams of k = max(LEAST - Q, (TIMES - 1) * Q) words, the overlap
that is guaranteed for every run of the class. As k is at least 2q, the next occurrence of a gram of a run
with smallest period q lies exactly q words on (two nearer ones would give the run a smaller period), so
only neighbouring occurrences in the same document are enumerated: a number of pairs that is linear in
the words, even for one word repeated all along. A pair seeds its lag's diagonal; a table of the furthest
word covered on each lag passes over seeds inside a stretch that is known; others are extended word by
word in both directions. Grams are compared exactly: a gram's rank is that of the pair of its two
overlapping shorter grams, and grams found once leave the index for all longer ones.

Each row is worked on by itself, in slices of whole texts: no shuffle.

Defined cases: null and empty texts have no words and no runs; rows that repeat a doc_id stand for
themselves; doc_id is not looked at; columns named like an output column are replaced. A text is never
split: one of n bytes takes some 60 n bytes of arrays in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cadenza.llm.common import PLAIN, Words, lists, slices, words_of

#: A run has at least LEAST words and at least TIMES periods.
LEAST, TIMES = 6, 4
RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
OUTPUTS = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]


def lag_classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least lag, greatest lag, k) of each class of lags that texts of `longest` words can have."""
    low = 1
    while TIMES * low <= longest:
        k = max(LEAST - low, (TIMES - 1) * low)
        high = max(low, min(k // 2, low * 3 // 2))
        yield low, high, k
        low = high + 1


def _word_codes(w: Words) -> np.ndarray:
    """A number of each word, equal for equal words: 128 bits tell words apart."""
    a, b = w.hashes(0), w.hashes(1)
    _, first, code = np.unique(a, return_index=True, return_inverse=True)
    if (b[first][code] != b).any():  # one hash for two words: tell them apart by both
        _, code = np.unique(np.stack([a, b]), axis=1, return_inverse=True)
    return code.astype(np.int64)


class _Grams:
    """The k-grams that occur twice or more in their row: places in order, and a rank equal for equal ones."""

    def __init__(self, n: int):
        self.rank = np.zeros(n, np.int64)  # 0: found once

    def index(self, at: np.ndarray, key: np.ndarray) -> None:
        """Rank the places `at` (ascending) by key; keep those whose key is found twice."""
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        group = np.cumsum(new)
        several = np.bincount(group, minlength=group[-1] + 1 if len(group) else 1)[group] > 1
        rank = np.zeros(len(self.rank), np.int64)
        rank[at[order[several]]] = group[several]
        self.rank, self.at = rank, np.sort(at[order[several]])
        places, same = at[order], ~new[1:]
        self.pairs = places[:-1][same], places[1:][same]  # neighbouring occurrences

    def longer(self, by: int) -> None:
        """From grams of k words to those of k + by (by <= k): the gram here and the one `by` words on."""
        at = self.at[self.at + by < len(self.rank)]
        at = at[self.rank[at + by] > 0]
        self.index(at, self.rank[at] * (len(self.rank) + 1) + self.rank[at + by])


def _extend(code: np.ndarray, start: int, end: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The whole stretch around [start, end) in which words `lag` apart are equal, in the row [low, high)."""
    while start > low and code[start - 1] == code[start - 1 + lag]:
        start -= 1
    while end + lag < high and code[end] == code[end + lag]:
        end += 1
    return start, end


def find_runs(code: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All runs (row, start, length, period), starts counted in the row, by row, start and period.

    code: a number per word, equal for equal words; row i holds the words first[i]:first[i + 1].
    """
    found: list[tuple[int, int, int, int]] = []
    grams, k_now = _Grams(len(code)), 1
    if len(code):
        grams.index(np.arange(len(code)), row * (int(code.max()) + 1) + code)
    longest = int(np.diff(first).max()) if len(first) > 1 else 0
    for low, high, k in lag_classes(longest):
        while k_now < k and len(grams.at):
            by = min(k_now, k - k_now)
            grams.longer(by)
            k_now += by
        if not len(grams.at):
            break
        here, there = grams.pairs
        lag = there - here
        fits = (lag >= low) & (lag <= high)
        here, lag = here[fits], lag[fits]
        if not len(here):
            continue
        order = np.lexsort((here, lag))
        here, lag = here[order], lag[order]
        head = np.ones(len(here), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + 1)  # others touch the seed before them
        begins = np.flatnonzero(head)
        ends = np.append(begins[1:], len(here)) - 1
        furthest: dict[int, int] = {}  # per lag, the first word behind the last stretch
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            q, at, until = int(lag[b]), int(here[b]), int(here[e]) + k
            if until <= furthest.get(q, 0):
                continue
            r = int(row[at])
            start, end = _extend(code, at, until, q, int(first[r]), int(first[r + 1]))
            furthest[q] = end
            if end - start + q >= max(LEAST, TIMES * q):
                found.append((r, start - int(first[r]), end - start + q, q))
    runs = np.array(found, np.int64).reshape(-1, 4)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _collapsed(w: Words, runs: np.ndarray) -> pa.Array:
    """The words of each row outside all runs but for a run's first period, joined by one space."""
    n_rows, n = len(w.first) - 1, len(w.row)
    step = np.zeros(n + 1, np.int64)
    begins = w.first[runs[:, 0]] + runs[:, 1]
    np.add.at(step, begins + runs[:, 3], 1)
    np.add.at(step, begins + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(step)[:n] == 0)
    lengths = w.ends[kept] - w.starts[kept] + 1  # with a space
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    out = w.data[np.minimum(np.repeat(w.starts[kept] - offsets[:-1], lengths) + np.arange(offsets[-1]), max(len(w.data) - 1, 0))]
    out[offsets[1:] - 1] = 0x20
    per_row = np.bincount(w.row[kept], minlength=n_rows)
    bounds = offsets[np.concatenate([[0], np.cumsum(per_row)])]
    last = np.flatnonzero(per_row)
    inner = np.delete(out, bounds[last + 1] - 1)  # no space behind a row's last word
    sizes = np.diff(bounds) - (per_row > 0)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n_rows, pa.py_buffer(ends), pa.py_buffer(inner)).cast(pa.string())


def _scan(batches: Iterator[pa.RecordBatch], others: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, bounds in slices(batch.column("text")):
            w = words_of(data, bounds, PLAIN)
            runs = find_runs(_word_codes(w), w.row, w.first)
            values = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], names=["start", "length", "period"])
            listed = lists(values, np.bincount(runs[:, 0], minlength=to - at))
            own = [pa.array(w.counts.astype(np.int64)), listed, _collapsed(w, runs)]
            columns = [batch.column(c).slice(at, to - at) for c in others] + own
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The columns of docs (text among them) and n_words, runs (start, length, period of each, by start and
    period; words counted from 0) and collapsed, the text without the repeats of its runs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    new = {f.name for f in OUTPUTS}
    kept = [c for c in docs.columns if c not in new]
    given = docs.select(*kept)
    schema = StructType([*given.schema.fields, *OUTPUTS])
    arrow = to_arrow_schema(schema)
    return given.mapInArrow(lambda batches: _scan(batches, kept, arrow), schema)
