"""Token counts of sections from one encoding of the whole document.

Each document is encoded once. Token lengths in bytes give the character span of every token; the
spans are interval-joined to the document's sections. A token that crosses a boundary goes to

* "first": the section that holds its first byte;
* "most": the section that holds most of its bytes, the earlier one if equal.

Bytes outside every section are counted under section -1 if a token is allotted there. The counts of
a document's sections always sum to its tokens.

Defined cases: a null or empty text is one empty section without tokens; rows are counted each by
itself, so repeated and null doc_ids are kept; further columns are left out; sections must be sorted
and may not overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.bpe import encoder, vocabulary
from cadenza.llm.common import slices

SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def line_sections(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) in bytes: each line with its newline is a section."""
    breaks = np.flatnonzero(data[: bounds[-1]] == 10) + 1
    inner = breaks[np.searchsorted(bounds, breaks, side="right") - 1 == np.searchsorted(bounds, breaks - 1, side="right") - 1] if len(breaks) else breaks
    tail = breaks[~np.isin(breaks, inner)]  # a newline that ends its row leaves an empty last line
    rows = len(bounds) - 1
    start = np.concatenate([bounds[:-1], inner, tail])
    of_tail = np.searchsorted(bounds, tail - 1, side="right") - 1
    row = np.concatenate([np.arange(rows), np.searchsorted(bounds, inner, side="right") - 1, of_tail])
    late = np.concatenate([np.zeros(rows + len(inner), bool), np.ones(len(tail), bool)])
    order = np.lexsort((late, start, row))
    start, row = start[order], row[order]
    last = np.append(row[1:] != row[:-1], True)
    return row, start, np.where(last, bounds[row + 1], np.append(start[1:], 0))


def allot(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none) and whether it crosses a boundary. Bytes of one buffer;
    empty sections hold nothing."""
    full = np.flatnonzero(end > start)
    if not len(full):
        return np.full(len(token_start), -1), np.zeros(len(token_start), bool)
    s, e = start[full], end[full]
    at = np.searchsorted(s, token_start, side="right") - 1
    inside = (at >= 0) & (token_start < e[np.maximum(at, 0)])
    crossing = ~inside | (token_end > e[np.maximum(at, 0)])
    out = np.where(inside, full[np.maximum(at, 0)], -1)
    if rule == "most":
        for i in np.flatnonzero(crossing).tolist():
            j = max(0, int(at[i]))
            best, most = -1, 0
            while j < len(s) and s[j] < token_end[i]:
                share = min(e[j], token_end[i]) - max(s[j], token_start[i])
                if share > most:
                    best, most = int(full[j]), share
                j += 1
            outside = (token_end[i] - token_start[i]) - sum(max(0, min(e[x], token_end[i]) - max(s[x], token_start[i])) for x in range(max(0, int(at[i])), j))
            out[i] = -1 if outside > most else best
    return out, crossing


def _count(path: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(2) if batch.num_columns > 2 else None
            for at, to, data, bounds in slices(batch.column(1)):
                enc = encoder(path)
                ids, first = enc.encode(data, bounds)
                size = enc.size[ids]
                token_end = np.cumsum(size)
                token_start = token_end - size
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                if given is None:
                    row, start, end = line_sections(data, bounds)
                else:
                    row, start, end = _given(given.slice(at, to - at), data, bounds)
                section, crossing = allot(token_start, token_end, start, end, rule)
                token_row = np.repeat(np.arange(to - at), np.diff(first))
                lost = section < 0
                outside = np.flatnonzero(np.bincount(token_row[lost], minlength=to - at))
                n = np.bincount(section[~lost], minlength=len(row))
                crossed = np.bincount(section[~lost], crossing[~lost], len(row)).astype(np.int64)
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                base = chars[bounds[:-1]]
                all_row = np.concatenate([row, outside])
                columns = [
                    batch.column(0).slice(at, to - at).take(pa.array(all_row)),
                    pa.array(np.concatenate([nth, np.full(len(outside), -1)]), pa.int64()),
                    pa.array(np.concatenate([chars[start] - base[row], np.zeros(len(outside), np.int64)]), pa.int64()),
                    pa.array(np.concatenate([chars[end] - base[row], np.zeros(len(outside), np.int64)]), pa.int64()),
                    pa.array(np.concatenate([n, np.bincount(token_row[lost], minlength=to - at)[outside]]), pa.int64()),
                    pa.array(np.concatenate([crossed, np.bincount(token_row[lost], crossing[lost], to - at)[outside].astype(np.int64)]), pa.int64()),
                    pa.array(np.diff(first)[all_row], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    return run


def _given(spans: pa.Array, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character spans of the rows as bytes of the buffer."""
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(lead, bounds[:-1])
    row, start, end = [], [], []
    for r, own in enumerate(spans.to_pylist()):
        for x in own or ():
            row.append(r), start.append(lead[first[r] + x["start"]]), end.append(lead[first[r] + x["end"]])
    return np.array(row, np.int64), np.array(start, np.int64), np.array(end, np.int64)


def section_tokens(docs: DataFrame, rule: str = "most", sections: str | None = None, vocab: str | None = None) -> DataFrame:
    """One row per section: doc_id, section (from 0), start, end (characters), n_tokens, n_crossing
    (boundary-crossing tokens among them), doc_tokens. sections: a column of sorted
    array<struct<start,end>> in characters; without it every line is a section."""
    if rule not in ("first", "most"):
        raise ValueError(f"rule: first or most, not {rule!r}")
    read = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *((F.col(sections),) if sections else ())]
    return docs.select(*read).mapInArrow(_count(vocab or vocabulary(), rule), SCHEMA)
