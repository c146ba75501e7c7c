"""Who holds a key first: range partitions, secondary sort, one streaming pass.

Rows (k1, k2, doc, tag) are range-partitioned and sorted by all four, so that Spark can cut even one
very frequent key into several partitions. A task streams its rows with a state of one run. What a
task can't know - whether its first run began in an earlier partition - is settled afterwards
against one row per partition (the last run of each), which is all that is broadcast.

The partitions are blocks of an index of everything that is held: for each later row the block also
names a reference, the row of a smaller doc that holds the key first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.storage import stored

#: Kinds of rows that the pass emits.
LATER, PENDING, EDGE, BRANCH = 0, 1, 2, 3
SCHEMA = "kind tinyint, k1 long, k2 long, doc long, tag long, ref_doc long, ref_tag long"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def _batch(kind: int, k1, k2, doc, tag, ref_doc=None, ref_tag=None) -> pa.RecordBatch:
    n = len(doc)
    full = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (k1, k2, doc, tag, ref_doc, ref_tag)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *full], names=_COLUMNS)


def _stream(batches: Iterator[pa.RecordBatch], branches: bool, refs: bool) -> Iterator[pa.RecordBatch]:
    """LATER: held by a smaller doc in this partition. PENDING: first holders of the partition's
    first run. EDGE: the last run. BRANCH: first holders of a (k1, k2) whose k1 has another k2."""
    last: tuple[int, int, int, int] | None = None  # k1, k2, first doc and its tag of the open run
    opening = True  # still in the partition's first run
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        n = len(doc)
        new1, new = np.ones(n, bool), np.ones(n, bool)
        new1[1:] = k1[1:] != k1[:-1]
        new[1:] = new1[1:] | (k2[1:] != k2[:-1])
        if last is not None:
            new1[0] = last[0] != k1[0]
            new[0] = new1[0] or last[1] != k2[0]
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first = np.where(at >= 0, doc[at], last[2] if last is not None else 0)
        first_tag = np.where(at >= 0, tag[at], last[3] if last is not None else 0)
        later = doc > first
        if last is None:
            new[0] = False  # the first run isn't known to begin here
        in_first = (np.cumsum(new) == 0) if opening else np.zeros(n, bool)
        opening = opening and bool(in_first.all())
        if later.any():
            reference = (first[later], first_tag[later]) if refs else ()
            yield _batch(LATER, None, None, doc[later], tag[later], *reference)
        wait = ~later & in_first
        if wait.any():
            yield _batch(PENDING, k1[wait], k2[wait], doc[wait], tag[wait])
        if branches:
            group = np.cumsum(new1)
            further = new & ~new1
            further[0] = further[0] and last is not None
            several = np.bincount(group, further, group[-1] + 1) > 0
            several[[group[0], group[-1]]] = True  # cut by the batch: counted among them, which costs little
            out = ~later & ~in_first & several[group]
            if out.any():
                yield _batch(BRANCH, k1[out], k2[out], doc[out], tag[out])
        last = (int(k1[-1]), int(k2[-1]), int(first[-1]), int(first_tag[-1]))
    if last is not None:
        yield _batch(EDGE, [last[0]], [last[1]], [last[2]], [last[3]])


def first_holders(rows: DataFrame, branches: bool = False, refs: bool = False, name: str = "holders") -> tuple[DataFrame, DataFrame | None]:
    """rows: k1, k2, doc, tag (longs, no nulls).

    Returns (doc, tag) of all rows whose (k1, k2) a smaller doc holds too, with `refs` also (ref_doc,
    ref_tag) of a row of a smaller doc that holds it; and, with `branches`, (k1, k2, doc, tag) of first
    holders in groups of one k1 with several k2 (a few others may be among them: groups at the edge of
    an Arrow batch or partition).
    """
    keys = ["k1", "k2", "doc", "tag"]
    ordered = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    seen = stored(ordered.mapInArrow(lambda it: _stream(it, branches, refs), SCHEMA), name)
    began = F.min(F.struct("doc", "tag")).alias("began")
    edges = seen.where(F.col("kind") == EDGE).groupBy("k1", "k2").agg(began)
    # one row per partition at most: bounded by the partitioning, not by the rows
    waiting = seen.where(F.col("kind") == PENDING).drop("ref_doc", "ref_tag").join(F.broadcast(edges), ["k1", "k2"], "left")
    settled = F.coalesce(F.col("began.doc") < F.col("doc"), F.lit(False))
    named = ("doc", "tag", "ref_doc", "ref_tag") if refs else ("doc", "tag")
    late = waiting.where(settled).select("doc", "tag", F.col("began.doc").alias("ref_doc"), F.col("began.tag").alias("ref_tag"))
    later = seen.where(F.col("kind") == LATER).select(*named).unionByName(late.select(*named))
    if not branches:
        return later, None
    first = seen.where(F.col("kind") == BRANCH).select(*keys).unionByName(waiting.where(~settled).select(*keys))
    return later, first
