"""Line deduplication: range-partitioned key hashes, first occurrences streamed, keep bitmaps.

A line's key is the line stripped of blanks at both ends with A-Z lower-cased. A key of at least
`min_chars` code points that several documents hold keeps its lines only in the smallest doc_id.

Defined cases: a null or empty text is one empty line; a row without doc_id is returned whole and
takes no part; rows that repeat a doc_id count as one document (none drops the other's lines), each
keeps its own text; columns named like an output column are replaced; empty tables give empty ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import row_tag
from cadenza.llm.holders import first_holders
from cadenza.storage import dropped, stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_rows(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row (k1, k2, doc, tag) for each line that can be a duplicate; tag: text hash and place."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc"), row_tag(F.col("text")).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    )
    key = F.translate(F.btrim("line", F.lit(BLANKS)), UPPER, LOWER)
    return lines.withColumn("key", key).where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(0x5BD1E995), "key").alias("k2"), "doc", (F.shiftleft("row", 32) + F.col("pos")).alias("tag")
    )


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for places in batch.column(2).to_pylist():
            bits = np.ones((max(places) | 7) + 1, bool)
            bits[places] = False
            out.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc", "row", "keep"])


def line_keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc, row, keep) of the documents that lose lines. keep: zlib of packed bits, one per line,
    1 to keep; lines past its end are kept. row: hash of the text, for repeated doc_ids."""
    # stored: cutting ranges reads the rows twice, and they are far narrower than the texts
    rows = stored(line_rows(docs, min_chars), "line_keys")
    later, _ = first_holders(rows, name="lines")
    dropped(rows)
    by_row = later.groupBy("doc", F.shiftright("tag", 32).alias("row")).agg(F.collect_list(F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF))).alias("places"))
    return by_row.mapInArrow(_bitmaps, "doc long, row long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index
        texts, bitmaps = batch.column(at("_cz_text")).to_pylist(), batch.column(at("_cz_keep")).to_pylist()
        kept, n_lines, n_dropped = [], [], []
        for text, bitmap in zip(texts, bitmaps, strict=True):
            text = text or ""
            n, dropped = text.count("\n") + 1, 0
            if bitmap is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
                lines = text.split("\n")
                dropped = int(len(bits) - bits.sum())
                text = "\n".join([x for x, keep in zip(lines, bits, strict=False) if keep] + lines[len(bits) :])
            kept.append(text)
            n_lines.append(n)
            n_dropped.append(dropped)
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if not name.startswith("_cz_")]
        names = [name for name in batch.schema.names if not name.startswith("_cz_")]
        made = [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays([*rest, *made], names=[*names, "text", "n_lines", "n_dropped"])


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents without the lines that the bitmaps drop, with n_lines and n_dropped."""
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    left = docs.select(*own, F.col("doc_id").cast("long").alias("_cz_doc"), row_tag(F.col("text")).alias("_cz_row"), F.col("text").alias("_cz_text"))
    marks = bitmaps.select(F.col("doc").alias("_cz_doc"), F.col("row").alias("_cz_row"), F.col("keep").alias("_cz_keep"))
    joined = left.join(marks, ["_cz_doc", "_cz_row"], "left").select(*own, "_cz_text", "_cz_keep")
    schema = T.StructType([docs.schema[c] for c in own]).add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(_apply, schema)


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    return drop_lines(docs, line_keep_bitmaps(docs, min_chars))
