"""Quality rules: counts of words, signs and repeats, and the fertility of public tokenisers.

Base rules reject a document with fewer than 10 words, or in which over a fifth of the words lie in
five-word windows that occur twice or more. Fertility is measured with two byte-level vocabularies, one
made for English and one for many languages:

* chars_per_token, multi_chars_per_token: code points over tokens of either;
* fragment_share: share of the first's tokens that are bytes of a split character (its byte fallback);
* token_entropy: entropy of the first's tokens over its largest value for their number;
* sign_share: share of the first's tokens without a letter, digit or non-ASCII character.

A document is rejected outside the band of its language, or of its script if the language has none or is
written in another one; script is that of most of its letters. The languages' bands are those of
fit_bands() on the labelled documents of the test tables (scale 0.1, 3,330 good ones), rounded outwards;
the scripts' are wide, since no labelled document has them.

Defined cases: a null or empty text has no words and fails the base rules; its measures are null;
columns named like an output column are replaced; rows are judged each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.bpe import as_double, encoder, entropies, vocabulary
from cadenza.llm.common import PLAIN, covered, sequence_hashes, slices, span_hashes, sums, words_of


@dataclass(frozen=True)
class Band:
    """Accepted: least <= chars_per_token <= most, multi_least <= multi_chars_per_token <= multi_most,
    fragment_share <= fragments, token_entropy >= entropy, sign_share <= signs."""

    least: float
    most: float
    fragments: float
    entropy: float
    multi_least: float = 0.0
    multi_most: float = 1e9
    signs: float = 0.24


BANDS = {
    "en": Band(2.17, 3.06, 0.03, 0.51, 2.19, 3.06),
    "de": Band(1.91, 2.71, 0.10, 0.48, 1.91, 3.01),
    "es": Band(1.80, 2.52, 0.20, 0.49, 1.85, 2.71),
    "fr": Band(1.85, 2.66, 0.20, 0.46, 1.95, 2.78),
}
#: Scripts of the languages with a band.
WRITTEN = {"en": "latin", "de": "latin", "es": "latin", "fr": "latin"}
#: Scripts, and the first bytes of their letters in UTF-8 (from, to).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9)),
    "greek": ((0xCD, 0xCF),),
    "cyrillic": ((0xD0, 0xD4),),
    "semitic": ((0xD6, 0xDD),),
    "indic": ((0xE0, 0xE0),),
    "cjk": ((0xE3, 0xE9), (0xF0, 0xF0)),
    "hangul": ((0xEA, 0xED),),
    "other": ((0xCA, 0xCC), (0xD5, 0xD5), (0xDE, 0xDF), (0xE1, 0xE1), (0xEE, 0xEF)),
}
SCRIPT_BANDS = {
    "latin": Band(1.2, 7.0, 0.40, 0.40, 1.3, 7.5),
    "greek": Band(0.5, 3.0, 0.95, 0.35, 0.6, 5.0),
    "cyrillic": Band(0.5, 3.0, 0.95, 0.35, 0.8, 6.0),
    "semitic": Band(0.4, 3.0, 1.0, 0.35, 0.5, 5.0),
    "indic": Band(0.25, 2.0, 1.0, 0.25, 0.3, 4.0),
    "cjk": Band(0.25, 2.0, 1.0, 0.35, 0.3, 3.0),
    "hangul": Band(0.25, 2.0, 1.0, 0.35, 0.3, 3.0),
}
DEFAULT = Band(0.2, 8.0, 1.0, 0.3, 0.2, 8.0, 0.5)
SIGNS = b"#*$%&|<>"
WINDOW = 5
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "multi_tokens")
_SHARES = ("chars_per_token", "fragment_share", "token_entropy", "sign_share", "multi_chars_per_token")
MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS] + [T.StructField(c, T.DoubleType()) for c in _SHARES] + [T.StructField("script", T.StringType())])


def _script_of_bytes() -> np.ndarray:
    """The script (its place in SCRIPTS, from 1) of a letter's first byte, 0 for other bytes."""
    table = np.zeros(256, np.int64)
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for low, high in ranges:
            table[low : high + 1] = i
    return table


_SCRIPT = _script_of_bytes()


def scripts(data: np.ndarray, bounds: np.ndarray) -> list[str | None]:
    """The script of most letters of each row; none without a letter."""
    rows, n = len(bounds) - 1, len(SCRIPTS) + 1
    row = np.repeat(np.arange(rows), np.diff(bounds))
    counts = np.bincount(row * n + _SCRIPT[data], minlength=rows * n).reshape(rows, n)[:, 1:]
    names = list(SCRIPTS)
    return [names[i] if some else None for i, some in zip(counts.argmax(axis=1).tolist(), counts.any(axis=1).tolist(), strict=True)]


def _first_seen(key_row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether an equal key of the same row stands earlier."""
    order = np.lexsort((key, key_row))
    again = np.zeros(len(key), bool)
    again[1:] = (key_row[order][1:] == key_row[order][:-1]) & (key[order][1:] == key[order][:-1])
    out = np.zeros(len(key), bool)
    out[order] = again
    return out


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(bounds) - 1
    w = words_of(data, bounds, PLAIN)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row_of_byte = lambda at: np.searchsorted(bounds, at, side="right") - 1
    signs = np.flatnonzero(np.isin(data, np.frombuffer(SIGNS, np.uint8)))
    # lines with a word, compared by hash within the row
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    line_row = np.sort(np.concatenate([np.arange(rows), row_of_byte(breaks)]), kind="stable")
    ends = np.sort(np.concatenate([bounds[1:], breaks]), kind="stable")
    worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, line_row = starts[worded], ends[worded], line_row[worded]
    dup = _first_seen(line_row, span_hashes(data, starts, ends))
    # words in five-word windows that occur twice
    h, whole = sequence_hashes(w.hashes(), WINDOW), w.whole(WINDOW)
    at = np.flatnonzero(whole)
    order = at[np.lexsort((h[at], w.row[at]))]
    same = (h[order][1:] == h[order][:-1]) & (w.row[order][1:] == w.row[order][:-1])
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeat = covered(twice, WINDOW) if len(h) else np.zeros(len(w.row), bool)
    return {
        "n_words": w.counts,
        "word_chars": sums(chars[w.ends] - chars[w.starts], w.row, rows),
        "n_symbols": sums(np.ones(len(signs)), row_of_byte(signs), rows),
        "n_dup_lines": sums(dup, line_row, rows),
        "n_repeat_words": sums(repeat, w.row, rows),
        "_chars": np.diff(chars[bounds]),
    }


def _measure(path: str, multi: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = {f.name: [] for f in MEASURES}
            for _, _, data, bounds in slices(batch.column(batch.schema.get_field_index("text"))):
                enc = encoder(path)
                counts = base_counts(data, bounds)
                ids, first = enc.encode(data, bounds)
                n, multi_n = np.diff(first), np.diff(encoder(multi).encode(data, bounds)[1])
                row = np.repeat(np.arange(len(n)), n)
                split, signs = (np.bincount(row, kind[ids], len(n)) for kind in (enc.fragment, enc.sign))
                with np.errstate(divide="ignore", invalid="ignore"):
                    entropy = np.where(n > 0, entropies(ids, first, len(enc.size)), np.nan)
                    shares = (counts["_chars"] / n, split / n, entropy, signs / n, counts["_chars"] / multi_n)
                made = counts | {"n_tokens": n, "multi_tokens": multi_n}
                for name in _COUNTS:
                    parts[name].append(pa.array(made[name], pa.int64()))
                for name, values in zip(_SHARES, shares, strict=True):
                    parts[name].append(as_double(values))
                parts["script"].append(pa.array(scripts(data, bounds), pa.string()))
            kinds = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
            done = [pa.concat_arrays(parts[f.name]) if parts[f.name] else pa.array([], kinds[f.dataType]) for f in MEASURES]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *done], names=[*keep, *parts])

    return run


def _inside(b: Band) -> Column:
    chars = F.col("chars_per_token").between(b.least, b.most) & F.col("multi_chars_per_token").between(b.multi_least, b.multi_most)
    return chars & (F.col("fragment_share") <= b.fragments) & (F.col("token_entropy") >= b.entropy) & (F.col("sign_share") <= b.signs)


def quality(
    docs: DataFrame, bands: dict[str, Band] | None = None, script_bands: dict[str, Band] | None = None, default: Band = DEFAULT,
    vocab: str | None = None, multi: str | None = None, keep_text: bool = True,
) -> DataFrame:
    """docs with the measures, base_failed and kept; keep_text=False leaves the text out."""
    bands, script_bands = BANDS if bands is None else bands, SCRIPT_BANDS if script_bands is None else script_bands
    made = [*MEASURES.names, "base_failed", "kept"]
    own = [c for c in docs.columns if c not in made and (keep_text or c != "text")]
    read = [*own, *(() if keep_text else ("text",))]
    schema = T.StructType([docs.schema[c] for c in own] + list(MEASURES))
    vocabs = vocab or vocabulary(), multi or vocabulary("byte_bpe_multi_50k.tiktoken")
    measured = docs.select(*read).mapInArrow(_measure(*vocabs, own), schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = _inside(default)
    for script, band in script_bands.items():
        verdict = F.when(F.col("script") == script, _inside(band)).otherwise(verdict)
    for lang, band in bands.items() if "lang" in docs.columns else ():
        written = F.col("script") == WRITTEN[lang] if lang in WRITTEN else F.lit(True)
        verdict = F.when((F.col("lang") == lang) & written, _inside(band)).otherwise(verdict)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(verdict, F.lit(False)))


def fit_bands(measured: DataFrame, by: str = "lang", share: float = 0.001, room: float = 0.05) -> dict[str, Band]:
    """Bands that hold all but a share of good documents at either end, and some room. measured: the good
    documents with their measures; one row per value of `by` reaches the driver (languages or scripts)."""
    columns = ("chars_per_token", "multi_chars_per_token", "fragment_share", "token_entropy", "sign_share")
    ends = [F.percentile_approx(c, [share, 1 - share], 10_000).alias(c) for c in columns]
    found = measured.where(f"{by} is not null and chars_per_token is not null and not base_failed").groupBy(by).agg(*ends).collect()
    low, high = lambda x: x[0] * (1 - room), lambda x: x[1] * (1 + room)
    return {
        r[by]: Band(low(r.chars_per_token), high(r.chars_per_token), high(r.fragment_share) + 0.01, low(r.token_entropy), low(r.multi_chars_per_token), high(r.multi_chars_per_token), high(r.sign_share))
        for r in found
    }
