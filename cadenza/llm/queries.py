"""The queries of the text operators, over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.decontaminate import find_contamination
from cadenza.llm.html_extract import extract
from cadenza.llm.licenses import THRESHOLD, scan_licenses, template_values
from cadenza.llm.line_dedup import dedup_lines
from cadenza.llm.lsh_forest import near_duplicates
from cadenza.llm.packing import pack
from cadenza.llm.periodic_runs import periodic_runs
from cadenza.llm.preference import preference_pairs
from cadenza.llm.quality import quality
from cadenza.llm.quality_net import quality_scores
from cadenza.llm.spelling import letter_runs, spelling_variants, word_counts
from cadenza.llm.substring_dedup import dedup_substrings
from cadenza.llm.token_counts import section_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False).drop("lang")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS pos) AS u),
firsts AS (SELECT line_key, min(doc_id) AS first_doc FROM lines WHERE length(line_key) >= 10 GROUP BY line_key),
marked AS (SELECT l.doc_id, l.line, l.pos, coalesce(f.first_doc < l.doc_id, false) AS dropped FROM lines l LEFT JOIN firsts f USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM windows),
starts AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM folded, lengths WHERE len(w) >= k)),
hits AS (SELECT doc_id, s.k, s.i, item_id FROM starts s JOIN windows USING (k, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM starts GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM starts JOIN firsts USING (win) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM split s LEFT JOIN kept USING (doc_id)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_licenses", F.array_join("licenses", ",").alias("licenses"), "best_license", F.round("best_score", 6).alias("best_score"))


def op6_sql() -> str:
    bigrams, sizes = template_values()
    return rf"""
WITH template_bigrams(name, bigram) AS (VALUES {bigrams}),
sizes(name, licence, nt, least_shared, longest) AS (VALUES {sizes}),
templates AS (SELECT name, list(bigram) AS t FROM template_bigrams GROUP BY name),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT doc_id, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] AS b FROM words WHERE len(w) > 1),
hits AS (
  SELECT doc_id, name, pos, bigram FROM (SELECT doc_id, unnest(b) AS bigram, unnest(range(1, len(b) + 1)) AS pos FROM grams) JOIN template_bigrams USING (bigram)),
held AS (SELECT doc_id, name FROM hits JOIN sizes USING (name) GROUP BY doc_id, name, least_shared HAVING count(DISTINCT bigram) >= least_shared),
windows AS (
  SELECT h.doc_id, h.name, i.pos AS a, j.pos AS z, list_distinct(b[i.pos:j.pos]) AS s
  FROM held h JOIN hits i ON i.doc_id = h.doc_id AND i.name = h.name JOIN hits j ON j.doc_id = h.doc_id AND j.name = h.name
  JOIN sizes z ON z.name = h.name JOIN grams g ON g.doc_id = h.doc_id
  WHERE j.pos >= i.pos AND j.pos - i.pos < longest),
scored AS (SELECT doc_id, name, licence, nt, a, z, 2.0 * len(list_intersect(s, t)) / (len(s) + nt) AS score FROM windows JOIN templates USING (name) JOIN sizes USING (name)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY score DESC, a, z) AS nth FROM scored) WHERE nth = 1 AND score >= {THRESHOLD}),
stays AS (
  SELECT * FROM best x WHERE NOT EXISTS (
    SELECT 1 FROM best y WHERE y.doc_id = x.doc_id AND y.name <> x.name AND y.a <= x.z AND x.a <= y.z
    AND (y.score > x.score OR y.score = x.score AND (y.nt > x.nt OR y.nt = x.nt AND y.name < x.name)))),
found AS (
  SELECT doc_id, count(DISTINCT licence) AS n_licenses, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses, first(licence ORDER BY score DESC, nt DESC, name) AS best_license, max(score) AS best_score
  FROM stays GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, best_license, round(CAST(best_score AS DOUBLE), 6) AS best_score
FROM documents d LEFT JOIN found f USING (doc_id)
"""


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preference_pairs(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return made.select("pair_id", "n_prefix", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
compared AS (
  SELECT c.pair_id, c.nth, coalesce(c.role = r.role AND c.text = r.text, false) AS same
  FROM (SELECT * FROM turns WHERE side = 0) c LEFT JOIN (SELECT * FROM turns WHERE side = 1) r ON c.pair_id = r.pair_id AND c.nth = r.nth),
prefix AS (SELECT pair_id, coalesce(min(nth) FILTER (WHERE NOT same) - 1, count(*)) AS n_prefix FROM compared GROUP BY pair_id),
placed AS (
  SELECT t.*, coalesce(n_prefix, 0) AS n_prefix, t.nth <= coalesce(n_prefix, 0) AS shared,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
  FROM turns t LEFT JOIN prefix USING (pair_id)),
spans AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, side, shared ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS span_start
  FROM placed)
SELECT pair_id, max(n_prefix) AS n_prefix,
       coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (WHERE shared AND side = 0), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (WHERE NOT shared AND side = 0), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY nth) FILTER (WHERE NOT shared AND side = 1), '') AS rejected,
       coalesce(string_agg(CAST(span_start AS BIGINT) || '-' || CAST(span_start + length(text) + 10 AS BIGINT), ',' ORDER BY nth) FILTER (WHERE NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(span_start AS BIGINT) || '-' || CAST(span_start + length(text) + 10 AS BIGINT), ',' ORDER BY nth) FILTER (WHERE NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY pair_id
"""


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM split),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
components AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN components USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"), rule="most")


def noisy_words(docs: DataFrame) -> DataFrame:
    """word: the letter runs of the texts, with a code point gone where 31 divides the crc32 of doc_id and run."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("_h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return letter_runs(docs, 7).withColumn("_h", h).select(F.when(F.col("_h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(noisy_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT doc_id, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')) AS u FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [192 | (unicode(ch) >> 6), 128 | (unicode(ch) & 63)] END)) AS b
  FROM counted),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM bytes, crc_table),
noisy AS (
  SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word FROM gaps g JOIN words w ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near JOIN (SELECT word AS other, n FROM words) USING (other) GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
follow AS (SELECT word, coalesce(form, word) AS at FROM forms UNION SELECT f.word, g.form FROM follow f JOIN forms g ON f.at = g.word WHERE g.form IS NOT NULL),
roots AS (SELECT f.word, f.at AS root FROM follow f JOIN forms g ON f.at = g.word WHERE g.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


WORDS = r"[^\x20\x09-\x0D]+"


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; in documents whose crc32 is divisible by 10 the words from a place on repeat a
    stretch of the text, so that there are runs of many periods. No lambda: words are split once."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, g = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.floor(F.col("_h") / 10)
    split = docs.select("doc_id", "text", h.alias("_h")).withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_w"))
    placed = split.withColumn("_a", F.when(F.col("_n") > 0, (g % F.col("_n")).cast("int")))
    period = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int")
    cut = placed.withColumn("_p", period).withColumn("_times", F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.col("_times")))
    made = F.array_join(F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), F.lit(1), F.col("_n")), " ")
    return cut.select("doc_id", F.coalesce(made, "text").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text", "n_words")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    top = found.withColumn("_top", longest)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.start")).alias("start"), F.col("_top.length").alias("length"), (-F.col("_top.period")).alias("period"),
        F.floor(1000 * F.col("_top.length") / -F.col("_top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fertility": op1_fertility,
        "op2_line_dedup": op2_line_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_packing": op5_packing,
        "op6_license_scan": op6_license_scan,
        "op7_preference": op7_preference,
        "op8_html_extract": op8_html_extract,
        "op9_minhash": op9_minhash,
        "op10_token_counts": op10_token_counts,
        "op11_spelling": op11_spelling,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_quality_net": op13_quality_net,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op9_minhash": OP9_SQL, "op6_license_scan": op6_sql(), "op7_preference": OP7_SQL, "op11_spelling": OP11_SQL}
