"""One query for each operator, over whole tables, with the SQL that says the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import (
    decontamination, hmm_lm, hot_keys, html_text, line_dedup, mixing, ngram_join, pieces, pii, quality_classifier, quality_rules, source_audit, toxicity, vector_codes,
)
from pathloom.plans.staging import stage

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.hmm_scores(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, decoded="decoded").select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.size("piece_ids").cast("long").alias("n_pieces"),
        "piece_ids",
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontamination.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    numbers = ",".join(str(v) for book in books for entry in book for v in entry)
    of_label = coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    found = hot_keys.with_totals(coded, stage(of_label, "label-errors"), "label", "n")
    most = F.lit(vector_codes.LONGEST).cast("decimal(38,0)")
    return found.select(
        "vec_id",
        "code",
        "error",
        F.least("label_error", most).cast("long").alias("label_error"),
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (
  SELECT rid, i, hash(list_slice(w, i, i + 7)) AS h
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)),
repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT rid, CAST(sum(least(8, i - coalesce(prev, i - 8))) AS BIGINT) AS n
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM repeated) GROUP BY rid),
s AS (
  SELECT d.doc_id, d.text, d.w, CAST(len(d.w) AS BIGINT) AS n_words,
         CAST(length(list_aggregate(list_concat(['']::VARCHAR[], d.w), 'string_agg', '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM d JOIN lines USING (rid) LEFT JOIN covered c USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 100 * n_symbols > 10 * n_words
            OR word_chars < 2 * n_words OR word_chars > 16 * n_words
            OR 100 * n_dup_lines > 30 * n_lines
            OR 10 * len(regexp_extract_all(text, '!')) > 3 * n_words
            OR 2 * len(regexp_extract_all(text, '[A-Z]')) > word_chars
            OR (n_words >= 50 AND 20 * len(list_distinct(w)) < n_words)
            OR 2 * len(regexp_extract_all(text, '[0-9]')) > word_chars
            OR 10 * len(regexp_extract_all(text, '\p{L}+')) < 6 * n_words
            OR NOT regexp_matches(text, '@STOP')
            OR 10 * len(regexp_extract_all(text, '(?m)^[ \t]*[-*•] ')) > 9 * n_lines
            OR 10 * len(regexp_extract_all(text, '(?m)(\.\.\.|…)[ \t\r]*$')) > 3 * n_lines) AS kept
FROM b
""".replace("@STOP", quality_rules.STOP_PATTERN)

OP8_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 10) AS n
  FROM (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0 AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT rid, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d CROSS JOIN sizes)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (
  SELECT rid, count(DISTINCT k) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


OP11_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
         regexp_extract_all({LOWER_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT lang, source, term, count(*) AS c, count(DISTINCT rid) AS df FROM (SELECT lang, source, rid, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM t GROUP BY lang, term HAVING sum(df) >= {source_audit.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, CAST(sum(c) AS BIGINT) AS n FROM kept GROUP BY lang),
n AS (SELECT t.lang, t.source, CAST(sum(t.c) AS BIGINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY t.lang, t.source),
g AS (SELECT g.lang, g.source, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(t.c, 0) AS c,
         1 + CAST({source_audit.SCALE} AS HUGEINT) * (coalesce(t.c, 0) + 2) // (g.n + 2 * v.v) AS p,
         1 + CAST({source_audit.SCALE} AS HUGEINT) * (k.c + 2) // (v.n + 2 * v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value
             FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL SELECT * FROM (
  SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms)
WHERE rank <= {source_audit.TOP}
"""


def _op13_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    nearest = """SELECT rid, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
  FROM (SELECT p.rid, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda t: CAST((t[1] - t[2]) * (t[1] - t[2]) AS HUGEINT))) AS d
        FROM p JOIN b{k} b ON b.part = p.part) GROUP BY rid, part"""
    steps = [
        f"""a{k} AS MATERIALIZED ({nearest.format(k=k)}),
u{k} AS (SELECT part, entry, i, sum(v) AS s, count(*) AS n
  FROM (SELECT a.part, a.entry, unnest(range(1, len(p.x) + 1)) AS i, unnest(p.x) AS v FROM a{k} a JOIN p ON p.rid = a.rid AND p.part = a.part) GROUP BY part, entry, i),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(z.x, b.x) AS x FROM b{k} b
  LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM u{k} GROUP BY part, entry) z ON z.part = b.part AND z.entry = b.entry)"""
        for k in range(rounds)
    ]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT rid, part, list_slice(e, part * (len(e) // {parts}) + 1, (part + 1) * (len(e) // {parts})) AS x FROM v, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= {entries}),
{", ".join(steps)},
z AS MATERIALIZED ({nearest.format(k=rounds)}),
c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN c USING (rid) CROSS JOIN h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hmm_lm": op1_hmm_lm,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_line_dedup": op3_line_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_quality_classifier": op10_quality_classifier,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_html_text": op5_html_text,
        "op6_pii": op6_pii,
        "op7_quality_rules": op7_quality_rules,
        "op8_decontamination": op8_decontamination,
        "op11_source_audit": op11_source_audit,
        "op12_source_mix": op12_source_mix,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": OP7_SQL, "op8_decontamination": OP8_SQL, "op11_source_audit": OP11_SQL, "op13_vector_codes": _op13_sql()}
