"""One query for each operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, table
from . import bpe, mixing, pii, repetition, separator_scan, simhash, suffix_dedup, toxicity, training_order, weighted_sampling


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text with surrogates, and how many entities were replaced."""
    return pii.replace_pii(_documents(spark, sf_dir).select("doc_id", "text"))  # the count clashes with no column of the table


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    groups = simhash.near_duplicates(_documents(spark, sf_dir))
    return groups.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op3_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of each document."""
    judged = repetition.judge_repetition(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_consistent_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document."""
    return weighted_sampling.compare_fingerprints(_documents(spark, sf_dir))


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's token count, found in the flat token files written of all of them."""
    return separator_scan.count_tokens(_documents(spark, sf_dir)).select("doc_id", "n_tokens")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence's slot in training order, and its ids as counted in the shard it was written to."""
    return training_order.ordered_sequences(_documents(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated strings of 400 bytes."""
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir)).drop("kept")


def op8_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of each document's ids and of the text they decode to."""
    return bpe.encode_documents(_documents(spark, sf_dir))


def op9_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learnt from the labels that aren't held out."""
    docs = _documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document."""
    return mixing.mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
words AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM split),
grams AS (
  SELECT doc_id, n, i,
         hash(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS g3,
         hash(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) AS g8,
         hash(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 100 FOLLOWING)) AS g101
  FROM words),
starts AS (
  SELECT doc_id, i,
         i <= n - 2 AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS again_3,
         i <= n - 7 AND count(*) OVER (PARTITION BY doc_id, g8) > 1 AS again_8,
         i <= n - 100 AND count(*) OVER (PARTITION BY doc_id, g101) > 1 AS again_101
  FROM grams),
covered AS (
  SELECT doc_id, again_101,
         max(again_3::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS 2 PRECEDING) AS in_3,
         max(again_8::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS 7 PRECEDING) AS in_8
  FROM starts),
repeats AS (SELECT doc_id, sum(in_3) AS n_3, sum(in_8) AS n_8, max(again_101::INT) AS long FROM covered GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS full_lines
  FROM split),
base AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_3, 0) AS BIGINT) AS n_repeat_words, coalesce(n_8, 0) AS n_8, coalesce(long, 0) AS long
  FROM counts c LEFT JOIN repeats r ON c.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_8 <= CAST(0.3 AS DOUBLE) * n_words AND long = 0 AS kept
FROM base
"""

OP5_SQL = r"""
SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents
"""


def _op6_sql() -> str:
    """The permutation spelled out: one expression a round, and a recursive walk along the cycles."""
    left, right = "(v >> bits)", "(v & (1::BIGINT << bits) - 1)"
    for k in training_order.round_keys():
        mixed = f"(({right} + {k}) * {training_order.FIRST} % {training_order.PRIME} * {training_order.SECOND} % {training_order.PRIME} & (1::BIGINT << bits) - 1)"
        left, right = right, f"xor({left}, {mixed})"
    step = f"(({left} << bits) | {right})"
    return rf"""
WITH RECURSIVE counted AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n FROM documents),
numbered AS (
  SELECT doc_id, n, n // 256 + 1 AS k, CAST(sum(n // 256 + 1) OVER (ORDER BY doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) - (n // 256 + 1) AS first
  FROM counted),
sized AS (SELECT CAST(sum(k) AS BIGINT) AS total, CAST(greatest(1, ceil(ceil(log2(greatest(sum(k), 2))) / 2)) AS INT) AS bits FROM numbered),
sequences AS (SELECT doc_id, n, first, unnest(range(k)) AS seq_no FROM numbered),
walk AS (
  SELECT doc_id, seq_no, n, first + seq_no AS v, total, bits, 0 AS steps FROM sequences, sized
  UNION ALL
  SELECT doc_id, seq_no, n, {step} AS v, total, bits, steps + 1 FROM walk WHERE steps = 0 OR v >= total)
SELECT doc_id, seq_no, v AS slot, least(256, n + 1 - 256 * seq_no) AS n_tokens FROM walk WHERE steps > 0 AND v < total
"""


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, md5(coalesce(text, '')) AS text_key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 3 * source_size AS most,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS all_size FROM totals),
running AS (
  SELECT *, row_number() OVER w AS place,
         CAST(all_size - sum(most) OVER (w ROWS UNBOUNDED PRECEDING) + most AS BIGINT) AS num,
         CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS den
  FROM ranked WINDOW w AS (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST)),
free AS (SELECT place, num, den FROM running WHERE num * weight <= most * den ORDER BY place LIMIT 1),
targets AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.place >= f.place THEN CAST(f.num * r.weight AS DOUBLE) / f.den ELSE CAST(r.most AS DOUBLE) END AS target,
         CASE WHEN r.place >= f.place THEN f.num * r.weight // f.den ELSE r.most END AS budget
  FROM running r LEFT JOIN free f ON true),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.budget,
         CASE WHEN t.source_size = 0 THEN 0 ELSE t.budget // t.source_size END AS epochs,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.text_key ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_simhash_near_duplicates": op2_simhash_near_duplicates,
    "op3_suffix_array_repetition": op3_suffix_array_repetition,
    "op4_consistent_weighted_sampling": op4_consistent_weighted_sampling,
    "op5_separator_scan": op5_separator_scan,
    "op6_training_order": op6_training_order,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_bpe_chunk_reuse": op8_bpe_chunk_reuse,
    "op9_string_kernel_toxicity": op9_string_kernel_toxicity,
    "op10_mix_sources": op10_mix_sources,
}

ORACLE_SQL = {
    "op3_suffix_array_repetition": OP3_SQL,
    "op5_separator_scan": OP5_SQL,
    "op6_training_order": _op6_sql(),
    "op10_mix_sources": OP10_SQL,
}
