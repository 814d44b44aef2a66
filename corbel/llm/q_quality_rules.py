"""Query op6: base metrics and the cascade's verdict for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality_rules import quality_rules


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS r FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, t, w, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(ln.n, 0) AS n_lines,
    coalesce(cov.r, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    word_chars > 20 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > n_words OR n_lines >= 8 AND 100 * n_dup_lines > 30 * n_lines
    OR 2 * (length(t) - length(replace(t, '!', ''))) > n_words
    OR 2 * (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) > word_chars
    OR 2 * (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) > word_chars
    OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 7 * n_words AS bad
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM v
"""
