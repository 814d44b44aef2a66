"""Query op1: documents mixed to target weights over a domain-language-source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import mix

#: Target weights by level; other names weigh 1. A source's domain is its number modulo 4.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 3, "fr": 2, "es": 2}, "source": {"src0": 1, "src1": 2, "src2": 3}}
BUDGET = "(total * 9) div 10"
MAX_EPOCHS = 3
DOMAIN = "concat('d', CAST(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 3) % 4 AS STRING))"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", F.expr(DOMAIN))
    return mix(docs, WEIGHTS, F.expr(BUDGET), MAX_EPOCHS)


def _case(name: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _fill(name: str, src: str, parent: str, child: str) -> str:
    return f"""
{name}_1 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / CAST(w AS DOUBLE), {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (PARTITION BY {parent} ORDER BY cap / CAST(w AS DOUBLE), {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM {src}),
{name}_2 AS (SELECT *, cap * rest_w <= (given - before) * w AS is_full FROM {name}_1),
{name}_3 AS (SELECT *, given - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS remain,
  sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS open_w FROM {name}_2),
{name} AS (SELECT * EXCLUDE (given), CASE WHEN is_full THEN cap ELSE (remain * w) // open_w END AS share FROM {name}_3)"""


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || CAST(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 3) % 4 AS VARCHAR) AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents
), s AS (SELECT * FROM d WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST({_case('domain', WEIGHTS['domain'])} AS HUGEINT) AS w_domain,
  CAST({_case('lang', WEIGHTS['lang'])} AS HUGEINT) AS w_lang, CAST({_case('source', WEIGHTS['source'])} AS HUGEINT) AS w, sum(n_tokens) * {MAX_EPOCHS} AS cap FROM s GROUP BY ALL),
dom AS (SELECT domain, sum(cap) AS cap, min(w_domain) AS w, least((SELECT sum(tokens) * 9 // 10 FROM leaf), (SELECT sum(cap) FROM leaf)) AS given FROM leaf GROUP BY domain),
{_fill('dom_f', 'dom', '1', 'domain')},
lng AS (SELECT l.domain, lang, sum(l.cap) AS cap, min(w_lang) AS w, min(f.share) AS given FROM leaf l JOIN dom_f f USING (domain) GROUP BY l.domain, lang),
{_fill('lng_f', 'lng', 'domain', 'lang')},
src AS (SELECT l.*, f.share AS given FROM leaf l JOIN lng_f f USING (domain, lang)),
{_fill('src_f', 'src', 'domain, lang', 'source')},
plan AS (SELECT domain, lang, source, CAST(share // tokens AS BIGINT) AS full_epochs, CAST(share % tokens AS BIGINT) AS rest FROM src_f WHERE share > 0),
r AS (SELECT s.*, full_epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('11:' || CAST(full_epochs + 1 AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM s JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, full_epochs + 1)) AS epoch FROM r WHERE full_epochs > 0
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, full_epochs + 1 FROM r WHERE run <= rest
"""
