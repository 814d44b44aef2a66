"""The jobs as registered queries: each runs twice over the whole tables, into a new folder, and returns what then stands there."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from corbel.workspace import shared_folder
from jobs import change_report, mention_index
from jobs.common import load_config

HERE = Path(__file__).parent


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_mention_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = _new_folder(spark, "job1"), load_config(mention_index.Config, HERE / "mention_index.json")
    for _ in range(2):
        mention_index.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{out}/out", f"{out}/checkpoint", config)
    return mention_index.read_index(spark, f"{out}/out")


def job2_change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = _new_folder(spark, "job2"), load_config(change_report.Config, HERE / "change_report.json")
    for _ in range(2):
        change_report.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet", f"{sf_dir}/part.parquet", out, config)
    return change_report.read_report(spark, out)


QUERIES = {"job1_mention_index": job1_mention_index, "job2_change_report": job2_change_report}
ORACLE = {
    "job1_mention_index": r"""WITH bw AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS name FROM benchmark),
rare AS (SELECT name FROM bw WHERE length(name) >= 8 AND NOT starts_with(name, '__') GROUP BY name HAVING count(*) <= 2),
ln AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
w AS (SELECT doc_id, lang, source, i, l, unnest(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS name FROM ln)
SELECT doc_id, lang, source, name, min(i) AS line, substr(regexp_replace(arg_min(l, i), '^\s+|\s+$', '', 'g'), 1, 200) AS line_text
FROM w JOIN rare USING (name) GROUP BY doc_id, lang, source, name""",
    "job2_change_report": """WITH r AS (
  SELECT DISTINCT l_orderkey AS o, l_partkey AS p, o_custkey AS who, o_orderdate AS d, o_orderstatus AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey
), h AS (
  SELECT p, count(*) AS n, count(DISTINCT who) AS n_who, min(d) AS first_date, max(d) AS last_date, arg_max(kind, (d, o)) AS last_kind FROM r GROUP BY p
), k AS (
  SELECT o, p FROM r WHERE o IN (SELECT o FROM r GROUP BY o HAVING count(*) BETWEEN 2 AND 25)
), pr AS (
  SELECT x.p AS a, y.p AS b, count(*) AS n FROM k x JOIN k y ON x.o = y.o AND x.p <> y.p GROUP BY 1, 2 HAVING count(*) >= 2
), t AS (
  SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b DESC) AS rank FROM pr QUALIFY rank <= 6
)
SELECT m.p_brand AS package, m.p_partkey AS module, m.p_name AS name, coalesce(h.n, 0) AS commits, coalesce(n_who, 0) AS authors, CAST(first_date AS DATE) AS first_date,
  CAST(last_date AS DATE) AS last_date, last_kind, CAST(rank AS INTEGER) AS rank, b AS partner, q.p_name AS partner_name, t.n AS together
FROM part m LEFT JOIN h ON h.p = m.p_partkey LEFT JOIN t ON t.a = m.p_partkey LEFT JOIN part q ON q.p_partkey = t.b""",
}
