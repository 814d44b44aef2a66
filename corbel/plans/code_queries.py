"""The code model as queries over a source tree: the library's own, as the supplied tables hold no code. The SQL reads the
same files as texts and finds modules and imports by patterns, without a parser; symbols and calls have none."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corbel
from corbel.layout import Layout
from corbel.plans import model as M
from corbel.plans.resolve import NameResolver, full_facts
from corbel.workspace import keep

ROOT = Path(corbel.__file__).resolve().parent.parent
LAYOUT = Layout("corbel", ".", "corbel", skip=(*Layout.skip, "/corbel/llm/"))


def _tree(spark: SparkSession) -> M.Tree:
    return M.read_code(spark, ROOT, LAYOUT, keep)


def code_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _tree(spark).modules
    return m.select("id", "path", "loc", "package", F.size("symbols").alias("n_symbols"), F.size("consts").alias("n_consts"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark).symbols.select("id", "kind", "name", "module", "line", "end", "col", "h", "sig", "private")


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.link_imports(_tree(spark)).select("src", "dst")


def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_facts(_tree(spark), NameResolver()).select(F.col("id").alias("src"), F.explode("calls_out").alias("dst"))


QUERIES = {f.__name__: f for f in (code_modules, code_symbols, code_imports, code_calls)}

_FILES = f"""f AS (SELECT replace(filename, '{ROOT}/', '') AS path, content FROM read_text('{ROOT}/corbel/**/*.py') WHERE NOT contains(filename, '/corbel/llm/')),
m AS (SELECT path, content, replace(regexp_replace(path, '((^|/)__init__)?[.]py$', ''), '/', '.') AS id FROM f),
l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM m)"""
ORACLE = {
    "code_modules": f"""WITH {_FILES},
t AS (SELECT id, i, line, regexp_extract(line, '^(?:class|def|async def) (\\w+)', 1) AS top, regexp_extract(line, '^    (?:async )?def (\\w+)', 1) AS inner_name FROM l),
o AS (SELECT *, last_value(CASE WHEN top <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i) AS own FROM t),
s AS (SELECT id, count(DISTINCT CASE WHEN top <> '' THEN top ELSE regexp_extract(own, '^class (\\w+)', 1) || '.' || inner_name END) AS n
  FROM o WHERE top <> '' OR inner_name <> '' AND starts_with(own, 'class ') GROUP BY id),
c AS (SELECT id, count(*) AS n FROM l WHERE regexp_matches(line, '^_*[A-Z][A-Z0-9_]*(: [^=]+)? = ') GROUP BY id)
SELECT m.id, path, CAST(len(string_split(content, chr(10))) AS INTEGER) AS loc, CASE WHEN contains(m.id, '.') THEN regexp_replace(m.id, '[.][^.]*$', '') ELSE m.id END AS package,
  CAST(coalesce(s.n, 0) AS INTEGER) AS n_symbols, CAST(coalesce(c.n, 0) AS INTEGER) AS n_consts FROM m LEFT JOIN s USING (id) LEFT JOIN c USING (id)""",
    "code_imports": f"""WITH {_FILES},
x AS (SELECT id, regexp_extract(line, '^ *from (corbel[.\\w]*) import (.*)$', ['base', 'names']) AS g, regexp_extract(line, '^ *import (corbel[.\\w]*)', 1) AS plain FROM l),
n AS (SELECT id, g.base AS base, unnest(string_split(regexp_replace(g.names, '[()]', '', 'g'), ',')) AS name FROM x WHERE g.base <> ''),
cand AS (SELECT id, base AS cand FROM n UNION SELECT id, base || '.' || regexp_extract(trim(name), '^\\w+') FROM n UNION SELECT id, plain FROM x WHERE plain <> ''),
hit AS (SELECT c.id, cand, arg_max(m.id, length(m.id)) AS dst FROM cand c JOIN m ON (cand = m.id OR starts_with(cand, m.id || '.')) AND c.id <> m.id GROUP BY 1, 2)
SELECT DISTINCT id AS src, dst FROM hit""",
}
