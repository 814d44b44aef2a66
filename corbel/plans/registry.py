"""Registered queries over the supplied tables, and their SQL. Each applies one kernel to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corbel.functions import text as T
from corbel.operators import incremental as I
from corbel.operators import links as L
from corbel.operators import pairs as P
from corbel.operators import snapshots as S
from corbel.operators.named import NamedEdges
from corbel.plans import model as M
from corbel.plans import resolve as R
from corbel.sources.tables import table
from corbel.streaming.facts import follow, kept
from corbel.workspace import keep, own_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ pairs, top-k, histories

_BASKETS = """
WITH d AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
s AS (SELECT o FROM d GROUP BY o HAVING count(*) BETWEEN 2 AND {hi}),
k AS (SELECT d.* FROM d JOIN s USING (o)),
pr AS (SELECT x.p AS a, y.p AS b, count(*) AS n FROM k x JOIN k y ON x.o = y.o AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= 2)
"""


@query(_BASKETS.format(hi=5) + "SELECT a, b, n FROM pr")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_counts(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 2, 5, 2, P.COUNTERS, keep)


@query("""WITH u AS (SELECT DISTINCT user_id AS i, strftime(ts, '%Y%m%d%H%M')[1:11] AS b FROM events), s AS (SELECT b FROM u GROUP BY b HAVING count(*) BETWEEN 2 AND 25),
k AS (SELECT u.* FROM u JOIN s USING (b)) SELECT x.i AS a, y.i AS b, count(*) AS n FROM k x JOIN k y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 3""")
def pair_counts_times(spark: SparkSession, d: str) -> DataFrame:
    """Users seen in the same ten minutes, three times or more; guard and support of the build."""
    seen = table(spark, d, "events").select("user_id", F.substring(F.date_format("ts", "yyyyMMddHHmm"), 1, 11).alias("b"))
    return P.pair_counts(seen, "b", "user_id", 2, 25, 3, P.COUNTERS, keep)


@query(
    _BASKETS.format(hi=25)
    + """, r AS (SELECT a, b, n FROM pr UNION ALL SELECT b, a, n FROM pr)
SELECT a, b, n, p_name AS name, row_number() OVER (PARTITION BY a ORDER BY n DESC, b DESC) AS rank
FROM r LEFT JOIN part ON p_partkey = b QUALIFY rank <= 6"""
)
def topk_related(spark: SparkSession, d: str) -> DataFrame:
    top = P.topk_related(P.pair_counts(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 2, 25, 2, P.COUNTERS, keep), 6)
    names = table(spark, d, "part").select(F.col("p_partkey").alias("b"), F.col("p_name").alias("name"))
    return top.join(names, "b", "left").select("a", "b", "n", "name", "rank")


@query("""SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_who, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type
FROM events GROUP BY user_id""")
def group_history(spark: SparkSession, d: str) -> DataFrame:
    return P.group_history(table(spark, d, "events"), "user_id", "event_id", "event_type", {"first_type": "event_type"}, {"last_type": "event_type"})


@query("SELECT count(*) AS n FROM events")
def total_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events QUALIFY rank <= 12""")
def arrival_cap(spark: SparkSession, d: str) -> DataFrame:
    return P.arrival_cap(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], 12)


@query("""WITH x AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS i FROM x)
SELECT l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM r WHERE i <= 6 GROUP BY l_suppkey""")
def capped_sets(spark: SparkSession, d: str) -> DataFrame:
    out = P.capped_sets(table(spark, d, "lineitem"), ["l_suppkey"], "l_partkey", 6)
    return out.select("l_suppkey", F.array_join("vals", ",").alias("parts"))


@query("""SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank
FROM events GROUP BY user_id, event_type""")
def grouped_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.grouped_counts(table(spark, d, "events"), "user_id", "event_type")


@query("""WITH u AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS f, l_orderkey AS t FROM lineitem), c AS (SELECT p, f, least(count(*), 6) AS n FROM u GROUP BY p, f)
SELECT p_brand AS module, CAST(f AS VARCHAR) AS file, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY sum(n) DESC, CAST(f AS VARCHAR)) AS rank
FROM c JOIN part ON p_partkey = p GROUP BY p_brand, f""")
def module_tests(spark: SparkSession, d: str) -> DataFrame:
    """The build's counts of tests by module and file, over capped lists: parts as symbols of brands, orders as tests of suppliers."""
    hits = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").cast("string").alias("file"), F.col("l_orderkey").alias("name"))
    facts = P.capped_sets(hits, ["id", "file"], "name", R.TESTS_PER_FILE, "names").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("file", "names"))).alias("tests"))
    out = M.module_tests(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("module")), facts)
    return out.select("module", F.posexplode("tests").alias("i", "t")).select("module", "t.file", "t.n", (F.col("i") + 1).alias("rank"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT src AS id, count(*) AS n_out, min(dst) AS least, max(dst) AS greatest FROM e WHERE src <> dst GROUP BY src""")
def distinct_callees(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("src")).join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("dst")), "o_orderkey")
    e = e.filter("src <> dst").select("src", "dst").distinct()
    return e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"), F.min("dst").alias("least"), F.max("dst").alias("greatest"))


# ------------------------------------------------------------------ links

_URL = "regexp_replace(regexp_replace(url, '^https?://', ''), '/', '.', 'g')"


@query(f"""WITH u AS (SELECT page_id, {_URL} AS cand FROM pages),
p AS (SELECT page_id, cand, k, array_to_string(string_split(cand, '.')[1:k], '.') AS pre FROM (SELECT *, unnest(range(1, len(string_split(cand, '.')) + 1)) AS k FROM u)),
dict AS (SELECT pre FROM p GROUP BY pre HAVING count(*) >= 2)
SELECT page_id AS id, cand, arg_max(pre, k) AS target FROM p JOIN dict USING (pre) GROUP BY page_id, cand""")
def longest_prefix_link(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(".")).alias("cand"))
    parts = F.split("cand", "[.]", -1)
    pre = u.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))).alias("name"))
    return L.longest_prefix_link(u, pre.groupBy("name").agg(F.count("*").alias("n")).filter("n >= 2"))


@query("""SELECT p.o_orderkey AS id, arg_min(s.o_orderkey, (s.o_custkey % 50) * 10000000000 + s.o_orderkey) AS span
FROM orders p JOIN orders s ON p.o_orderpriority = s.o_orderpriority AND p.o_orderkey BETWEEN s.o_orderkey AND s.o_orderkey + s.o_custkey % 50 GROUP BY 1""")
def innermost_span(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    points = o.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("id"))
    spans = o.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.col("o_custkey") % 50).alias("hi"), F.col("o_orderkey").alias("span"), F.col("o_orderkey").alias("ord"))
    return L.innermost_span(points, spans)


@query("""WITH sp AS (SELECT o_orderpriority AS grp, o_orderkey AS lo, o_orderkey + o_custkey % 20 AS hi, o_orderkey AS span FROM orders),
it AS (SELECT l_orderkey * 10 + l_linenumber AS id, o_orderpriority AS grp, l_orderkey AS pos, l_shipdate IS NOT NULL AND l_partkey % 5 = 0 AS is_test, l_partkey % 2 = 0 AS inside
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
ex AS (SELECT grp, lo AS pos, min(span) AS target FROM sp WHERE lo % 3 = 0 GROUP BY 1, 2),
ar AS (SELECT it.id, arg_min(span, (hi - lo) * 10000000000 + span) AS around FROM it JOIN sp ON it.grp = sp.grp AND pos BETWEEN lo AND hi GROUP BY 1)
SELECT it.id, CASE WHEN target IS NOT NULL THEN 'sym' WHEN is_test THEN 'test' WHEN around IS NOT NULL THEN 'sym' WHEN inside THEN 'local' ELSE 'ext' END AS kind,
  CASE WHEN target IS NOT NULL THEN target WHEN is_test THEN NULL ELSE around END AS target
FROM it LEFT JOIN ex USING (grp, pos) LEFT JOIN ar USING (id)""")
def classify(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    spans = o.select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + F.col("o_custkey") % 20).alias("hi"), F.col("o_orderkey").alias("span"), F.col("o_orderkey").alias("ord"))
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey").join(o.select("o_orderkey", F.col("o_orderpriority").alias("grp")), "o_orderkey")
    items = items.select((F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "grp", F.col("o_orderkey").alias("at"), (F.col("l_partkey") % 5 == 0).alias("is_test"), (F.col("l_partkey") % 2 == 0).alias("inside"))
    exact = spans.filter("lo % 3 = 0").select("grp", F.col("lo").alias("at"), F.col("span").alias("target"))
    return L.classify(items, exact, spans, F.col("is_test"), F.col("inside")).select("id", "kind", "target")


_BENCH = """WITH bw AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS name FROM benchmark),
rare AS (SELECT name, count(*) AS n FROM bw WHERE length(name) >= 8 AND NOT starts_with(name, '__') GROUP BY name HAVING count(*) <= 2)
"""


def _words(text) -> F.Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bench_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(_words("text"))).alias("name")).distinct()


@query(_BENCH + "SELECT name, n FROM rare")
def rare_names(spark: SparkSession, d: str) -> DataFrame:
    return L.rare_names(_bench_words(spark, d), "name", 8, 2)


@query(_BENCH + """, w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS name FROM documents)
SELECT doc_id, name FROM w JOIN rare USING (name)""")
def mention_words(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "documents").select(F.col("doc_id").alias("src"), F.explode(F.array_distinct(_words("text"))).alias("name"))
    names = L.rare_names(_bench_words(spark, d), "name", 8, 2).select("name", F.col("name").alias("id"))
    return L.name_link(uses, names).select(F.col("src").alias("doc_id"), F.col("id").alias("name"))


@query(_BENCH + """, ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
w AS (SELECT doc_id, i, l, unnest(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS name FROM ln)
SELECT doc_id AS doc, name AS id, min(i) AS line, substr(trim(arg_min(l, i)), 1, 200) AS text FROM w JOIN rare USING (name) GROUP BY 1, 2""")
def first_mention(spark: SparkSession, d: str) -> DataFrame:
    ln = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).select("doc", (F.col("i") + 1).cast("bigint").alias("line"), "text")
    names = L.rare_names(_bench_words(spark, d), "name", 8, 2).select("name", F.col("name").alias("id"))
    out = L.mention_link(ln, names, F.array_distinct(_words("text")))
    return out.select("doc", "id", "line", T.cut(F.col("text"), T.DOC_CHARS).alias("text"))


@query(_BENCH + """, t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'see ' || chr(96) || w || chr(96) || ' for ' || w ELSE 'call ' || chr(96) || w || '(x)' || chr(96) || ' here' END AS line
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents))
SELECT t.doc_id, count(DISTINCT name) AS names FROM t JOIN rare ON contains(t.line, chr(96) || name || chr(96)) OR contains(t.line, chr(96) || name || '(') GROUP BY 1""")
def ticked_mentions(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(_words("text"))).alias("w"))
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see `"), "w", F.lit("` for "), "w")).otherwise(F.concat(F.lit("call `"), "w", F.lit("(x)` here")))
    t = w.select("doc_id", F.explode(L.ticked_tokens(line)).alias("name"))
    return t.join(L.rare_names(_bench_words(spark, d), "name", 8, 2).select("name"), "name").groupBy("doc_id").agg(F.count_distinct("name").alias("names"))


@query(_BENCH + """, u AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS name FROM conversations)
SELECT DISTINCT conv_id, item_id FROM u JOIN rare USING (name) JOIN bw USING (name)""")
def name_link(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "conversations").select(F.col("conv_id").alias("src"), F.explode(_words(F.coalesce("text", F.lit("")))).alias("name"))
    bw = _bench_words(spark, d)
    names = bw.join(L.rare_names(bw, "name", 8, 2).select("name"), "name", "left_semi").select("name", F.col("item_id").alias("id"))
    return L.name_link(uses, names).select(F.col("src").alias("conv_id"), F.col("id").alias("item_id"))


@query("""WITH sym AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS name FROM benchmark),
rare AS (SELECT name FROM sym WHERE length(name) >= 5 AND NOT starts_with(name, '__') GROUP BY name HAVING count(*) <= 3),
u AS (SELECT conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS name FROM conversations WHERE role = 'user'),
h AS (SELECT DISTINCT item_id || ':' || name AS id, CAST(conv_id AS VARCHAR) AS file, 'test_' || turn AS t FROM u JOIN sym USING (name) JOIN rare USING (name)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, file ORDER BY t) AS i FROM h)
SELECT id, file, string_agg(t, ',' ORDER BY t) AS names FROM r WHERE i <= 6 GROUP BY id, file""")
def tests_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The build's links of tests by rare names: benchmark words as symbols, users' turns as test functions, other turns as helpers."""
    symbols = _bench_words(spark, d).select(F.concat_ws(":", "item_id", "name").alias("id"), "name")
    test = F.concat(F.when(F.col("role") == "user", "test_").otherwise("helper_"), F.col("turn").cast("string"))
    tests = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), test.alias("test"), _words(F.coalesce("text", F.lit(""))).alias("used"))
    return R.tests_by_name(tests, symbols).select("id", F.explode("tests").alias("t")).select("id", "t.file", F.array_join("t.names", ",").alias("names"))


_NAMED = """WITH m AS (SELECT DISTINCT item_id || ':' || name AS id, name FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS name FROM benchmark)),
u AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS src, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS name FROM documents),
e AS (SELECT src, id FROM u JOIN m USING (name))
"""


def _named(spark: SparkSession, d: str) -> NamedEdges:
    """Documents use words, each word of a benchmark item is a member of that name: frequent words have a third of all uses and many members."""
    uses = table(spark, d, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("src"), F.explode(F.array_distinct(_words("text"))).alias("name"))
    return NamedEdges(uses, _bench_words(spark, d).select("name", F.concat_ws(":", "item_id", "name").alias("id")))


@query(_NAMED + "SELECT id, count(*) AS n_in FROM e GROUP BY id")
def named_callers(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).callers()


@query(_NAMED + "SELECT src, count(*) AS n_out FROM e GROUP BY src")
def named_callees(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).callees()


@query(_NAMED + "SELECT id, src, rank FROM (SELECT id, src, CAST(row_number() OVER (PARTITION BY id ORDER BY src) AS INTEGER) AS rank FROM e) WHERE rank <= 12")
def named_first_callers(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve sources of each member: the build's cap on callers."""
    return _named(spark, d).first_callers(R.CALLERS_ELSEWHERE)


@query("""SELECT c.c_custkey AS id, s.s_suppkey AS target FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey WHERE c.c_custkey <> s.s_suppkey""")
def name_equi_link(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("name"))
    return L.name_equi_link(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("name"))).select("id", "target")


@query("""WITH e AS (SELECT l_suppkey AS dst, l_partkey AS src, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2)
SELECT dst, string_agg(CAST(src AS VARCHAR), ',' ORDER BY o, src) AS sources FROM e GROUP BY dst""")
def reverse_adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_orderkey").alias("o"))
    return L.reverse_adjacency(e, "o").select("dst", F.array_join("sources", ",").alias("sources"))


# ------------------------------------------------------------------ incremental maintenance

_OLD_NEW = """o AS (SELECT o_orderkey AS k, o_totalprice AS h FROM orders WHERE o_orderkey % 11 <> 0),
n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS h FROM orders WHERE o_orderkey % 13 <> 0),
df AS (SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'gone' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'same' ELSE 'changed' END AS status
  FROM o FULL OUTER JOIN n ON o.k = n.k)"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("h"))
    new = o.filter("k % 13 <> 0").withColumn("h", F.when(F.col("k") % 7 == 0, F.col("h") + 1).otherwise(F.col("h")))
    return I.snapshot_diff(o.filter("k % 11 <> 0"), new, "k", "h")


@query(f"WITH {_OLD_NEW} SELECT k, status FROM df")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d)


@query(f"WITH {_OLD_NEW} SELECT k, status FROM df WHERE status <> 'same'")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """The same change as in snapshot_diff, between two kept snapshots."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("h"))
    new = o.filter("k % 13 <> 0").withColumn("h", F.when(F.col("k") % 7 == 0, F.col("h") + 1).otherwise(F.col("h")))
    at = f"{own_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    S.write_snapshot(o.filter("k % 11 <> 0"), "k", "h", f"{at}/old", 16, 4)
    S.write_snapshot(new, "k", "h", f"{at}/new", 16, 4)
    return S.snapshot_changes(spark, f"{at}/old", f"{at}/new").select(F.col("key").alias("k"), "status")


@query("""SELECT o_orderkey AS k, 'changed' AS status FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders)""")
def snapshot_small_change(spark: SparkSession, d: str) -> DataFrame:
    """One changed row: one part of each snapshot is read."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("h"))
    last = o.agg(F.max("k").alias("_last"))
    new = o.join(F.broadcast(last), F.col("k") == F.col("_last"), "left").select("k", F.when(F.col("_last").isNotNull(), F.col("h") + 1).otherwise(F.col("h")).alias("h"))
    at = f"{own_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    S.write_snapshot(o, "k", "h", f"{at}/old", 16, 4)
    S.write_snapshot(new, "k", "h", f"{at}/new", 16, 4)
    return S.snapshot_changes(spark, f"{at}/old", f"{at}/new").select(F.col("key").alias("k"), "status")


@query("""WITH f AS (SELECT doc_id, quality, toxic, 1 AS p FROM labels UNION ALL SELECT doc_id, 1 - quality, toxic, 2 FROM labels WHERE doc_id % 3 = 0),
l AS (SELECT doc_id, arg_max(quality, p) AS quality, arg_max(toxic, p) AS toxic FROM f GROUP BY doc_id)
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN l USING (doc_id)""")
def merge_facts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(1).alias("p"))
    b = a.filter("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), "toxic", F.lit(2).alias("p"))
    return I.merge_facts(table(spark, d, "documents").select("doc_id", "lang"), a.unionByName(b), "doc_id", ["quality", "toxic"], F.col("p"))


@query(ORACLE["merge_facts"])
def merge_facts_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same merge by a stream that is run twice: the second time on corrections, and on late facts that it drops."""
    at = f"{own_folder(spark)}/facts-{uuid.uuid4().hex}"
    first = table(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit("a").alias("file"), F.lit(1).cast("long").alias("n"))
    corrected = first.filter("doc_id % 3 = 0").withColumns({"quality": 1 - F.col("quality"), "n": F.lit(2).cast("long")})
    late = first.filter("doc_id % 2 = 0").withColumns({"quality": F.lit(9), "n": F.lit(0).cast("long")})
    for new in (first, corrected.unionByName(late)):
        new.write.mode("append").parquet(f"{at}/in")
        follow(spark.readStream.schema(first.schema).parquet(f"{at}/in"), "doc_id", ["quality", "toxic"], f"{at}/changes", f"{at}/checkpoint").awaitTermination()
    last = kept(spark, f"{at}/checkpoint", "doc_id", StructType([first.schema[c] for c in ("quality", "toxic")])).select("doc_id", "quality", "toxic")
    return table(spark, d, "documents").select("doc_id", "lang").join(last, "doc_id", "left")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def resume(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.resume(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("""SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
AND l_partkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def carry_over(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return I.carry_over(e, table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id")))


@query("""WITH c AS (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P') SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM c)""")
def impact_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst"))
    changed = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    parts = I.neighbours(e, changed).filter("id < 0")
    return I.neighbours(e, parts).filter("id >= 0")


@query("""SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 7)""")
def shadow_set(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return I.shadow_set(e, part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")), part.filter("p_size = 7").select(F.col("p_brand").alias("name")))


@query(f"""WITH {_OLD_NEW}, a_new AS (SELECT k FROM df WHERE status IN ('new', 'changed')), a_old AS (SELECT k FROM df WHERE status IN ('gone', 'changed')),
e AS (SELECT l_orderkey AS src, o_orderkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_partkey), alive AS (SELECT k FROM n),
nb AS (SELECT dst AS k FROM e WHERE src IN (SELECT k FROM a_old) UNION SELECT src FROM e WHERE dst IN (SELECT k FROM a_old)),
sh AS (SELECT DISTINCT src AS k FROM e JOIN orders ON dst = o_orderkey WHERE o_custkey IN (SELECT o_custkey FROM orders JOIN df ON k = o_orderkey WHERE status IN ('new', 'gone'))),
w1 AS (SELECT k FROM a_new UNION SELECT k FROM (SELECT k FROM nb UNION SELECT k FROM sh) JOIN alive USING (k)),
w2 AS (SELECT DISTINCT dst AS k FROM e WHERE src IN (SELECT k FROM a_new) AND dst NOT IN (SELECT k FROM w1))
SELECT k AS id, 1 AS wave FROM w1 UNION ALL SELECT k, 2 FROM w2""")
def impact_set(spark: SparkSession, d: str) -> DataFrame:
    # What several steps read is written once; the plan stays small.
    df = keep(_diff(spark, d))
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    a_new, a_old = df.filter("status IN ('new', 'changed')").selectExpr("k AS id"), df.filter("status IN ('gone', 'changed')").selectExpr("k AS id")
    e = li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("o_orderkey")).join(o.select("o_orderkey"), "o_orderkey").select("src", F.col("o_orderkey").alias("dst"))
    e = keep(e)
    name_of = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("name"))
    moved = df.filter("status IN ('new', 'gone')").selectExpr("k AS id").join(name_of, "id").select("name")
    alive = o.filter("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("id"))
    near = I.neighbours(e, a_old).unionByName(I.shadow_set(e, name_of, moved)).distinct().join(alive, "id", "left_semi")
    first = keep(a_new.unionByName(near).distinct())
    second = e.join(a_new.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(first, "id", "left_anti")
    return first.withColumn("wave", F.lit(1)).unionByName(second.withColumn("wave", F.lit(2)))


@query("""WITH l AS (SELECT user_id AS id, event_type AS file, event_id % 100 AS name FROM events),
near AS (SELECT * FROM l WHERE file IN (SELECT min(event_type) FROM events))
SELECT id FROM near GROUP BY id, file HAVING count(*) >= 6 UNION SELECT id FROM near WHERE name < 3""")
def suspect_links(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    links = e.select(F.col("user_id").alias("id"), F.col("event_type").alias("file"), (F.col("event_id") % 100).alias("name"))
    return I.suspect_links(links, e.agg(F.min("event_type").alias("file")), spark.range(3).select(F.col("id").alias("name")), 6)


@query("""WITH ot AS (SELECT l_orderkey AS file, l_linenumber AS qual, l_quantity AS hash, l_partkey AS name FROM lineitem WHERE l_partkey % 9 <> 0),
nt AS (SELECT l_orderkey AS file, l_linenumber AS qual, CASE WHEN l_partkey % 8 = 0 THEN l_quantity + 1 ELSE l_quantity END AS hash, l_partkey AS name FROM lineitem WHERE l_partkey % 10 <> 0),
j AS (SELECT coalesce(ot.file, nt.file) AS file, coalesce(ot.qual, nt.qual) AS qual, coalesce(nt.name, ot.name) AS name,
  CASE WHEN ot.file IS NULL THEN 'new' WHEN nt.file IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM ot FULL OUTER JOIN nt ON ot.file = nt.file AND ot.qual = nt.qual WHERE ot.hash IS DISTINCT FROM nt.hash)
SELECT CAST(file AS VARCHAR) AS file, CAST(qual AS VARCHAR) AS qual, CAST(name AS VARCHAR) AS name, change FROM j
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, NULL, 'rest' FROM orders WHERE o_orderkey % 17 = 0""")
def table_diff(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").cast("string").alias("qual"), F.col("l_quantity").alias("hash"), F.col("l_partkey").alias("p"), F.col("l_partkey").cast("string").alias("name"))
    old, new = li.filter("p % 9 <> 0").drop("p"), li.filter("p % 10 <> 0").withColumn("hash", F.when(F.col("p") % 8 == 0, F.col("hash") + 1).otherwise(F.col("hash"))).drop("p")
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.lit("a").alias("rest"), F.col("o_orderkey").alias("k"))
    return I.table_diff(old, new, o.select("file", "rest"), o.select("file", F.when(F.col("k") % 17 == 0, "b").otherwise("a").alias("rest")))


@query("""WITH RECURSIVE m AS (SELECT c_nationkey AS k, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS r FROM customer GROUP BY 1),
w AS (SELECT 0::BIGINT AS r, NULL::INTEGER AS k, [0, 0, 0, 0]::BIGINT[] AS load, NULL::INTEGER AS shard
  UNION ALL SELECT m.r, m.k, list_transform(w.load, lambda x, i: CASE WHEN i = list_position(w.load, list_min(w.load)) THEN x + m.n ELSE x END), CAST(list_position(w.load, list_min(w.load)) - 1 AS INTEGER)
  FROM w JOIN m ON m.r = w.r + 1)
SELECT CAST(k AS VARCHAR) AS module, shard FROM w WHERE r > 0""")
def balanced_assign(spark: SparkSession, d: str) -> DataFrame:
    sizes = [(str(k), n) for k, n in table(spark, d, "customer").groupBy("c_nationkey").count().orderBy("c_nationkey").collect()]  # one row per nation
    return spark.createDataFrame(sorted(I.balanced_assign(sizes, 4).items()), "module string, shard int")


@query("""SELECT 'appeared' AS what, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"appeared": c.distinct().join(s.distinct(), "k", "left_anti"), "union": c.union(s).distinct(), "both": c.distinct().join(s, "k", "left_semi")}
    out = None
    for name, x in parts.items():
        one = x.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ scalar functions and filters

@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[.]html$', '.py') AS rel FROM pages)
SELECT page_id, replace(regexp_replace(rel, '((^|/)__init__)?[.]py$', ''), '/', '.') AS module_id,
  CASE WHEN contains(replace(regexp_replace(rel, '((^|/)__init__)?[.]py$', ''), '/', '.'), '.') THEN regexp_replace(replace(regexp_replace(rel, '((^|/)__init__)?[.]py$', ''), '/', '.'), '[.][^.]*$', '') ELSE rel END AS package,
  regexp_extract(rel, '[^/]*$') AS base, contains('/' || rel, '/de/') AS skipped, rel = 'x' OR starts_with(rel, 'tionsh.example.net/en/') AS is_test FROM p""")
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    rel = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[.]html$", ".py")
    p = table(spark, d, "pages").select("page_id", rel.alias("rel"))
    mid = T.module_id(F.col("rel"))
    return p.select(
        "page_id", mid.alias("module_id"), T.package_of(mid).alias("package"), T.base_name(F.col("rel")).alias("base"), T.is_skipped(F.col("rel"), ["/de/"]).alias("skipped"),
        T.is_test_path(F.col("rel"), ["x", "tionsh.example.net/en/"]).alias("is_test"),
    )


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, len(ls) AS loc, substr(sha1(array_to_string(ls[2:5], chr(10))), 1, 12) AS h,
  CASE WHEN len(ls[2:5]) > 2 THEN array_to_string(ls[2:3], chr(10)) || chr(10) || '    # ... ' || CAST(len(ls[2:5]) - 2 AS VARCHAR) || ' more lines' ELSE array_to_string(ls[2:5], chr(10)) END AS code,
  substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 120) AS subject, starts_with(text, '_') AND NOT starts_with(text, '__') AS private FROM l""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    t, two, five = F.col("text"), F.lit(2), F.lit(5)
    return table(spark, d, "documents").select("doc_id", T.loc(t).cast("bigint").alias("loc"), T.source_hash(t, two, five).alias("h"), T.snippet(t, two, five, 2).alias("code"), T.cut(t, T.SUBJECT_CHARS).alias("subject"), T.is_private(t).alias("private"))


@query("""SELECT page_id, row_number() OVER (ORDER BY string_split(url, '/'), page_id) AS ord FROM pages""")
def scan_order(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", T.scan_order(F.col("url")).alias("key"))
    return P.numbered(pages, ["key", "page_id"], "ord", keep).select("page_id", "ord")


@query("""SELECT doc_id, CASE WHEN contains(text, ' ') THEN substr(text, 1, strpos(text, ' ') - 1) ELSE text END AS name, strpos(substr(text, 6), 'th') AS at5,
  CASE WHEN strpos(substr(text, 6), 'th') > 0 THEN strpos(substr(text, 6), 'th') + 4 ELSE 5 END AS col FROM documents""")
def name_columns(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.substring_index(t, " ", 1).alias("name"), F.instr(F.substring(t, 6, 2**31 - 1), "th").cast("bigint").alias("at5"), T.name_column(t, F.lit("th"), F.lit(5)).cast("bigint").alias("col"))
