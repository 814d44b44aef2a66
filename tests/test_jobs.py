"""The jobs over growing copies, after broken runs, and against plain Python."""

from __future__ import annotations

import itertools
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobs import change_report, mention_index
from jobs.common import load_config

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, extra int"
CONFIG = mention_index.Config(carry=("lang", "source"), min_len=4, max_defs=2, buckets=3, files_per_batch=2)
WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "fox", "__golf__", "hotel"]


def plain_index(docs, names):
    out = set()
    for i, (text, lang, source) in docs.items():
        for n in names:
            hit = [(k, x) for k, x in enumerate((text or "").split("\n"), 1) if n in re.findall(r"[^\x20\x09-\x0D]+", x)]
            if hit:
                out.add((i, lang, source, n, hit[0][0], hit[0][1].strip()[:200]))
    return out


def some_docs(rng, ids):
    line = lambda: " ".join(rng.choice(WORDS + ["a", "of"]) for _ in range(rng.randint(0, 5)))
    return {i: (rng.choice([None, "", *["\n".join(line() for _ in range(rng.randint(1, 4))) for _ in range(8)]]), rng.choice("ab"), rng.choice("xy")) for i in ids}


class Feed:
    """A folder of documents that grows, and the index's folders."""

    def __init__(self, spark, tmp, config=CONFIG):
        self.spark, self.tmp, self.config = spark, tmp, config
        self.names(["alpha bravo charlie", "delta echo bravo fox", "bravo __golf__ hotel"])
        spark.createDataFrame([], DOCS).write.parquet(str(tmp / "docs"))

    def names(self, texts):
        self.spark.createDataFrame([(t,) for t in texts], "text string").write.mode("overwrite").parquet(str(self.tmp / "names"))

    def add(self, docs, more=()):
        rows = [(i, *d, 1) for i, d in docs.items()] + list(more)
        self.spark.createDataFrame(rows, DOCS).repartition(3).write.mode("append").parquet(str(self.tmp / "docs"))

    def run(self):
        t = self.tmp
        return mention_index.run(self.spark, str(t / "docs"), str(t / "names"), str(t / "out"), str(t / "mark"), self.config)

    def index(self):
        return Counter(map(tuple, mention_index.read_index(self.spark, str(self.tmp / "out")).collect()))


NAMES = {"alpha", "charlie", "delta", "echo", "hotel"}  # four characters or more, in two texts at most, no __


def test_only_new_files_are_taken_and_later_versions_win(spark, tmp_path):
    rng, feed = random.Random(1), Feed(spark, tmp_path)
    first = some_docs(rng, range(30))
    feed.add(first, [(None, "alpha", "a", "x", 1), (5, *first[5], 2)])  # one without an id, one twice
    got = feed.run()
    assert (got["rows"], got["nameless"]) == (32, 1) and feed.index() == Counter(plain_index(first, NAMES))
    again = feed.run()
    assert (again["rows"], again["batches"]) == (0, 0) and feed.index() == Counter(plain_index(first, NAMES))
    later = some_docs(rng, range(20, 45)) | {3: ("", "a", "x"), 4: (None, "b", "y")}
    feed.add(later)
    assert feed.run()["rows"] == len(later) and feed.index() == Counter(plain_index(first | later, NAMES))


def test_no_documents_at_all(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.run()
    assert feed.index() == Counter()
    feed.add({1: ("alpha", "a", "x")})
    feed.run()
    assert feed.index() == {(1, "a", "x", "alpha", 1, "alpha"): 1}


@pytest.mark.parametrize("where", ["log", "links"])
def test_a_run_that_breaks_is_finished_by_the_next(spark, tmp_path, monkeypatch, where):
    rng, feed = random.Random(2), Feed(spark, tmp_path)
    first = some_docs(rng, range(12))
    feed.add(first)
    feed.run()
    later = some_docs(rng, range(6, 20))
    feed.add(later)
    step = "entries" if where == "log" else "last_versions"
    real = getattr(mention_index, step)

    def broken(*a):
        real(*a).write.mode("overwrite").parquet(str(tmp_path / "half"))
        raise RuntimeError("killed")

    monkeypatch.setattr(mention_index, step, broken)
    with pytest.raises(Exception, match="killed"):
        feed.run()
    monkeypatch.setattr(mention_index, step, real)
    feed.run()
    assert feed.index() == Counter(plain_index(first | later, NAMES))


def test_other_names_start_another_index(spark, tmp_path):
    rng, feed = random.Random(3), Feed(spark, tmp_path)
    docs = some_docs(rng, range(20))
    feed.add(docs)
    before = feed.run()["index"]
    feed.names(["bravo alpha"])
    after = feed.run()
    assert after["index"] != before and after["rows"] == 20 and feed.index() == Counter(plain_index(docs, {"alpha", "bravo"}))
    feed.names(["alpha bravo"])  # the same names
    assert feed.run()["index"] == after["index"]


def test_texts_are_not_shuffled(spark):
    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), spark.createDataFrame([("alpha",)], "name string")
    plan = mention_index.entries(docs, names, CONFIG)._jdf.queryExecution().executedPlan().toString()
    parts = [x for x in plan.split("\n") if "hashpartitioning" in x and "Exchange" in x]
    assert parts and not any("text#" in x.replace("line_text#", "") and "doc#" not in x for x in parts)


def test_job1_equals_its_sql(spark):
    check_sql(spark, "job1_mention_index", ["documents", "benchmark"])


def test_job2_equals_its_sql(spark):
    check_sql(spark, "job2_change_report", ["lineitem", "orders", "part"])


def check_sql(spark, name, tables):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())


def test_report_of_a_small_log(spark, tmp_path):
    rng = random.Random(4)
    commits = [(o, rng.randint(1, 4), datetime(2020, rng.randint(1, 12), 1), rng.choice("OF")) for o in range(40)] + [(None, 1, datetime(2020, 1, 1), "O")]
    changes = [(o, rng.choice([1, 2, 3, 4, 5, 99, None])) for o in range(45) for _ in range(rng.randint(1, 4))] + [(0, p) for p in range(200, 240)]
    modules = [(p, f"m{p}", rng.choice(["A", "B"])) for p in range(1, 8)] + [(8, "m8", None), (1, "a", "A")]
    where = {}
    for name, rows, kind in (("changes", changes, "l_orderkey long, l_partkey long"), ("commits", commits, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string"), ("modules", modules, "p_partkey long, p_name string, p_brand string")):
        where[name] = str(tmp_path / name)
        spark.createDataFrame(rows, kind).write.parquet(where[name])
    config = change_report.Config(support=3, top=2, since="2020-03-01", until="2020-11-01")
    counts = change_report.run(spark, where["changes"], where["commits"], where["modules"], str(tmp_path / "out"), config)
    assert (counts["changes"], counts["modules"]) == (len(changes), len(modules))

    when = {o: (d, o) for o, _, d, _ in commits if o is not None and datetime(2020, 3, 1) <= d < datetime(2020, 11, 1)}
    info = {o: (who, kind) for o, who, _, kind in commits}
    baskets = defaultdict(set)
    for o, p in changes:
        if o in when and p is not None:
            baskets[o].add(p)
    pairs = Counter(x for b in baskets.values() if 2 <= len(b) <= 25 for x in itertools.permutations(b, 2))
    want = Counter()
    for p in {m[0] for m in modules}:
        mine = sorted((when[o], o) for o, b in baskets.items() if p in b)
        name, package = max(m[1] for m in modules if m[0] == p), max((m[2] for m in modules if m[0] == p and m[2]), default=None)
        head = (package, p, name, len(mine), len({info[o][0] for _, o in mine}))
        head += (mine[0][0][0].date(), mine[-1][0][0].date(), info[mine[-1][1]][1]) if mine else (None, None, None)
        near = sorted(((n, b) for (a, b), n in pairs.items() if a == p and n >= 3), reverse=True)[:2]
        for r, (n, b) in enumerate(near, 1):
            want[(*head, r, b, f"m{b}" if b < 9 else None, n)] += 1
        if not near:
            want[(*head, None, None, None, None)] += 1
    columns = ["package", "module", "name", "commits", "authors", "first_date", "last_date", "last_kind", "rank", "partner", "partner_name", "together"]
    read = lambda: Counter(map(tuple, change_report.read_report(spark, str(tmp_path / "out")).select(*columns).collect()))
    assert read() == want
    change_report.run(spark, where["changes"], where["commits"], where["modules"], str(tmp_path / "out"), config)
    assert read() == want and sum(want.values()) == counts["report"]


def test_command_lines(spark, tmp_path):
    run = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=ROOT, capture_output=True, text=True, timeout=300)
    out = run("jobs.change_report", "--changes", f"{SF}/lineitem.parquet", "--commits", f"{SF}/orders.parquet", "--modules", f"{SF}/part.parquet", "--out", str(tmp_path / "r"))
    assert out.returncode == 0 and "wrote" in out.stderr and change_report.read_report(spark, str(tmp_path / "r")).count() > 0
    out = run("jobs.mention_index", "--documents", f"{SF}/documents.parquet", "--names", f"{SF}/benchmark.parquet", "--out", str(tmp_path / "o"), "--checkpoint", str(tmp_path / "c"))
    assert out.returncode == 0 and "rows read" in out.stderr
    assert mention_index.read_index(spark, str(tmp_path / "o")).count() == entry.queries()["job1_mention_index"](spark, SF).count()


def test_settings(tmp_path):
    for name, kind in (("mention_index", mention_index.Config), ("change_report", change_report.Config)):
        assert load_config(kind, ROOT / "jobs" / f"{name}.json")
    (tmp_path / "x.json").write_text('{"tops": 3}')
    with pytest.raises(ValueError, match="tops"):
        load_config(change_report.Config, tmp_path / "x.json")
