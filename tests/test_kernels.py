"""Kernels on small hand-made or random tables, against plain Python."""

from __future__ import annotations

import ast
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corbel.functions import text as T
from corbel.layout import Layout
from corbel.operators import incremental as I
from corbel.operators import links as L
from corbel.operators import pairs as P
from corbel.plans import model as M
from corbel.plans import registry
from corbel.sources.gitlog import parse_log
from corbel.sources.parse import import_candidates, rows_of
from corbel.sources.tree import read_tree


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pairs_guard_and_ties(spark):
    rng = random.Random(1)
    data = [(b, f"f{rng.randint(0, 9)}") for b in range(60) for _ in range(rng.randint(1, 5))] + [(99, f"f{i}") for i in range(26)]
    df = spark.createDataFrame(data, "b long, i string")
    sets = defaultdict(set)
    for b, i in data:
        sets[b].add(i)
    want = Counter(p for s in sets.values() if 2 <= len(s) <= 25 for p in itertools.combinations(sorted(s), 2))
    got = P.pair_counts(df, "b", "i", 2, 25, 3)
    assert rows(got) == sorted(((a, b, n) for (a, b), n in want.items() if n >= 3), key=str)
    top = defaultdict(list)
    for (a, b), n in want.items():
        if n >= 3:
            top[a].append((n, b)), top[b].append((n, a))
    expect = {a: [(n, b) for n, b in sorted(v, reverse=True)[:6]] for a, v in top.items()}
    have = defaultdict(dict)
    for a, b, n, r in P.topk_related(got, 6).collect():
        have[a][r] = (n, b)
    assert {a: [v[k] for k in sorted(v)] for a, v in have.items()} == expect


def test_innermost_span_random(spark):
    rng = random.Random(2)
    spans = [(rng.choice("ab"), s := rng.randint(0, 200), s + rng.randint(0, 90), f"s{k}", k) for k in range(60)]
    points = [(rng.choice("ab"), rng.randint(0, 250), k) for k in range(200)]
    got = dict(L.innermost_span(spark.createDataFrame(points, "grp string, at long, id long"), spark.createDataFrame(spans, "grp string, lo long, hi long, span string, ord long"), 16).collect())
    for g, at, k in points:
        hit = [(hi - lo, o, s) for gg, lo, hi, s, o in spans if gg == g and lo <= at <= hi]
        assert got.get(k) == (min(hit)[2] if hit else None)


def test_longest_prefix_passes_itself(spark):
    c = spark.createDataFrame([("a.b", "a.b.c"), ("x", "a.b.c.d"), ("a.b", "zz")], "id string, cand string")
    d = spark.createDataFrame([("a",), ("a.b",)], "name string")
    assert rows(L.longest_prefix_link(c, d, ".", "id")) == [("a.b", "a.b.c", "a"), ("x", "a.b.c.d", "a.b")]


def test_ticked_tokens_equal_contains(spark):
    rng = random.Random(3)
    names = ["ab", "abc", "b", "f"]
    lines = ["".join(rng.choice(["`", "(", ")", " ", *names]) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select("l", L.ticked_tokens(F.col("l"))).collect()
    for line, tokens in got:
        assert {n for n in names if f"`{n}`" in line or f"`{n}(" in line} == set(tokens) & set(names)


def test_snapshot_diff_nulls(spark):
    o = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "k long, h string")
    n = spark.createDataFrame([(1, "b"), (2, None), (4, "x"), (5, None)], "k long, h string")
    assert dict(I.snapshot_diff(o, n, "k", "h").collect()) == {1: "changed", 2: "same", 3: "gone", 4: "changed", 5: "new"}


def test_merge_caps_and_assignment(spark):
    base = spark.createDataFrame([("a",), ("b",)], "id string")
    facts = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("z", 3, 2)], "id string, v int, p int")
    assert rows(I.merge_facts(base, facts, "id", ["v"], F.col("p"))) == [("a", 2), ("b", None)]
    got = P.capped_sets(spark.createDataFrame([("k", x) for x in "ggfedcba"], "k string, v string"), ["k"], "v", 6).first()
    assert got["vals"] == list("abcdef")
    assert I.balanced_assign([("a", 1), ("b", 5), ("c", 3), ("d", 3)], 2) == {"b": 0, "c": 1, "d": 1, "a": 0}


def test_table_diff(spark):
    s = "file string, qual string, hash string, name string"
    old = spark.createDataFrame([("f", "a", "1", "a"), ("f", "b", "1", "b")], s)
    new = spark.createDataFrame([("f", "a", "2", "a"), ("g", "c", "1", "c")], s)
    rest = "file string, rest string"
    got = I.table_diff(old, new, spark.createDataFrame([("f", "x")], rest), spark.createDataFrame([("f", "y"), ("g", "z")], rest))
    assert rows(got.select("file", "name", "change")) == sorted([("f", "a", "changed"), ("f", "b", "removed"), ("g", "c", "new"), ("f", None, "rest"), ("g", None, "rest")], key=str)


def test_text_functions(spark):
    df = spark.createDataFrame([("src/a/__init__.py",), ("src/a/b.py",), ("c.py",)], "p string")
    mid = T.module_id(F.col("p"), "src")
    assert [tuple(r) for r in df.select(mid, T.package_of(mid)).collect()] == [("a", "a"), ("a.b", "a"), ("c", "c")]
    t = spark.createDataFrame([("\t xé\r\n1\n2\n",)], "t string").select(T.strip(F.col("t")), T.loc(F.col("t")), T.snippet(F.col("t"), F.lit(1), F.lit(3), 2), T.is_private(F.lit("_a")), T.is_private(F.lit("__a"))).first()
    assert tuple(t) == ("xé\r\n1\n2", 4, "\t xé\n1\n    # ... 1 more lines", True, False)


def test_source_tree_reads_underscored(spark, tmp_path):
    for n in ("a/__init__.py", "a/_p.py", "a/b/.h.py", "a-b/c.py", "a/_pb2.py"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x = 1\xff\n")
    got = read_tree(spark, tmp_path, ["."], skips=("_pb2.py",)).orderBy("ord")
    assert [r["path"] for r in got.collect()] == ["a/__init__.py", "a/_p.py", "a/b/.h.py", "a-b/c.py"]


def test_parse_edges(spark, tmp_path):
    code = b"import p.q as z\nfrom . import w\nfrom .... import no\nA = B = 1\nclass C(G[x.Y]):\n    @d\n    def e(self): f(); x.g()\nif 1:\n    def hidden(): pass\ndef e(): pass\ndef e(): h()\n"
    got = list(rows_of("p/m.py", code, "p.m", "p", False))
    mod = next(d for k, d in got if k == "module")
    assert mod["symbols"] == ["p.m.C", "p.m.C.e", "p.m.e"] and [c["name"] for c in mod["consts"]] == ["A", "B"]
    assert [d["cand"] for k, d in got if k == "import"] == ["p", "p.q", "p.w"]
    sym = [d for k, d in got if k == "symbol"]
    assert [(s["qual"], s["line"], s["first"]) for s in sym] == [("C", 5, 5), ("C.e", 7, 6), ("e", 10, 10), ("e", 11, 11)]
    assert {(d["src"], d["name"]) for k, d in got if k == "call"} == {("p.m.C.e", "f"), ("p.m.C.e", "g"), ("p.m.e", "h")}
    assert list(rows_of("p/x.py", b"def (", "p.x", "p", False)) == [] and list(rows_of("t.py", b"def (", "t", "p", True)) == [("rest", {"file": "t.py", "rest": "syntax-error", "names": []})]
    assert import_candidates(ast.parse("from .. import y"), "p.q.r", False, "") == ["p", "p.y"]
    kinds = [d for k, d in rows_of("t.py", b"match 1:\n  case 1:\n    def test_a(): q()\nfor x in y: pass\nelse:\n  if 1:\n    def test_b(): pass\n", "t", "p", True) if k == "func"]
    assert [d["qual"] for d in kinds] == ["test_a", "test_b"]
    # Positions become columns in the build.
    (tmp_path / "p").mkdir()
    (tmp_path / "p/m.py").write_bytes(code)
    tree = M.read_code(spark, tmp_path, Layout("p", ".", "p"))
    cols = {(r["qual"], r["line"]): (r["col"], r["code"], r["h"] != r["hx"], r["private"]) for r in tree.symbols.collect()}
    assert cols[("C.e", 7)] == (8, "    def e(self): f(); x.g()", True, False) and cols[("C", 5)][0] == 6 and cols[("e", 11)] == (4, "def e(): h()", False, False)


def test_rest_of_a_test_file():
    """What changes outside functions changes the digest, what changes inside doesn't."""
    rest = lambda t: next(d["rest"] for k, d in rows_of("t.py", t.encode(), "t", "p", True) if k == "rest")
    base = "import a\nclass T(b.C):\n    x = 1\n    def test_a(self): return 1\nfor i in r:\n    def test_b(): pass\ntry:\n    u()\nexcept E:\n    v()\n"
    for old, new in (("return 1", "return 2"), ("test_b(): pass", "test_b(): q()"), ("self", "me")):
        assert rest(base.replace(old, new)) == rest(base)
    for old, new in (("x = 1", "x = 2"), ("b.C", "b.D"), ("in r", "in s"), ("u()", "w()"), ("except E", "except F"), ("import a", "import a2"), ("v()", "v(1)")):
        assert rest(base.replace(old, new)) != rest(base)


def test_path_link_is_contains(spark):
    rng = random.Random(8)
    paths = ["a.py", "p/a.py", "p/q/ab.py", "q/b.py", "b.py", "p/x.py.py", "é/c d.py", ".py", "p/.py"]
    bits = [*paths, "p/", "a", "b", ".py", "/", " ", "x", "see ", "`"]
    lines = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 6))), k) for k in range(400)]
    got = L.path_link(spark.createDataFrame(lines, "text string, line long"), spark.createDataFrame(list(enumerate(paths)), "id long, path string"))
    assert sorted((r["line"], r["id"]) for r in got.collect()) == sorted((k, i) for t, k in lines for i, p in enumerate(paths) if p in t)


def test_parse_log():
    text = "\x1eab\x1f2024-01-02\x1fA|B\x1fone|two\n\nx.py\ny.py\n\x1ecd\x1f2024-01-01\x1fC\x1f\n"
    assert parse_log(text) == [(0, "ab", "2024-01-02", "A|B", "one|two", ["x.py", "y.py"]), (1, "cd", "2024-01-01", "C", "", [])]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries_match_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    df = registry.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    got = sorted((tuple(map(str, r)) for r in df.select(*cols).collect()))
    if name not in registry.ORACLE:
        assert got
        return
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE[name]}) q").fetchall()
    assert got == sorted(tuple(map(str, r)) for r in want)


FAKE_SERVER = r'''
import json, sys
def read():
    n = 0
    while (line := sys.stdin.buffer.readline()) not in (b"\r\n", b""):
        if line.lower().startswith(b"content-length"): n = int(line.split(b":")[1])
    return json.loads(sys.stdin.buffer.read(n)) if n else None
def send(x):
    b = json.dumps(x).encode(); sys.stdout.buffer.write(b"Content-Length: %d\r\n\r\n" % len(b) + b); sys.stdout.buffer.flush()
root = None
def item(rel, line, name): return {"uri": root + "/" + rel if rel else "file:///usr/lib/x.py", "name": name, "selectionRange": {"start": {"line": line - 1, "character": 0}}}
while m := read():
    if "id" not in m: continue
    p, r = m["params"], []
    if m["method"] == "initialize": root, r = p["rootUri"], {}
    elif m["method"].endswith("prepareCallHierarchy"): r = [{"line": p["position"]["line"] + 1}]
    elif m["method"].endswith("incomingCalls") and p["item"]["line"] == 15: r = [{"from": i} for i in (item("tests/test_rates.py", 4, "test_discount"), item("src/orchard/trees/species.py", 36, "<lambda>"), item("setup.py", 3, "main"))]
    elif m["method"].endswith("outgoingCalls") and p["item"]["line"] == 15:
        send({"jsonrpc": "2.0", "id": 900, "method": "workspace/configuration", "params": None})
        assert read()["id"] == 900
        r = [{"to": i} for i in (item(None, 1, "len"), item("src/orchard/pricing/rates.py", 10, "rounded"))]
    send({"jsonrpc": "2.0", "id": m["id"], "result": r})
'''


def test_server_resolver(spark, tmp_path):
    import sys
    from pathlib import Path

    from corbel.plans.model import read_code
    from corbel.plans.resolve import assemble
    from corbel.sources.lsp import ServerResolver
    from corbel.workspace import keep

    (tmp_path / "server.py").write_text(FAKE_SERVER)
    root = Path(__file__).parent / "fixture"
    lay = Layout.detect(root)
    tree = read_code(spark, root, lay, keep)
    raw = ServerResolver(root, lay, (sys.executable, str(tmp_path / "server.py")), 1).resolve(tree, tree.symbols)
    got = {r["id"]: r.asDict(True) for r in assemble(tree.symbols, raw).collect()}
    priced = got["orchard.pricing.rates.discounted"]
    assert priced["calls_in"] == ["orchard.trees.species.AppleTree.worth"] and priced["calls_out"] == ["orchard.pricing.rates.rounded"]
    assert priced["tests"] == [{"file": "tests/test_rates.py", "names": ["test_discount"]}] and priced["calls_out_x"] == ["len"]
    assert priced["calls_in_x"] == [{"name": "main", "at": "setup.py:3"}]
    assert raw.info["requests"] == 1 + 3 * 20 and raw.info["timeouts"] == 0 and raw.info["init_s"] >= 0


def test_kept_tables_and_release(spark):
    from corbel.workspace import keep, last_kept, own_folder, release, scratch

    kept = keep(spark.range(5))
    assert kept.count() == 5 and "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()
    with scratch(spark) as spared:
        gone = keep(spark.range(3))
        left = keep(spark.range(4))
        spared.append(last_kept(spark))
    assert left.count() == 4
    with pytest.raises(Exception, match="(?i)not.?exist|not_exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        gone.collect()
    release(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_ticked_tokens_split_a_line_once(spark):
    line = F.concat(F.lit("see `"), "l", F.lit("` and `"), "l", F.lit("(x)`"))
    df = spark.createDataFrame([("a",), ("",), (None,), ("x`y(z",)], "l string").select("l", F.explode_outer(L.ticked_tokens(line)).alias("t"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    got = defaultdict(list)
    for said, token in df.collect():
        got[said].append(token)
    assert set(got["a"]) == {"a", " and ", "a(x)"} and got[None] == [None]
    assert set(got["x`y(z"]) == {"x", "y(z", " and ", "y(z(x)", "y"}
