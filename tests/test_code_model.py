"""The code model on a small package: hand-derived facts, and the equalities merged = full and incremental = full."""

from __future__ import annotations

import json
import shutil
import subprocess
from pathlib import Path

import pytest

from corbel.build import BuildOptions, build, build_shard, document
from corbel.cli import layout_of, main, parser
from corbel.layout import Layout, LayoutError
from corbel.plans import code_queries, shards
from corbel.plans import model as M
from corbel.plans.resolve import NameResolver
from corbel.sinks import pack, write_document, write_tables

FIXTURE = Path(__file__).parent / "fixture"


@pytest.fixture
def tree(tmp_path):
    shutil.copytree(FIXTURE, tmp_path / "repo")
    return tmp_path / "repo"


def made(spark, root, **more):
    opts = BuildOptions(root, Layout.detect(root), **more)
    return document(build(spark, opts), opts)


def test_a_build_counts_while_it_writes(spark, tree, monkeypatch):
    want = made(spark, tree, tests_by_name=tree)
    monkeypatch.setattr(type(spark.range(1)), "count", lambda self: pytest.fail("a scan for a count"))
    got = made(spark, tree, tests_by_name=tree)["stats"]
    assert (got["modules"], got["symbols"], got["docs"], got["commits_seen"]) == (len(want["modules"]), len(want["symbols"]), len(want["docs"]), 0)
    assert got["call_graph"]["queried"] == len(want["symbols"])
    hit = [s for s in want["symbols"].values() if s["tests"]]
    assert (got["call_graph"]["tests_by_name"]["test_files"], got["call_graph"]["tests_by_name"]["symbols_with_tests"]) == (2, len(hit))


def facts(doc):
    return {k: {c: s[c] for c in ("calls_in", "calls_out", "tests")} for k, s in doc["symbols"].items()}


def test_layout():
    lay = Layout.detect(FIXTURE)
    assert lay == Layout("src/orchard", "src", "orchard", ("tests",))
    assert lay.is_test("tests/unit/test_harvest.py") and not lay.is_test("tests2/x.py")
    assert lay.skips("src/orchard/__pycache__/x.py") and not lay.skips("src/orchard/trees/species.py")


def test_layout_errors(tmp_path):
    with pytest.raises(LayoutError):
        Layout.detect(tmp_path)
    for n in ("one", "two"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "__init__.py").touch()
    with pytest.raises(LayoutError):
        Layout.detect(tmp_path)
    assert main(["build", str(tmp_path)]) == 2
    assert layout_of(parser().parse_args(["build", str(tmp_path), "--pkg-dir", "one", "--module-root", ".", "--import-prefix", "one"])).tests == ()


def test_full_build(spark, tree):
    d = made(spark, tree)
    mods, syms, rates, trees, harvest = d["modules"], d["symbols"], "orchard.pricing.rates", "orchard.trees.species.", "orchard.trees.harvest."
    assert list(mods) == ["orchard", "orchard.pricing", rates, "orchard.trees", "orchard.trees.harvest", "orchard.trees.species"]
    assert {k: m["imports"] for k, m in mods.items() if m["imports"]} == {
        "orchard.pricing": [rates], "orchard.trees.harvest": [rates, "orchard.trees.species"], "orchard.trees.species": [rates],
    }
    assert mods[rates]["imported_by"] == ["orchard.pricing", "orchard.trees.harvest", "orchard.trees.species"]
    assert mods[rates]["consts"] == [{"name": "TARIFF", "line": 5, "value": "{'apple': 1.5, 'pear': 2.0}"}, {"name": "SEASON_START", "line": 6, "value": "9"}]
    assert [mods[m]["loc"] for m in ("orchard", "orchard.trees", "orchard.pricing")] == [2, 1, 6] and mods[rates]["package"] == "orchard.pricing" and mods["orchard"]["package"] == "orchard"
    assert len(syms) == 20 and syms[trees + "Tree"]["subclasses"] == [trees + "AppleTree"] and syms[trees + "AppleTree"]["subclasses"] == [trees + "Espalier"]
    sell = syms[harvest + "Basket.sell_all"]
    assert sell["sig"] == "async sell_all(self) -> float" and sell["col"] == 14 and sell["class"] == harvest + "Basket"
    assert syms[trees + "AppleTree"]["sig"] == "class AppleTree(Tree)" and syms[trees + "AppleTree"]["col"] == 6
    assert syms[trees + "Tree.seedling"]["sig"] == "seedling() -> 'Tree'" and syms[trees + "Tree.bearing"]["decorators"] == ["property"]
    crop = syms[trees + "AppleTree.crop"]
    assert (crop["line"], crop["end"], crop["code"]) == (32, 33, "    def crop(self) -> float:\n        return 40.0 if self.bearing else 0.0") and crop["h"] != crop["hx"]
    assert [k.rpartition(".")[2] for k, x in syms.items() if x["private"]] == ["_weigh_twice"]
    assert crop["calls_in"] == [harvest + "Basket.add", trees + "AppleTree.worth", trees + "Espalier.crop"] and syms[trees + "Espalier.crop"]["calls_out"] == [trees + "AppleTree.crop", trees + "Tree.crop"]
    assert syms[rates + ".discounted"]["calls_in"] == [harvest + "Basket.sell_all", trees + "AppleTree.worth"] and syms[rates + ".discounted"]["calls_out"] == [rates + ".rounded"]
    assert syms[harvest + "gather_baskets"]["calls_out"] == [harvest + "Basket", harvest + "Basket.add", trees + "AppleTree", trees + "Espalier"]
    assert syms[harvest + "gather_baskets"]["tests"] == {"tests/unit/test_harvest.py": ["test_empty_season", "test_gather"]}
    assert mods["orchard.trees.species"]["tests"] == {"tests/unit/test_harvest.py": 4} and mods[rates]["tests"] == {"tests/test_rates.py": 1}
    assert [(h["file"], h["title"], h["line"]) for h in mods[rates]["docs"]] == [("docs/handbook.md", "Handbook", 3)]
    assert mods["orchard.trees.species"]["docs"][0]["line"] == 3 and mods["orchard"]["docs"] == mods["orchard.trees.harvest"]["docs"] == []
    assert {k.rpartition(".")[2]: [h["line"] for h in x["docs"]] for k, x in syms.items() if x["docs"]} == {"discounted": [5], "gather_baskets": [5]}
    assert mods["orchard"]["git"] is None and d["commit"] == ""


def test_merged_shards_equal_full(spark, tree, tmp_path):
    whole, folder = facts(made(spark, tree)), tmp_path / "facts"
    opts = BuildOptions(tree, Layout.detect(tree), facts_dir=folder)
    got = [build_shard(spark, opts, i, 2) for i in (0, 1)]
    assert [g["queried"] for g in got] == [11, 9]
    again = build_shard(spark, opts, 0, 2)
    assert again["queried"] == 0 and again["resumed"] == 11
    merged = made(spark, tree, facts_dir=folder)
    assert facts(merged) == whole and merged["stats"]["call_graph"]["symbols_with_facts"] == 20


class Killed(NameResolver):
    """Ends the shard in its second step."""

    def __init__(self):
        self.steps = 0

    def resolve(self, tree, symbols):
        self.steps += 1
        if self.steps == 2:
            raise RuntimeError("killed")
        return super().resolve(tree, symbols)


def test_a_killed_shard_keeps_what_it_has(spark, tree, tmp_path, monkeypatch):
    whole, folder = facts(made(spark, tree)), tmp_path / "facts"
    monkeypatch.setattr(shards, "STEP", 1)
    opts = BuildOptions(tree, Layout.detect(tree), facts_dir=folder, resolver=Killed())
    with pytest.raises(RuntimeError):
        build_shard(spark, opts, 0, 1)
    opts.resolver, said = NameResolver(), []
    rest = shards.run_shard(spark, M.read_code(spark, tree, opts.layout), opts.resolver, 0, 1, folder, said.append)
    assert 0 < rest["resumed"] < 20 and rest["queried"] + rest["resumed"] == 20
    assert len(said) >= 2 and "20 of 20" in said[-1]
    assert facts(made(spark, tree, facts_dir=folder)) == whole


RATES, SPECIES, HARVEST = "src/orchard/pricing/rates.py", "src/orchard/trees/species.py", "src/orchard/trees/harvest.py"
EDITS = {
    "none": lambda r: None,
    "body": lambda r: _sub(r, RATES, "rounded(cut(price))", "rounded(cut(price), 0.01)"),
    "nested": lambda r: _sub(r, RATES, "p * 0.9", "logged(p) * 0.8"),
    "override": lambda r: _add(r, SPECIES, "\n\nclass Giant(AppleTree):\n    def crop(self) -> float:\n        return rounded(99.0)\n"),
    "rename": lambda r: (_sub(r, RATES, "def rounded(", "def to_step("), _sub(r, RATES, "return rounded(", "return to_step(")),
    "lost": lambda r: _sub(r, RATES, "def rounded(", "def to_step("),
    "moved": lambda r: (r / HARVEST).rename(r / "src/orchard/gathering.py"),
    "property": lambda r: _sub(r, SPECIES, "    @property\n    def bearing(self)", "    def bearing(self)"),
    "new_test": lambda r: _add(r, "tests/test_rates.py", "\n\ndef test_rounded():\n    from orchard.pricing.rates import rounded\n\n    assert rounded(1.01) == 1.0\n"),
    "lost_test": lambda r: _sub(r, "tests/unit/test_harvest.py", "    basket = gather_baskets([])\n    assert basket.kilos == 0.0\n", "    pass\n"),
    "test_import": lambda r: _sub(r, "tests/test_rates.py", "from orchard.pricing import discounted", "import orchard\nfrom orchard.pricing import discounted"),
    "no_tests": lambda r: (r / "tests/unit/test_harvest.py").unlink(),
    "decorator": lambda r: _sub(r, SPECIES, "    @logged\n    def crop", "    @logged\n    @discounted\n    def crop"),
    "new_name_called_before": lambda r: _add(r, RATES, "\n\ndef floor(x):\n    return seedling(x)\n"),
    "broken": lambda r: _add(r, RATES, "\ndef (:\n"),
}


def _sub(root, rel, a, b):
    p = root / rel
    text = p.read_text()
    assert a in text
    p.write_text(text.replace(a, b))


def _add(root, rel, more):
    with (root / rel).open("a") as f:
        f.write(more)


@pytest.mark.parametrize("edit", EDITS)
def test_incremental_equals_full(spark, tree, tmp_path, edit):
    before = BuildOptions(tree, Layout.detect(tree))
    built = build(spark, before)
    write_document(document(built, before), tmp_path / "prev.json")
    write_tables(built.tables(), str(tmp_path / "tables"))
    shutil.copytree(tree, tmp_path / "old")
    EDITS[edit](tree)
    full = made(spark, tree)
    inc = made(spark, tree, prev_data=tmp_path / ("tables" if edit in ("none", "override", "lost") else "prev.json"), prev_root=tmp_path / "old")
    assert facts(inc) == facts(full)
    queried = inc["stats"]["call_graph"]["queried"]
    if edit == "none":
        assert queried == 0
    if edit == "body":
        assert 0 < queried < len(full["symbols"])
    assert {m: x["tests"] for m, x in inc["modules"].items()} == {m: x["tests"] for m, x in full["modules"].items()}


def test_tests_by_name_history_and_cli(spark, tree, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=a|b", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(3):
        (tree / RATES).open("a").write(f"# {k}\n"), (tree / SPECIES).open("a").write(f"# {k}\n")
        git("add", "."), git("commit", "-qm", f"change | {k}")
    d = made(spark, tree, tests_by_name=tree)
    rates = d["modules"]["orchard.pricing.rates"]
    assert d["stats"]["commits_seen"] == 3 and rates["git"]["commits"] == 3 and rates["git"]["subject"] == "change | 2"
    assert rates["cochange"] == [{"file": SPECIES, "n": 3, "module": "orchard.trees.species"}]
    assert {k.rpartition(".")[2] for k, s in d["symbols"].items() if s["tests"]} == {"discounted", "gather_baskets", "seedling"}
    assert len(d["commit"]) == 40
    write_document(d, tmp_path / "data.json")
    n = pack(tmp_path / "data.json", tmp_path / "page.html", "<x>__DATA_B64__</x>")
    import base64
    import gzip

    page = (tmp_path / "page.html").read_text()
    assert n == len(page) and json.loads(gzip.decompress(base64.b64decode(page[3:-4]))) == d
    assert main(["build", str(tree), "--prev-data", "x"]) == 2 and main(["build", str(tree), "--shard", "0/2"]) == 2


@pytest.mark.parametrize("name", sorted(code_queries.ORACLE))
def test_code_queries_match_sql(spark, name):
    import duckdb

    df = code_queries.QUERIES[name](spark, "")
    cols = sorted(df.columns)
    want = duckdb.connect().execute(f"SELECT {', '.join(cols)} FROM ({code_queries.ORACLE[name]}) q").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want) and len(want) > 20
