"""A whole build: tree to tables and data document."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.layout import Layout
from corbel.operators import links as L
from corbel.plans import model as M
from corbel.plans.incremental import incremental_facts
from corbel.plans.resolve import NameResolver, Resolver, assemble, full_facts, replace_tests, tests_by_name
from corbel.plans.shards import run_shard
from corbel.sinks import SNAPSHOT, rows_of
from corbel.sources.facts import COLUMNS, FILE, apply_facts, from_file, read_facts
from corbel.sources.gitlog import head_commit, read_log
from corbel.sources.parse import of_kind, parse_files
from corbel.sources.tree import read_tree
from corbel.workspace import keep_counted as keep
from corbel.workspace import kept_counts, kept_rows


@dataclass
class BuildOptions:
    root: Path
    layout: Layout
    git_dir: Path | None = None
    name: str | None = None
    call_graph: bool = True
    tests_by_name: Path | None = None
    facts_dir: Path | None = None
    prev_data: Path | None = None
    prev_root: Path | None = None
    resolver: Resolver | None = None


@dataclass
class Built:
    modules: DataFrame
    symbols: DataFrame
    docs: DataFrame
    info: dict

    def tables(self) -> dict[str, DataFrame]:
        return {"modules": self.modules, "symbols": self.symbols, "docs": self.docs}


def _or_empty(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column).cast(kind), F.array().cast(kind)))


def read_previous(spark: SparkSession, data: Path, tree: M.Tree) -> tuple[M.Tree, DataFrame, str | None]:
    """The previous build: its tree, parsed again from its checkout, with the digests and facts that it has kept: in its
    symbols table, if data is a folder of tables or has them beside it, or else in the data document. And its snapshot of digests,
    if there is one."""
    folder, snapshot = data if data.is_dir() else data.parent, None
    if (folder / "symbols.parquet").is_dir():
        rows = spark.read.parquet(f"{folder}/symbols.parquet").select("id", "hx", *COLUMNS)
        facts, known = rows.drop("hx"), rows.select("id", F.col("hx").alias("_hx"))
        snapshot = f"{folder}/{SNAPSHOT}" if (folder / SNAPSHOT / "digests").is_dir() else None
    else:
        doc = json.loads(data.read_text())["symbols"]
        empty = lambda c: {} if c == "tests" else []
        facts = from_file(spark.createDataFrame([(k, *(s.get(c) or empty(c) for c in COLUMNS)) for k, s in doc.items()], FILE))
        known = spark.createDataFrame([(k, s.get("hx")) for k, s in doc.items()], "id string, _hx string")
    old = tree.symbols.drop("hx").join(known, "id").withColumnRenamed("_hx", "hx")
    return M.Tree(**{**tree.__dict__, "symbols": keep(old)}), facts, snapshot


def call_facts(spark: SparkSession, opts: BuildOptions, tree: M.Tree) -> tuple[DataFrame, dict]:
    resolver, t0 = opts.resolver or NameResolver(), time.time()
    if not opts.call_graph:
        return full_facts(M.Tree(**{**tree.__dict__, "calls": tree.calls.limit(0), "tests": tree.tests.limit(0)}), NameResolver()), {}
    if opts.facts_dir:
        facts, applied = apply_facts(tree.symbols, read_facts(spark, opts.facts_dir))
        return facts, {"mode": "merged-shards", "symbols_with_facts": applied.first()["n"]}
    if opts.prev_data and opts.prev_root:
        old, old_facts, snapshot = read_previous(spark, opts.prev_data, M.read_code(spark, opts.prev_root, opts.layout, keep))
        facts, info = incremental_facts(old, keep(old_facts), tree, resolver, keep, snapshot)
    else:
        raw = resolver.resolve(tree, tree.symbols)
        facts, info = assemble(tree.symbols, raw), {"mode": "full", "queried": kept_rows(tree.symbols), **raw.info}
    return facts, info | {"query_s": round(time.time() - t0, 1)}


def build(spark: SparkSession, opts: BuildOptions) -> Built:
    t0, root, layout = time.time(), opts.root, opts.layout
    tree = M.read_code(spark, root, layout, keep)
    facts, info = call_facts(spark, opts, tree)
    facts = keep(facts)
    if opts.tests_by_name:
        t1 = time.time()
        readable = (F.col("kind") == "rest") & (F.get_json_object("data", "$.rest") != "syntax-error")
        tests = keep(parse_files(read_tree(spark, opts.tests_by_name, list(layout.tests)), layout, True), readable=F.count_if(readable))
        found = keep(tests_by_name(of_kind(tests, "test"), tree.symbols))
        facts = replace_tests(facts, found)
        info["tests_by_name"] = {"test_files": kept_counts(tests)["readable"], "symbols_with_tests": kept_rows(found), "seconds": round(time.time() - t1, 1)}

    docs = M.read_docs(spark, root, layout)
    module_docs, symbol_docs = M.link_docs(docs, tree.modules, tree.symbols)
    imports = M.link_imports(tree)
    subclasses = M.link_subclasses(tree.symbols)
    out_imports = imports.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    in_imports = L.reverse_adjacency(imports, "ord").select(F.col("dst").alias("id"), F.col("sources").alias("imported_by"))
    subs = M.in_order(subclasses.select(F.col("base").alias("id"), F.col("id").alias("sub"), "ord"), "id", "sub", "ord", "subclasses")
    mod = tree.modules.join(out_imports, "id", "left").join(in_imports, "id", "left").join(M.module_tests(tree.symbols, facts).withColumnRenamed("module", "id"), "id", "left").join(module_docs, "id", "left")
    commits = read_log(spark, opts.git_dir or root, [layout.pkg_dir, *layout.tests])
    git_kind, co_kind = "struct<commits:bigint,authors:bigint,last:string,first:string,subject:string>", "array<struct<file:string,n:bigint,module:string>>"
    if commits is None:
        mod, seen = mod.withColumn("git", F.lit(None).cast(git_kind)).withColumn("cochange", F.lit(None)), 0
    else:
        commits = keep(commits)
        git, cochange = M.history(commits, tree.modules, keep)
        mod, seen = mod.join(git, "path", "left").join(cochange, "path", "left"), kept_rows(commits)
    for c, kind in (("imports", "array<string>"), ("imported_by", "array<string>"), ("tests", "array<struct<file:string,n:bigint>>"), ("docs", f"array<{M.DOC_HIT}>"), ("cochange", co_kind)):
        mod = _or_empty(mod, c, kind)
    sym = tree.symbols.join(facts, "id").join(symbol_docs, "id", "left").join(subs, "id", "left")
    sym = _or_empty(sym, "docs", f"array<{M.DOC_HIT}>")
    sym = sym.withColumn("subclasses", F.when(F.col("kind") == "class", F.coalesce("subclasses", F.array().cast("array<string>"))))
    mod, sym, docs = keep(mod), keep(sym), keep(docs)
    stats = {
        "commits_seen": seen, "modules": kept_rows(mod), "symbols": kept_rows(sym), "docs": kept_rows(docs),
        "build_seconds": round(time.time() - t0, 1), "call_graph": info,
    }
    return Built(mod, sym, docs, stats)


def document(built: Built, opts: BuildOptions) -> dict:
    """The data document; rows come to the driver one partition at a time, as one file is what is asked for."""
    modules, symbols = {}, {}
    for m in rows_of(built.modules.orderBy("ord")):
        m.pop("ord")
        m["tests"] = {t["file"]: t["n"] for t in m["tests"]}
        modules[m["id"]] = m
    for s in rows_of(built.symbols.orderBy("ord")):
        s.pop("ord")
        s["tests"] = {t["file"]: t["names"] for t in s["tests"]}
        for c in ("bases", "methods", "subclasses") if s["kind"] != "class" else ("class",):
            s.pop(c, None)
        symbols[s["id"]] = s
    layout = opts.layout
    return {
        "commit": head_commit(opts.git_dir or opts.root),
        "project": {"name": opts.name or Path(opts.root).resolve().name, "prefix": layout.import_prefix, "tests": list(layout.tests), "docs_dir": layout.docs_dir, "pkg_dir": layout.pkg_dir},
        "stats": built.info, "modules": modules, "symbols": symbols,
        "docs": [{k: d[k] for k in ("file", "title", "text")} for d in rows_of(built.docs.orderBy("ord"))],
    }


def build_shard(spark: SparkSession, opts: BuildOptions, i: int, n: int, say=lambda text: None) -> dict:
    if opts.facts_dir is None:
        raise ValueError("a shard needs a facts directory")
    t0 = time.time()
    out = run_shard(spark, M.read_code(spark, opts.root, opts.layout, keep), opts.resolver or NameResolver(), i, n, opts.facts_dir, say)
    return out | {"seconds": round(time.time() - t0, 1)}
