"""The code model: modules, symbols and their links, wired from the kernels."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.functions import text as T
from corbel.layout import Layout
from corbel.operators import links as L
from corbel.operators import pairs as P
from corbel.sources.parse import of_kind, parse_files
from corbel.sources.tree import read_tree

MIN_DOC_NAME, MAX_DOC_DEFS, MAX_COMMIT_FILES, MIN_COCHANGE, TOP_COCHANGE = 8, 2, 25, 3, 6
DOC_HIT = "struct<file:string,title:string,line:int,text:string>"


@dataclass
class Tree:
    """What one checkout holds."""

    modules: DataFrame  # id, path, doc, symbols, consts, loc, package, ord
    symbols: DataFrame  # id, ..., ord
    imports: DataFrame  # module, cand
    calls: DataFrame  # src, name: calls within a symbol
    tests: DataFrame  # file, test, used, called: functions of test files
    functions: DataFrame  # file, qual, hash, used, name of test files
    rests: DataFrame  # file, rest, names of test files
    files: DataFrame  # path, hash of module files
    test_files: DataFrame  # path, hash


def last_wins(rows: DataFrame) -> DataFrame:
    """One row for each id: the last in scan order, at the first one's place."""
    place = F.struct("ord", "seq")
    rest = [c for c in rows.columns if c not in ("ord", "seq", "id")]
    got = rows.groupBy("id").agg(F.max_by(F.struct(*rest), place).alias("d"), F.min(place).alias("p"))
    return got.select("id", "d.*", (F.col("p.ord").cast("bigint") * (1 << 24) + F.col("p.seq")).alias("ord"))


def read_code(spark: SparkSession, root: str | Path, layout: Layout, keep=lambda df: df) -> Tree:
    """keep: writes the parsed rows, which everything else reads, and the tables made of them."""
    code = read_tree(spark, root, [layout.pkg_dir], skips=layout.skip)
    tests = read_tree(spark, root, list(layout.tests))
    parsed, parsed_tests = keep(parse_files(code, layout, False)), keep(parse_files(tests, layout, True))
    modules = of_kind(parsed, "module").withColumn("loc", T.loc(F.col("text"))).withColumn("package", T.package_of(F.col("id"))).drop("text")
    modules = keep(last_wins(modules))
    symbols = symbol_columns(of_kind(parsed, "symbol"), of_kind(parsed, "module").select(F.col("path").alias("file"), "text"))
    shown = modules.select("id", F.col("path").alias("_p"))
    imports = of_kind(parsed, "import").join(modules.select(F.col("id").alias("module")), "module", "left_semi")
    digest = lambda df: df.select("path", F.sha1("content").alias("hash"))
    return Tree(
        modules, keep(last_wins(symbols)), imports.select("module", "cand").distinct(), of_kind(parsed, "call").select("src", "name").distinct(), of_kind(parsed_tests, "test").select("file", "test", "used", "called"),
        of_kind(parsed_tests, "func").drop("ord", "seq"), of_kind(parsed_tests, "rest").drop("ord", "seq"), digest(code).join(shown.select(F.col("_p").alias("path")), "path", "left_semi"), digest(tests),
    )


def symbol_columns(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """symbols with what their positions mean in their file's text (file, text): code, digests, column of the name."""
    text, line, start = F.col("text"), F.element_at(T.lines(F.col("text")), F.col("line")), F.col("start") + F.col("word")
    out = symbols.join(texts, "file")
    out = out.withColumn("code", T.snippet(text, F.col("line"), F.col("end"))).withColumn("private", T.is_private(F.col("name")))
    out = out.withColumn("h", T.source_hash(text, F.col("line"), F.col("end"))).withColumn("hx", T.source_hash(text, F.col("first"), F.col("end")))
    there = F.position(F.col("name"), line, start + 1) > 0
    return out.withColumn("col", F.when(there, T.name_column(line, F.col("name"), start)).otherwise(F.col("start"))).drop("text", "first", "start", "word")


def link_imports(tree: Tree) -> DataFrame:
    """(src, dst, ord): module imports module; each import name goes to its longest prefix that is another module."""
    cands = tree.imports.select(F.col("module").alias("id"), "cand")
    hit = L.longest_prefix_link(cands, tree.modules.select(F.col("id").alias("name")), ".", "id")
    order = tree.modules.select(F.col("id").alias("src"), "ord")
    return hit.select(F.col("id").alias("src"), F.col("target").alias("dst")).distinct().join(order, "src")


def link_subclasses(symbols: DataFrame) -> DataFrame:
    """(base, id, ord): classes that name a class as base, by bare name; repeats stay."""
    bare = lambda c: F.substring_index(F.substring_index(c, "[", 1), ".", -1)
    classes = symbols.filter("kind = 'class'")
    rows = classes.select("id", "ord", F.posexplode("bases").alias("k", "base")).select("id", F.struct("ord", "k").alias("ord"), bare(F.col("base")).alias("name"))
    return L.name_equi_link(rows, classes.select(F.col("id").alias("target"), "name")).select(F.col("target").alias("base"), "id", "ord")


def read_docs(spark: SparkSession, root: str | Path, layout: Layout) -> DataFrame:
    """file, title, text, ord of the markdown files of the docs directory, not of its subdirectories."""
    raw = read_tree(spark, root, [layout.docs_dir], suffix=".md", deep=False) if (Path(root) / layout.docs_dir).is_dir() else spark.createDataFrame([], "path string, ord int, content binary")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return raw.select(F.col("path").alias("file"), T.doc_title(text, F.col("path")).alias("title"), text.alias("text"), "ord")


def doc_lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("file").alias("doc"), "title", "ord", F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).select("doc", "title", "ord", (F.col("i") + 1).alias("line"), "text")


def _hits(first: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, docs): per id its first line in each doc, in doc order."""
    named = first.join(docs.select(F.col("file").alias("doc"), "title", "ord"), "doc")
    hit = F.struct(F.col("doc").alias("file"), "title", "line", T.cut(F.col("text"), T.DOC_CHARS).alias("text"))
    return named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", hit.alias("hit")))), lambda x: x["hit"]).alias("docs"))


def link_docs(docs: DataFrame, modules: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, docs) of modules and of symbols."""
    lines = doc_lines(docs)
    seg = F.split("text", "`", -1)
    inner = F.slice(seg, F.lit(2), F.greatest(F.size(seg) - 2, F.lit(0)))
    names = modules.select("id", F.col("id").alias("name")).unionByName(modules.filter(T.base_name(F.col("path")) != "__init__.py").select("id", T.base_name(F.col("path")).alias("name")))
    by_name = lines.withColumn("name", F.explode(F.array_distinct(inner))).join(names, "name").select("doc", "id", "line", "text")
    by_path = L.path_link(lines, modules.select("id", "path")).select("doc", "id", "line", "text")
    first = by_name.unionByName(by_path).groupBy("doc", "id").agg(F.min("line").alias("line"), F.min_by("text", "line").alias("text"))
    rare = L.rare_names(symbols, "name", MIN_DOC_NAME, MAX_DOC_DEFS).select("name")
    named = symbols.select("id", "name").join(rare, "name", "left_semi")
    return _hits(first, docs), _hits(L.mention_link(lines, named, L.ticked_tokens(F.col("text"))), docs)


def history(commits: DataFrame, modules: DataFrame, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(path, git) and (path, cochange) of module files. First and last are by place in the log."""
    rows = commits.select("pos", "date", "author", "subject", F.explode("files").alias("path"))
    h = P.group_history(rows, "path", "pos", "author", {"last": "date", "subject": "subject"}, {"first": "date"})
    git = h.select("path", F.struct(F.col("n").alias("commits"), F.col("n_who").alias("authors"), "last", "first", F.substring("subject", 1, T.SUBJECT_CHARS).alias("subject")).alias("git"))
    pairs = P.pair_counts(rows.filter(F.col("path").endswith(".py")), "pos", "path", 2, MAX_COMMIT_FILES, MIN_COCHANGE, P.COUNTERS, keep)
    top = P.topk_related(pairs, TOP_COCHANGE).join(modules.select(F.col("path").alias("b"), F.col("id").alias("module")), "b", "left")
    item = F.struct("rank", F.struct(F.col("b").alias("file"), "n", "module").alias("c"))
    cochange = top.groupBy(F.col("a").alias("path")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("cochange"))
    paths = modules.select("path")
    return git.join(paths, "path", "left_semi"), cochange.join(paths, "path", "left_semi")


def in_order(rows: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(out))


def module_tests(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """(module, tests): names of each test file over the module's symbols, most first, then by file."""
    hit = facts.select("id", F.explode("tests").alias("t")).join(symbols.select("id", "module"), "id").select("module", F.col("t.file").alias("file"), F.size("t.names").alias("n"))
    counted = P.grouped_counts(hit, "module", "file", F.col("n"))
    item = F.struct("rank", F.struct("file", "n").alias("c"))
    return counted.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("tests"))

