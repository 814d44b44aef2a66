"""Call facts: who calls whom, and which tests reach what.

A resolver turns symbols into raw links; assembling facts from them (caps, order, removal of self links) is common to
all. The name resolver, the default, links by name: a call of f() or x.f() goes to every symbol named f. Only edges that touch
the asked symbols are made, hot names in cells.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.operators import links as L
from corbel.operators import pairs as P
from corbel.operators.named import NamedEdges
from corbel.plans.model import Tree

TESTS_PER_FILE, CALLERS_ELSEWHERE, CALLEES_ELSEWHERE = 6, 12, 25
FACTS = (
    "id string, calls_in array<string>, calls_in_x array<struct<name:string,at:string>>, calls_out array<string>, calls_out_x array<string>, "
    "tests array<struct<file:string,names:array<string>>>"
)


@dataclass
class RawLinks:
    """edges (src, dst); tests (id, file, name); callers (id, pos, name, at); callees (id, name)."""

    edges: DataFrame
    tests: DataFrame
    callers: DataFrame | None = None
    callees: DataFrame | None = None
    info: dict = field(default_factory=dict)


class Resolver(Protocol):
    def resolve(self, tree: Tree, symbols: DataFrame) -> RawLinks:
        """Links that touch symbols (id, name, file, line, end, col, ord)."""


class NameResolver:
    def resolve(self, tree: Tree, symbols: DataFrame) -> RawLinks:
        graph = NamedEdges.of(tree.calls, tree.symbols.select("id", "name"))
        edges = graph.pairs().filter("src <> id") if symbols is tree.symbols else graph.touching(symbols)
        called = tree.tests.select(F.struct("file", F.col("test").alias("name")).alias("src"), F.explode("called").alias("name"))
        tests = NamedEdges.of(called, symbols.select("id", "name")).pairs().select("id", "src.*")
        return RawLinks(edges.withColumnRenamed("id", "dst"), tests)


def assemble(symbols: DataFrame, raw: RawLinks) -> DataFrame:
    """One row of FACTS for each of symbols."""
    ids = symbols.select("id")
    edges = raw.edges.filter("src <> dst").distinct()
    one = lambda a, b, out: edges.groupBy(F.col(a).alias("id")).agg(F.array_sort(F.collect_list(b)).alias(out))
    tests = P.capped_sets(raw.tests, ["id", "file"], "name", TESTS_PER_FILE, "names")
    tests = tests.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("file", "names"))).alias("tests"))
    out = ids.join(one("dst", "src", "calls_in"), "id", "left").join(one("src", "dst", "calls_out"), "id", "left").join(tests, "id", "left")
    if raw.callers is not None:
        item = F.struct("pos", F.struct("name", "at").alias("c"))
        got = P.arrival_cap(raw.callers, ["id"], ["pos"], CALLERS_ELSEWHERE).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("calls_in_x"))
        out = out.join(got, "id", "left")
    else:
        out = out.withColumn("calls_in_x", F.lit(None))
    if raw.callees is not None:
        out = out.join(P.capped_sets(raw.callees, ["id"], "name", CALLEES_ELSEWHERE, "calls_out_x"), "id", "left")
    else:
        out = out.withColumn("calls_out_x", F.lit(None))
    kinds = dict(x.strip().split(" ", 1) for x in FACTS.replace("struct<name:string,at:string>", "struct<name:string;at:string>").replace("struct<file:string,names", "struct<file:string;names").split(", "))
    return out.select("id", *[F.coalesce(F.col(c).cast(t.replace(";", ",")), F.array().cast(t.replace(";", ","))).alias(c) for c, t in kinds.items() if c != "id"])


def full_facts(tree: Tree, resolver: Resolver) -> DataFrame:
    return assemble(tree.symbols, resolver.resolve(tree, tree.symbols))


def tests_by_name(tests: DataFrame, symbols: DataFrame, max_defs: int = 3, min_len: int = 5) -> DataFrame:
    """(id, tests): a test function reaches every symbol whose rare name it uses."""
    rare = L.rare_names(symbols, "name", min_len, max_defs).select("name")
    uses = tests.filter(F.col("test").startswith("test")).select(F.struct("file", F.col("test").alias("name")).alias("src"), F.explode("used").alias("name"))
    hits = L.name_link(uses, symbols.select("id", "name").join(rare, "name", "left_semi")).select("id", "src.*")
    names = P.capped_sets(hits, ["id", "file"], "name", TESTS_PER_FILE, "names")
    return names.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("file", "names"))).alias("tests"))


def replace_tests(facts: DataFrame, found: DataFrame) -> DataFrame:
    out = facts.drop("tests").join(found, "id", "left")
    kind = "array<struct<file:string,names:array<string>>>"
    return out.withColumn("tests", F.coalesce("tests", F.array().cast(kind)))
