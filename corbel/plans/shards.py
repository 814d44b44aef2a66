"""Sharded, resumable resolution."""

from __future__ import annotations

import time
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.operators.incremental import balanced_assign, resume
from corbel.plans.model import Tree
from corbel.plans.resolve import Resolver, assemble
from corbel.sources.facts import read_facts, to_file
from corbel.workspace import keep


def shard_symbols(tree: Tree, i: int, n: int) -> DataFrame:
    """Symbols of shard i of n: whole modules, largest first to the least loaded shard."""
    sizes = tree.symbols.groupBy("module").count().join(tree.modules.select(F.col("id").alias("module"), "ord"), "module").orderBy("ord").collect()  # one row per module
    mine = [m for m, s in balanced_assign([(r["module"], r["count"]) for r in sizes], n).items() if s == i]
    return tree.symbols.filter(F.col("module").isin(mine)) if mine else tree.symbols.limit(0)


#: Symbols of one step of a shard, about: what a killed shard may lose.
STEP = 2000


def steps(todo: DataFrame, size: int) -> list[list[str]]:
    """Modules of todo, in scan order, in lists of size symbols or more (the last may have fewer)."""
    out: list[list[str]] = [[]]
    n = 0
    for r in todo.groupBy("module").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).orderBy("ord").collect():  # one row per module
        if n >= size:
            out.append([])
            n = 0
        out[-1].append(r["module"])
        n += r["n"]
    return [x for x in out if x]


def run_shard(spark: SparkSession, tree: Tree, resolver: Resolver, i: int, n: int, folder: str | Path, say=lambda text: None) -> dict:
    """Appends facts of shard i's unfinished symbols to facts_<i>.jsonl, step by step: a killed shard keeps its finished
    steps, and the next run skips their symbols. say gets a line on the progress after each step."""
    if not 0 <= i < n:
        raise ValueError(f"shard {i} of {n}")
    own = shard_symbols(tree, i, n)
    done = read_facts(spark, folder).filter(F.col("place.file").contains(f"facts_{i}.jsonl")).select("id").distinct()
    todo = keep(resume(own, done, "id"))
    total, queried, begun, counters = own.count(), todo.count(), time.time(), Counter()
    resumed = finished = total - queried
    for modules in steps(todo, STEP):
        some = todo.filter(F.col("module").isin(modules))
        raw = resolver.resolve(tree, some)
        to_file(assemble(some, raw)).write.mode("append").json(f"{folder}/facts_{i}.jsonl")
        counters.update(raw.info)
        finished += some.count()
        left = (time.time() - begun) / max(finished - resumed, 1) * (total - finished)
        say(f"shard {i}/{n}: {finished} of {total} symbols, some {left:.0f} s left")
    return {"shard": f"{i}/{n}", "symbols": total, "queried": queried, "resumed": resumed, **counters}
