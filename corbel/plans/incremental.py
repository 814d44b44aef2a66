"""Incremental call facts: resolve again only what a change can reach, carry the rest over."""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.operators import incremental as I
from corbel.operators.snapshots import snapshot_changes, write_snapshot
from corbel.plans.model import Tree
from corbel.plans.resolve import FACTS, TESTS_PER_FILE, RawLinks, Resolver, assemble
from corbel.sinks import SNAPSHOT_BUCKETS, SNAPSHOT_PARTS
from corbel.workspace import keep_counted, kept_counts, kept_rows, own_folder


def changed_test_names(old: Tree, new: Tree) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file) of changed tests; (name) used in their changed or new functions; (name) of changed or lost functions."""
    status = I.snapshot_diff(old.test_files, new.test_files, "path", "hash").filter("status <> 'same'").select(F.col("path").alias("file"))
    semi = lambda df: df.join(status, "file", "left_semi")
    diff = I.table_diff(semi(old.functions).select("file", "qual", "hash", "name"), semi(new.functions).select("file", "qual", "hash", "name"), semi(old.rests), semi(new.rests))
    rest = diff.filter("change = 'rest'").select("file").distinct()
    mine = diff.filter("change IN ('new', 'changed')").select("file", "qual")
    names = semi(new.functions).join(mine, ["file", "qual"], "left_semi").select(F.explode("used").alias("name"))
    # Code outside functions has changed, or the whole file is new: any name in it counts.
    names = names.unionByName(new.rests.join(rest, "file", "left_semi").select(F.explode("names").alias("name"))).distinct()
    lost = diff.filter("change IN ('removed', 'changed')").select("name")
    lost = lost.unionByName(old.functions.join(rest, "file", "left_semi").select("name")).distinct()
    return status, names, lost


def _edges(facts: DataFrame) -> DataFrame:
    out = facts.select(F.col("id").alias("src"), F.explode("calls_out").alias("dst"))
    return out.unionByName(facts.select(F.explode("calls_in").alias("src"), F.col("id").alias("dst"))).distinct()


def incremental_facts(old: Tree, old_facts: DataFrame, new: Tree, resolver: Resolver, keep=keep_counted, snapshot: str | None = None) -> tuple[DataFrame, dict]:
    """Facts of the new tree, and counts. Equal to resolving everything, for resolvers whose links come from names. With a
    snapshot of the old symbols' digests, only those parts of it are read in which something has changed."""
    if snapshot:
        spark = new.symbols.sparkSession
        now = f"{own_folder(spark)}/snapshot-{uuid.uuid4().hex}"
        write_snapshot(new.symbols, "id", "hx", now, SNAPSHOT_PARTS, SNAPSHOT_BUCKETS)
        diff = snapshot_changes(spark, snapshot, now).withColumnRenamed("key", "id")
    elif old.symbols.filter("hx IS NULL").isEmpty():
        diff = I.snapshot_diff(old.symbols, new.symbols, "id", "hx")
    else:  # old rows without a digest: whole files count
        files = I.snapshot_diff(old.files, new.files, "path", "hash").filter("status <> 'same'").select(F.col("path").alias("file"))
        mark = lambda t: t.symbols.join(files.withColumn("_c", F.lit(True)), "file", "left").select("id", "_c")
        o, n = mark(old).withColumnRenamed("_c", "oc"), mark(new).withColumnRenamed("_c", "nc")
        both = o.withColumn("_o", F.lit(1)).join(n.withColumn("_n", F.lit(1)), "id", "full_outer")
        diff = both.select("id", F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("oc") | F.col("nc"), "changed").otherwise("same").alias("status"))
    diff = keep(diff)
    a_new = diff.filter("status IN ('new', 'changed')").select("id")
    a_old = diff.filter("status IN ('gone', 'changed')").select("id")
    moved = diff.filter("status IN ('new', 'gone')").select("id")
    old_names, new_names = old.symbols.select("id", "name"), new.symbols.select("id", "name")
    appeared = moved.join(old_names.unionByName(new_names).distinct(), "id").select("name").distinct()

    files, names, lost = (keep(x) for x in changed_test_names(old, new))
    links = old_facts.select("id", F.explode("tests").alias("t")).select("id", F.col("t.file").alias("file"), F.explode("t.names").alias("name"))
    test_hit = new_names.join(names, "name", "left_semi").select("id").unionByName(I.suspect_links(links, files, lost, TESTS_PER_FILE)).distinct()
    # Edges are taken from both directions of the old facts; a caller of a name that comes or goes may be routed anew.
    edges = keep(_edges(old_facts))
    shadow = I.shadow_set(edges, old_names, appeared)
    twins = old_names.join(appeared, "name", "left_semi").select("id")
    test_hit = keep(test_hit)
    near = test_hit.unionByName(shadow).unionByName(twins).unionByName(I.neighbours(edges, a_old)).distinct()
    first = keep(a_new.unionByName(near.join(new_names.select("id"), "id", "left_semi")).distinct())

    again = keep(new.symbols.join(first, "id", "left_semi"))
    raw = resolver.resolve(new, again)
    raw = RawLinks(keep(raw.edges), keep(raw.tests), raw.callers, raw.callees, raw.info)
    wave1 = keep(assemble(again, raw))
    after = wave1.join(a_new, "id", "left_semi").select(F.explode("calls_out").alias("id")).distinct().join(first, "id", "left_anti")
    after = keep(after.join(new_names.select("id"), "id", "left_semi"))
    again = keep(new.symbols.join(after, "id", "left_semi"))
    raw2 = resolver.resolve(new, again)
    raw2 = RawLinks(keep(raw2.edges), keep(raw2.tests), raw2.callers, raw2.callees, raw2.info)
    wave2 = keep(assemble(again, raw2))
    done = first.unionByName(after)

    # An edge between two symbols that weren't resolved again is as it was; all others come from the waves.
    rest = old_facts.join(new_names.select("id"), "id", "left_semi").join(done, "id", "left_anti")
    rest_ids = rest.select("id")
    same = I.carry_over(edges, rest_ids)
    edges = keep(same.unionByName(raw.edges).unionByName(raw2.edges).filter("src <> dst").distinct())
    end = lambda a, b, out: edges.groupBy(F.col(a).alias("id")).agg(F.array_sort(F.collect_list(b)).alias(out))
    others = [c for c in wave1.columns if c not in ("calls_in", "calls_out")]
    out = wave1.select(*others).unionByName(wave2.select(*others)).unionByName(rest.select(*others))
    out = out.join(end("dst", "src", "calls_in"), "id", "left").join(end("src", "dst", "calls_out"), "id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("calls_in", F.coalesce("calls_in", none)).withColumn("calls_out", F.coalesce("calls_out", none)).select(*wave1.columns)
    moved_files = keep(I.snapshot_diff(old.files, new.files, "path", "hash").filter("status <> 'same'"), changed=F.count_if(F.col("status") != "gone"), removed=F.count_if(F.col("status") == "gone"))
    info = {
        "mode": "incremental", "changed_tests": kept_rows(files), "test_hit": kept_rows(test_hit), "queried": kept_rows(first) + kept_rows(after), "queried_first": kept_rows(first),
        "queried_after": kept_rows(after), "changed_files": kept_counts(moved_files)["changed"], "removed_files": kept_counts(moved_files)["removed"],
    }
    info |= Counter(raw.info) + Counter(raw2.info)
    return out, info


__all__ = ["FACTS", "changed_test_names", "incremental_facts"]
