"""Snapshot diff, impact sets and merges: the parts of incremental maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): new, gone, changed or same. Null digests equal each other only."""
    o, n = old.select(F.col(key), F.col(digest).alias("_o"), F.lit(True).alias("_in_old")), new.select(F.col(key), F.col(digest).alias("_n"), F.lit(True).alias("_in_new"))
    both = o.join(n, key, "full_outer")
    status = F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "gone").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    return both.select(key, status.alias("status"))


def merge_facts(base: DataFrame, facts: DataFrame, key: str, columns: Sequence[str], order: Column) -> DataFrame:
    """base with columns from the last fact of each key; facts without a base row are left out."""
    last = facts.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_f"))
    return base.drop(*[c for c in columns if c in base.columns]).join(last, key, "left").select("*", *[F.col("_f")[c].alias(c) for c in columns]).drop("_f")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def carry_over(edges: DataFrame, alive: DataFrame) -> DataFrame:
    """edges (src, dst) both of whose ends are in alive (id)."""
    ids = alive.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): ends of edges whose other end is in ids."""
    both = edges.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    return both.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def shadow_set(edges: DataFrame, name_of: DataFrame, names: DataFrame) -> DataFrame:
    """(id): sources of old edges whose target's name (name_of: id, name) is among names (name)."""
    hit = name_of.join(names.select("name").distinct(), "name", "left_semi").select(F.col("id").alias("dst"))
    return edges.join(hit, "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def suspect_links(links: DataFrame, changed: DataFrame, vanished: DataFrame, cap: int = 6) -> DataFrame:
    """(id): ids whose old links (id, file, name) in changed files (file) fill the cap, so that more may have been cut
    off, or name one of vanished (name)."""
    near = links.join(changed.select("file").distinct(), "file", "left_semi")
    full = near.groupBy("id", "file").agg(F.count("*").alias("n")).filter(F.col("n") >= cap).select("id")
    lost = near.join(vanished.select("name").distinct(), "name", "left_semi").select("id")
    return full.unionByName(lost).distinct()


def table_diff(old: DataFrame, new: DataFrame, old_rest: DataFrame, new_rest: DataFrame) -> DataFrame:
    """Function tables (file, qual, hash, name) against each other: (file, qual, name, change). Where the rest of a file
    (file, rest) differs, the file itself is listed with qual null and change rest."""
    o = old.select("file", "qual", F.col("hash").alias("oh"), F.col("name").alias("oname"))
    n = new.select("file", "qual", F.col("hash").alias("nh"), F.col("name").alias("nname"))
    both = o.join(n, ["file", "qual"], "full_outer").filter(~F.col("oh").eqNullSafe(F.col("nh")))
    change = F.when(F.col("oh").isNull(), "new").when(F.col("nh").isNull(), "removed").otherwise("changed")
    rows = both.select("file", "qual", F.coalesce("nname", "oname").alias("name"), change.alias("change"))
    r = old_rest.select("file", F.col("rest").alias("orest")).join(new_rest.select("file", F.col("rest").alias("nrest")), "file", "full_outer").filter(~F.col("orest").eqNullSafe(F.col("nrest")))
    return rows.unionByName(r.select("file", F.lit(None).cast("string").alias("qual"), F.lit(None).cast("string").alias("name"), F.lit("rest").alias("change")))


def balanced_assign(sizes: list[tuple[str, int]], n: int) -> dict[str, int]:
    """Greedy packing, largest first to the least loaded shard (lowest number on ties); sizes in scan order. One entry
    per module, so this is driver-side configuration and not a data step."""
    load, out = [0] * n, {}
    for key, size in sorted(sizes, key=lambda x: -x[1]):
        shard = min(range(n), key=lambda i: (load[i], i))
        out[key] = shard
        load[shard] += size
    return out
