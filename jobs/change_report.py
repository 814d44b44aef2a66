"""Reports, for each module of each package, its history in a change log and the modules that change with it most often.

    python -m jobs.change_report --changes PATH --commits PATH --modules PATH --out PATH [--config FILE]

Inputs (Parquet): changes (commit l_orderkey, module l_partkey), commits (o_orderkey, author o_custkey, date o_orderdate, kind
o_orderstatus) and modules (p_partkey, name p_name, package p_brand). Output: out/log, partitioned by month, a row for each
commit and module; out/report, partitioned by package, a row for each module and partner, or one row without a partner. A run replaces both,
so the same input gives the same output; since and until (not included) are pushed down to the commits.

Defined results: changes of commits that are not listed, or without a module, are left out; modules that never changed have no history (nulls,
commits 0); a partner that is no listed module has a null name; repeated changes count once for pairs and commits; commits of more than `most` different
modules say nothing about pairs; a module listed twice is reported once, with its greatest name and package; null packages are reported under Spark's default
partition.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.operators.pairs import group_history, pair_counts, topk_related
from jobs.common import Counted, command_line, load_config, own_session

log = logging.getLogger("change_report")


@dataclass(frozen=True)
class Config:
    """Commits of least to most modules make pairs; those seen support times count; top partners are kept. Dates from since to before until."""

    least: int = 2
    most: int = 25
    support: int = 2
    top: int = 6
    since: str | None = None
    until: str | None = None


def change_log(changes: DataFrame, commits: DataFrame, config: Config) -> DataFrame:
    """(commit, module, author, date, kind), a row for each commit and module."""
    some = commits.select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("kind"))
    if config.since:
        some = some.filter(F.col("date") >= F.lit(config.since).cast(some.schema["date"].dataType))
    if config.until:
        some = some.filter(F.col("date") < F.lit(config.until).cast(some.schema["date"].dataType))
    touched = changes.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("module")).filter("module IS NOT NULL").distinct()
    return touched.join(some, "commit")


def report(rows: DataFrame, modules: DataFrame, config: Config) -> DataFrame:
    history = group_history(rows.withColumn("pos", F.struct("date", "commit")), "module", "pos", "author", {"first_date": "date"}, {"last_date": "date", "last_kind": "kind"})
    partners = topk_related(pair_counts(rows, "commit", "module", config.least, config.most, config.support), config.top)
    named = modules.groupBy(F.col("p_partkey").alias("module")).agg(F.max("p_name").alias("name"), F.max("p_brand").alias("package"))
    theirs = partners.join(named.select(F.col("module").alias("b"), F.col("name").alias("partner_name")), "b", "left")
    out = named.join(history, "module", "left").join(theirs.withColumnRenamed("a", "module").withColumnRenamed("n", "together"), "module", "left")
    return out.select(
        "package", "module", "name", F.coalesce("n", F.lit(0)).cast("long").alias("commits"), F.coalesce("n_who", F.lit(0)).cast("long").alias("authors"),
        F.to_date("first_date").alias("first_date"), F.to_date("last_date").alias("last_date"), "last_kind", "rank", F.col("b").alias("partner"), "partner_name", "together",
    )


def run(spark: SparkSession, changes: str, commits: str, modules: str, out: str, config: Config) -> dict[str, int]:
    """Writes the log and the report; returns how many rows were read and written."""
    counted = lambda df: Counted(df, n=F.count("*"))
    read = {name: counted(spark.read.parquet(path)) for name, path in (("changes", changes), ("commits", commits), ("modules", modules))}
    rows = counted(change_log(read["changes"].df, read["commits"].df, config))
    rows.df.withColumn("month", F.date_format("date", "yyyy-MM")).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{out}/log")
    made = counted(report(spark.read.schema(rows.df.schema).parquet(f"{out}/log"), read["modules"].df, config))
    made.df.hint("rebalance", "package").sortWithinPartitions("package", "module", "rank").write.mode("overwrite").partitionBy("package").parquet(f"{out}/report")
    counts = {name: c.get()["n"] for name, c in {**read, "log": rows, "report": made}.items()}
    log.info("read %d changes of %s, %d commits of %s, %d modules of %s", counts["changes"], changes, counts["commits"], commits, counts["modules"], modules)
    log.info("wrote %d rows to %s/log and %d to %s/report", counts["log"], out, counts["report"], out)
    return counts


def read_report(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/report")


def main() -> None:
    paths = {"changes": "Parquet files of changes", "commits": "Parquet files of commits", "modules": "Parquet files of modules", "out": "folder of the report"}
    args = command_line(__doc__, "change_report", paths)
    spark = own_session("change_report")
    try:
        run(spark, args.changes, args.commits, args.modules, args.out, load_config(Config, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
