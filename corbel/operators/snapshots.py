"""Kept snapshots of (key, digest) tables that are compared by what has changed.

A snapshot is a table of parts (a folder each, by the key's hash), each in buckets sorted by key, and a digest of every part. Parts whose
digests are equal hold the same rows and are not read; the rows of the others are joined bucket by bucket, where they lie: both
tables have the same buckets, so nothing is shuffled. What is read follows the change.

    folder/rows      part=: key and digest, in buckets
    folder/digests   part, its rows, two 64-bit sums over them that no order changes
    folder/layout    how many parts and buckets, and the columns' types
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.operators.incremental import snapshot_diff

#: Parts of a snapshot, and buckets of each part.
PARTS, BUCKETS = 64, 8


@contextlib.contextmanager
def _plain_partitions(spark: SparkSession):
    """Tables made within find their partitions as folders, as paths do, and not in the session's catalog."""
    setting = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _digests(rows: DataFrame) -> DataFrame:
    sums = [F.bit_xor(F.xxhash64(F.lit(k), "key", "digest")).alias(name) for k, name in enumerate("ab")]
    return rows.groupBy("part").agg(F.count("*").alias("n"), *sums)


def write_snapshot(df: DataFrame, key: str, digest: str, folder: str, parts: int = PARTS, buckets: int = BUCKETS) -> None:
    """Writes a snapshot of df's keys and digests to a folder, in place of one that is there. Rows with a null key are left out;
    of several rows of a key the one with the greatest digest counts (a null one is the least)."""
    spark = df.sparkSession
    one = df.select(F.col(key).alias("key"), F.col(digest).alias("digest")).filter("key IS NOT NULL").groupBy("key").agg(F.max("digest").alias("digest"))
    kinds = {f.name: f.dataType.simpleString() for f in one.schema}
    name = f"corbel_{uuid.uuid4().hex}"
    placed = one.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    # A part is written by one task, so it has one file for each bucket. Keys are hashed, so parts are about equal.
    with _plain_partitions(spark):
        placed.repartition(parts, "part").write.format("parquet").mode("overwrite").partitionBy("part").bucketBy(buckets, "key").sortBy("key").option("path", f"{folder}/rows").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the session's entry; the files stay
    spark.createDataFrame([(parts, buckets, kinds["key"], kinds["digest"])], "parts int, buckets int, key string, digest string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")
    _digests(open_snapshot(spark, folder)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/digests")


def open_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(key, digest, part) of a snapshot, with its buckets known to Spark."""
    how = spark.read.parquet(f"{folder}/layout").first()
    name = f"corbel_{uuid.uuid4().hex}"
    with _plain_partitions(spark):
        spark.sql(
            f"CREATE TABLE {name} (key {how['key']}, digest {how['digest']}, part int) USING parquet PARTITIONED BY (part) "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {how['buckets']} BUCKETS LOCATION '{folder}/rows'"
        )
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def changed_parts(spark: SparkSession, old: str, new: str) -> list[int]:
    """Parts whose digests differ; a snapshot has a row for each part, so this is a bounded list."""
    o, n = (spark.read.parquet(f"{f}/digests").select("part", F.struct("n", "a", "b").alias(c)) for f, c in ((old, "o"), (new, "n")))
    return [r["part"] for r in o.join(n, "part", "full_outer").filter(~F.col("o").eqNullSafe(F.col("n"))).select("part").collect()]


def snapshot_changes(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(key, status) of the keys that are new, gone or changed between two snapshots. Snapshots of different parts, buckets or
    types are compared whole."""
    layouts = [spark.read.parquet(f"{f}/layout").first() for f in (old, new)]
    if layouts[0] != layouts[1]:
        return snapshot_diff(open_snapshot(spark, old), open_snapshot(spark, new), "key", "digest").filter("status <> 'same'")
    parts = changed_parts(spark, old, new)
    some = lambda f: open_snapshot(spark, f).filter(F.col("part").isin(parts) if parts else F.lit(False)).select("key", "digest")
    return snapshot_diff(some(old), some(new), "key", "digest").filter("status <> 'same'")
