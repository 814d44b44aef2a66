"""Fact files: one JSON row per finished symbol, in files or Spark output folders named facts_*.jsonl."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.operators import incremental as I
from corbel.plans.resolve import FACTS

TESTS = "map<string,array<string>>"
FILE = FACTS.replace("tests array<struct<file:string,names:array<string>>>", f"tests {TESTS}")
COLUMNS = ["calls_in", "calls_in_x", "calls_out", "calls_out_x", "tests"]


def to_file(facts: DataFrame) -> DataFrame:
    return facts.withColumn("tests", F.map_from_entries("tests"))


def from_file(rows: DataFrame) -> DataFrame:
    """Maps carry no order, so tests become an array sorted by file."""
    item = F.transform(F.array_sort(F.map_entries("tests")), lambda e: F.struct(e["key"].alias("file"), e["value"].alias("names")))
    return rows.withColumn("tests", item)


def read_facts(spark: SparkSession, folder: str | Path) -> DataFrame:
    """Rows of all fact files with their place; rows that don't parse (a torn last line) are left out."""
    try:
        raw = spark.read.schema(FILE).option("mode", "DROPMALFORMED").json(f"{folder}/facts_*.jsonl")
    except AnalysisException:
        return spark.createDataFrame([], FILE + ", place struct<file:string,n:long>")
    return raw.filter("id IS NOT NULL").withColumn("place", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")))


def apply_facts(ids: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of ids, the last row of each winning; and how many rows were applied, repeats counted."""
    applied = rows.join(ids.select("id"), "id", "left_semi").agg(F.count("*").alias("n"))
    merged = from_file(I.merge_facts(ids.select("id"), rows, "id", COLUMNS, F.col("place")))
    kinds = dict(x for x in ((f.name, f.dataType) for f in merged.schema.fields))
    return merged.select("id", *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in COLUMNS]), applied
