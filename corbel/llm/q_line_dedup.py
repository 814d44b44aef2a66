"""Query op10: documents after line dedup, by length and digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .line_dedup import line_dedup


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("before", F.length("text"))
    out = line_dedup(docs)
    return out.select("doc_id", (F.col("before") - F.length("text")).cast("bigint").alias("removed_chars"), F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")
