"""Query op8: secret spans of all documents, and how many of their credential values are scored and withstand guessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secrets import GUESS_LIMIT, find_secrets


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    return out.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(F.filter("found", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        F.size("scored").cast("bigint").alias("n_scored"), F.size(F.filter("scored", lambda s: s["cost"] >= GUESS_LIMIT)).cast("bigint").alias("n_strong"),
        F.round(F.array_max(F.transform("scored", lambda s: s["cost"])), 6).alias("highest_cost"),
    )
