"""From documents to a training mix: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again. All stages but the last return the columns of documents.

Defined results: rows with null doc_id pass line dedup, near-dedup and decontamination untouched; rows with null or empty
text stay up to mixing, which never selects them; repeated rows are judged each by their own text (near-dedup keeps one of
equal texts, so of rows equal in doc_id and text too; line dedup keeps the first holder's); rows that share a doc_id but not
their text stay or go by themselves, but in decontamination, where a leak in one takes all; empty tables: no rows; columns beside
those of documents are kept, whatever their names, up to mixing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.llm.common import settle, table
from corbel.llm.decontaminate import decontaminate
from corbel.llm.line_dedup import line_dedup
from corbel.llm.mixing import mix
from corbel.llm.near_dedup import drop_near_duplicates
from corbel.llm.q_mixing import BUDGET, DOMAIN, MAX_EPOCHS, WEIGHTS
from corbel.llm.q_toxicity import THRESHOLD, held_out
from corbel.llm.toxicity import drop_toxic
from corbel.workspace import discard, last_kept, scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")), THRESHOLD)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the later texts; every row stays, n_chars follows the text."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more) stays."""
    return drop_near_duplicates(docs, threshold=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The target mix: a row for each document and epoch, with its text."""
    named = docs.select("doc_id", "text", "lang", "source").withColumn("domain", F.expr(DOMAIN))
    return mix(named, WEIGHTS, F.expr(BUDGET), MAX_EPOCHS, carry=("text",))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: Trained weights, signatures and latent spaces have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix. Of the tables that the stages write, only those that it reads stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark) as spared:
            docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
            spared.append(last_kept(spark))
        if before:
            discard(spark, before)
        before = spared[0]
    return docs
