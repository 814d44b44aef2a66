"""Keeps an index of which documents mention which rare names, and on which line first, as documents arrive.

    python -m jobs.mention_index --documents PATH --names PATH --out PATH --checkpoint PATH [--config FILE]

New files of --documents (Parquet; a folder, a file or a pattern) are taken by a file stream, once each; the stream's checkpoint is
the mark. Names are the rare words of the texts in --names: long ones that few texts hold.

    out/current                  which index is the valid one, and its columns (one row)
    out/index-<digest>/names     the names it was made with
    out/index-<digest>/log       batch=, bucket=: every document of each batch, and what it mentions
    out/index-<digest>/links     bucket=: the same of each document's last version; what readers want

A batch writes its own folder of the log, then remakes those buckets of the links that it touches from the log. Both replace what a
broken run may have left of the same batch, so a run can be killed and started again at any point. A document that comes again
replaces its older version. An index holds for its names and settings: if they change, the next run starts another one over all
documents, and `current` goes over to it when that is done.

Defined results: rows with a null id are left out and counted in the log; null and empty texts mention nothing, and take back what
an older version mentioned; of rows with one id in one batch, the one with the greatest digest counts; equal rows count once; other
columns are not read; a table of documents without rows gives an empty index.
"""

from __future__ import annotations

import json
import logging
from collections import Counter
from dataclasses import asdict, dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corbel.functions.text import DOC_CHARS, cut
from corbel.operators.links import mention_link, rare_names
from jobs.common import Counted, command_line, load_config, own_session

log = logging.getLogger("mention_index")
#: Fixed value: what separates words.
SPACE = r"[\x20\x09-\x0D]+"
LINK = "name string, line long, line_text string"


@dataclass(frozen=True)
class Config:
    """id, text and carry name columns of the documents; files_per_batch bounds a batch, buckets the parts of the index."""

    id: str = "doc_id"
    text: str = "text"
    carry: tuple[str, ...] = ()
    min_len: int = 8
    max_defs: int = 2
    buckets: int = 16
    files_per_batch: int = 64


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, SPACE), lambda w: w != ""))


def find_names(texts: DataFrame, config: Config) -> DataFrame:
    """(name): words of min_len characters or more that max_defs rows at most hold."""
    held = texts.select(F.explode(words(F.col(config.text))).alias("name"))
    return rare_names(held, "name", config.min_len, config.max_defs).select("name")


def digest_of(names: DataFrame, config: Config) -> str:
    """The same for the same names and settings, in whatever order the names come."""
    r = names.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("name")).alias("a"), F.bit_xor(F.xxhash64(F.lit("b"), "name")).alias("b")).first()
    settings = {k: v for k, v in asdict(config).items() if k != "files_per_batch"}
    return sha256(json.dumps([r["n"], r["a"], r["b"], settings]).encode()).hexdigest()[:16]


def entries(docs: DataFrame, names: DataFrame, config: Config) -> DataFrame:
    """Of each row of docs an entry without a name, and one for each name that its text mentions: with the first line that does,
    and how that line begins. Texts are not shuffled: only found names, with their lines' beginnings, are."""
    doc = F.struct(F.col(config.id), *config.carry, F.xxhash64(config.text).alias("version"))
    ids = docs.filter(F.col(config.id).isNotNull())
    lines = ids.select(doc.alias("doc"), F.posexplode(F.split(config.text, "\n", -1)).alias("at", "whole"))
    lines = lines.select("doc", (F.col("at") + 1).cast("long").alias("line"), cut(F.col("whole"), DOC_CHARS).alias("text"), words(F.col("whole")).alias("words"))
    found = mention_link(lines, names.select("name", F.col("name").alias("id")), F.col("words")).select("doc.*", F.col("id").alias("name"), "line", F.col("text").alias("line_text"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(LINK)]
    held = ids.select(doc.alias("doc")).select("doc.*", *none).distinct().unionByName(found)
    return held.withColumn("bucket", F.pmod(F.xxhash64(config.id), F.lit(config.buckets)).cast("int"))


def schema_of(docs: T.StructType, config: Config) -> T.StructType:
    """Columns of the log and of the links, for documents of these types."""
    own = [*(docs[c] for c in (config.id, *config.carry)), T.StructField("version", T.LongType()), *T._parse_datatype_string(LINK)]
    return T.StructType([*own, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])


def last_versions(held: DataFrame, id: str) -> DataFrame:
    """Entries of each id's last version: that of the last batch, and of the greatest digest in it."""
    last = held.groupBy(id).agg(F.max(F.struct("batch", "version")).alias("_last"))
    return held.join(last.select(F.col(id).alias("_id"), "_last.*").withColumnsRenamed({"batch": "_batch", "version": "_version"}), (F.col(id) == F.col("_id")) & (F.col("batch") == F.col("_batch")) & F.col("version").eqNullSafe(F.col("_version"))).select(held.columns)


def take(batch: DataFrame, n: int, index: str, config: Config) -> Counter:
    """One batch: its part of the log, then the buckets it touches."""
    spark = batch.sparkSession
    given = Counted(batch.select(config.id, *config.carry, config.text), rows=F.count("*"), nameless=F.count_if(F.col(config.id).isNull()))
    mine = f"{index}/log/batch={n}"
    entries(given.df, spark.read.parquet(f"{index}/names"), config).write.mode("overwrite").partitionBy("bucket").parquet(mine)
    kind = schema_of(batch.schema, config)
    got = spark.read.schema(kind).parquet(mine).groupBy("bucket").agg(F.count("*").alias("n"), F.count("name").alias("links")).collect()  # a row for each bucket
    counts = Counter({**given.get(), "batches": 1, "entries": sum(r["n"] for r in got), "links": sum(r["links"] for r in got)})
    if got:
        held = spark.read.schema(kind).parquet(f"{index}/log")
        held = last_versions(held.filter(F.col("bucket").isin([r["bucket"] for r in got]) & (F.col("batch") <= n)), config.id)
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{index}/links")
    log.info("batch %d: %d rows read (%d without an id), %d links in %d buckets written to %s", n, counts["rows"], counts["nameless"], counts["links"], len(got), index)
    return counts


def as_pattern(path: str) -> str:
    """A pattern that matches the path alone: streams take patterns of files, but no plain file."""
    bare = path.rstrip("/")
    return bare if set("*?[{") & set(bare) else f"{bare[:-1]}[{bare[-1]}]"


def run(spark: SparkSession, documents: str, names: str, out: str, checkpoint: str, config: Config) -> dict[str, int | str]:
    """Takes what is new in documents; returns counts and the index's folder."""
    found = find_names(spark.read.parquet(names).select(config.text), config)
    digest = digest_of(found, config)
    index, total = f"{out}/index-{digest}", Counter()
    found.write.mode("overwrite").parquet(f"{index}/names")
    log.info("index %s: names of %s", digest, names)
    docs = spark.read.parquet(documents).schema
    kind = schema_of(docs, config)
    spark.createDataFrame([], kind).write.mode("append").partitionBy("bucket").parquet(f"{index}/links")  # there to be read, whatever comes
    stream = spark.readStream.schema(docs).option("maxFilesPerTrigger", config.files_per_batch).parquet(as_pattern(documents))
    query = stream.writeStream.foreachBatch(lambda batch, n: total.update(take(batch, n, index, config))).option("checkpointLocation", f"{checkpoint}/{digest}").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([(digest, kind.json())], "digest string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{out}/current")
    log.info("read %d rows in %d batches of %s, wrote %d links to %s", total["rows"], total["batches"], documents, total["links"], index)
    return {**{k: total[k] for k in ("rows", "nameless", "batches", "entries", "links")}, "index": index}


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """The valid index: a row for each document and name that it mentions."""
    valid = spark.read.parquet(f"{out}/current").first()
    links = spark.read.schema(T.StructType.fromJson(json.loads(valid["schema"]))).parquet(f"{out}/index-{valid['digest']}/links")
    return links.filter("name IS NOT NULL").drop("batch", "bucket", "version")


def main() -> None:
    paths = {"documents": "Parquet files of documents", "names": "Parquet files of texts whose rare words are the names", "out": "folder of the index", "checkpoint": "folder of the stream's checkpoints"}
    args = command_line(__doc__, "mention_index", paths)
    spark = own_session("mention_index")
    try:
        run(spark, args.documents, args.names, args.out, args.checkpoint, load_config(Config, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
