"""Facts as a stream: the last one of each key is kept in a state store, and only changes leave it.

Facts have a place (file, n). A fact whose place comes before that of the one kept is late and dropped; one that says the same moves
the place alone. What is kept is read from the state store itself, a row for each key, so nothing is ranked again; changes go to
a folder for each batch, for whoever follows them. A run that breaks is finished by the next from the checkpoint.

Each task sends the last fact of each key of an Arrow batch, so a key with many facts is thinned out before the shuffle. A key's facts pass
through its task one batch after another.

Defined results: rows without a key are left out; of facts with one place, the one with the greatest JSON text counts; null columns are
values like others; empty input changes nothing; columns beside key, place and values are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corbel.sources.facts import COLUMNS, FILE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "last"


class LastFact(StatefulProcessor):
    """For each key the last fact by place."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState(STATE, "file string, n long, fact string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = max(fact for part in rows for fact in zip(part["file"], part["n"].astype(int), part["fact"], strict=True))
        old = tuple(self.last.get()) if self.last.exists() else None
        if old is None or new > old:
            self.last.update(new)
            if old is None or new[2] != old[2]:
                yield pd.DataFrame({"key": [key[0]], "fact": [new[2]]})

    def close(self) -> None:
        pass


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last fact of each key of a batch."""
    for b in batches:
        facts = pd.DataFrame({c: b.column(c).to_pandas() for c in ("key", "file", "n", "fact")})
        last = facts.sort_values(["file", "n", "fact"]).drop_duplicates("key", keep="last").index
        yield b.take(pa.array(last.sort_values()))


def last_facts(rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, fact): changes of the last fact by place (file, n) of each key, of a stream; fact holds the values as JSON."""
    kind = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("fact", T.StringType())])
    fact = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    sent = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), fact.alias("fact"))
    return sent.mapInArrow(_thinned, sent.schema).groupBy("key").transformWithStateInPandas(LastFact(), kind, "Update", "None")


def follow(rows: DataFrame, key: str, values: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Takes what is new in a stream of facts; a batch's changes overwrite their own folder, so a repeated batch changes nothing."""
    spark = rows.sparkSession
    kind = T.StructType([rows.schema[c] for c in values])
    read = F.from_json("fact", kind)

    def write(batch: DataFrame, n: int) -> None:
        batch.select(F.col("key").alias(key), read.alias("v")).select(key, "v.*").write.mode("overwrite").parquet(f"{out}/batch={n}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings that it starts with
    try:
        return last_facts(rows, key, values).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def kept(spark: SparkSession, checkpoint: str, key: str, values: T.StructType) -> DataFrame:
    """The last fact of each key, as the state store holds it: (key, file, n, values)."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    finally:
        spark.conf.set(PROVIDER, before)
    return rows.select(F.col("key.key").alias(key), "value.file", "value.n", F.from_json("value.fact", values).alias("v")).select(key, "file", "n", "v.*")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n: bytes before a row's split and rows before it in the split. A row takes a byte at least, so later rows of a file have a
    greater n."""
    seen: dict[tuple[str, int], int] = {}
    for b in batches:
        out = []
        for split in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
            seen[split] = seen.get(split, -1) + 1
            out.append(split[1] + seen[split])
        yield b.append_column("n", pa.array(out, pa.int64()))


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str) -> StreamingQuery:
    """Follows a folder of fact files (a JSON row a line); later files by name and later lines win."""
    raw = spark.readStream.schema(FILE).json(source)
    placed = raw.filter("id IS NOT NULL").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    numbered = placed.mapInArrow(_numbered, T.StructType([*placed.schema, T.StructField("n", T.LongType())]))
    return follow(numbered, "id", COLUMNS, out, checkpoint)


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last fact of each symbol."""
    fields = T._parse_datatype_string(FILE)
    return kept(spark, checkpoint, "id", T.StructType([fields[c] for c in COLUMNS])).drop("file", "n")
