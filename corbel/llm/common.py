"""What the operators share: table access, Arrow tokenising, and tables cut into the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corbel.workspace import keep

#: Fixed value: what the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass over a batch handles at most (one text is never split).
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again: lineage ends there, and no executor's loss undoes it.
    corbel.workspace.release deletes all of an application's tables, scratch those of one step."""
    return keep(df, tag)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches by row count; rows of documents are some KB, so a batch is some MB. A setting of the session, and
    left so, as plans run later than they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_chunks(batch: pa.RecordBatch, column: str):
    """Slices of a batch whose texts together stay near CHUNK_BYTES."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and for each text where its words begin (one more entry at the end). Null is no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return flat.filter(pa.array(keep)), before[offsets - offsets[0]].astype(np.int64)


def distinct_words(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words, and for each word its number among them."""
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied to whole arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Bytes of a string whose random values are tabulated; values further on are computed.
TABLED = 64
_TABLE = mix(np.arange(TABLED << 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))


def hash_array(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit tabulation hashes: the sum of a random value for each byte at its place. Empty strings: 0 (for seed 0)."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[:-1][some] - offsets[0]
        place = np.arange(len(data)) - np.repeat(starts, sizes[some])
        code = (place << 8) | data
        values = _TABLE[np.minimum(code, len(_TABLE) - 1)]
        far = place >= TABLED
        if far.any():
            values[far] = mix(code[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
        out[some] = np.add.reduceat(values, starts)
    return mix(out + np.uint64(seed)) if seed else out


def hash_strings(strings: list[str], seed: int = 0) -> np.ndarray:
    return hash_array(pa.array(strings, pa.string()), seed)


def hash_words(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """A hash for each word; each different word is hashed once."""
    if not len(flat):
        return np.empty(0, np.uint64)
    coded = flat.dictionary_encode()
    return hash_array(coded.dictionary, seed)[coded.indices.to_numpy(zero_copy_only=False)]


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


#: Bits of a Bloom filter (a fixed 8 MB, whatever it is built from), and hashes per key.
BLOOM_BITS, BLOOM_HASHES = 1 << 26, 3


def _bloom_places(ids: np.ndarray) -> np.ndarray:
    """One row of bit numbers for each hash."""
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED))
    step = mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(BLOOM_BITS - 1) for k in range(BLOOM_HASHES)])


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a long column, as bits. It passes every id of the column, and few others until there are some
    ten million; beyond that it only saves less. What reaches the driver are its words of 64 bits, a million at most."""

    def build(batches):
        held = np.zeros(BLOOM_BITS >> 6, np.uint64)
        for b in batches:
            places = _bloom_places(b.column(0).to_numpy(zero_copy_only=False)).ravel().astype(np.int64)
            np.bitwise_or.at(held, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        words = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(held[words].view(np.int64))], ["word", "bits"])

    held = ids.select(column).filter(f"{column} IS NOT NULL").mapInArrow(build, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = held.toArrow()
    out = np.zeros(BLOOM_BITS >> 6, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def likely(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the ids the filter passes; later hashes are looked up for what earlier ones have left."""
    h = mix(ids.astype(np.int64, copy=False).view(np.uint64) + np.uint64(0x51ED))
    left, step = np.arange(len(h)), mix(h) | np.uint64(1)
    for k in range(BLOOM_HASHES):
        at = ((h[left] + np.uint64(k) * step[left]) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)
        left = left[(bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
    out = np.zeros(len(h), bool)
    out[left] = True
    return out


def split_likely(df: DataFrame, column: str, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose column the filter passes, and all others (nulls too). Two scans, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def part(wanted: bool):
        def run(batches):
            for b in batches:
                ids = b.column(column)
                hit = likely(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), shared.value) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == wanted))

        return run

    return df.mapInArrow(part(True), df.schema), df.mapInArrow(part(False), df.schema)


def keep_likely(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """df without most rows whose column isn't in the filter; done before a join's shuffle."""
    return split_likely(df, column, bits)[0]
