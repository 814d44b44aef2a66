"""Pair mining and per-group rankings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Hashed counters of pairs and of items, and how many of those of pairs a task sends as one row.
COUNTERS, ITEM_COUNTERS, LANES = 1 << 22, 1 << 22, 1 << 14
#: Items are counted to leave those below the support out if these can hold one of so many rows.
RARE = 8


def _words(lanes: DataFrame) -> DataFrame:
    """(word, bits): a bit for each lane of the table, in words of 64. At most as many rows as there are words, so it is
    small enough to be sent to every task."""
    bit = F.expr("shiftleft(1L, CAST(lane & 63 AS INT))")
    return lanes.groupBy(F.shiftright("lane", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _in_words(rows: DataFrame, lane: Column, words: DataFrame) -> DataFrame:
    """rows whose lane has its bit set."""
    mine = words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    hit = rows.withColumn("_lane", lane).withColumn("_word", F.shiftright("_lane", 6)).join(F.broadcast(mine), "_word")
    return hit.filter(F.getbit("_bits", F.col("_lane").bitwiseAND(F.lit(63)).cast("int")) == 1).select(rows.columns)


def baskets(rows: DataFrame, basket: str, item: str, lo: int = 2, hi: int = 25, support: int = 1) -> DataFrame:
    """(basket, items): the sorted items of each basket that holds lo to hi different ones, without those that fewer than
    support rows hold, as no pair with them can have that support (but for a few that share a hashed counter with others). The
    counters have a fixed size, so rows are sorted out where they stand.

    Sizes are counted before items are gathered, so no row holds more than hi of them. Different rows are shuffled once by
    basket, counted and gathered there. Where items are so few that less than a RARE-th of the rows can be below the support, all stay:
    the counters would cost more than they save."""
    d = rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).filter("basket IS NOT NULL AND item IS NOT NULL").distinct()
    sized = d.withColumn("_n", F.count("*").over(Window.partitionBy("basket"))).filter(F.col("_n").between(lo, hi)).drop("_n")
    if support > 1:
        seen = rows.select(F.col(item).alias("item")).filter("item IS NOT NULL")
        some = seen.agg(F.count("*").alias("rows"), F.approx_count_distinct("item").alias("items")).first()
        if some["items"] * (support - 1) * RARE > some["rows"]:
            lane = F.xxhash64("item").bitwiseAND(F.lit(ITEM_COUNTERS - 1))
            sized = _in_words(sized, lane, _words(seen.groupBy(lane.alias("lane")).agg(F.count("*").alias("n")).filter(F.col("n") >= support)))
    return sized.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items") > 1)


def pairs_of(sets: DataFrame) -> DataFrame:
    """(a, b) with a < b for each pair of each row's sorted items; made where the row stands, without a join."""
    tails = F.transform("items", lambda x, i: F.struct(x.alias("a"), F.slice("items", i + 2, F.greatest(F.size("items") - i - 1, F.lit(0))).alias("rest")))
    return sets.select(F.explode(tails).alias("t")).select("t.a", F.explode("t.rest").alias("b"))


def basket_pairs(rows: DataFrame, basket: str, item: str, lo: int = 2, hi: int = 25) -> DataFrame:
    """(a, b) with a < b for each pair of items of each basket that holds lo to hi different items: hi * (hi - 1) / 2 a basket
    at most."""
    return pairs_of(baskets(rows, basket, item, lo, hi))


def _lane(counters: int) -> Column:
    """The counter of pair (a, b): both items' hashes together, as the counting tasks do it."""
    return F.xxhash64("a").bitwiseXOR(F.xxhash64("b")).bitwiseAND(F.lit(counters - 1))


def crowded_lanes(sets: DataFrame, support: int, counters: int) -> DataFrame:
    """(word, bits): which of so many hashed pair counters (a power of two) reach support. Each task counts all its pairs in
    one array of a byte for each counter, stops at support, and sends the parts that aren't empty; the result has a bit
    for each counter, whatever the number of pairs."""

    def count(batches: Iterator[pa.RecordBatch]):
        held = np.zeros(counters, np.uint8)
        for b in batches:
            lists = b.column(0)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            size = np.diff(at)
            for n in np.unique(size):
                hashes = flat[at[:-1][size == n][:, None] + np.arange(n)]
                for i in range(n - 1):
                    lanes, seen = np.unique((hashes[:, i, None] ^ hashes[:, i + 1 :]) & (counters - 1), return_counts=True)
                    held[lanes] = np.minimum(held[lanes].astype(np.int64) + seen, support)
        blocks = held.reshape(-1, min(LANES, counters))
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[k].tobytes() for k in used], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                both = held.get(k, 0) + np.frombuffer(counts, np.uint8).astype(np.uint16)
                held[k] = np.minimum(both, support).astype(np.uint8)
        for k, counts in held.items():
            bits = np.packbits((counts >= support).reshape(-1, 64), axis=1, bitorder="little").view(np.int64).ravel()
            some = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(some + k * (len(counts) // 64)), pa.array(bits[some])], ["word", "bits"])

    if not 1 < support < 256 or counters < 64 or counters & (counters - 1):
        raise ValueError("a support of 2 to 255, and a power of two of 64 counters or more")
    hashed = sets.select(F.transform("items", lambda x: F.xxhash64(x)).alias("hashes"))
    return hashed.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "word long, bits long")


def pair_counts(rows: DataFrame, basket: str, item: str, lo: int = 2, hi: int = 25, support: int = 3, counters: int = 0, keep=lambda df: df) -> DataFrame:
    """(a, b, n): pairs that share support baskets or more.

    Items below the support leave before pairs are made. With counters, pairs are then counted twice: first into so many
    hashed counters, next exactly, but only those whose counter reaches the support. That pays where most pairs are
    rare and there are no more of them than counters; with more, nearly every counter reaches the support, so the first count is left
    out. It never changes the result. keep writes the baskets, which all passes read."""
    sets = baskets(rows, basket, item, lo, hi, support)
    counted = bool(counters) and support > 1
    if counted:
        sets = keep(sets)
        n = F.size("items").cast("bigint")
        counted = (sets.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0) <= counters
    if not counted:
        made = pairs_of(sets)
    else:
        made = _in_words(pairs_of(sets), _lane(counters), crowded_lanes(sets, support, counters))
    return made.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= support)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, from one pass over pairs."""
    turned = F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return pairs.select(F.inline(turned))


def topk_related(pairs: DataFrame, k: int = 6) -> DataFrame:
    """(a, b, n, rank): the k partners of each a by count; ties go to the greater partner."""
    w = Window.partitionBy("a").orderBy(F.desc("n"), F.desc("b"))
    return both_ways(pairs).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def arrival_cap(rows: DataFrame, key: Sequence[str], pos: Sequence[str], k: int) -> DataFrame:
    """The first k rows of each key by position, repeats kept."""
    w = Window.partitionBy(*key).orderBy(*pos)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def capped_sets(rows: DataFrame, key: Sequence[str], value: str, k: int, out: str = "vals") -> DataFrame:
    """The k least different values of each key, sorted. Ranked after distinct, so no group is gathered whole."""
    w = Window.partitionBy(*key).orderBy(value)
    top = rows.select(*key, value).filter(F.col(value).isNotNull()).distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias(out))


def grouped_counts(rows: DataFrame, group: str, item: str, weight: Column | None = None) -> DataFrame:
    """(group, item, n, rank): sums by item, greatest first; ties by item."""
    n = F.count("*") if weight is None else F.sum(weight)
    w = Window.partitionBy(group).orderBy(F.desc("n"), item)
    return rows.groupBy(group, item).agg(n.cast("bigint").alias("n")).withColumn("rank", F.row_number().over(w))


def group_history(rows: DataFrame, key: str, pos: str, who: str, first: dict[str, str], last: dict[str, str]) -> DataFrame:
    """Per key: rows, different who, and columns at the first and last position (by position, not by value). Who is counted apart:
    in one aggregate each key and who would carry its own first and last columns, as many rows as the input has."""
    ends = rows.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("n"), *[F.min_by(c, pos).alias(name) for name, c in first.items()], *[F.max_by(c, pos).alias(name) for name, c in last.items()],
    )
    people = rows.select(key, F.col(who).alias("_who")).filter("_who IS NOT NULL").distinct().groupBy(key).agg(F.count("*").alias("n_who"))
    both = ends.join(people, F.col("_key").eqNullSafe(F.col(key)), "left")
    return both.select(F.col("_key").alias(key), "n", F.coalesce("n_who", F.lit(0).cast("bigint")).alias("n_who"), *first, *last)


def numbered(rows: DataFrame, by: Sequence[str], out: str, keep) -> DataFrame:
    """rows with their place, from 1 on, in the order of by. Rows are sorted by ranges, numbered in each, and shifted by
    the sizes of the ranges before: only one row for each range meets in one task. keep writes the sorted rows, so that
    both steps read the same ones."""
    placed = keep(rows.orderBy(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", "_first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_shift"))
    return placed.join(F.broadcast(shifts), "_part").withColumn(out, F.col("_at") - F.col("_first") + F.col("_shift") + 1).drop("_part", "_at", "_first", "_shift")
