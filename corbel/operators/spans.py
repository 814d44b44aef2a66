"""Which span holds a point most narrowly: ranges of positions, each solved by itself.

Positions are ordered by (group, place) and cut into ranges by borders drawn from a sample of points and span ends. A point goes to its
range. A span goes to the range where it starts and to the one where it ends, if it covers just a part of them; of the
spans that cover a range wholly, the narrowest alone matters there, so each task sends one for each range. So every point is
shuffled once and every span twice at most, however long it is, and a range holds about as many rows as any other: where one
position has the points of several ranges, these share them out, as the spans that hold it cover all of them.

Inside a range nothing is compared pair by pair either: spans by width are laid over the sorted points in doubling steps.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled positions for each range.
SAMPLED = 20


class Borders(NamedTuple):
    """Sorted borders (group, place): groups that have any, where each one's places begin (and all end), and the places."""

    groups: list[Any]
    starts: np.ndarray
    places: np.ndarray


def _borders(points: DataFrame, spans: DataFrame, ranges: int) -> Borders:
    """A uniform sample of bounded size, whatever the tables' sizes: the rows with the least random numbers."""
    ends = spans.select("grp", F.explode(F.array("lo", "hi")).alias("at"))
    drawn = points.select("grp", "at").unionByName(ends).withColumn("_r", F.rand(7)).orderBy("_r").limit(SAMPLED * ranges)
    sample = sorted((r["grp"], r["at"]) for r in drawn.collect())  # SAMPLED * ranges rows at most
    chosen = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []
    groups = sorted({g for g, _ in chosen})
    starts = np.cumsum([0, *(sum(1 for h, _ in chosen if h == g) for g in groups)])
    return Borders(groups, starts, np.array([p for _, p in chosen]))


def _around(borders: Borders, grp: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, how many borders are less, and how many are not greater."""
    coded = pc.dictionary_encode(grp)
    code = coded.indices.to_numpy(zero_copy_only=False)
    low = np.empty(len(code), np.int64)
    high = np.empty(len(code), np.int64)
    known, names = {g: k for k, g in enumerate(borders.groups)}, coded.dictionary.to_pylist()
    before = np.array([borders.starts[bisect_left(borders.groups, g)] for g in names], np.int64)
    low[:] = high[:] = before[code] if len(names) else 0
    for k, g in enumerate(names):
        if g in known:
            mine = code == k
            own = borders.places[borders.starts[known[g]] : borders.starts[known[g] + 1]]
            low[mine] += np.searchsorted(own, place[mine], "left")
            high[mine] += np.searchsorted(own, place[mine], "right")
    return low, high


def first_over(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the number of the first interval (begin to before end, none empty) that covers it, or -1.

    Each interval is two steps of a power of two that overlap; steps of a size are halved until they are single places."""
    none = len(begin)
    level = np.frexp((end - begin).astype(float))[1] - 1
    held = np.full(n, none)
    for k in range(int(level.max()) if none else 0, -1, -1):
        if k < (level.max() if none else 0):  # halve what the longer steps have left
            half = held.copy()
            half[1 << k :] = np.minimum(half[1 << k :], held[: n - (1 << k)])
            held = half
        mine = np.flatnonzero(level == k)[::-1]  # the first one is written last
        step = np.full(n, none)
        step[begin[mine]] = mine
        held = np.minimum(held, step)
        step[:] = none
        step[end[mine] - (1 << k)] = mine
        held = np.minimum(held, step)
    return np.where(held == none, -1, held)


def _by_width(spans: pa.Table) -> pa.Table:
    order = pc.sort_indices(spans.append_column("_w", pc.subtract(spans.column("hi"), spans.column("lo"))), sort_keys=[("_w", "ascending"), ("ord", "ascending"), ("span", "ascending")])
    return spans.take(order)


def _numpy(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _solve(points: pa.Table, spans: pa.Table) -> tuple[np.ndarray, pa.Table, np.ndarray]:
    """Rows of points that a span holds, the spans by width, and the number among them of each such point's one."""
    spans = _by_width(spans)
    coded = pc.dictionary_encode(pa.chunked_array([*points.column("grp").chunks, *spans.column("grp").chunks])).combine_chunks()
    code = _numpy(coded.indices if isinstance(coded, pa.DictionaryArray) else coded.chunk(0).indices).astype(np.int64)
    of_point, of_span = code[: points.num_rows], code[points.num_rows :]
    at = _numpy(points.column("at"))
    places = np.unique(at)
    key = of_point * (len(places) + 1) + np.searchsorted(places, at)
    order = np.argsort(key, kind="stable")
    low = of_span * (len(places) + 1) + np.searchsorted(places, _numpy(spans.column("lo")), "left")
    high = of_span * (len(places) + 1) + np.searchsorted(places, _numpy(spans.column("hi")), "right")
    begin, end = np.searchsorted(key[order], low, "left"), np.searchsorted(key[order], high, "left")
    some = np.flatnonzero(begin < end)
    got = first_over(begin[some], end[some], points.num_rows)
    hit = np.flatnonzero(got >= 0)
    return order[hit], spans, some[got[hit]]


def placed(points: DataFrame, spans: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """points (grp, at, id) and spans (grp, lo, hi, ord, span) with the ranges that they go to, and meet in."""
    borders = _borders(points, spans, ranges) if ranges > 1 else Borders([], np.zeros(1, np.int64), np.zeros(0))

    def place_points(batches):
        rng = np.random.default_rng(7)
        for b in batches:
            low, high = _around(borders, b.column("grp"), _numpy(b.column("at")))
            shared = high - low  # ranges low + 1 to high - 1 hold nothing but a border that comes so often
            to = np.where(shared > 1, low + 1 + rng.integers(0, np.maximum(shared - 1, 1)), high)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), b.column("grp"), b.column("at"), b.column("id")], ["range", "grp", "at", "id"])

    def place_spans(batches):
        whole = None  # for each range that is covered, the narrowest span so far
        for b in batches:
            low, at_low = _around(borders, b.column("grp"), _numpy(b.column("lo")))
            below_hi, high = _around(borders, b.column("grp"), _numpy(b.column("hi")))
            last = np.where(high - below_hi > 1, high - 1, high)
            first = np.where(at_low > low, low + 1, at_low)
            cover = np.stack([low + 1, high])  # ranges from the one to before the other
            inside = lambda r: (r >= cover[0]) & (r < cover[1])  # noqa: E731, B023
            ends, starts = np.flatnonzero(~inside(last)), np.flatnonzero(~inside(first) & (first != last))
            rows = np.concatenate([ends, starts])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([last[ends], first[starts]]), pa.int32()), *(c.take(pa.array(rows)) for c in b.columns)], ["range", *b.schema.names])
            long = np.flatnonzero(cover[0] < cover[1])
            if len(long):
                some = pa.table({"range": pa.array(cover[0][long], pa.int32()), "to": pa.array(cover[1][long], pa.int32()), **{c: b.column(c).take(pa.array(long)) for c in b.schema.names}})
                held = _by_width(some if whole is None else pa.concat_tables([whole, some]))
                got = first_over(_numpy(held.column("range")), _numpy(held.column("to")), ranges)
                there = np.flatnonzero(got >= 0)
                whole = held.take(pa.array(got[there])).set_column(0, "range", pa.array(there, pa.int32())).set_column(1, "to", pa.array(there + 1, pa.int32()))
        if whole is not None:
            yield from whole.drop_columns(["to"]).combine_chunks().to_batches()

    ranged = lambda df: T.StructType([T.StructField("range", T.IntegerType()), *df.schema])
    return points.mapInArrow(place_points, ranged(points)), spans.mapInArrow(place_spans, ranged(spans))


def innermost_span(points: DataFrame, spans: DataFrame, ranges: int | None = None) -> DataFrame:
    """points (grp, at, id) that a span (grp, lo, hi, span, ord) holds: (id, span) of the narrowest; ties: least ord, then span.

    at, lo and hi are numbers, both ends belong to a span. Rows with a null group, place or end match nothing; nor do spans
    that end before they start. ranges: as many as shuffle partitions if not given; only speed and memory hang on it. Repeated points
    give a row each."""
    n = ranges or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = points.select("grp", "at", "id").filter("grp IS NOT NULL AND at IS NOT NULL")
    s = spans.select("grp", "lo", "hi", "ord", "span").filter("grp IS NOT NULL AND lo <= hi")

    def solve(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, ordered, which = _solve(left, right)
        return pa.table({"id": left.column("id").take(pa.array(rows)), "span": ordered.column("span").take(pa.array(which))})

    out = T.StructType([points.schema["id"], spans.schema["span"]])
    at, over = placed(p, s, n)
    return at.groupBy("range").cogroup(over.groupBy("range")).applyInArrow(solve, out)
