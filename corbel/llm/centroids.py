"""Centroid clustering of integer vectors, with a partial-distance search for the nearest centroid.

Each component x becomes floor(scale * x). The first centroids are the k vectors whose ids hash least; each round assigns
every vector to its nearest centroid and moves each centroid that has vectors to the floor of their mean. All sums are of
integers, so the result does not depend on how the rows are spread.

What travels: the centroids (k * dims integers) with each task, and back one row of sums for each task and centroid. The
vectors themselves are never shuffled nor written: every round is one scan of the vector column alone.

Defined results: vectors that are null, have another number of components, or hold a null, NaN or infinity are left out;
repeated rows count each; rows with a null id are assigned and summed like others but never become a first centroid; ids that
clash among the first centroids go by their vectors; fewer than k vectors give fewer centroids, and an empty table no rows; a
component beyond 2^27 after scaling is an error, as squared distances would leave 64 bits. Other columns of the table are not
carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions that every centroid gets before the first comparison, and ends of the later groups of dimensions.
FIRST, ENDS = 8, (16, 32)
#: Vectors that one numpy pass holds: its widest array has a number for each of them and each centroid.
ROWS = 4096
#: Greatest scaled component: 64 squares of differences of two such stay below 2^63.
REACH = 1 << 27


class Model(NamedTuple):
    """Centroids by number, and the dimensions in the order in which the search takes them."""

    centroids: np.ndarray
    order: np.ndarray


def scaled(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors, and their components as integers (one row each)."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = np.isfinite(flat).all(axis=1)
    whole = np.floor(flat[good] * scale)
    if whole.size and np.abs(whole).max() > REACH:
        raise ValueError(f"a component beyond {REACH} after scaling: squared distances would not fit 64 bits")
    return fits[good], whole.astype(np.int64)


def nearest(vectors: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller), squared distance, and how many squared differences were summed.

    Dimensions come by falling variance. After the first few, the centroid that leads is finished: its distance is the best so far.
    The others go on group by group and are given up once strictly above it; those that are left finish all dimensions."""
    v, c = vectors[:, model.order], model.centroids[:, model.order]
    rows, dims, first = np.arange(len(v)), v.shape[1], min(FIRST, v.shape[1])
    sums = np.zeros((len(v), len(c)), np.int64)
    for j in range(first):
        step = v[:, j, None] - c[None, :, j]
        sums += step * step
    lead = sums.argmin(axis=1)
    rest = v[:, first:] - c[lead, first:]
    best = sums[rows, lead] + (rest * rest).sum(axis=1)
    at, to = np.nonzero(sums <= best[:, None])
    part, work = sums[at, to], sums.size * first + rest.size
    for low, high in zip((first, *[e for e in ENDS if first < e < dims]), (*[e for e in ENDS if first < e < dims], dims), strict=True):
        step = v[at, low:high] - c[to, low:high]
        part = part + (step * step).sum(axis=1)
        work += step.size
        left = part <= best[at]
        at, to, part = at[left], to[left], part[left]
    starts = np.searchsorted(at, rows)  # every row has its leading centroid at least
    least = np.minimum.reduceat(part, starts) if len(rows) else part
    hit = np.flatnonzero(part == least[at])
    return to[hit[np.searchsorted(at[hit], rows)]], least, work


def _blocks(batch: pa.RecordBatch, column: str, dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        yield part, *scaled(part.column(column), dims, scale)


def _first(vectors: DataFrame, id: str, column: str, k: int, dims: int, scale: int, seed: int) -> np.ndarray:
    """The k first centroids; k vectors at most reach the driver."""
    usable = (F.size(column) == dims) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")), 256)
    got = vectors.filter(F.col(id).isNotNull() & F.col(column).isNotNull()).filter(usable).select(key.alias("key"), F.col(column).alias("vector")).orderBy("key", "vector").limit(k)
    return scaled(got.select("vector").toArrow().column("vector").combine_chunks(), dims, scale)[1]


def _order(vectors: DataFrame, column: str, dims: int, scale: int) -> np.ndarray:
    """Dimensions by falling variance over all vectors. Only speed hangs on it, so doubles will do."""

    def moments(batches):
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for b in batches:
            for _, _, v in _blocks(b, column, dims, scale):
                n, s, q = n + len(v), s + v.sum(axis=0), q + (v.astype(float) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()), "s": pa.array(s), "q": pa.array(q)})

    sums = vectors.select(column).mapInArrow(moments, "dim int, n long, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).toArrow()
    got = {name: sums.column(name).to_numpy() for name in ("dim", "n", "s", "q")}
    variance = np.zeros(dims)
    n = np.maximum(got["n"], 1)
    variance[got["dim"]] = got["q"] / n - (got["s"] / n) ** 2
    return np.argsort(-variance, kind="stable")


def _moved(vectors: DataFrame, column: str, model: Model, dims: int, scale: int) -> np.ndarray:
    """Centroids after one round: of the sums of each task, one row for each centroid and task is shuffled."""
    k = len(model.centroids)

    def sums(batches):
        n, s = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for _, _, v in _blocks(b, column, dims, scale):
                to = nearest(v, model)[0]
                n += np.bincount(to, minlength=k)
                by = np.argsort(to, kind="stable")
                has, at = np.unique(to[by], return_index=True)
                if len(has):
                    s[has] += np.add.reduceat(v[by], at, axis=0)
        used = np.flatnonzero(n)
        parts = [pa.array(used, pa.int32()), pa.array(n[used]), *(pa.array(s[used, j]) for j in range(dims))]
        yield pa.RecordBatch.from_arrays(parts, ["cluster", "n", *(f"s{j}" for j in range(dims))])

    schema = "cluster int, n long, " + ", ".join(f"s{j} long" for j in range(dims))
    total = vectors.select(column).mapInArrow(sums, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(dims)]).toArrow()
    out, cluster, n = model.centroids.copy(), total.column("cluster").to_numpy(), total.column("n").to_numpy()
    for j in range(dims):
        out[cluster, j] = total.column(f"s{j}").to_numpy() // n
    return out


def fit(vectors: DataFrame, id: str, column: str, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> Model:
    """Centroids after so many rounds. vectors is scanned once for each round and twice more: write it before if it is costly."""
    start = _first(vectors, id, column, k, dims, scale, seed)
    if not len(start):
        return Model(start.reshape(0, dims), np.arange(dims))
    model = Model(start, _order(vectors, column, dims, scale))
    for _ in range(rounds):
        model = model._replace(centroids=_moved(vectors, column, model, dims, scale))
    return model


def assign(vectors: DataFrame, id: str, column: str, model: Model, scale: int = 256) -> DataFrame:
    """(id, cluster, distance) of every usable vector; no shuffle."""
    dims = len(model.order)

    def run(batches):
        for b in batches:
            for part, rows, v in _blocks(b, column, dims, scale):
                if len(rows) and len(model.centroids):
                    to, distance, _ = nearest(v, model)
                    yield pa.RecordBatch.from_arrays([part.column(id).take(pa.array(rows)), pa.array(to, pa.int32()), pa.array(distance)], [id, "cluster", "distance"])

    kind = vectors.schema[id].dataType.simpleString()
    return vectors.select(id, column).mapInArrow(run, f"`{id}` {kind}, cluster int, distance long")


def digests(model: Model) -> list[str]:
    """sha256 of each centroid's components, as decimal integers joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids.tolist()]
