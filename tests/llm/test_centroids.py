"""Operator 11 against brute force, and on odd and empty tables."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from corbel.llm import queries
from corbel.llm.centroids import Model, assign, digests, fit, nearest

SF = "/root/testdata/sf0.001"


def plain(rows, k, rounds, dims, scale=256, seed=2):
    """(vec_id, vector) rows: final centroids, and (vec_id, cluster, distance) of each usable row."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds if centroids else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else old for n, old in enumerate(centroids)]
    return centroids, [(i, near(v)[1], near(v)[0]) for i, v in kept] if centroids else []


@pytest.mark.parametrize("seed", range(4))
def test_nearest_finds_the_least_distance_and_number(seed):
    rng = np.random.default_rng(seed)
    dims = (64, 64, 8, 3)[seed]
    vectors, centroids = rng.integers(-3, 3, (300, dims)), rng.integers(-3, 3, (40, dims))
    centroids[20:30] = centroids[5:15]  # ties
    vectors[:40] = centroids
    model = Model(centroids, rng.permutation(dims))
    far = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    to, distance, work = nearest(vectors, model)
    assert to.tolist() == far.argmin(axis=1).tolist() and distance.tolist() == far.min(axis=1).tolist()
    assert work <= far.size * dims + vectors.size


def test_clear_clusters_are_told_apart_by_few_dimensions():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (40, 64))
    vectors = centroids[rng.integers(0, 40, 500)] + rng.integers(-20, 20, (500, 64))
    assert nearest(vectors, Model(centroids, np.arange(64)))[2] < 500 * 40 * 64 / 4


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_ones(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (301, None), (302, [1.0] * 5), (303, [1.0] * 7), (304, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(305, [math.nan] * 6), (306, [math.inf] + [0.0] * 5), (307, []), (308, [-0.001] * 6)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "id long, v array<double>, cluster int, n int, s0 int").repartition(5)
    want, assigned = plain(rows, 9, 3, 6)
    model = fit(df, "id", "v", 9, 3, 6)
    assert model.centroids.tolist() == want
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in assign(df, "id", "v", model).collect()), key=key) == sorted(assigned, key=key)
    assert digests(model) == [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in want]


def test_few_rows_none_and_too_large_ones(spark):
    kind = "id long, v array<float>"
    few = spark.createDataFrame([(1, [0.5, 0.25]), (2, [-0.5, 0.0])], kind)
    model = fit(few, "id", "v", 40, 5, 2)
    assert sorted(model.centroids.tolist()) == [[-128, 0], [128, 64]] and {r["distance"] for r in assign(few, "id", "v", model).collect()} == {0}
    for none in (few.filter("id < 0"), spark.createDataFrame([(None, [1.0, 2.0])], kind)):
        model = fit(none, "id", "v", 40, 5, 2)
        assert len(model.centroids) == 0 and assign(none, "id", "v", model).count() == 0 and assign(none, "id", "v", model).columns == ["id", "cluster", "distance"]
    with pytest.raises(Exception, match="64 bits"):
        fit(spark.createDataFrame([(1, [1e30, 0.0])], kind), "id", "v", 40, 5, 2)


def test_query_equals_its_sql(spark):
    got = queries.QUERIES["op11_centroid_clusters"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE["op11_centroid_clusters"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
