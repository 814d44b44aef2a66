"""Query op11: clusters of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import assign, digests, fit
from .common import settle, table

K, ROUNDS, DIMS = 40, 5, 64


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors, "vec_id", "embedding", K, ROUNDS, DIMS)
    rows = settle(assign(vectors, "vec_id", "embedding", model), "op11")
    by_cluster = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row for each centroid
    named = [(i, by_cluster.get(i, 0), sum(by_cluster.values()), h) for i, h in enumerate(digests(model))]
    sums = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """One table of centroids and one of assignments for each round; the last assignment gives the rows."""
    square = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)"
    near = f"SELECT r, arg_min(k, dist * 64 + k) AS k, min(dist) AS dist FROM (SELECT r, k, {square} AS dist FROM v, c{{i}}) GROUP BY r"
    move = """SELECT c{i}.k, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
  SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY j) AS c FROM (
    SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS j, unnest(v) AS x FROM a{i} JOIN v USING (r)) GROUP BY k, j
  ) GROUP BY k
) n USING (k)"""
    steps = [f"a{i} AS MATERIALIZED ({near.format(i=i)}), c{i + 1} AS MATERIALIZED ({move.format(i=i)})" for i in range(ROUNDS)]
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k, v AS c FROM v WHERE vec_id IS NOT NULL QUALIFY k < {K}
), {", ".join(steps)}, a AS MATERIALIZED ({near.format(i=ROUNDS)}), s AS (SELECT k, sum(dist) AS n FROM a GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, dist AS distance, CAST(s.n AS BIGINT) AS cluster_inertia, CAST((SELECT sum(n) FROM s) AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN v USING (r) JOIN c{ROUNDS} USING (k) JOIN s USING (k)"""


SQL = _sql()
