"""Centroid clustering by delta Lloyd.

Assignments, with their distances, are kept in a table from round to round, and the sums and sizes of all clusters with
them. A round compares a vector only with the centroids that changed; a vector whose own centroid moved is compared with
all of them, as its old distance says nothing any more. Only vectors that change their cluster touch the sums: they are
taken from one and added to the other as signed whole numbers, which add up without error in any order. A round in which
no centroid changed ends the work, as no later one would change anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import delete, stored_at
from sievework.llm.vectors import exact_dot, matrix, quantised, usable

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, "3"
#: With 64 components of at most this size a squared distance fits a long.
MOST = 1 << 27

_STATE = "x array<int>, own int, was int, distance long"


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centroid, exactly."""
    if not len(centroids):
        return np.zeros((len(x), 0), np.int64)
    x = x.astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * exact_dot(x, centroids) + (centroids * centroids).sum(1)[None, :]


def reassigned(x: np.ndarray, own: np.ndarray, held: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its distance (ties: the smaller number), from those it had: `own` is -1 for none.

    Rows whose owner changed, or that have none, are compared with all centroids, the others only with the changed ones.
    """
    own, held = own.astype(np.int64), held.copy()
    anew = (own < 0) | changed[own]
    full = distances(x[anew], centroids)
    best = full.argmin(1)
    moved = np.flatnonzero(changed)
    some = distances(x[~anew], centroids[moved])
    out = own.copy()
    out[anew], held[anew] = best, full[np.arange(len(best)), best]
    if len(moved):
        near = some.argmin(1)
        d, c, rest = some[np.arange(len(near)), near], moved[near], np.flatnonzero(~anew)
        wins = (d < held[rest]) | ((d == held[rest]) & (c < out[rest]))
        out[rest[wins]], held[rest[wins]] = c[wins], d[wins]
    return out, held


def _assign(centroids: np.ndarray, changed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(2).to_numpy()
            now, d = reassigned(matrix(batch.column(1)), own, batch.column(4).to_numpy(), centroids, changed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(now.astype(np.int32)), pa.array(own), pa.array(d)], batch.schema.names)

    return run


def _transfers(k: int):
    """What the batches' moved rows take from one cluster and add to another: cluster, rows and component sums, signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own, was = matrix(batch.column(0)).astype(np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sums, sizes = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
            for c in range(k):
                sums[c] = x[own == c].sum(0) - x[was == c].sum(0)
                sizes[c] = (own == c).sum() - (was == c).sum()
            at = np.arange(-1, x.shape[1])  # -1 stands for the number of rows
            values = np.concatenate([sizes[:, None], sums], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), len(at)).astype(np.int32)), pa.array(np.tile(at, k).astype(np.int32)), pa.array(values.ravel())], ["cluster", "at", "delta"])

    return run


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """One row for each usable vector: id, cluster, distance (squared), cluster_inertia, inertia and centroid (whole numbers).

    A vector is usable if it has exactly `dim` components, none of them null, NaN or infinite; other rows are left out.
    Components become floor(scale * x); one beyond 2^27 is an error, as its distance would not fit a long. Centroids
    start as the vectors with the smallest SHA-256 of `seed:id` in order of it; rows of one identifier are ordered by
    their vectors, a null identifier comes last. With fewer vectors than clusters there are fewer clusters. Repeated
    rows are rows like others. Columns but the two are not looked at. An empty table gives an empty result.

    The driver holds clusters x dim numbers. Each round writes the assignments anew and deletes the ones before.
    """
    spark = df.sparkSession
    vector = F.col(vector_col)
    rows = df.where(usable(vector) & (F.size(vector) == dim)).select(F.col(id_col).alias("id"), quantised(vector, scale, most=MOST).cast("array<int>").alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    state, path = stored_at(rows.withColumns({"own": F.lit(-1), "was": F.lit(-1), "distance": F.lit(0).cast("long")}), "assignments")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.orderBy(order.asc_nulls_last(), "x").select("x").limit(clusters).collect()  # as many rows as clusters
    centroids = np.array([r["x"] for r in first], np.int64).reshape(len(first), dim)
    k, changed = len(first), np.ones(len(first), bool)
    sums = [[0] * (dim + 1) for _ in range(k)]  # rows, and components, as whole numbers of any size
    for done in range(rounds + 1 if k else 0):
        now, at = stored_at(state.select("id", "x", "own", "was", "distance").mapInArrow(_assign(centroids, changed), f"id {kind}, {_STATE}"), "assignments")
        delete(spark, path)
        state, path = now, at
        if done == rounds:
            break
        moved = state.where("own <> was").select("x", "own", "was").mapInArrow(_transfers(k), "cluster int, at int, delta long")
        for r in moved.groupBy("cluster", "at").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta")).collect():  # clusters x (dim + 1) rows
            sums[r["cluster"]][r["at"] + 1] += int(r["delta"])
        means = np.array([[v // s[0] for v in s[1:]] if s[0] else c.tolist() for s, c in zip(sums, centroids)], np.int64).reshape(k, dim)
        changed = (means != centroids).any(1)
        centroids = means
        if not changed.any():
            break
    inertia = state.groupBy("own").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a cluster
    total = sum(int(r["s"]) for r in inertia)
    each = spark.createDataFrame([(r["own"], int(r["s"]), total, centroids[r["own"]].tolist()) for r in inertia], "_own int, cluster_inertia long, inertia long, centroid array<long>")
    return state.join(F.broadcast(each), F.col("own") == F.col("_own")).select(F.col("id").alias(id_col), F.col("own").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the embeddings, ten rounds."""
    found = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """Lloyd's rounds written out, each from scratch."""
    parts = [
        """WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT 8))"""
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, x, p.d AS d, p.c AS c FROM (
    SELECT v.vec_id, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': k.c}}) AS p
    FROM (SELECT vec_id, x, row_number() OVER () AS u FROM v) v CROSS JOIN c{r} k GROUP BY v.u, v.vec_id, v.x))""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.x, k.x) AS x FROM c{r} k LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x
    FROM (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m ON m.c = k.c)""")
    last = f"a{rounds}"
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM {last} a JOIN c{rounds} k ON k.c = a.c"""


OP12_SQL = _sql()
