"""Embedding whitening by two-pass covariance.

The first pass adds up whole numbers, exactly, which gives the mean. The second takes each vector's distance from it,
multiplies batches of them by GEMM, and merges the tasks' matrices in a tree, so the driver meets a few of them only. The
driver finds the eigenvectors of one symmetric matrix with LAPACK and sends back a projection. Both are bounded by the
square of the dimension, not by the corpus. A third pass measures the covariance of what came out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import stored
from sievework.llm.vectors import matrix, quantised, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: The driver holds a few matrices of the square of the dimension: 128 MB each at this one.
MOST_DIM = 4096
#: Components beyond this are an error: sums of a batch of them are exact in longs.
MOST = 1 << 40


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch and dimension: dimension, rows, their sum."""
    for batch in batches:
        if batch.num_rows:
            s = matrix(batch.column(0)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s)).astype(np.int32)), pa.array(np.full(len(s), batch.num_rows)), pa.array(s)], ["at", "n", "s"])


class Moments:
    """Rows, mean and centred products of a set of vectors; two of them merge into that of their union."""

    def __init__(self, dim: int, n: int = 0, mean: np.ndarray | None = None, products: np.ndarray | None = None):
        self.n, self.mean, self.products = n, np.zeros(dim) if mean is None else mean, np.zeros((dim, dim)) if products is None else products

    def with_rows(self, x: np.ndarray) -> Moments:
        """All that is multiplied is centred first, on the mean of its own batch."""
        mean = x.mean(0)
        return self.merged(Moments(x.shape[1], len(x), mean, (x - mean).T @ (x - mean)))

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        self.products = self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.n = n
        return self


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles: whole numbers are subtracted first, so nothing is lost to the size of the mean."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - s // n * n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S) ** 2, exactly; in Python's whole numbers where longs would not do."""
    if not x.size:
        return [0] * len(x)
    most = max(abs(n * int(f(x[:, i])) - s) for i, s in enumerate(sums) for f in (np.min, np.max))
    large = n * max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 62 or max(map(abs, sums)) >= 1 << 62 or most * most * x.shape[1] >= 1 << 63
    off = x.astype(object) * n - np.array(sums, object) if large else x * n - np.array(sums, np.int64)
    return [int(v) for v in (off * off).sum(1)]


def _products(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), len(sums)))
        some = False
        for batch in batches:
            if batch.num_rows:
                c = centred(matrix(batch.column(0)), n, sums)
                total += c.T @ c
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def _moments(n: int, sums: list[int], projection: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments(projection.shape[1])
        for batch in batches:
            if batch.num_rows:
                found = found.with_rows(centred(matrix(batch.column(0)), n, sums) @ projection)
        if found.n:
            yield pa.RecordBatch.from_arrays([pa.array([found.n]), pa.array([found.mean.tobytes()], pa.binary()), pa.array([found.products.tobytes()], pa.binary())], ["n", "mean", "m"])

    return run


def _project(n: int, sums: list[int], projection: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), len(sums))
            w = np.ascontiguousarray(centred(x, n, sums) @ projection)
            at = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            out = pa.ListArray.from_arrays(pa.array(at), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(str, deviations(x, n, sums)), pa.string()), out], ["id", "deviation", "whitened"])

    return run


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row for each vector that is left: id, n, deviation decimal, whitened array<double>, explained array<double>, identity_error.

    Vectors that are null or hold a null, NaN or infinite entry go. Entries become floor(scale * c) + shift. All that are
    left are the fit list. Vectors of several sizes have no common covariance: those of the most frequent size stay (of
    equally frequent ones the smallest), the others go, and so do vectors of more than MOST_DIM entries (an error if
    they are the most frequent). `whitened` has the components by falling eigenvalue, `components` at most and only those
    whose eigenvalue is not zero to double precision: a constant dimension, or fewer vectors than dimensions, leave no
    direction to scale. Equal vectors all give no row. Signs are arbitrary but one for all rows. `deviation` is exact
    and may be beyond a long. Repeated rows and null identifiers are rows like others; other columns are not looked at.
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    vector = F.col(vector_col)
    rows = df.where(usable(vector)).select(F.col(id_col).alias("id"), quantised(vector, scale, shift, MOST).alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    held = stored(rows.where(F.size("x") > 0), "whole-vectors")
    none = spark.createDataFrame([], f"`{id_col}` {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    usual = held.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if not usual:
        return none
    dim = usual["dim"]
    if dim > MOST_DIM:
        raise ValueError(f"vectors of {dim} entries; at most {MOST_DIM} can be whitened")
    held = held.where(F.size("x") == dim)
    totals = held.select("x").mapInArrow(_sums, "at int, n long, s long").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()  # a row a dimension
    n, sums = int(totals[0]["n"]), [int(r["s"]) for r in totals]
    square = (dim, dim)
    parts = held.select("x").mapInArrow(_products(n, sums), "m binary").rdd
    covariance = parts.treeAggregate(np.zeros(square), lambda a, r: a + np.frombuffer(r["m"]).reshape(square), lambda a, b: a + b) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    kept = int((values[:components] > max(values[0], 0) * dim * np.finfo(float).eps * 4).sum())
    if not kept:
        return none
    projection = vectors[:, :kept] / np.sqrt(values[:kept])
    parts = held.select("x").mapInArrow(_moments(n, sums, projection), "n long, mean binary, m binary").rdd
    own = (kept, kept)
    found = parts.treeAggregate(Moments(kept), lambda a, r: a.merged(Moments(kept, r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m"]).reshape(own))), lambda a, b: a.merged(b))
    error = float(np.abs(found.products / n - np.eye(kept)).max())
    explained = F.lit((values[:kept] / np.trace(covariance)).tolist()).cast("array<double>")
    out = held.select("id", "x").mapInArrow(_project(n, sums, projection), f"id {kind}, deviation string, whitened array<double>")
    return out.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; a deviation beyond a long, as some 10^7 vectors may have, is null here and whole in whitened()."""
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_c")
    rows = found.select("vec_id", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("_at") + 1).alias("component"), "n", "deviation", F.col("_c.whitened").alias("whitened"), F.col("_c.explained").alias("explained"), "identity_error")
