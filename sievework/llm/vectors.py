"""Vectors of whole numbers, as the vector operators share them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_LONG = 1 << 63


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds numbers only: no null, no NaN, nothing infinite."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def quantised(vector: Column, scale: int, shift: int = 0, most: int = 1 << 53) -> Column:
    """floor(scale * v) + shift of each component as a long; one beyond `most` is an error, as sums and products of it would not be exact."""

    def whole(v: Column) -> Column:
        large = F.raise_error(F.concat(F.lit("a component is too large for exact arithmetic: "), v.cast("string")))
        return F.when(F.abs(v * scale) > most, large.cast("long")).otherwise(F.floor(v * scale) + F.lit(shift).cast("long"))

    return F.transform(vector.cast("array<double>"), whole)


def matrix(vectors: pa.Array | pa.ChunkedArray, size: int | None = None) -> np.ndarray:
    """Lists of equal size, without nulls, as the rows of a matrix."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), (len(flat) // len(vectors) if len(vectors) else 0) if size is None else size)


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers as longs, exactly: by floating-point GEMM where all sums stay below 2^53, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max())))
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound >= _LONG:
        raise OverflowError("an inner product may not fit a long")
    return a.astype(np.int64) @ b.astype(np.int64).T
