"""Exact top-k search against all inner products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import topk
from sievework.llm.vectors import exact_dot

SCHEMA = "vec_id long, embedding array<double>, label int, node string, q string, x string, h1 int, batch int"


def plain(rows, k, scale=64, asked=lambda i: i is not None and i % 20 == 0):
    """What top_k() promises, by all pairs."""
    held = [(i, [math.floor(scale * v) for v in e]) for i, e in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    out = []
    for p, (i, x) in enumerate(held):
        if asked(i):
            others = sorted(((-sum(a * b for a, b in zip(x, y)), j is None, j or 0) for q, (j, y) in enumerate(held) if q != p and len(x) == len(y)))[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(others, 1)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "a", "b", "c", 2, 3) for i, e in rows], SCHEMA)


def found(df):
    return sorted((tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in df.collect()), key=str)


def asked():
    return F.col("vec_id") % 20 == 0


def clustered(n, dim, seed, spread=0.02, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 4
    return [(i, (middle[i % centres] + rng.normal(size=dim) * spread).tolist()) for i in range(n)]


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randint(-2, 2) / 2 for _ in range(3)]) for i in range(150)]  # many ties and equal vectors
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(200, 260)] + [(240, [0.5, 0.5, 0.5])] * 2  # copies, and identical rows
    rows += [(40, [1.0, 1.0, 1.0]), (40, [-1.0, 0.0, 1.0]), (None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(60, None), (80, [None, 1.0, 1.0]), (100, [float("nan"), 1.0, 0.0]), (120, [float("inf"), 0.0, 0.0]), (300, []), (301, []), (320, [1.0, 2.0]), (321, [2.0, 2.0]), (340, [1.0])]
    df = frame(spark, rows).repartition(5)
    assert found(topk.top_k(df, asked(), k=5, block=16, batch=4, pivots=3, first=1, growth=2)) == plain(rows, 5)
    assert found(topk.top_k(df, asked(), k=20)) == plain(rows, 20)
    assert topk.top_k(df, F.lit(None).cast("boolean")).count() == 0
    assert topk.top_k(df.limit(0), asked()).columns == ["query_id", "rank", "vec_id", "score"] and topk.top_k(df.limit(0), asked()).count() == 0


def test_bounds_exclude_annuli(spark):
    rows = clustered(1200, 8, 1)
    counts = []
    df = frame(spark, rows).repartition(4)
    assert found(topk.top_k(df, asked(), k=10, block=16, batch=16, pivots=12, first=2, growth=4, counts=counts)) == plain(rows, 10)
    opened, every = sum(n for n, _ in counts), counts[0][1]
    assert len(counts) > 1 and opened < every / 3


@pytest.mark.parametrize("dim", [3, 16])
def test_bound_holds(dim):
    rng = np.random.default_rng(dim)
    x = rng.integers(-200, 200, size=(400, dim))
    pivots = topk.fit_pivots(x[:100], 7)
    own = topk.Directory({dim: pivots}, {dim: 0}, *[np.zeros(0)] * 5).away(x)
    near = own.argmin(1)
    away = own[np.arange(len(x)), near]
    held = [(p, near == p) for p in range(len(pivots)) if (near == p).any()]
    directory = topk.Directory({dim: pivots}, {dim: 0}, np.array([p for p, _ in held]), np.array([away[m].min() for _, m in held]), np.array([away[m].max() for _, m in held]), np.array([float((x[m] ** 2).sum(1).max()) for _, m in held]), np.ones(len(held)))
    at, bound = directory.bounds(x)
    for k, a in enumerate(at):
        assert (exact_dot(x, x[held[a][1]]).max(1) <= bound[:, k]).all()


def test_best_of_keeps_first_of_equals():
    scores = np.array([[3, 5, 5, 5, 1], [1, 1, 1, 1, 1]])
    row, column = topk.best_of(scores, np.array([-(1 << 63)] * 2), 2)
    assert list(zip(row.tolist(), column.tolist())) == [(0, 1), (0, 2), (1, 0), (1, 1)]
    assert topk.best_of(scores, np.array([4, 2]), 2)[0].tolist() == [0, 0]


def test_large_numbers_stay_exact(spark):
    rows = [(20 * i, [float((1 << 24) + i), float(i), 1.0]) for i in range(6)]
    assert found(topk.top_k(frame(spark, rows), asked(), k=3)) == plain(rows, 3)
    big = np.array([[1 << 31, 1]]), np.array([[(1 << 30) + 1, 1]])
    assert exact_dot(*big).tolist() == [[(1 << 31) * ((1 << 30) + 1) + 1]]
    with pytest.raises(OverflowError):
        exact_dot(np.array([[1 << 40]]), np.array([[1 << 40]]))
