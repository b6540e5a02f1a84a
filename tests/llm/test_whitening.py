"""Whitening against numpy on whole vectors and Python's whole numbers."""

from __future__ import annotations

import math

import numpy as np

from sievework.llm import whitening
from sievework.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n int, whitened string, deviation int, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "a", 2, "b", 3, 4) for i, e in rows], SCHEMA).repartition(3)


def plain(rows, dim, components):
    held = [(i, [math.floor(64 * v) + 1_000_000 for v in e]) for i, e in rows if e is not None and len(e) == dim and all(v is not None and math.isfinite(v) for v in e)]
    n, sums = len(held), [sum(c) for c in zip(*[x for _, x in held])]
    centred = np.array([[float(v - s // n) - (s % n) / n for v, s in zip(x, sums)] for _, x in held])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    w = centred @ vectors[:, order] / np.sqrt(values[order])
    return [(i, n, sum((n * v - s) ** 2 for v, s in zip(x, sums))) for i, x in held], w, values[order] / values.sum()


def matches(got, rows, dim, components):
    exact, w, share = plain(rows, dim, components)
    assert sorted(((r.vec_id, r.n, int(r.deviation)) for r in got), key=str) == sorted(exact, key=str)
    mine = np.array([r.whitened for r in sorted(got, key=lambda r: (str(r.vec_id), int(r.deviation)))])
    w = w[sorted(range(len(exact)), key=lambda k: (str(exact[k][0]), exact[k][2]))]
    sign = np.sign((mine * w).sum(0))
    assert np.abs(mine - w * sign).max() < 1e-8
    assert all(np.allclose(r.explained, share, rtol=1e-9) and r.identity_error < 1e-9 for r in got)
    cov = (mine - mine.mean(0)).T @ (mine - mine.mean(0)) / len(mine)
    assert np.abs(cov - np.eye(len(share))).max() < 1e-9


def test_whitened(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6)) * [5, 4, 3, 2, 1, 0.5]
    rows = [(i, (rng.normal(size=6) @ mix + 100).tolist()) for i in range(90)]
    rows += [rows[3]] * 4 + [(None, rows[5][1]), (200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [math.inf] * 6), (204, []), (205, [1.0] * 5)]
    matches(whitening.whitened(frame(spark, rows), components=4).collect(), rows, 6, 4)
    matches(whitening.whitened(frame(spark, rows)).collect(), rows, 6, 6)


def test_degenerate(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [*rng.normal(size=2).tolist(), 7.0]) for i in range(40)]  # one dimension is constant: two directions are left
    got = whitening.whitened(frame(spark, rows)).collect()
    assert {len(r.whitened) for r in got} == {2} and got[0].identity_error < 1e-9 and abs(sum(got[0].explained) - 1) < 1e-12
    assert whitening.whitened(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitening.whitened(frame(spark, rows[:1])).count() == 0
    assert whitening.whitened(frame(spark, rows).limit(0)).count() == 0
    assert whitening.whitened(frame(spark, [(1, None), (2, [])])).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_longs():
    x = np.array([[1 << 39, 5], [-(1 << 39), 6]])
    n, sums = 1 << 24, [3, 11]
    assert whitening.deviations(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert whitening.deviations(np.array([[4, 5]]), 3, [10, 11]) == [4 + 16]


def test_moments_merge():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)) + 1e6
    a, b = whitening.Moments(3).with_rows(x[:20]), whitening.Moments(3).with_rows(x[20:])
    m = a.merged(b).merged(whitening.Moments(3))
    assert m.n == 50 and np.allclose(m.products, (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-9)


def test_query(spark, sf):
    got = QUERIES["op13_embedding_whitening"](spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    exact, w, share = plain(rows, 64, 32)
    by = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(by) == len(rows) * 32
    mine = np.array([[by[i, c].whitened for c in range(1, 33)] for i, _, _ in exact])
    assert np.abs(mine - w * np.sign((mine * w).sum(0))).max() < 1e-8
    assert all(by[i, c].deviation == d and by[i, c].n == n and math.isclose(by[i, c].explained, share[c - 1], rel_tol=1e-9) for i, n, d in exact for c in (1, 32))
