"""Delta Lloyd against Lloyd's rounds from scratch."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from sievework.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, own string, x string, distance int, cluster int, was int"


def plain(rows, clusters, rounds, dim, scale=1024):
    held = [(i, tuple(math.floor(scale * v) for v in e)) for i, e in rows if e is not None and len(e) == dim and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in order[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in held]
        centres = [tuple(sum(v) // len(m) for v in zip(*m)) if (m := [x for (_, x), o in zip(held, own) if o == k]) else c for k, c in enumerate(centres)]
    last = [nearest(x) for _, x in held]
    sums = [sum(d for d, o in last if o == k) for k in range(len(centres))]
    return sorted(((i, k, d, sums[k], sum(sums), centres[k]) for (i, _), (d, k) in zip(held, last)), key=str)


def found(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "a", "b", 2, 3, 4) for i, e in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rounds", [0, 1, 4, 10])
def test_rounds(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(i, (rng.normal(size=4) + 3 * (i % 5)).tolist()) for i in range(120)]
    assert found(centroids.clustered(frame(spark, rows), clusters=6, rounds=rounds, dim=4)) == plain(rows, 6, rounds, 4)


def test_awkward_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(-2, 3, size=2) / 1024).tolist()) for i in range(60)]  # ties between centroids, equal vectors
    rows += [(7, [0.0, 0.0])] * 3 + [(7, [0.001, 0.0]), (None, [0.5, -0.5]), (None, [0.5, -0.5])]
    rows += [(61, None), (62, [None, 1.0]), (63, [float("nan"), 0.0]), (64, [float("-inf"), 0.0]), (65, [1.0]), (66, []), (67, [1.0, 1.0, 1.0])]
    assert found(centroids.clustered(frame(spark, rows), clusters=5, dim=2)) == plain(rows, 5, 10, 2)
    same = [(i, [1.0, 2.0]) for i in range(12)]  # equal centroids: the first has all rows, the others stay as they are
    assert found(centroids.clustered(frame(spark, same), clusters=3, dim=2)) == plain(same, 3, 10, 2)
    few = rows[:3]
    assert found(centroids.clustered(frame(spark, few), clusters=8, dim=2)) == plain(few, 8, 10, 2)
    assert centroids.clustered(frame(spark, rows).limit(0), dim=2).count() == 0


def test_only_what_changed_is_compared():
    rng = np.random.default_rng(2)
    x, old = rng.integers(-50, 50, size=(300, 3)), rng.integers(-50, 50, size=(7, 3))
    own, d = centroids.reassigned(x, np.full(300, -1), np.zeros(300, np.int64), old, np.ones(7, bool))
    new = old.copy()
    changed = np.array([0, 1, 0, 0, 1, 0, 0], bool)
    new[changed] += rng.integers(-20, 20, size=(2, 3))
    got = centroids.reassigned(x, own, d, new, changed)
    full = centroids.distances(x, new)
    assert (got[0] == full.argmin(1)).all() and (got[1] == full.min(1)).all()
    asked = []
    plain_distances = centroids.distances
    try:
        centroids.distances = lambda a, c: asked.append(len(a) * len(c)) or plain_distances(a, c)
        centroids.reassigned(x, own, d, new, changed)
    finally:
        centroids.distances = plain_distances
    moved = int(changed[own].sum())
    assert sum(asked) == moved * 7 + (300 - moved) * 2
