"""Nearest vectors of many questions against all pairs."""

from __future__ import annotations

import numpy as np

from sievework.operators import nearest as N

SCHEMA = "vec_id long, embedding array<double>, label string, team int"


def plain(questions, rows, k, scope):
    def usable(r):
        return r[0] is not None and all(r[c] is not None for c in scope) and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    out = []
    for q in filter(usable, questions):
        a = np.array(q[1]) / np.linalg.norm(q[1])
        near = sorted((-round(float(a @ (np.array(r[1]) / np.linalg.norm(r[1]))), 9), r[0]) for r in rows if usable(r) and r[0] != q[0] and len(r[1]) == len(q[1]) and all(r[c] == q[c] for c in scope))
        out += [(q[0], n, i, -s) for n, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r.question, r.rank, r.vec_id, round(r.similarity, 9)) for r in df.collect())


def test_scopes_and_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, size=3).astype(float).tolist(), "ab"[i % 2], i % 3) for i in range(200)]  # ties, equal vectors, zeros
    rows += [(300, None, "a", 0), (301, [], "a", 0), (302, [None, 1.0, 1.0], "a", 0), (303, [float("nan")] * 3, "a", 0), (304, [1.0, 2.0], "a", 0), (305, [2.0, 2.0], "a", 0), (306, [1.0, 0.0, 0.0], None, 0), (350, [1.0, 1.0], "a", 0), (400, [1e300, 1e300, 0.0], "c", 0), (None, [1.0, 0.0, 0.0], "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = [r for r in rows if r[0] is None or r[0] % 10 == 0]
    q = spark.createDataFrame(asked, SCHEMA)
    for scope, columns in (("label",), (2,)), (("label", "team"), (2, 3)):
        assert got(N.nearest_for_each(q, df, 5, scope, pivots=4, block=16, batch=7)[0]) == plain(asked, rows, 5, columns)
    assert N.nearest_for_each(q.limit(0), df)[0].count() == 0 and N.nearest_for_each(q, df.limit(0))[0].count() == 0


def test_far_cells_are_not_compared(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * 0.02).tolist(), "a", 0) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = rows[::50]
    found, compared = N.nearest_for_each(spark.createDataFrame(asked, SCHEMA), df, 8, pivots=20)
    assert got(found) == plain(asked, rows, 8, (2,))
    assert sum(r.compared for r in compared.collect()) < len(asked) * len(rows) / 4
