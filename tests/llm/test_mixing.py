"""The schedule against the target weights themselves, not against rounded shares."""

from __future__ import annotations

from fractions import Fraction

import pytest

from sievework.llm import mixing


@pytest.mark.parametrize(
    "weights",
    [{"hot": 0.5} | {f"s{i}": 0.025 for i in range(20)}, {"tiny": 0.0001, "rest": 0.9999}, {"a": 1200**0.7, "b": 37**0.7, "c": 5**0.7}, {"a": 0.5, "b": 0.3, "c": 0.2}],
)
def test_deviation_from_weights(weights):
    total = sum(Fraction(str(w)) for w in weights.values())
    blocks = dict.fromkeys(weights, 20000)
    first = mixing.phases(blocks, weights)[0]
    source_of = {int(at): s for s, own in first["slots"].items() for at in own}
    assert sorted(source_of) == list(range(len(source_of))) and len(source_of) >= 20000
    given = dict.fromkeys(weights, 0)
    for slot in range(len(source_of)):
        given[source_of[slot]] += 1
        if slot % 37 == 0 or slot < 500:
            assert all(abs(given[s] - Fraction(str(w)) / total * (slot + 1)) < 1 for s, w in weights.items())


def test_slots_of_all_phases(spark):
    rows = [(i, s) for i, s in enumerate(["a"] * 300 + ["b"] * 40 + ["c"] * 7)]
    weights = {"a": 0.51, "b": 0.3003, "c": 0.1897}
    df = mixing.stored(spark.createDataFrame(rows, "doc_id long, source string"), "mix-test")
    got = mixing.mix(df, weights, block_rows=1).collect()
    assert sorted(r.mix_block for r in got) == list(range(347))
    planned = mixing.phases({"a": 300, "b": 40, "c": 7}, weights)
    want = {int(at) + p["slot"]: s for p in planned for s, own in p["slots"].items() for at in own}
    assert {r.mix_block: r.source for r in got} == want
