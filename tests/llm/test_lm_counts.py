"""Counts beyond 32 bits stay exact in the unigram score, whichever way they reach it."""

from __future__ import annotations

import numpy as np
import pytest

from sievework.llm import lm_scoring


def test_counts_beyond_32_bits(spark):
    words = {w: int(lm_scoring.token_hashes(w)[0]) for w in ("often", "seldom")}
    end = lm_scoring.token_hashes("")[0]
    hashes = np.array([words["often"], words["seldom"], end], np.uint64)
    counts = np.array([5 * 2**32 + 3, 7, 2**33 + 1], np.int64)
    raw = lm_scoring.filled_slice(hashes, lm_scoring.level_of(counts))
    row = (0, 3, int(counts.sum()), int(counts.sum()), bytearray(raw), bytearray(hashes.astype("<u8").tobytes()), bytearray(counts.astype("<i8").tobytes()))
    table = spark.createDataFrame([row], "shard int, words long, tokens long, held_tokens long, filter binary, hashes binary, counts binary")
    held = lm_scoring.Counts(table, 1, 1)
    n, v = int(counts.sum()), 3
    of = dict(zip(("often", "seldom", None), counts.tolist()))
    texts = ["often seldom often", "seldom", "never often", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for more in ({}, {"max_filter_bytes": 0}, {"heavy_words": 2}):
        got = {r.doc_id: r.base_score for r in lm_scoring.score_texts(df, held, **more).collect()}
        for i, t in enumerate(texts):
            want = sum(np.log10((of.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in [*t.split(), None])
            assert got[i] == pytest.approx(want, abs=1e-9)
