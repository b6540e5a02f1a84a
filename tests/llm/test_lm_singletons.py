"""Words and pairs that training saw once count as seen."""

from __future__ import annotations

from collections import Counter

import numpy as np

from sievework.llm import lm_scoring


def test_count_of_a_level():
    assert lm_scoring.count_at(np.arange(4)).tolist() == [0.0, 1.0, 2.5, 5.5]


def test_scores_use_singletons(spark):
    train = [(i, f"common words here once{i} twice{i // 2}") for i in range(40)]
    df = spark.createDataFrame(train, "doc_id long, text string")
    counts = lm_scoring.count_grams(df, shards=3)
    assert counts.held_share == 1.0
    texts = [[*t.split(), None] for _, t in train]
    words, pairs = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip([None, *t], t))
    read = lambda n: float(lm_scoring.count_at(lm_scoring.level_of(np.array([n])))[0])
    for more in ({}, {"max_filter_bytes": 300}):
        got = {r.doc_id: r.score for r in lm_scoring.score_texts(df, counts, **more).collect()}
        exact = 0
        for (i, _), t in zip(train, texts):
            w, p = np.array([read(words[x]) for x in t]), np.array([read(pairs[x]) for x in zip([None, *t], t)])
            exact += abs(got[i] - lm_scoring.probability(w, p, counts.tokens, counts.words, 1.0)) < 1e-9
        assert exact >= 30  # a filter reads some counts one level too high by chance
