"""The search index against the regular expression of each term over all texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievework.functions.text import has_term
from sievework.operators import search_index as I

TEXTS = ["Python and SQL", "python, c++ and C", "a data lake", "Data  lake", "data lake data lake.", "x.net .NET", "", None, "c++x", "pythonic", "the the end", "Zoë's café_1", "data\nlake", "and AND And", "c++"]
TERMS = ["python", "sql", "c++", "c", "data lake", "lake data", ".net", "the the", "zoë", "café_1", "and", "nothing", "+", "zoë's café_1", "data  lake", "x", "lake."]


@pytest.fixture
def index(spark, tmp_path):
    return I.SearchIndex(spark, str(tmp_path / "index"), 4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc long, text string").repartition(3)


def holding(df):
    return sorted(r.doc for r in df.collect())


def test_terms(spark, index):
    texts = frame(spark, list(enumerate(TEXTS)))
    index.apply(texts, 0)
    for term in TERMS:
        assert holding(index.holding(term, texts)) == holding(texts.where(has_term("text", term))), term
    both = texts.where(has_term("text", "python") & has_term("text", "c++"))
    assert holding(index.search(["python", "c++"], texts=texts)) == holding(both)
    assert holding(index.search(["sql", "data lake"], True)) == [0, 2, 4] and index.search([]).count() == 0
    with pytest.raises(ValueError):
        index.holding("c++")


def test_changes_merges_and_repeats(spark, index):
    assert index.holding("python").count() == 0
    index.apply(frame(spark, [(1, "python"), (2, "python sql"), (3, "sql"), (None, "python")]), 0)
    change = frame(spark, [(1, "java"), (3, "python now"), (4, "python"), (5, None)])
    for _ in range(2):  # a batch that comes again
        index.apply(change, 1)
        assert index.segments() == [0, 1] and holding(index.holding("python")) == [2, 3, 4] and holding(index.holding("sql")) == [2]
    index.apply(frame(spark, [(2, None), (1, "python again")]), 2)
    assert holding(index.holding("python")) == [1, 3, 4]
    index.merge(3)
    assert index.segments() == [3] and holding(index.holding("python")) == [1, 3, 4] and index.holding("java").count() == 0
    index.apply(frame(spark, [(3, None)]), 4)
    index.merge(5)
    index.merge(5)
    assert holding(index.search(["python", "now"], True)) == [1, 4]
    index.apply(change.limit(0), 6)
    assert holding(index.holding("python")) == [1, 4]


def test_only_asked_postings_are_read(spark, index):
    index.apply(frame(spark, [(i, f"w{i % 50} common") for i in range(500)]), 0)
    plan = index._postings(index.segments(), ["w7"])
    assert "PushedFilters: [In(token" in plan._jdf.queryExecution().executedPlan().toString() or "EqualTo(token,w7)" in plan._jdf.queryExecution().executedPlan().toString()
    assert len(plan.inputFiles()) > 0 and plan.select(F.input_file_name()).distinct().count() <= I.PARTS
    assert holding(index.holding("w7")) == list(range(7, 500, 50))


def test_postings_without_a_shuffle(spark):
    """A document's words are grouped where it is; before, each word of each text was shuffled."""
    docs = spark.createDataFrame([(3, "To be, or not to be"), (1, "a a A"), (2, ""), (4, None), (5, "?!"), (6, "ÉTÉ été x_1")], "doc long, text string")
    found = I.postings(docs)
    places = {(r.token, r.doc): [sum(r.gaps[: k + 1]) for k in range(len(r.gaps))] for r in found.collect()}
    assert places == {("to", 3): [0, 4], ("be", 3): [1, 5], ("or", 3): [2], ("not", 3): [3], ("a", 1): [0, 1, 2], ("été", 6): [0, 1], ("x_1", 6): [2]}
    after = {(r.token, r.doc): r.after for r in found.collect()}
    h = {s: spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] for s in (" ", ", ", "")}
    assert after["be", 3] == [h[", "], h[""]] and after["a", 1] == [h[" "], h[" "], h[""]]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and I.postings(docs.where("false")).count() == 0
