from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.operators import aggregates as A
from sievework.operators import changes as C
from sievework.operators import chunking as K
from sievework.operators import joins as J
from sievework.operators import quality as Q
from sievework.operators import ranking as R
from sievework.functions import predicates as P
from sievework.functions import vectors as X
from sievework.functions.text import general_number
from sievework.operators import search as S


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_ranks_and_ties(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "a", 1.0), (4, "b", None), (5, "b", 2.0), (6, None, 1.0)], "id int, g string, s double")
    assert rows(R.ranked(df, ["g"], "s", "id").select("id", "rank", "tie"), "id") == [(1, 1, True), (2, 1, True), (3, 3, False), (4, 2, False), (5, 1, False), (6, 1, False)]
    assert R.at_rank(R.ranked(df.where("g = 'a'"), ["g"], "s", "id"), 2).count() == 0
    assert rows(R.top_with_ties(df.where("g = 'a'"), ["g"], "s", "id", 1)) == [("a", 1, True)]


def test_hot_keys_join(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    counted = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = {r.id: (r.k, r.least, r.n) for r in J.join_counted(df, counted, ["k"], "n", "id").collect()}
    assert len(got) == 4000 and got[3] == ("hot", 0, 1334) and got[5] == (None, 2, 1333) and got[4] == ("4", 4, 1)
    assert J.join_counted(df.limit(0), counted.limit(0), ["k"], "n", "id").count() == 0


def test_current_assessments(spark):
    records = spark.createDataFrame([(1, "r", "v2", "completed", True, None), (2, "r", "v1", "completed", True, 1), (3, "r", "v1", "review", True, None), (4, "p", "v1", "completed", True, None)], "id int, role_id string, version string, status string, active boolean, duplicate_of int")
    groups = spark.createDataFrame([("r", 9, True, False), ("p", 9, True, True)], "id string, rubric_id int, active boolean, paused boolean")
    done = spark.createDataFrame([(1, "v1", 9, 10.0, "x", 1.0), (1, "v2", 8, 20.0, "x", 1.0), (1, "v2", 9, 30.0, "x", 1.0), (4, "v1", 9, 40.0, "x", 1.0)], "application_id int, version string, rubric_id int, score double, body string, created double")
    assert [r.score for r in R.current_assessments(records, groups, done).collect()] == [30.0]


def test_stages_and_bins(spark):
    scores = spark.createDataFrame([(s,) for s in (0.0, 19.99, 20.0, 39.99, 40.0, 59.99, 60.0, 79.99, 80.0, 100.0)], "s double")
    assert [r.n for r in A.score_histogram(scores, "s").orderBy("place").collect()] == [2] * 5
    assert [r.n for r in A.score_histogram(scores.limit(0), "s").orderBy("place").collect()] == [0] * 5


def test_usage_of_nothing(spark):
    empty = spark.createDataFrame([], "at double, model string, sections long, chars long, provider string, purpose string, tokens long")
    assert rows(A.usage_summary(empty)) == [(0, 0, 0, None, None, [])]


_TITLES = ("skills", "summary")


def cut(text, embed=None):
    lines = text.split("\n")
    titles = [x.strip().rstrip(":").strip() if x.strip().rstrip(":").strip().lower() in _TITLES else None for x in lines]
    return K.passages([len(x) + (i < len(lines) - 1) for i, x in enumerate(lines)], titles, [not x.strip() for x in lines], text, embed)


def plain_passages(text, embed=None):
    """Line by line, as the survey's rules read."""
    out, sections, at = [], [], 0
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        core = line.strip().rstrip(":").strip()
        if core.lower() in _TITLES or not sections:
            sections.append([at, at, core if core.lower() in _TITLES else None])
        at += len(line)
        sections[-1][1] = at
    for start, end, title in sections:
        spans = [[start, end]]
        if embed and end - start > 1200:
            blocks, at, new = [], start, True
            for line in re.findall(r"[^\n]*\n|[^\n]+$", text[start:end]):
                if new:
                    blocks.append([at, at])
                at += len(line)
                blocks[-1][1], new = at, not line.strip()
            spans, last = [blocks[0]], embed(text[blocks[0][0] : blocks[0][1]])
            for a, b in blocks[1:]:
                now = embed(text[a:b])
                alike = sum(x * y for x, y in zip(last, now)) >= 0.6 * (sum(x * x for x in last) * sum(y * y for y in now)) ** 0.5
                if b - spans[-1][0] <= 1600 and (alike or spans[-1][1] - spans[-1][0] < 200):
                    spans[-1] = [spans[-1][0], b]
                else:
                    spans.append([a, b])
                last = now
        for a, b in spans:
            while b - a > 1600:
                at = text.rfind("\n", a + 1, a + 1600)
                stop = a + 1600 if at < 0 else at + 1
                out.append((a, stop, title))
                a = stop
            out.append((a, b, title))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Skills\n", "summary:\n", "\n", " \n", "alpha " * 30 + "\n", "beta " * 20, "x" * 1700, "é" * 90 + "\n", "\n\n", "beta alpha\n"]), max_size=40).map("".join), st.booleans())
def test_passages_are_the_text(text, alike):
    embed = (lambda t: [1.0 + t.count("alpha"), 1.0 + 3 * t.count("beta")]) if alike else None
    made = cut(text, embed)
    assert made == plain_passages(text, embed)
    assert "".join(text[a:b] for a, b, _ in made) == text
    assert all(0 < b - a <= 1600 for a, b, _ in made)


def test_hybrid_in_two_phases(spark):
    rng = random.Random(4)
    parts = ["Skills\n", "summary:\n", "\n", " \n", "alpha " * 30 + "\n", "beta " * 20, "x" * 1700, "é" * 90 + "\n", "\n\n", "beta alpha\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None] + ["alpha " * 300 + "\n\n" + "beta " * 40 + "\n\n"] * 3

    def vector(t):
        return [1.0 + t.count("alpha"), 1.0 + 3 * t.count("beta")]

    df = spark.createDataFrame([(i, 1 + i % 2, t, "x") for i, t in enumerate(texts)], "id int, page int, text string, chunk_text string").repartition(3).drop("chunk_text")
    none = spark.createDataFrame([], "key string, embedding array<double>")
    found, fresh = K.hybrid_chunks(df, ["id"], none, lambda ts: [vector(t) for t in ts], "m", batch=7)
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.heading.lower() if r.heading else None, r.chunk_text))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == [(a, b, h.lower() if h else None, t[a:b]) for a, b, h in plain_passages(t or "", vector)]
    keys = [r.key for r in fresh.collect()]
    assert keys and len(keys) == len(set(keys))  # each paragraph once
    again, more = K.hybrid_chunks(df, ["id"], fresh, lambda ts: 1 / 0, "m")  # all are in the cache: nothing is embedded
    assert more.count() == 0 and again.count() == found.count()
    apart = K.hybrid_chunks(df, ["id"], none, lambda ts: [None if k % 2 else [] for k in range(len(ts))], "n")[0]
    assert sorted((r.id, r.start) for r in apart.collect()) == sorted((i, a) for i, t in enumerate(texts) for a, _, _ in plain_passages(t or "", lambda _, n=iter(range(10**6)): [1.0, 0.0] if next(n) % 2 else [0.0, 1.0]))


def test_passage_shapes():
    flat = "first line 14c\n" + "x" * 10201
    assert [b - a for a, b, _ in cut(flat)] == [15] + [1600] * 6 + [601]
    assert cut("") == []
    assert len(cut("x" * 300_000)) > 160


def test_published_shapes(spark):
    """Chunks, their mean and largest size, and headed ones, of a page with five sections and of one without, as published
    for pages of these section sizes."""
    structured = "n" * 19 + "\n\n" + "Summary\n" + "s" * 47 + "\n\n" + "Experience\n" + ("e" * 51 + "\n") * 40 + "\nSkills\n" + "k" * 39 + "\n\n" + "Education\n" + "d" * 22 + "\n\n" + "Projects\n" + "p" * 34 + "\n"
    flat = "first line 14c\n" + "x" * 10200 + "\n"
    want = {"structured": (len(structured), (2, 1600, 0), (7, 1571, 6)), "flat": (10216, (7, 1600, 0), (8, 1600, 0))}
    assert abs(len(structured) - 2295) <= 2
    df = spark.createDataFrame([("structured", structured, 1), ("flat", flat, 1)], "name string, text string, page int")

    def shapes(found):
        n = F.length("chunk_text")
        return {r.name: (r.n, r.most, r.headed) for r in found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max(n).alias("most"), F.count("heading").alias("headed"), F.sum(n).alias("all")).collect()}

    assert shapes(K.chunked(df, "fixed")) == {k: v[1] for k, v in want.items()}
    assert shapes(K.chunked(df)) == {k: v[2] for k, v in want.items()}
    none = spark.createDataFrame([], "key string, embedding array<double>")
    assert shapes(K.hybrid_chunks(df, ["name"], none, lambda ts: [[float("e" in t), 1.0] for t in ts], "m")[0]) == {k: v[2] for k, v in want.items()}


def test_hybrid_merges_what_is_alike():
    text = "Skills\n" + "".join(("alpha " if i % 2 else "beta ") * 60 + "\n\n" for i in range(8))
    assert cut(text) != cut(text, lambda t: [float("alpha" in t), float("beta" in t)])

    def broken(_):
        raise RuntimeError

    assert "".join(text[a:b] for a, b, _ in cut(text, broken)) == text


def test_headings_in_frames(spark):
    text = "Jane\nSummary\na\n\nb\nSKILLS:\nc"
    df = spark.createDataFrame([(1, 1, text)], "doc_id int, page int, text string")
    assert [r.heading for r in K.chunked(df).orderBy("start").collect()] == [None, "Summary", "SKILLS"]


def test_chunks_as_frames(spark):
    df = spark.createDataFrame([(1, 1, "x" * 4000), (2, 1, ""), (3, 2, " " * 1600 + "y"), (4, 1, None)], "doc_id int, page int, text string")
    assert rows(K.fixed_chunks(df).select("doc_id", "chunk_id"), "doc_id", "start") == [(1, "p1-0"), (1, "p1-1600"), (1, "p1-3200"), (3, "p2-1600")]
    chunks = K.chunked(df, "structure")
    assert [r.exact for r in K.is_exact_partition(df, chunks, "doc_id").collect()] == [True] * 4
    assert rows(K.section_budget(df, chunks, "doc_id").select("doc_id", "needs_review"), "doc_id") == [(1, False), (2, True), (3, False), (4, True)]
    with pytest.raises(ValueError):
        K.chunked(df, "other")


def test_diff_and_upsert(spark):
    old = spark.createDataFrame([(1, "v", "n"), (2, "v", "n"), (3, "v", "n"), (4, None, "n")], "id int, version string, name string")
    new = spark.createDataFrame([(1, "w", "n"), (2, "v", "m"), (4, None, "n"), (5, "v", "n")], "id int, version string, name string")
    assert rows(C.snapshot_diff(old, new, "id", "version", "name"), "id") == [(1, "changed"), (2, "renamed"), (3, "removed"), (4, "unchanged"), (5, "new")]
    assert rows(C.upserted(old, new, ["id"]), "id") == [(1, "w", "n"), (2, "v", "m"), (3, "v", "n"), (4, None, "n"), (5, "v", "n")]
    assert C.inserted_if_absent(old, new, ["id"]).count() == 5
    assert rows(C.updated_where(old, F.col("version") == "v", name=F.lit("z")), "id")[3] == (4, None, "n")


RECORD = "id int, role_id int, version string, status string, active boolean, duplicate_of int, hash string, sections string, review_reason string, review_evidence array<string>, index_status string"


def test_decisions(spark):
    records = spark.createDataFrame([(1, 1, "v", "review", True, None, "h", "t", None, ["q"], "ready"), (2, 1, "v", "review", True, 1, "h2", "t", "r", [], "ready"), (3, 1, "v", "review", True, None, "h3", None, None, [], "ready"), (4, 1, "v", "review", True, None, "h4", "t", None, [], "ready"), (5, 2, "v", "review", True, None, "h5", "t", None, [], "ready"), (6, None, "v", "review", True, None, "h6", "t", None, [], "ready")], RECORD)
    roles = spark.createDataFrame([(1, 9), (2, 8)], "id int, rubric_id int")
    jobs = spark.createDataFrame([(i, i, "v", 9, "done", "done", 4, 0) for i in (1, 2, 3, 4, 5)], "id int, application_id int, version string, rubric_id int, state string, step string, attempts int, generation int")
    decisions = spark.createDataFrame([(1, "confirm_spam", "why"), (2, "dismiss", "ok"), (3, "retry", "ok"), (4, "confirm_spam", "no evidence"), (5, "restore", "ok"), (6, "retry", "ok")], "application_id int, action string, reason string")
    done = spark.createDataFrame([(2, "v", 9), (2, "v", 8), (5, "v", 9)], "application_id int, version string, rubric_id int")
    old = spark.createDataFrame([("document", "h5", "x", True, 0.0, 9.0), ("document", "h2", "x", True, 0.0, 9.0)], "kind string, identifier string, reason string, active boolean, created double, expires double")
    after, work, holds = C.decided(records, roles, jobs, decisions, done, old, 1000.0)
    assert rows(after.select("id", "status", "duplicate_of", "index_status"), "id") == [(1, "review", None, "ready"), (2, "completed", None, "pending"), (3, "queued", None, "pending"), (4, "review", None, "ready"), (5, "queued", None, "pending"), (6, "queued", None, "pending")]
    # 5 is assessed under another rubric than its role's: a job for that one is made; 6 has no role, hence no rubric.
    assert rows(work.select("application_id", "rubric_id", "state", "step", "attempts", "generation"), "application_id", "rubric_id") == [(1, 9, "queued", "report", 4, 1), (2, 9, "queued", "report", 0, 1), (3, 9, "queued", "download", 0, 1), (4, 9, "done", "done", 4, 0), (5, 8, "queued", "assess", 0, 0), (5, 9, "done", "done", 4, 0), (6, 0, "queued", "assess", 0, 0)]
    assert rows(holds.select("identifier", "active", "expires"), "identifier") == [("h", True, 1000.0 + 90 * 86400), ("h2", True, 9.0), ("h5", False, 9.0)]
    with pytest.raises(ValueError):
        C.decided(records, roles, jobs, decisions, done, old, 0.0, 0)


def test_activation(spark):
    rubrics = spark.createDataFrame([(1, 1, "a")], "id int, role_id int, body string")
    new = spark.createDataFrame([(2, 1, "b"), (1, 1, "x")], "id int, role_id int, body string")
    roles = spark.createDataFrame([(1, 1, True), (2, 1, True)], "id int, rubric_id int, paused boolean")
    records = spark.createDataFrame([(1, 1, "v", True, "t", "review", 9, "r"), (2, 2, "v", True, "t", "review", 9, "r"), (3, 1, "v", True, None, "done", None, None), (4, 1, "v", False, "t", "review", 9, "r")], "id int, role_id int, version string, active boolean, sections string, status string, duplicate_of int, review_reason string")
    jobs = spark.createDataFrame([(1, 1, "v", 1, "done", "done"), (2, 2, "v", 1, "done", "done"), (3, 4, "v", 1, "done", "done")], "id int, application_id int, version string, rubric_id int, state string, step string")
    a, b, c, d = C.activated(rubrics, roles, jobs, records, new)
    assert rows(a, "id") == [(1, 1, "a"), (2, 1, "b")] and rows(b, "id") == [(1, 2, False), (2, 1, True)]
    assert rows(c.select("application_id", "rubric_id", "state", "step"), "application_id", "rubric_id") == [(1, 1, "superseded", "done"), (1, 2, "queued", "assess"), (2, 1, "done", "done"), (3, 2, "queued", "download"), (4, 1, "superseded", "done")]
    assert rows(d.select("id", "status", "duplicate_of", "review_reason"), "id") == [(1, "queued", None, None), (2, "review", 9, "r"), (3, "queued", None, None), (4, "review", 9, "r")]


def test_low_scores_of_two_rubrics(spark):
    records = spark.createDataFrame([(i, 1, "v", True, "completed", None) for i in (1, 2, 3)] + [(4, 1, "v", False, "completed", None)], "id int, role_id int, version string, active boolean, status string, review_reason string")
    roles = spark.createDataFrame([(1, 7)], "id int, rubric_id int")
    scored = spark.createDataFrame([(1, "v", 6, 3.0), (1, "v", 7, 90.0), (2, "v", 6, 90.0), (2, "v", 7, 12.25), (3, "u", 7, 1.0), (4, "v", 7, 1.0)], "application_id int, version string, rubric_id int, score double")
    jobs = spark.createDataFrame([(i, "done", "done", 2) for i in (1, 2, 3, 4)] + [(2, "superseded", "done", 2)], "application_id int, state string, step string, attempts int")
    after, work = C.low_scores_to_review(records, roles, scored, jobs, 25)
    assert rows(after.select("id", "status"), "id") == [(1, "completed"), (2, "review"), (3, "completed"), (4, "completed")]
    assert "12.25/100 is below the 25/100" in after.where("id = 2").first()["review_reason"]
    assert rows(work, "application_id", "state") == [(1, "done", "done", 2), (2, "queued", "report", 0), (2, "superseded", "done", 2), (3, "done", "done", 2), (4, "done", "done", 2)]


def test_null_keys_are_equal(spark):
    start = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    change = spark.createDataFrame([(None, "c"), (2, "d")], "k int, v string")
    once = C.upserted(start, change, ["k"])
    assert rows(C.upserted(once, change, ["k"]), "k") == [(None, "c"), (1, "b"), (2, "d")]
    assert rows(C.inserted_if_absent(start, change, ["k"]), "k") == [(None, "a"), (1, "b"), (2, "d")]
    assert rows(C.replaced(start, change, ["k"]), "k") == [(None, "c"), (1, "b"), (2, "d")]


def test_general_numbers(spark):
    values = [0.0, 1.0, 25.5, 1234.5678, 100000.0, 123456.7, 999999.9, 1234567.0, 0.5, 0.012345678, 0.0001, 0.00001234, -3.25, 66.6667]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", general_number(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [f"{v:g}" for v in values]


def test_quotes(spark):
    texts = spark.createDataFrame([(1, "one two three four five six"), (2, "xone two three four fiver"), (3, "one Two three four five"), (4, None)], "t int, text string")
    quotes = spark.createDataFrame([(1, "one two three four five"), (2, "two"), (3, ""), (4, "six seven eight nine ten")], "q int, quote string")
    found = set(rows(J.quotes_in(texts, quotes, "t", "text", "q", "quote")))
    assert found == {(1, 1), (2, 1), (1, 2), (2, 2), (1, 3), (2, 3), (3, 3)}


def test_many_short_quotes(spark):
    texts = spark.createDataFrame([(i, f"t{i} u v w x") for i in range(30)], "t int, text string")
    quotes = spark.range(11000).select(F.col("id").cast("int").alias("q"), F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(" u")).alias("quote"))
    assert set(rows(J.quotes_in(texts, quotes, "t", "text", "q", "quote"))) == {(i, i) for i in range(30)}


@given(st.lists(st.text(alphabet="ab é\U0001f600", max_size=12), max_size=6))
@settings(max_examples=40, deadline=None)
def test_grams(texts):
    for t in texts:
        for n in (1, 2, 3):
            runs = {t[i : i + n] for i in range(len(t) - n + 1)}
            assert len(J.grams_of(t, (n,))) == len(runs)
            assert all(set(J.grams_of(r, (n,))) <= set(J.grams_of(t, (1, 2, 3))) for r in runs)


def test_short_quotes(spark):
    texts = ["the cat sat", "The cat", "a\nb c", "caté\U0001f600x", "", None, "aaaa", "of the cat of"] * 2
    quotes = ["cat", "e c", "t", "é\U0001f600", "", None, "\U0001f600", "aaa", "aaaaa", "zz", "the cat", "of", "a\nb", "the cat sat on", "q", "cat"]
    t = spark.createDataFrame(list(enumerate(texts)), "t int, text string").repartition(3)
    q = spark.createDataFrame(list(enumerate(quotes)), "q long, quote string")
    found = J.quotes_in(t, q, "t", "text", "q", "quote")
    assert sorted(rows(found)) == sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(quotes) if x is not None and y is not None and y in x)
    shown = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown
    assert J.quotes_in(t.limit(0), q, "t", "text", "q", "quote").count() == 0 and J.quotes_in(t, q.limit(0), "t", "text", "q", "quote").count() == 0


def test_more_keys_than_tasks_may_know(spark, monkeypatch):
    monkeypatch.setattr(J, "_MOST_KEYS", 3)
    t = spark.createDataFrame([(i, f"word{i} and more of it") for i in range(40)], "t int, text string")
    q = spark.createDataFrame([(i, f"word{i} and") for i in range(40)] + [(100 + i, f"word{i} and more of it") for i in range(9)], "q int, quote string")
    assert sorted(rows(J.quotes_in(t, q, "t", "text", "q", "quote"))) == sorted([(i, i) for i in range(40)] + [(i, 100 + i) for i in range(9)])


def test_blocks_meet_all(spark):
    a, b = spark.range(7).toDF("x"), spark.range(50).toDF("y")
    assert sorted(rows(J.in_blocks(a, b, "x", "y", block=3, chunk=8))) == [(i, j) for i in range(7) for j in range(50)]


def test_previous_rows(spark):
    df = spark.createDataFrame([("a", i, i * 2) for i in (0, 1, 5, 9, 23, 24)] + [("b", 3, None), ("b", 30, 1), (None, 4, 7), (None, 40, 8)], "k string, at int, v int")
    got = {(r.k, r.at): r.previous for r in R.with_previous(df, ["k"], "at", "v", width=4).collect()}
    assert got == {("a", 0): None, ("a", 1): 0, ("a", 5): 2, ("a", 9): 10, ("a", 23): 18, ("a", 24): 46, ("b", 3): None, ("b", 30): None, (None, 4): None, (None, 40): 7}


def test_cut_ties(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 4, 3, 3, 1])] + [("b", 9, 1), ("b", 10, 1)] + [("c", i, s) for i, s in enumerate([5, 4, 3, 2])], "k string, id int, s int")
    assert rows(R.top_with_ties(df, ["k"], "s", "id"), "k") == [("a", 3, True), ("b", 2, False), ("c", 3, False)]


def test_quality(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 1.5)], "x int, y double")
    b = spark.createDataFrame([(1, None), (2, 1.5), (3, 0.0)], "x int, y double")
    assert rows(Q.multiset_difference(a, b), "x") == [(1, None, 2, 1), (3, 0.0, 0, 1)]
    assert Q.compare_stores({"t": a}, {"t": a})["t"]["match"] is True
    with pytest.raises(ValueError):
        Q.assert_unique(a, ["x"])
    with pytest.raises(ValueError):
        Q.assert_append_only(a, b)


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("List all applicants", {"wants_list": True, "structured": True}), ("Who knows Python or SQL?", {"terms": ("python", "sql"), "any_term": True, "structured": False}),
        ("Who is second by score?", {"ordinal": 2, "ranks": True}), ("Who came first?", {"ordinal": None, "terms": ("came",)}), ("python not demonstrated", {"level": "not_demonstrated", "terms": ("python",)}),
        ('show "data lake"', {"terms": ("data lake",)}), ("top 3", {"top_three": True, "ranks": True}), ("failed or review", {"status": "review"}), ("compare Ann and Bob", {"compares": True}),
    ],
)
def test_questions(question, want):
    spec = S.parse_question(question, "Data Role")
    assert {k: getattr(spec, k) for k in want} == want


@pytest.mark.parametrize("bad", ["", "  ", "x" * 1001, None])
def test_bad_questions(bad):
    with pytest.raises(ValueError):
        S.parse_question(bad)


@pytest.fixture(scope="module")
def frames(spark):
    records = spark.createDataFrame([(1, "Ann Lee", "completed", None, "f1", "done"), (2, "Ann Lee", "duplicate", 1, "f2", "done"), (3, "Bob Ray", "completed", None, "f3", "done"), (4, "", "queued", None, "f4", "failed")], "id int, name string, status string, duplicate_of int, file_id string, job_state string")
    sections = spark.createDataFrame([(1, "s1", "p1", "Python and SQL"), (2, "s1", "p1", "Python and SQL"), (3, "s1", "p1", "python only"), (4, "s1", "p1", "nothing")], "record_id int, section_id string, location string, text string")
    ranking = spark.createDataFrame([(1, 100.0, 1, False), (3, 30.0, 2, False)], "id int, score double, rank int, tie boolean")
    findings = spark.createDataFrame([(1, "python", "supported", [("s1", "Python")]), (3, "python", "partial", [("s1", "python")])], "record_id int, criterion_id string, level string, evidence array<struct<section_id:string,quote:string>>")
    criteria = spark.createDataFrame([("python", "writes Python")], "id string, description string")
    vectors = spark.createDataFrame([(1, "s1", "p1", "Python and SQL", [1.0, 0.0]), (3, "s1", "p1", "python only", [0.0, 1.0])], "record_id int, section_id string, location string, text string, embedding array<double>")
    return S.Frames(records, sections, ranking, findings, criteria, vectors)


@pytest.mark.parametrize(
    ("question", "ids"),
    [
        ("List all applicants", [1, 2, 3, 4]), ("duplicate", [2]), ("python or sql", [1, 3]), ("python and sql", [1]), ("python supported", [1]), ("python partial", [3]), ("rank", [1, 3]),
        ("first in rank", [1]), ("third in rank", []), ("failed", [4]), ("compare Bob and Ann", []), ("compare Ann Lee with Bob Ray", [1, 3, 2]), ("compare the first in rank", []), ("compare the third in rank: Ann Lee, Bob Ray", [1, 3, 2]), ("cobol", []), ("top 3", [1, 3]),
    ],
)
def test_answers(frames, question, ids):
    spec = S.parse_question(question)
    if question == "duplicate":
        frames = S.Frames(frames.records.withColumn("duplicate_of", F.lit(None).cast("int")), frames.sections, frames.ranking)
    assert [r.id for r in S.plan(spec, frames).collect()] == ids


def test_compared_names_are_literal(spark):
    records = spark.createDataFrame([(1, r"A\Eb One"), (2, "Bo.* Two"), (3, ""), (4, "b.* Ann")], "id int, name string")
    assert rows(S.compared(records, r"compare a\eb with bo.* "), "id") == [(1,), (2,)]
    assert rows(S.compared(records, "compare bo with bob"), "id") == []


def test_fallback_keeps_to_its_scope(frames):
    more = frames.vectors.sparkSession.createDataFrame([(2, "s1", "p1", "a duplicate's", [0.1, 1.0]), (77, "s1", "p1", "nobody's", [0.1, 1.0])], frames.vectors.schema)
    wide = S.Frames(frames.records, frames.sections, frames.ranking, vectors=frames.vectors.unionByName(more))
    cards, cited, _ = S.answer(S.parse_question("cobol"), wide, lambda _: [0.1, 1.0], k=2)
    assert [r.id for r in cards.collect()] == [3, 1] and cited.count() == 2
    versions = S.in_scope(wide.vectors.withColumn("version", F.when(F.col("record_id") == 3, "old").otherwise("v")).withColumn("model", F.lit("m")), frames.records.withColumn("version", F.lit("v")), "m")
    assert rows(versions.select("record_id"), "record_id") == [(1,)]


def test_citations_and_fallback(frames):
    spec = S.parse_question("python or sql")
    cards, cited, mode = S.answer(spec, frames)
    assert cited.count() == 2 and "OR" in mode
    cards, cited, mode = S.answer(S.parse_question("cobol"), frames, lambda _: [0.1, 1.0])
    assert [r.id for r in cards.collect()] == [3, 1] and mode == "semantic excerpt suggestions"
    assert [r.citation_id for r in S.numbered_passages(cited, "record_id").orderBy("record_id").collect()] == ["c1", "c2"]
    cards, cited, _ = S.answer(S.parse_question("python supported"), frames)
    assert [r.quote for r in cited.collect()] == ["Python"]


def test_names_in_order_of_a_language(spark):
    names = ["Zoë", "zoe", "Émile", "emil", "Ångström", "angst", "Bo", "bo", None, "Öz", "oz", "ä", "Zoe"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string").repartition(3)
    got = [r.name for r in R.in_name_order(df, "name", "id").collect()]
    assert got == ["ä", "angst", "Ångström", "bo", "Bo", "emil", "Émile", "oz", "Öz", "zoe", "Zoe", "Zoë", None]
    ties = spark.createDataFrame([(3, "Bo"), (1, "Bo"), (2, "Bo")], "id int, name string")
    assert [r.id for r in R.in_name_order(ties, "name", "id").collect()] == [1, 2, 3]
    assert sorted(r.id for r in df.where(P.named_like(F.col("name"), " ZOE ")).collect()) == [0, 1, 12]
    assert sorted(r.id for r in df.where(P.by_language(F.col("name")) == F.lit("OZ")).collect()) == [9, 10]


def test_dense_criteria_and_acceptance(spark):
    criteria = spark.createDataFrame([("a", 60), ("b", 40), ("c", 0)], "id string, weight int")
    found = spark.createDataFrame([("a", "supported"), ("a", "partial"), ("b", "partial"), ("zz", "partial")], "id string, level string")
    assert rows(A.criteria_counts(criteria, found, "id", F.col("level")), "id") == [("a", 60, 1, 1, 0), ("b", 40, 0, 1, 0), ("c", 0, 0, 0, 0)]
    assert rows(A.criteria_counts(criteria, found.limit(0), "id", F.col("level")), "id") == [("a", 60, 0, 0, 0), ("b", 40, 0, 0, 0), ("c", 0, 0, 0, 0)]
    cases = spark.createDataFrame([(1, "done", True, 5), (2, None, False, None), (3, "done", True, None)], "id int, status string, passed boolean, tokens int")
    assert rows(A.acceptance(cases, "tokens")) == [(3, 2, 2, False, False, 5, False)]
    assert rows(A.acceptance(cases.where("id = 1"))) == [(1, 1, 1, True, True)]
    assert rows(A.acceptance(cases.limit(0), "tokens")) == [(0, 0, 0, True, True, None, True)]


def test_numbered_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    got = {r.k: r.citation_id for r in S.numbered_passages(df, "k").collect()}
    assert got == {k: f"c{k + 1}" for k in range(1000)} and S.numbered_passages(df.limit(0), "k").count() == 0


def test_cosine_stats(spark):
    """Each pair once, in tiles that give a row for a query, as vectors.cosine() has it; before, each pair was a row of a join."""
    v = [[1.0, 2.0], [2.0, 1.0], [-1.0, 0.5], [0.0, 0.0], None, [], [1.0, None], [1.0, 2.0, 3.0], [float("nan"), 1.0], [3.0, 2.0, 1.0], [1e-200, 1e-200]]
    df = spark.createDataFrame([(i, v[i % len(v)]) for i in range(40)] + [(None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 3 = 0")
    pairs = q.alias("a").join(df.alias("b"), F.expr("a.vec_id <> b.vec_id")).select("a.vec_id", X.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("s"))
    want = pairs.groupBy("vec_id").agg(F.max("s").alias("best"), F.min("s").alias("least"), F.avg("s").alias("mean"), F.count("*").alias("others"))
    shown = lambda x: sorted(str([None if c is None else round(c, 9) + 0.0 for c in r]) for r in x.collect())
    for block, chunk in ((4096, 4096), (3, 8)):
        assert shown(J.cosine_stats(q, df, "vec_id", "embedding", block, chunk)) == shown(want)
    one = df.where("vec_id = 0")
    assert J.cosine_stats(one, one, "vec_id", "embedding").count() == 0 and J.cosine_stats(q.where("false"), df, "vec_id", "embedding").count() == 0


def test_recognised_lines_where_they_are(spark):
    """Words of pages that were dealt by page are put together without a shuffle of words; before, they were moved twice."""
    pages = spark.createDataFrame([(i, f"b a{i}\n\nc  d\n \nlast") for i in range(20)] + [(20, ""), (21, None)], "page long, body string")
    lines = A.pages_dealt(pages, ["page"], "body", 64).select("page", F.posexplode(F.split("body", "\n")).alias("line_num", "line"))
    words = lines.select("page", "line_num", F.posexplode(F.split("line", " ")).alias("word_num", "text"))
    found = A.recognised_lines(words, ["page"], ["line_num"])
    assert sorted(map(tuple, found.collect())) == [(i, f"b a{i}\nc d\nlast") for i in range(20)]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert A.pages_dealt(pages.where("false"), ["page"], "body").count() == 0
