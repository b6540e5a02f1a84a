"""Streams over several batches, with restarts, late rows and keys whose rows fill many frames."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievework.streaming import job_states as JS
from sievework.streaming import jobs

EVENTS = "job string, at timestamp, seq long, generation long, kind string"


def put(spark, path, rows, schema=EVENTS):
    """One file, after those that are there."""
    spark.createDataFrame(rows, schema.replace("timestamp", "double")).withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_job_fold():
    job = JS.Job()
    for k in range(4):
        job = job.after(100_000_000 * k, 0, "error")
        assert (job.state, job.attempts, job.next_try - 100_000_000 * k) == ("retry", k + 1, 1000 * min(3600, 15 * 2 ** (k + 1)))
    assert job.fired == 3 and job.after(10**12, 0, "error").state == "failed"
    failed = job.after(10**12, 0, "error")
    assert failed.after(10**12, 0, "ok").state == "failed" and failed.after(10**12, 1, "ok") == JS.Job(1, "queued", 0, 0, 4, 0, 6)
    assert failed.after(10**12, -1, "ok").stale == 1


def test_states_in_any_order(spark, tmp_path):
    rng, own = random.Random(1), JS.stream_session(spark)
    path = str(tmp_path / "in")
    events = [(f"j{rng.randrange(6)}" if rng.random() < 0.9 else None, float(1 + i * 60), i, i // 150 - (rng.random() < 0.1), rng.choice(["error"] * 5 + ["ok", "done", "note"])) for i in range(400)]
    events += [("hot", 3600.0 + k * 0.5, 1000 + k, 0, "ok") for k in range(20_000)] + [("hot", 20_000.0 + k * 1000, 50_000 + k, 0, "error") for k in range(3)]
    batches = [[] for _ in range(5)]
    for e in events:  # some come a little early or late
        batches[max(0, min(4, int((e[1] + rng.uniform(-900, 900)) // 6000)))].append(e)
    end = max(e[1] for e in events) + 4000
    for k, rows in enumerate(batches + [[("end", end, -1, 0, "tick")]]):
        put(own, path, sorted(rows, key=lambda _: rng.random()))
        if k in (2, len(batches)):  # the stream ends, and starts again from its checkpoint
            stream = JS.job_states(jobs.watched(own, path, EVENTS, 1), "job", "at", "seq", F.col("generation"), F.col("kind"))
            out = jobs.into_files(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    want = {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        want[e[0]] = want.get(e[0], JS.Job()).after(int(e[1] * 1000), e[3], e[4])
    final = int(end * 1000) - 3_600_000
    got = {r["job"]: tuple(r)[2:] for r in JS.last_states(out).collect()}
    want = {k: j.by(final) for k, j in want.items()}
    assert {k: v for k, v in got.items() if v != tuple(vars(want[k]).values())} == {}, [(e, want["j0"]) for e in events if e[0] == "j0"][-3:]
    assert got.keys() == want.keys()
    assert got["hot"][1:3] in (("retry", 3), ("queued", 3)) and any(j.fired for j in want.values()) and any(j.stale for j in want.values())


def test_states_are_kept_by_bucket(spark, tmp_path):
    own, path = JS.stream_session(spark), str(tmp_path / "in")
    events = [(f"j{i % 500}" if i % 500 else None, float(1 + i * 7 % 3000), i, i % 3 // 2, ("error", "ok", "error", "done")[i % 4]) for i in range(4000)]
    put(own, path, events + [("late", None, 1, 0, "error"), ("bare", 5.0, None, None, None)])
    put(own, path, [("end", 20_000.0, -1, 0, "tick")])
    stream = JS.job_states(jobs.watched(own, path, EVENTS, 1), "job", "at", "seq", F.col("generation"), F.col("kind"), buckets=5)
    query = jobs.run_to_end(stream, "by_bucket", str(tmp_path / "checkpoint"), "append")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(held) < 60  # of 501 jobs: what is read and written at once is a bucket's
    want = {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        want[e[0]] = want.get(e[0], JS.Job()).after(int(e[1] * 1000), e[3], e[4])
    want = {k: j.by(16_400_000) for k, j in want.items()} | {"bare": JS.Job(changes=1)}
    got = {r["job"]: tuple(r)[2:] for r in JS.last_states(own.table("by_bucket")).collect()}
    assert got == {k: tuple(vars(j).values()) for k, j in want.items()}


@pytest.mark.parametrize("most", [40, 1 << 18])
def test_job_batches_are_written_by_several_tasks(spark, sf, tmp_path, monkeypatch, most):
    from sievework.plans import workflow_queries as W

    want = {tuple(r) for r in W.job_states(spark, sf).collect()}
    monkeypatch.setattr(W, "workspace", lambda *_: str(tmp_path / "w"))
    monkeypatch.setattr(W, "_FILE_ROWS", most)
    taken = []
    monkeypatch.setattr(W.jobs, "watched", lambda s, p, schema, n, f=jobs.watched: taken.append(n) or f(s, p, schema, n))
    assert {tuple(r) for r in W.job_states(spark, sf).collect()} == want
    files = [p for p in (tmp_path / "w" / "events").iterdir() if p.suffix == ".parquet"]
    assert (len(files), taken[0] > 1) == (5 * taken[0] + 1, most == 40)


def test_attempts_over_frames_and_batches(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "id long, at timestamp, ok boolean"
    rows = [(1, float(k), True) for k in range(19_997)] + [(1, 20_000.0 + k, False) for k in range(3)]
    random.Random(2).shuffle(rows)
    put(spark, path, rows + [(2, 1.0, False), (2, 2.0, True), (3, None, False), (3, 1.0, None)] + [(4, float(k), False) for k in range(9)], schema)
    put(spark, path, [(2, 0.5, False), (2, 3.0, False), (1, 19_999.5, True), (4, 6.5, True), (5, 1.0, True), (5, 1.0, False)], schema)
    jobs.run_to_end(jobs.attempts(jobs.watched(spark, path, schema, 1), "id", "at"), "tried_all", str(tmp_path / "c"), "update")
    last = spark.table("tried_all").collect()
    assert (1, 3, "retry") in [tuple(r) for r in last]
    assert {tuple(r) for r in last} >= {(2, 0, "queued"), (2, 1, "retry"), (3, 0, "queued"), (4, 5, "failed"), (4, 2, "retry"), (5, 1, "retry")}


@pytest.mark.parametrize("most", [2, 5])
def test_attempts_keep_few(spark, tmp_path, most):
    path, schema = str(tmp_path / "in"), "id long, at timestamp, ok boolean"
    put(spark, path, [(1, float(k), False) for k in range(1000)], schema)
    jobs.run_to_end(jobs.attempts(jobs.watched(spark, path, schema, 1), "id", "at", most), f"tried_{most}", str(tmp_path / "c"), "update")
    assert [tuple(r) for r in spark.table(f"tried_{most}").collect()] == [(1, most, "failed")]


@pytest.mark.parametrize(("limit", "rounds"), [(1, 2), (3, 9), (7, 4096)])
def test_admissions(spark, monkeypatch, limit, rounds):
    monkeypatch.setattr(jobs, "_ROUNDS", rounds)
    monkeypatch.setattr(jobs, "_STRETCH", 20)
    rng = random.Random(limit)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(400) * 500_000, i) for i in range(300)] + [("a", None, 900), ("c", 5, 901)] + [("b", 7, 1000 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "kind string, at long, id long").repartition(5)
    want = {}
    for kind in ("a", "b", "c", None):
        started = []
        for at, i in sorted((at, i) for k, at, i in rows if k == kind and at is not None):
            started.append(max(at, started[-limit] + 60_000_000) if len(started) >= limit else at)
            want[i] = started[-1]
    got = {r.id: r.admitted for r in jobs.admission_times(df, "kind", "at", "id", limit).collect()}
    assert got == want | {900: None}
    assert jobs.admission_times(df.limit(0), "kind", "at", "id", limit).count() == 0


def test_admissions_of_one_key_are_shared(spark):
    df = spark.range(20_000).select(F.lit("a").alias("kind"), (F.col("id") * 1000).alias("at"), "id")
    timed = jobs.admission_times(df, "kind", "at", "id", 10)
    assert timed.agg(F.max("admitted")).first()[0] == 9000 + 1_999 * 60_000_000
    windows = [line for line in timed._jdf.queryExecution().executedPlan().toString().split("\n") if " Window " in line and "_free" in line]
    assert windows and all("_range" in line for line in windows if "max(_free" in line)
