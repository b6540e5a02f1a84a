"""Durable states of jobs, with retries that fire by time and generations that fence stale results.

Events of a job may come in any order within the watermark's delay: they wait in the job's state until the watermark has
passed them, and are then applied in the order of their times. A retry is a timer on the same clock. So the states are
those of a fold over all events in order, however these are dealt to batches and frames, and after a restart too.

A call to the state store from Python costs far more than an event does. So jobs are dealt to buckets, and a bucket's jobs, its events that wait and its next timer are read and written together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

BASE_SECONDS, MOST_SECONDS, MOST_ATTEMPTS = 15, 3600, 5
#: Processors keep their state in this store; the one that Spark uses by default cannot hold timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Events in a row of the state.
CHUNK = 1000

#: A bucket's state by columns: all of its jobs in one row, the events that wait in rows of up to CHUNK.
_JOBS = "job array<string>, generation array<long>, state array<string>, attempts array<int>, next_try array<long>, fired array<long>, stale array<long>, changes array<long>"
_WAITING = "at array<long>, seq array<long>, generation array<long>, kind array<string>, job array<string>"
STATES = "job string, at long, generation long, state string, attempts int, next_try long, fired long, stale long, changes long"


@dataclass(frozen=True)
class Job:
    """A job's state. Times are milliseconds. `fired` counts retries that came due, `stale` results of old generations,
    `changes` all that was applied."""

    generation: int = -1
    state: str = "queued"
    attempts: int = 0
    next_try: int = 0
    fired: int = 0
    stale: int = 0
    changes: int = 0

    def by(self, now: int) -> Job:
        """A retry that is due by `now` is queued again; its attempts stay."""
        return replace(self, state="queued", fired=self.fired + 1) if self.state == "retry" and self.next_try <= now else self

    def after(self, at: int, generation: int, kind: str) -> Job:
        """What an event makes of it.

        A later generation starts anew, an earlier one's event is stale and counts for nothing else. `error` is a failed
        attempt: the n-th in a row waits min(3600, 15 * 2^n) seconds, the fifth ends the job. `ok` is a checkpoint: no
        failures, to be run on. `done` ends it. Nothing but a new generation follows an end; other kinds change nothing.
        """
        job, changes = self.by(at), self.changes + 1
        if generation < job.generation:
            return replace(job, stale=job.stale + 1, changes=changes)
        state, attempts, next_try = (job.state, job.attempts, job.next_try) if generation == job.generation else ("queued", 0, 0)
        if state not in ("failed", "done"):
            if kind == "error":
                attempts += 1
                state, next_try = "failed" if attempts >= MOST_ATTEMPTS else "retry", at + 1000 * min(MOST_SECONDS, BASE_SECONDS * 2**attempts)
            elif kind == "ok":
                state, attempts, next_try = "queued", 0, 0
            elif kind == "done":
                state = "done"
        return Job(generation, state, attempts, next_try, job.fired, job.stale, changes)


_NEW = Job()


def _columns(rows: list[tuple]) -> tuple[list, ...]:
    return tuple(list(c) for c in zip(*rows))


def _chunks(rows: list[tuple]) -> list[tuple[list, ...]]:
    return [_columns(rows[k : k + CHUNK]) for k in range(0, len(rows), CHUNK)]


class JobStates(StatefulProcessor):
    """Rows of a bucket's jobs (job, at_ms, seq, generation, kind) to their states; see job_states()."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", _JOBS)
        self.waiting = handle.getListState("waiting", _WAITING)
        self.settled: dict[tuple, int] = {}  # by bucket of this task, the time up to which all is applied

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            names = [j if isinstance(j, str) else None for j in frame["job"].tolist()]  # pandas may have NaN for null
            self.waiting.appendList(_chunks(list(zip(*(frame[c].tolist() for c in ("at_ms", "seq", "generation", "kind")), names))))
            first = int(frame["at_ms"].min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(earliest)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        if self.settled.get(key) == now:  # by another timer of the bucket
            return
        self.settled[key] = now
        events = [e for chunk in self.waiting.get() for e in zip(*chunk)]
        due, later = sorted((e for e in events if e[0] <= now), key=lambda e: e[:4]), [e for e in events if e[0] > now]
        held = self.jobs.get()
        before = {name: Job(*rest) for name, *rest in zip(*held)} if held else {}
        states = dict(before)
        for at, _, generation, kind, name in due:
            states[name] = states.get(name, _NEW).after(at, generation, kind)
        states = {name: job.by(now) for name, job in states.items()}
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(_chunks(later))
        timers = [e[0] for e in later] + [job.next_try for job in states.values() if job.state == "retry"]
        if timers:
            self.handle.registerTimer(min(timers))
        changed = [(name, now, *astuple(job)) for name, job in states.items() if job != before.get(name, _NEW)]
        if changed:
            self.jobs.update(_columns([(name, *astuple(job)) for name, job in states.items()]))
            yield pd.DataFrame(changed, columns=[c.split()[0] for c in STATES.split(", ")])

    def close(self) -> None:
        pass


def job_states(events: DataFrame, job: str, at: str, seq: str, generation: Column, kind: Column, delay: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """A stream of STATES: a row for a job whenever its state changed, when the watermark had passed what changed it.

    `events` is a stream; `at` its time, `seq` orders events of one time, `kind` is error, ok, done or what changes
    nothing. Events later than the watermark by more than `delay` are dropped by Spark before they get here. A null job is
    a job. Events without a time count for nothing, those without a `seq` come first at their time, those without a
    generation are of the one before all others.

    Jobs are dealt to `buckets` by their hash; a bucket's jobs and its events that wait for the watermark are its state,
    and a task reads those of one bucket at a time. So there should be as many as keep these to some ten thousand; a
    stream keeps the number that it began with.
    """
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).where(F.col("_at").isNotNull()).withWatermark("_at", delay)
    name = F.col(job).cast("string")
    rows = timed.select(
        F.pmod(F.xxhash64(name), F.lit(buckets)).alias("bucket"), name.alias("job"), "_at", F.unix_millis("_at").alias("at_ms"),
        F.coalesce(F.col(seq).cast("long"), F.lit(-(2**63))).alias("seq"), F.coalesce(generation.cast("long"), F.lit(-1).cast("long")).alias("generation"), F.coalesce(kind, F.lit("")).alias("kind"),
    )
    return rows.groupBy("bucket").transformWithStateInPandas(JobStates(), STATES, "append", "EventTime")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state where timers can lie."""
    own = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return own


def last_states(states: DataFrame) -> DataFrame:
    """The last state of each job."""
    rest = [c for c in states.columns if c != "job"]
    return states.groupBy("job").agg(F.max_by(F.struct(*rest), F.struct("at", "changes", "fired")).alias("_s")).select("job", "_s.*")
