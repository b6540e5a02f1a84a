"""Changes applied to snapshots: diffs, upserts, cascades, state transitions. Each takes frames and returns the next ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.predicates import backoff_seconds, retry_state


def snapshot_diff(known: DataFrame, current: DataFrame, key: str, version: str, name: str) -> DataFrame:
    """R2: key and change: new, changed, renamed, unchanged or removed. One full join of two keyed snapshots."""
    old = known.select(F.col(key).alias("_key"), F.col(version).alias("_v"), F.col(name).alias("_n"), F.lit(True).alias("_there"))
    new = current.select(F.col(key), F.col(version), F.col(name), F.lit(True).alias("_here"))
    change = (
        F.when(F.col("_there").isNull(), "new").when(F.col("_here").isNull(), "removed")
        .when(~F.col("_v").eqNullSafe(F.col(version)), "changed").when(~F.col("_n").eqNullSafe(F.col(name)), "renamed").otherwise("unchanged")
    )
    return new.join(old, F.col(key) == F.col("_key"), "full").select(F.coalesce(key, "_key").alias(key), change.alias("change"))


def _same(keys: list[str], left: str = "t", right: str = "c") -> Column:
    """Keys are equal; a null is a key like others, equal to a null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def upserted(target: DataFrame, changes: DataFrame, keys: list[str], updates: dict[str, Column] | None = None) -> DataFrame:
    """M1: rows of `changes` replace those with their keys or are added; `updates` may combine old t.* and new c.* columns.

    Null keys are equal to each other. Keys of `changes` are unique.
    """
    t, c = target.withColumn("_t", F.lit(True)).alias("t"), changes.withColumn("_c", F.lit(True)).alias("c")
    rest = [x for x in target.columns if x not in keys]
    both = F.col("_t") & F.col("_c")
    value = {x: F.when(both & F.lit(x in (updates or {})), (updates or {}).get(x, F.col(f"c.{x}"))).when(F.col("_c"), F.col(f"c.{x}")).otherwise(F.col(f"t.{x}")) for x in rest}
    return t.join(c, _same(keys), "full").select(*[F.coalesce(f"t.{k}", f"c.{k}").alias(k) for k in keys], *[v.alias(x) for x, v in value.items()])


def inserted_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """M2: rows are added whose keys are not there; of several new ones with one key, any one. Null keys are equal."""
    return target.unionByName(rows.dropDuplicates(keys).alias("t").join(target.select(*keys).alias("c"), _same(keys), "left_anti"))


def replaced(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """M3: whole rows replace those with their keys. Null keys are equal."""
    return target.alias("t").join(rows.select(*keys).distinct().alias("c"), _same(keys), "left_anti").unionByName(rows)


def updated_where(df: DataFrame, test: Column, **values: Column) -> DataFrame:
    """Columns get new values where the test holds; where it is null they stay."""
    return df.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})


def cascaded_delete(frames: dict[str, DataFrame], ids: DataFrame, links: dict[str, str], key: str = "id") -> tuple[dict[str, DataFrame], DataFrame]:
    """M5: every frame without the rows that belong to `ids` (key), and a table of how many rows each loses.

    `links`: for each frame the column that holds the key, in the order of deletion.
    """
    doomed = ids.select(F.col(key).alias("_id")).distinct()
    kept = {n: f.join(doomed, f[links[n]] == doomed["_id"], "left_anti") if n in links else f for n, f in frames.items()}
    lost = [frames[n].join(doomed, frames[n][c] == doomed["_id"], "left_semi").agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(n).alias("name"), "deleted") for n, c in links.items()]
    return kept, reduce(DataFrame.unionByName, lost)


def terminal_records(records: DataFrame, jobs: DataFrame, final: tuple[str, ...] = ("done", "failed", "superseded")) -> DataFrame:
    """Records with jobs, none of which is still to run."""
    return records.join(jobs.select("application_id").distinct(), records.id == F.col("application_id"), "left_semi").join(jobs.where(~F.col("state").isin(*final)).select("application_id"), records.id == F.col("application_id"), "left_anti")


def invalidated(records: DataFrame, dependents: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6: records of which `changed` (id, version) has another version start again, and their dependents go."""
    moved = changed.select(F.col("id").alias("_id"), F.col("version").alias("_version"))
    joined = records.join(moved, records.id == moved["_id"], "left")
    anew = F.col("_id").isNotNull() & ~F.col("version").eqNullSafe(F.col("_version"))
    stale = joined.where(anew).select(F.col("id").alias("_stale"))
    nothing = {c: F.lit(None).cast(records.schema[c].dataType) for c in ("hash", "sections", "review_reason", "duplicate_of") if c in records.columns}
    fresh = updated_where(joined, anew, **nothing, status=F.lit("queued"), index_status=F.lit("pending")).withColumn("version", F.when(anew, F.col("_version")).otherwise(F.col("version")))
    return fresh.select(*records.columns), dependents.join(stale, dependents.application_id == stale["_stale"], "left_anti")


def reindexed(records: DataFrame, model: str) -> DataFrame:
    """What was indexed by another model waits again."""
    other = (F.col("index_status") == "ready") & ~F.col("index_model").eqNullSafe(F.lit(model))
    return updated_where(records, other, index_status=F.lit("pending"))


def orphans(records: DataFrame) -> DataFrame:
    """Duplicates whose original is gone: not active, or itself a duplicate."""
    original = records.select(F.col("id").alias("_original"), F.col("active").alias("_active"), F.col("duplicate_of").alias("_of"))
    return records.where("active").join(original, F.col("duplicate_of") == F.col("_original")).where(~F.col("_active") | F.col("_of").isNotNull()).select(*records.columns)


def promoted(records: DataFrame) -> DataFrame:
    """M8: orphans stand for themselves again and wait."""
    lost = orphans(records).select(F.col("id").alias("_id"))
    joined = records.join(lost, records.id == lost["_id"], "left")
    test = F.col("_id").isNotNull()
    return updated_where(joined, test, status=F.lit("queued"), duplicate_of=F.lit(None).cast(records.schema["duplicate_of"].dataType)).select(*records.columns)


def with_next_revision(df: DataFrame, key: str, revision: str) -> DataFrame:
    """The revision that comes after all of a key's."""
    return df.groupBy(key).agg((F.max(revision) + 1).alias("next_revision"))


def failed_attempt(jobs: DataFrame, now: Column, base: float = 15, most: int = 5) -> DataFrame:
    """R5, A.6: one more failed attempt for each row: its state and when it may run again, base * 2^n after the n-th."""
    n = F.col("attempts") + 1
    return jobs.withColumn("state", retry_state(n, most)).withColumn("next_try", now + backoff_seconds(n, base)).withColumn("attempts", n)


def fenced(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results whose job is still at the version and generation that they were made for."""
    return results.join(jobs.where("state <> 'superseded'").select("application_id", "version", "rubric_id", "generation"), ["application_id", "version", "rubric_id", "generation"], "left_semi")


def due(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The next jobs to run."""
    return jobs.where(F.col("state").isin("queued", "retry") & (F.col("next_try") <= now)).orderBy("next_try", "id").limit(n)


def resumed_step(assessed: Column, sections: Column) -> Column:
    """The furthest checkpoint that a record can go on from."""
    return F.when(assessed, "report").when(sections.isNotNull() & (sections != ""), "assess").otherwise("download")


def _if_there(df: DataFrame, **values: Column) -> dict[str, Column]:
    """New values for the columns that a frame has, in their types."""
    return {c: v.cast(df.schema[c].dataType) for c, v in values.items() if c in df.columns}


def _upserted_jobs(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs of `wanted` (application_id, version, rubric_id, _step) begin at that step: where there is one, whatever its
    state, it starts a new generation without its attempts and errors; else there is a new one, with no identifier yet."""
    keys = ["application_id", "version", "rubric_id"]
    anew = F.lit(True)
    steps = wanted.select(*keys, "_step", anew.alias("_anew"))
    hit = F.col("_anew").isNotNull()
    held = jobs.join(steps, keys, "left")
    fresh = {"state": F.lit("queued"), "step": F.col("_step"), "attempts": F.lit(0), "next_try": F.lit(0.0), "error": F.lit(None), "error_at": F.lit(None), "generation": F.col("generation") + 1}
    kept = updated_where(held, hit, **_if_there(jobs, **fresh)).select(*jobs.columns)
    made = steps.join(jobs.select(*keys), keys, "left_anti")
    first = _if_there(jobs, **fresh | {"generation": F.lit(0)})
    return kept.unionByName(made.select(*[(F.col(c) if c in keys else first.get(c, F.lit(None).cast(jobs.schema[c].dataType))).alias(c) for c in jobs.columns]))


def decided(records: DataFrame, roles: DataFrame, jobs: DataFrame, decisions: DataFrame, assessments: DataFrame, holds: DataFrame, now: float, expiry_days: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Review decisions (application_id, action, reason), one a record: the next records, jobs and holds.

    confirm_spam holds the document's hash and sends the record's jobs to the report; a record without hash or evidence
    cannot be confirmed and stays as it is. Other actions put the record back at its furthest checkpoint under its
    role's rubric: the report if it is assessed under that one, which also completes it, else its text or its download.
    Its job for version and rubric starts again, or there is a new one. `restore` also ends the holds of the document.
    holds: kind, identifier, reason, active, created, expires. Records that are not active are not decided on.
    """
    if isinstance(expiry_days, bool) or not 1 <= expiry_days <= 365:
        raise ValueError("a hold lasts 1 to 365 days")
    d = decisions.select(F.col("application_id").alias("_id"), "action", F.col("reason").alias("_reason"))
    rubric = roles.select(F.col("id").alias("_role"), F.coalesce("rubric_id", F.lit(0)).alias("_rubric"))
    done = assessments.select(F.col("application_id").alias("_a"), F.col("version").alias("_av"), F.col("rubric_id").alias("_ar")).distinct()
    asked = records.where("active").join(d, records.id == d["_id"]).join(rubric, F.col("role_id") == F.col("_role"), "left").withColumn("_rubric", F.coalesce("_rubric", F.lit(0)))
    joined = asked.join(done, (F.col("id") == F.col("_a")) & (F.col("version") == F.col("_av")) & (F.col("_rubric") == F.col("_ar")), "left")
    spam = F.col("action") == "confirm_spam"
    evidence = F.coalesce((F.col("hash") != "") & (F.size("review_evidence") > 0), F.lit(False))
    assessed = F.col("_a").isNotNull()
    acts = joined.where(~spam | evidence).select(
        F.col("id").alias("_id"), spam.alias("_spam"), (F.col("action") == "restore").alias("_restore"), assessed.alias("_assessed"), F.col("version").alias("_version"), "_rubric", F.col("hash").alias("_hash"), "_reason",
        F.concat(F.lit("HR-confirmed spam: "), "_reason").alias("_why"), resumed_step(assessed, F.col("sections")).alias("_step"),
    )
    own, nothing = F.col("_spam"), F.lit(None)
    values = _if_there(
        records, status=F.when(own, "review").when(F.col("_assessed"), "completed").otherwise("queued"), review_reason=F.when(own, F.col("_why")),
        duplicate_of=F.when(own, F.col("duplicate_of")).otherwise(nothing), index_status=F.when(own, F.col("index_status")).otherwise("pending"),
    )
    again = _if_there(records, index_attempts=F.lit(0), index_next=F.lit(0.0), review_dismissed=F.lit(True))
    values |= {c: F.when(own, F.col(c)).otherwise(v) for c, v in again.items()}
    next_records = updated_where(records.join(acts, records.id == acts["_id"], "left"), own.isNotNull(), **values).select(*records.columns)
    reported = acts.where("_spam").select(F.col("_id").alias("_job"))
    sent = (F.col("_job").isNotNull()) & (F.col("state") != "superseded")
    after_spam = updated_where(jobs.join(reported, jobs.application_id == reported["_job"], "left"), sent, state=F.lit("queued"), step=F.lit("report"), generation=F.col("generation") + 1).select(*jobs.columns)
    next_jobs = _upserted_jobs(after_spam, acts.where("NOT _spam").select(F.col("_id").alias("application_id"), F.col("_version").alias("version"), F.col("_rubric").alias("rubric_id"), "_step"))
    released = acts.where("_restore").select(F.lit("document").alias("_kind"), F.col("_hash").alias("_held")).distinct()
    ended = updated_where(holds.join(released, (F.col("kind") == F.col("_kind")) & (F.col("identifier") == F.col("_held")), "left"), F.col("_held").isNotNull(), active=F.lit(False)).select(*holds.columns)
    new = acts.where("_spam").select(F.lit("document").alias("kind"), F.col("_hash").alias("identifier"), F.col("_reason").alias("reason"), F.lit(True).alias("active"), F.lit(now).alias("created"), F.lit(now + 86400.0 * expiry_days).alias("expires"))
    return next_records, next_jobs, ended.unionByName(new, allowMissingColumns=True)


def activated(rubrics: DataFrame, roles: DataFrame, jobs: DataFrame, records: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Approved rubrics (id, role_id, body) come in force: the next rubrics, roles, jobs and records.

    Rubrics are added (one that is there stays as it is), their roles take them and are paused no longer, the roles' jobs
    are superseded, and every active record is queued again, as no duplicate and without a reason, with a new job from its
    text on, or from its download; new jobs have no identifier yet. Of several new rubrics of a role the one with the largest id counts.
    """
    fresh = new.join(rubrics.select("id"), "id", "left_anti")
    switch = fresh.groupBy("role_id").agg(F.max("id").alias("_rubric")).withColumnRenamed("role_id", "_role")
    next_roles = updated_where(roles.join(switch, roles.id == F.col("_role"), "left"), F.col("_role").isNotNull(), **_if_there(roles, rubric_id=F.col("_rubric"), paused=F.lit(False))).select(*roles.columns)
    of_role = records.join(switch, records.role_id == F.col("_role")).select(F.col("id").alias("_id"), F.col("active").alias("_active"), F.col("version").alias("_version"), "_rubric", F.col("sections").alias("_text"))
    queued = _if_there(records, status=F.lit("queued"), duplicate_of=F.lit(None), review_reason=F.lit(None))
    next_records = updated_where(records.join(of_role.select("_id", "_active"), records.id == F.col("_id"), "left"), F.col("_active"), **queued).select(*records.columns)
    old = updated_where(jobs.join(of_role.select("_id"), jobs.application_id == F.col("_id"), "left"), F.col("_id").isNotNull(), state=F.lit("superseded")).select(*jobs.columns)
    wanted = of_role.where("_active").select(F.col("_id").alias("application_id"), F.col("_version").alias("version"), F.col("_rubric").alias("rubric_id"), resumed_step(F.lit(False), F.col("_text")).alias("step"))
    made = wanted.join(jobs.select("application_id", "version", "rubric_id"), ["application_id", "version", "rubric_id"], "left_anti")
    first = {c: F.col(c) for c in wanted.columns} | _if_there(jobs, state=F.lit("queued"), attempts=F.lit(0), next_try=F.lit(0.0), generation=F.lit(0))
    every = made.select(*[first.get(c, F.lit(None).cast(jobs.schema[c].dataType)).alias(c) for c in jobs.columns])
    return rubrics.unionByName(fresh.select(*rubrics.columns)), next_roles, old.unionByName(every), next_records


def low_scores_to_review(records: DataFrame, roles: DataFrame, assessments: DataFrame, jobs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """M9: active, completed records whose score under their role's rubric lies below the threshold go to review, with the
    reason, and their jobs that are not superseded to the report: the next records and jobs. Scores under other rubrics or
    of other versions say nothing; a record has one row however many there are."""
    from sievework.functions.predicates import low_score_reason

    rubric = roles.select(F.col("id").alias("_role"), F.col("rubric_id").alias("_rubric"))
    scored = assessments.groupBy(F.col("application_id").alias("_a"), F.col("version").alias("_v"), F.col("rubric_id").alias("_r")).agg(F.min("score").alias("_score"))
    completed = records.where("active AND status = 'completed'").select(F.col("id").alias("_id"), "role_id", "version")
    current = completed.join(rubric, F.col("role_id") == F.col("_role")).join(scored, (F.col("_id") == F.col("_a")) & (F.col("version") == F.col("_v")) & (F.col("_rubric") == F.col("_r")))
    low = current.select("_id", low_score_reason(F.col("_score"), threshold).alias("_why")).where("_why IS NOT NULL")
    hit = F.col("_why").isNotNull()
    next_records = updated_where(records.join(low, records.id == low["_id"], "left"), hit, status=F.lit("review"), review_reason=F.col("_why")).select(*records.columns)
    sent = _if_there(jobs, step=F.lit("report"), state=F.lit("queued"), attempts=F.lit(0), next_try=F.lit(0.0), error=F.lit(None), error_at=F.lit(None))
    next_jobs = updated_where(jobs.join(low, jobs.application_id == low["_id"], "left"), hit & (F.col("state") != "superseded"), **sent).select(*jobs.columns)
    return next_records, next_jobs
