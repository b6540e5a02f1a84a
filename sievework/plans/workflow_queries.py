"""Queries: decisions, rubrics, keys, ledgers, caches, recognised words and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import aggregates as A
from sievework.operators import changes as C
from sievework.operators import quality as Q
from sievework.plans.registry import query
from sievework.plans.session import table, workspace
from sievework.sources import readers
from sievework.streaming import job_states as JS
from sievework.streaming import jobs


def _workflow(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents as records of roles with one rubric or the other, most with a job, some assessed under either; roles last."""
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    records = docs.select(
        d.alias("id"), F.regexp_extract("source", r"\d+", 0).cast("int").alias("role_id"), F.lit("v").alias("version"), F.lit("review").alias("status"), (F.col("lang") != "fr").alias("active"),
        F.when(d % 7 == 0, F.lit(1).cast("long")).alias("duplicate_of"), F.when(d % 4 != 0, d.cast("string")).alias("hash"), F.when(d % 5 != 1, "text").alias("sections"), F.lit("low score").alias("review_reason"),
        F.when(d % 5 != 0, F.array(F.lit("quote"))).otherwise(F.array().cast("array<string>")).alias("review_evidence"), F.lit("ready").alias("index_status"),
    )
    work = docs.where("doc_id % 13 <> 0").select(d.alias("id"), d.alias("application_id"), F.lit("v").alias("version"), F.lit(9).alias("rubric_id"), F.when(d % 11 == 0, "superseded").otherwise("done").alias("state"), F.lit("done").alias("step"), F.lit(3).alias("attempts"), F.lit(0).alias("generation"))
    assessed = docs.where("doc_id % 3 <> 0").select(d.alias("application_id"), F.lit("v").alias("version"), F.when(d % 3 == 1, 9).otherwise(8).alias("rubric_id"))
    roles = records.select("role_id").distinct().select(F.col("role_id").alias("id"), F.when(F.col("role_id") % 2 == 0, 9).otherwise(8).alias("rubric_id"), (F.col("role_id") == 2).alias("paused"))
    return records, work, assessed, roles


def _decided(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records, work, assessed, roles = _workflow(spark, sf)
    k = F.col("id") % 6
    decisions = records.where(k <= 2).select(F.col("id").alias("application_id"), F.when(k == 0, "confirm_spam").when(k == 1, "restore").otherwise("retry").alias("action"), F.lit("why").alias("reason"))
    holds = records.where("id % 10 = 3 AND hash IS NOT NULL").select(F.lit("document").alias("kind"), F.col("hash").alias("identifier"), F.lit("old").alias("reason"), F.lit(True).alias("active"), F.lit(1.0).alias("created"), F.lit(2000.0).alias("expires"))
    return C.decided(records, roles, work, decisions, assessed, holds, 1000.0)


_DECIDED = """
WITH r AS (SELECT doc_id AS id, lang <> 'fr' AS active, doc_id % 6 AS k, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS evidence, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 2 AS odd,
  doc_id % 3 = CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 2 = 0 THEN 1 ELSE 2 END AS assessed, doc_id % 5 <> 1 AS sections, doc_id % 11 = 0 AS over, doc_id % 13 <> 0 AS job FROM documents),
a AS (SELECT *, active AND k <= 2 AND (k <> 0 OR evidence) AS acts, CASE WHEN assessed THEN 'report' WHEN sections THEN 'assess' ELSE 'download' END AS next FROM r)"""


@query(_DECIDED + """
SELECT id, CASE WHEN NOT acts OR k = 0 THEN 'review' WHEN assessed THEN 'completed' ELSE 'queued' END AS status, CASE WHEN NOT acts THEN 'low score' WHEN k = 0 THEN 'HR-confirmed spam: why' END AS review_reason,
       CASE WHEN acts AND k > 0 THEN 'pending' ELSE 'ready' END AS index_status, CASE WHEN id % 7 = 0 AND NOT (acts AND k > 0) THEN 1 END AS duplicate_of FROM a""")
def review_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Spam is held, the rest goes on from its furthest checkpoint under its role's rubric."""
    return _decided(spark, sf)[0].select("id", "status", "review_reason", "index_status", F.col("duplicate_of").cast("int").alias("duplicate_of"))


@query(_DECIDED + """
SELECT id AS application_id, 9 AS rubric_id, CASE WHEN acts AND (k > 0 AND odd = 0 OR k = 0 AND NOT over) THEN 'queued' WHEN over THEN 'superseded' ELSE 'done' END AS state,
  CASE WHEN acts AND k > 0 AND odd = 0 THEN next WHEN acts AND k = 0 AND NOT over THEN 'report' ELSE 'done' END AS step, CASE WHEN acts AND k > 0 AND odd = 0 THEN 0 ELSE 3 END AS attempts,
  CASE WHEN acts AND (k > 0 AND odd = 0 OR k = 0 AND NOT over) THEN 1 ELSE 0 END AS generation FROM a WHERE job
UNION ALL SELECT id, CASE WHEN odd = 0 THEN 9 ELSE 8 END, 'queued', next, 0, 0 FROM a WHERE acts AND k > 0 AND (odd = 1 OR NOT job)""")
def decided_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs start again, go to the report, or are made where there were none."""
    return _decided(spark, sf)[1].select("application_id", "rubric_id", "state", "step", "attempts", "generation")


@query(_DECIDED + """
SELECT CAST(id AS VARCHAR) AS identifier, 'old' AS reason, NOT (acts AND k = 1) AS active, 2000.0::DOUBLE AS expires FROM a WHERE id % 10 = 3 AND id % 4 <> 0
UNION ALL SELECT CAST(id AS VARCHAR), 'why', true, 1000.0 + 86400 * 90 FROM a WHERE acts AND k = 0""")
def decided_holds(spark: SparkSession, sf: str) -> DataFrame:
    """Holds that are ended and made."""
    return _decided(spark, sf)[2].select("identifier", "reason", "active", "expires")


def _activated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    records, work, _, roles = _workflow(spark, sf)
    new = roles.where("id < 5").select((F.col("id") + 100).alias("id"), F.col("id").alias("role_id"), F.lit("body").alias("body"))
    known = roles.where("id = 1").select((F.col("id") + 100).alias("id"), F.col("id").alias("role_id"), F.lit("old").alias("body"))  # one is in force
    return C.activated(known, roles, work, records, new)


_ACTIVATED = """
WITH r AS (SELECT doc_id, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS role, lang <> 'fr' AS active, doc_id % 5 <> 1 AS sections, doc_id % 11 = 0 AS over FROM documents)"""


@query(_ACTIVATED + """
SELECT doc_id AS application_id, 9 AS rubric_id, CASE WHEN role < 5 AND role <> 1 OR over THEN 'superseded' ELSE 'done' END AS state, 'done' AS step FROM r WHERE doc_id % 13 <> 0
UNION ALL SELECT doc_id, 100 + role, 'queued', CASE WHEN sections THEN 'assess' ELSE 'download' END FROM r WHERE role < 5 AND role <> 1 AND active""")
def rubric_activation(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs after new rubrics come in force for some roles."""
    return _activated(spark, sf)[2].select("application_id", "rubric_id", "state", "step")


@query(_ACTIVATED + """
SELECT doc_id AS id, role AS role_id, CASE WHEN hit AND active THEN 'queued' ELSE 'review' END AS status, CASE WHEN NOT (hit AND active) THEN 'low score' END AS review_reason, doc_id % 7 = 0 AND NOT (hit AND active) AS duplicate,
  CASE WHEN hit THEN 100 + role WHEN role % 2 = 0 THEN 9 ELSE 8 END AS rubric_id, role = 2 AND NOT hit AS paused FROM (SELECT *, role < 5 AND role <> 1 AS hit FROM r)""")
def activated_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records are queued again, and their roles have the new rubric and go on."""
    _, roles, _, records = _activated(spark, sf)
    own = roles.select(F.col("id").alias("role_id"), "rubric_id", "paused")
    return records.join(own, "role_id").select("id", "role_id", "status", "review_reason", F.col("duplicate_of").isNotNull().alias("duplicate"), "rubric_id", "paused")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """M13."""
    return Q.violations(table(spark, sf, "events"), ["user_id", "event_type"])


@query("""
SELECT event_type AS model, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sections FROM events WHERE event_id % 9 > 2 GROUP BY 1""")
def ledger_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are torn, arrays or blank are left out."""
    e = table(spark, sf, "events")
    whole = F.to_json(F.struct(F.col("event_type").alias("model"), F.from_json("props", "k long")["k"].alias("sections")))
    k = F.col("event_id") % 9
    lines = e.select(F.when(k == 0, F.expr("left(props, 5)")).when(k == 1, F.concat(F.lit("["), whole, F.lit("]"))).when(k == 2, "  ").otherwise(whole).alias("value"))
    return readers.parsed_lines(lines).groupBy("model").agg(F.count(F.lit(1)).alias("events"), F.sum("sections").alias("sections"))


@query("""
WITH k AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0)
SELECT count(*) AS rows, CAST(count(*) FILTER (WHERE k.text IS NOT NULL) AS BIGINT) AS cached, (SELECT count(*) FROM (SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM k))) AS fresh
FROM documents d LEFT JOIN k ON k.text = d.text""")
def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    """What the cache has, and what must be embedded, each text once."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = docs.where("doc_id % 3 = 0").select(readers.cache_key("m", "document", F.col("text")).alias("key")).distinct().withColumn("embedding", F.array(F.lit(0.0)))
    rows, fresh = readers.embedded(docs, known, lambda texts: [[1.0 + len(t)] for t in texts], "m")
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("embedding")[0] == 0, 1)).alias("cached"))
    return counts.join(fresh.agg(F.count(F.lit(1)).alias("fresh")))  # one row and one row


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
w AS (SELECT doc_id, p, trim(regexp_replace(line, ' +', ' ', 'g')) AS line FROM l)
SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS hash FROM w WHERE line <> '' GROUP BY 1""")
def recognised_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words with their places become lines, and lines a text."""
    docs = A.pages_dealt(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_num", "line"))
    words = lines.select("doc_id", "line_num", F.posexplode(F.split("line", " ", -1)).alias("word_num", "text"))
    return A.recognised_lines(words, ["doc_id"], ["line_num"]).select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_without_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """A stream in which each key passes once; here all events lie within the watermark."""
    events, folder = table(spark, sf, "events"), workspace(spark, "once")
    stream = jobs.without_repeats(jobs.watched(spark, f"{sf}/events.parquet*", events.schema).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "400 days")
    return jobs.into_files(stream.select("user_id", "event_type"), f"{folder}/rows", f"{folder}/checkpoint")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1
UNION ALL SELECT -1, -1, 'start'""")
def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of changes applied to a table; a batch that comes again changes nothing."""
    events, folder = table(spark, sf, "events"), workspace(spark, "merge")
    start = spark.createDataFrame([(-1, -1, "start")], "user_id long, event_id long, event_type string")
    merged = jobs.MergedTable(spark, f"{folder}/table", start, ["user_id"], "event_id")

    def twice(batch: DataFrame, n: int) -> None:
        for _ in range(2):
            merged.apply(batch.select("user_id", "event_id", "event_type"), n)

    stream = jobs.watched(spark, f"{sf}/events.parquet*", events.schema)
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return merged.read()


#: Events in a file that a stream reads, and of the jobs of a bucket in all.
_FILE_ROWS, _BUCKET_ROWS = 1 << 18, 1 << 14
#: Of an event: the job's generation, now and then an old one, and what it says.
_KIND = "CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_type = 'view' AND event_id % 10 = 0 THEN 'done' WHEN event_type = 'view' THEN 'seen' ELSE 'error' END"


@query(f"""
WITH RECURSIVE e AS (
  SELECT user_id AS job, epoch_us(ts) // 1000 AS ms, {_KIND} AS kind, day(ts) // 10 - CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS gen, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
f AS (
  SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS gen, 'queued' AS state, 0 AS attempts, CAST(0 AS BIGINT) AS next_try, CAST(0 AS BIGINT) AS fired, CAST(0 AS BIGINT) AS stale FROM e
  UNION ALL
  SELECT job, n, g, CASE WHEN old OR s IN ('failed', 'done') THEN s WHEN kind = 'error' THEN CASE WHEN a + 1 >= 5 THEN 'failed' ELSE 'retry' END WHEN kind = 'ok' THEN 'queued' WHEN kind = 'done' THEN 'done' ELSE s END,
    CASE WHEN old OR s IN ('failed', 'done') THEN a WHEN kind = 'error' THEN a + 1 WHEN kind = 'ok' THEN 0 ELSE a END,
    CASE WHEN old OR s IN ('failed', 'done') THEN t WHEN kind = 'error' THEN ms + CAST(1000 * least(3600, 15 * pow(2, a + 1)) AS BIGINT) WHEN kind = 'ok' THEN 0 ELSE t END, fired, stale
  FROM (
    SELECT job, n, ms, kind, old, greatest(gen, new_gen) AS g, CASE WHEN new_gen > gen THEN 'queued' WHEN due THEN 'queued' ELSE state END AS s, CASE WHEN new_gen > gen THEN 0 ELSE attempts END AS a, CASE WHEN new_gen > gen THEN 0 ELSE next_try END AS t,
      fired + CAST(due AS BIGINT) AS fired, stale + CAST(old AS BIGINT) AS stale
    FROM (SELECT f.job, e.n, e.ms, e.kind, f.gen, e.gen AS new_gen, e.gen < f.gen AS old, f.state, f.attempts, f.next_try, f.state = 'retry' AND f.next_try <= e.ms AS due, f.fired, f.stale FROM f JOIN e ON e.job = f.job AND e.n = f.n + 1))),
w AS (SELECT max(epoch_us(ts) // 1000) + 600000 AS ms FROM events),
l AS (SELECT f.*, f.state = 'retry' AND next_try <= w.ms AS due FROM f, w WHERE (job, n) IN (SELECT (job, max(n)) FROM e GROUP BY job))
SELECT CAST(job AS VARCHAR) AS job, gen AS generation, CASE WHEN due THEN 'queued' ELSE state END AS state, attempts, next_try, fired + CAST(due AS BIGINT) AS fired, stale, n AS changes FROM l""")
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs by their events, in five batches that overlap, until ten minutes after the last; each retry fires by a timer.

    A batch is the same number of files for each part, so that no part is divided: the watermark would pass its rest. A
    task deals its rows in turns, so every file is written if some task has as many rows of the part as there are files.
    """
    own, folder = JS.stream_session(spark), workspace(spark, "job-states")
    events = table(own, sf, "events")
    day = F.datediff(F.col("ts") + F.make_dt_interval(mins=F.pmod(F.hash("event_id"), F.lit(40)) - 20), F.lit("2024-01-01"))  # some come a little early or late
    rows = events.select(F.col("user_id").cast("string").alias("job"), "ts", "event_id", (F.floor(F.dayofmonth("ts") / 10) - (F.col("event_id") % 17 == 0).cast("int")).alias("generation"), F.expr(_KIND).alias("kind"), F.floor(F.greatest(F.lit(0), F.least(F.lit(34), day)) / 7).alias("part"))
    sizes = rows.groupBy("part", F.spark_partition_id().alias("task")).count().groupBy("part").agg(F.sum("count").alias("rows"), F.max("count").alias("most")).orderBy("part").collect()  # a row a part
    files = max(1, min([max((r["rows"] for r in sizes), default=0) // _FILE_ROWS, *(r["most"] for r in sizes)]))
    for r in sizes:
        rows.where(F.col("part") == r["part"]).drop("part").repartition(files).write.mode("append").parquet(f"{folder}/events")
    end = events.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("string").alias("job"), (F.col("ts") + F.expr("INTERVAL 70 MINUTES")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit(0).cast("long").alias("generation"), F.lit("tick").alias("kind"))
    end.write.mode("append").parquet(f"{folder}/events")
    buckets = max(16, sum(r["rows"] for r in sizes) // _BUCKET_ROWS)
    tasks = min(int(own.conf.get("spark.sql.shuffle.partitions")), max(own.sparkContext.defaultParallelism, buckets // 16))  # a task with state takes most of a second, whatever it holds
    own.conf.set("spark.sql.shuffle.partitions", tasks)
    stream = jobs.watched(own, f"{folder}/events", end.schema, files)
    states = jobs.into_files(JS.job_states(stream, "job", "ts", "event_id", F.col("generation"), F.col("kind"), buckets=buckets), f"{folder}/states", f"{folder}/checkpoint")
    last = JS.last_states(spark.read.schema(states.schema).parquet(f"{folder}/states"))
    return last.select("job", "generation", "state", "attempts", "next_try", "fired", "stale", "changes")


@query("""
WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) - 1 AS i FROM events),
t AS (SELECT event_type, event_id, i, us AS admitted FROM e WHERE i < 10
  UNION ALL SELECT e.event_type, e.event_id, e.i, greatest(e.us, t.admitted + 21600000000) FROM t JOIN e ON e.event_type = t.event_type AND e.i = t.i + 10)
SELECT event_type, event_id, admitted FROM t""")
def admission_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """When requests start if ten of a kind may start in six hours; most wait."""
    requests = table(spark, sf, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return jobs.admission_times(requests, "event_type", "at", "event_id", 10, 21600).select("event_type", "event_id", "admitted")


def _daily(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events in five batches by week, of which every fiftieth event comes with the last one."""
    folder = workspace(spark, "daily")
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    week = F.floor(F.greatest(F.lit(0), F.least(F.lit(34), F.datediff("ts", F.lit("2024-01-01")))) / 7)
    rows = events.withColumn("part", F.when(F.col("event_id") % 50 == 0, 4).otherwise(week))
    for part in range(5):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    kind = F.col("event_type")
    stream = jobs.watched(spark, f"{folder}/in", events.schema, 1)
    return jobs.daily_activity(stream, "ts", {"assessments": kind == "purchase", "views": kind == "view"}, folder, "1 day")


_DAILY = """
WITH e AS (SELECT event_id, event_type, ts, CASE WHEN event_id % 50 = 0 THEN 4 ELSE least(4, greatest(0, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7)) END AS part FROM events),
w AS (SELECT p.part, (SELECT max(ts) FROM e WHERE e.part < p.part) - INTERVAL 1 DAY AS mark FROM (SELECT DISTINCT part FROM e) p),
l AS (SELECT e.*, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM e JOIN w USING (part))"""


@query(_DAILY + """
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS assessments, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS views FROM l
WHERE NOT late AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM l WHERE NOT late) - INTERVAL 1 DAY GROUP BY 1""")
def daily_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Days that are over; their state is gone."""
    return _daily(spark, sf)[0].select(F.date_format("start", "yyyy-MM-dd").alias("day"), "assessments", "views")


@query(_DAILY + """
SELECT event_id, event_type FROM l WHERE late""")
def daily_late(spark: SparkSession, sf: str) -> DataFrame:
    """Events that came when their day was over are kept beside it."""
    return _daily(spark, sf)[1].select("event_id", "event_type")
