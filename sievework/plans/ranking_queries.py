"""Queries: ranking, latest and canonical rows, histograms, scores, usage, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import predicates as P
from sievework.operators import aggregates as A
from sievework.operators import ranking as R
from sievework.plans.registry import query
from sievework.plans.session import table, tables

_LEVEL = "CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'N' THEN 'partial' ELSE 'not_demonstrated' END"
_STATUS = "CASE WHEN l.toxic = 1 THEN 'review' WHEN l.quality = 1 THEN 'completed' ELSE 'queued' END"


def _level():
    return F.expr(_LEVEL)


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    part, lineitem = tables(spark, sf, "part", "lineitem")
    return part.join(lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("""
WITH e AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50))
SELECT p_brand, p_partkey, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank,
       count(*) OVER (PARTITION BY p_brand, p_size) > 1 AS tie FROM e""")
def rank_current(spark: SparkSession, sf: str) -> DataFrame:
    """J1, W1, L1."""
    return R.ranked(_eligible(spark, sf).select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey").orderBy("p_brand", F.desc("p_size"), "p_partkey")


@query("""
WITH r AS (SELECT p_brand, p_partkey, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank FROM part)
SELECT p_brand, p_partkey, p_size FROM r WHERE rank = 2""")
def rank_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """All that are second; empty for brands with two firsts."""
    return R.at_rank(R.ranked(table(spark, sf, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey"), 2).select("p_brand", "p_partkey", "p_size")


@query("""
WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS k,
                  row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part)
SELECT p_brand, CAST(count(*) FILTER (WHERE n <= 3) AS BIGINT) AS shown,
       coalesce(max(k) FILTER (WHERE n = 3) = max(k) FILTER (WHERE n = 4), false) AS tie_beyond_limit FROM r GROUP BY p_brand""")
def rank_ties_beyond(spark: SparkSession, sf: str) -> DataFrame:
    """W5, L5."""
    return R.top_with_ties(table(spark, sf, "part"), ["p_brand"], "p_size", "p_partkey")


@query("""
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """W2."""
    return R.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("""
SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id,
       min(doc_id) OVER (PARTITION BY sha256(text)) <> doc_id AS is_duplicate FROM documents""")
def canonical_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each content stands for its copies."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return R.with_canonical(docs, ["hash"], "doc_id").drop("hash")


@query("""
SELECT p_brand, p_partkey, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 3""")
def top_three_each(spark: SparkSession, sf: str) -> DataFrame:
    """L4, L5."""
    return R.top_n_each(table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], 3, F.desc("p_retailprice"), F.asc("p_partkey"))


@query(f"""
WITH j AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1),
s AS (SELECT d.doc_id, {_STATUS} AS status, j.event_type FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN j ON j.user_id = d.doc_id),
c AS (SELECT CASE WHEN status IN ('completed', 'review', 'duplicate') THEN status WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS stage, count(*) AS n FROM s GROUP BY 1)
SELECT CAST(v.place AS INTEGER) AS place, v.stage, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (VALUES (0, 'pending'), (1, 'completed'), (2, 'review'), (3, 'duplicate'), (4, 'failed')) v(place, stage) LEFT JOIN c ON c.stage = v.stage""")
def stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One stage a record; only the latest job counts."""
    docs, labels, events = tables(spark, sf, "documents", "labels", "events")
    jobs = R.latest(events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")
    status = F.when(F.col("toxic") == 1, "review").when(F.col("quality") == 1, "completed").otherwise("queued")
    rows = docs.select("doc_id").join(labels, "doc_id", "left").join(jobs, F.col("doc_id") == F.col("user_id"), "left")
    from sievework.functions.vocabulary import STAGES

    return A.dense_counts(rows, P.stage_of(status, F.when(F.col("event_type") == "error", "failed")), STAGES, "stage")


@query("""
WITH c AS (SELECT CASE WHEN s < 20 THEN 0 WHEN s < 40 THEN 1 WHEN s < 60 THEN 2 WHEN s < 80 THEN 3 ELSE 4 END AS place, count(*) AS n
           FROM (SELECT p_size * 2 AS s FROM part) GROUP BY 1)
SELECT CAST(v.place AS INTEGER) AS place, v.band, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (VALUES (0, '0–19'), (1, '20–39'), (2, '40–59'), (3, '60–79'), (4, '80–100')) v(place, band) LEFT JOIN c ON c.place = v.place""")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """F11, A5."""
    return A.score_histogram(table(spark, sf, "part").select((F.col("p_size") * 2).alias("s")), "s")


@query(f"""
WITH f AS (SELECT l_orderkey, l_linestatus, arg_min({_LEVEL}, (l_linenumber, l_partkey, l_suppkey)) AS level FROM lineitem GROUP BY 1, 2)
SELECT l_linestatus, CAST(count(*) FILTER (WHERE level = 'supported') AS BIGINT) AS supported, CAST(count(*) FILTER (WHERE level = 'partial') AS BIGINT) AS partial,
       CAST(count(*) FILTER (WHERE level = 'not_demonstrated') AS BIGINT) AS not_demonstrated FROM f GROUP BY 1""")
def criteria_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The first finding of each record on each criterion counts."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", _level().alias("level"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return A.level_pivot(A.first_findings(rows, ["l_orderkey", "l_linestatus"], "at"), ["l_linestatus"], F.col("level"))


@query(f"""
WITH f AS (SELECT l_orderkey, l_suppkey, arg_min({_LEVEL}, (l_linenumber, l_partkey)) AS level FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1, 2)
SELECT s_suppkey AS id, s_name AS description, CAST(count(*) FILTER (WHERE level = 'supported') AS BIGINT) AS supported, CAST(count(*) FILTER (WHERE level = 'partial') AS BIGINT) AS partial,
       CAST(count(*) FILTER (WHERE level = 'not_demonstrated') AS BIGINT) AS not_demonstrated FROM supplier LEFT JOIN f ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def criteria_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as criteria; those without findings have zeros."""
    supplier, lineitem = tables(spark, sf, "supplier", "lineitem")
    rows = lineitem.where("l_suppkey % 3 <> 0").select("l_orderkey", F.col("l_suppkey").alias("id"), _level().alias("level"), F.struct("l_linenumber", "l_partkey").alias("at"))
    criteria = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("description"))
    return A.criteria_counts(criteria, A.first_findings(rows, ["l_orderkey", "id"], "at"), "id", F.col("level"))


@query("""
SELECT l_orderkey, round(sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 4) AS score
FROM lineitem GROUP BY l_orderkey""")
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    """A13."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(A.weighted_points(F.col("l_quantity"), _level())), 4).alias("score"))


@query("""
SELECT b.p_brand, round(avg(p.p_size), 1) AS average FROM (SELECT DISTINCT p_brand FROM part) b
LEFT JOIN (SELECT * FROM part WHERE p_size > 48 AND p_type = 'ECONOMY') p ON p.p_brand = b.p_brand GROUP BY b.p_brand""")
def avg_or_null(spark: SparkSession, sf: str) -> DataFrame:
    """Null for brands with nothing to average."""
    wanted = F.when((F.col("p_size") > 48) & (F.col("p_type") == "ECONOMY"), F.col("p_size"))
    return table(spark, sf, "part").select("p_brand", wanted.alias("size")).groupBy("p_brand").agg(A.average_or_null("size").alias("average"))


@query("""
SELECT event_type AS model, count(*) AS count FROM events GROUP BY 1""")
def usage_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A2, A3."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "model")


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.from_json("props", "k bigint")["k"]
    return e.select("event_id", "user_id", F.col("event_type").alias("model"), k.alias("sections"), F.floor(F.col("value") * 100).cast("long").alias("chars"), F.when(F.col("event_type") == "purchase", k).alias("tokens"), F.col("ts").alias("at"), F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))).alias("provider"))


@query("""
WITH u AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id, value, ts FROM events)
SELECT count(*) AS events, CAST(sum(k) AS BIGINT) AS sections, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS chars,
       CAST(sum(k) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS tokens_reported, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last,
       (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT CASE WHEN event_type = 'view' THEN 'local' ELSE 'p' || (user_id % 3) END AS p FROM events)) AS providers FROM u""")
def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A8."""
    return A.usage_summary(_usage(spark, sf)).withColumn("last", F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss")).withColumn("providers", F.array_join("providers", ","))


@query("""
SELECT event_type AS model, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sections FROM events GROUP BY 1""")
def usage_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """A9, N1."""
    return A.usage_by_model(_usage(spark, sf)).orderBy("model")


@query("""
SELECT strftime(d.day, '%Y-%m-%d') AS day, CAST(count(*) FILTER (WHERE e.event_type = 'purchase') AS BIGINT) AS assessments,
       CAST(count(*) FILTER (WHERE e.event_type = 'view') AS BIGINT) AS embedding_events
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-25', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY 1""")
def activity_7d(spark: SparkSession, sf: str) -> DataFrame:
    """Seven days, the last of which has no events."""
    kind = F.col("event_type")
    found = A.daily_activity(table(spark, sf, "events"), "ts", "2024-01-31", {"assessments": kind == "purchase", "embedding_events": kind == "view"})
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd")).orderBy("day")


@query("""
SELECT event_type, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29 12:00:00') AS BIGINT) AS last_24h, count(*) AS total,
       strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last FROM events WHERE ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1""")
def last_24h(spark: SparkSession, sf: str) -> DataFrame:
    """`now` is given, here noon of 30 January."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    e = table(spark, sf, "events").where(F.col("ts") < now)
    return e.groupBy("event_type").agg(F.count(F.when(F.col("ts") >= now - F.expr("INTERVAL 24 HOURS"), 1)).alias("last_24h"), F.count(F.lit(1)).alias("total"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last"))


@query("""
SELECT user_id AS application_id, event_type AS step, props AS error, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS error_at
FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 5""")
def recent_failures(spark: SparkSession, sf: str) -> DataFrame:
    """A18, L2."""
    jobs = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("application_id"), F.col("event_type").alias("step"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("state"), F.col("props").alias("error"), F.col("ts").alias("error_at"))
    return A.recent_failures(jobs).withColumn("error_at", F.date_format("error_at", "yyyy-MM-dd'T'HH:mm:ss"))


@query("""
SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS jobs_failed,
       (SELECT count(*) FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0 AND d.lang = 'en') AS index_failed""")
def health_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A18."""
    docs, labels, events = tables(spark, sf, "documents", "labels", "events")
    records = docs.select("doc_id", "lang").join(labels, "doc_id").select(F.when(F.col("quality") == 0, "failed").otherwise("ready").alias("index_status"), (F.col("lang") == "en").alias("active"))
    return A.health(events.select(F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("state")), records)


@query("""
SELECT count(*) AS searched, CAST(count(*) FILTER (WHERE d.n_chars <= 200) AS BIGINT) AS unreadable,
       CAST(count(*) FILTER (WHERE l.quality IS NULL OR l.quality <> 1) AS BIGINT) AS unindexed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def coverage_counters(spark: SparkSession, sf: str) -> DataFrame:
    """A19."""
    docs, labels = tables(spark, sf, "documents", "labels")
    return A.coverage(docs.select("doc_id", "n_chars").join(labels, "doc_id", "left"), F.col("n_chars") > 200, F.col("quality") == 1)


@query("""
WITH a AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'review' WHEN l.quality = 1 THEN 'completed' ELSE 'failed' END AS status, CAST(d.n_chars % 101 AS DOUBLE) AS score
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['completed'] ELSE ['completed', 'review'] END AS statuses, CASE WHEN doc_id % 5 = 0 THEN CAST(n_chars % 101 AS DOUBLE) END AS want FROM documents WHERE doc_id % 3 = 0)
SELECT x.doc_id, a.status, a.score, coalesce(list_contains(x.statuses, a.status) AND (x.want IS NULL OR a.score = x.want), false) AS passed
FROM x LEFT JOIN a ON a.doc_id = x.doc_id""")
def eval_expected(spark: SparkSession, sf: str) -> DataFrame:
    """A20."""
    docs, labels = tables(spark, sf, "documents", "labels")
    score = (F.col("n_chars") % 101).cast("double")
    actual = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "review").when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"), score.alias("score"), F.lit(0).alias("errors"))
    wanted = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("completed"))).otherwise(F.array(F.lit("completed"), F.lit("review"))).alias("statuses"), F.when(F.col("doc_id") % 5 == 0, score).alias("score"))
    return A.evaluated(actual, wanted, "doc_id")


_CASES = """
WITH a AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'review' ELSE 'completed' END AS status, CASE WHEN d.doc_id % 17 <> 0 THEN n_chars END AS tokens FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT x.doc_id, x.source, a.status, a.tokens, coalesce(CASE WHEN x.doc_id % 2 = 0 THEN a.status = 'completed' ELSE a.status IN ('completed', 'review') END, false) AS passed FROM documents x LEFT JOIN a ON a.doc_id = x.doc_id WHERE x.doc_id % 3 = 0)"""


@query(_CASES + """
SELECT count(*) AS cases, CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS passed, CAST(count(status) AS BIGINT) AS found, bool_and(passed) AS all_passed, count(*) = count(status) AS complete,
       CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE status IS NOT NULL AND tokens IS NULL) = 0 AS tokens_reported FROM r""")
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all cases are there and passed, with their tokens."""
    docs, labels = tables(spark, sf, "documents", "labels")
    actual = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "review").otherwise("completed").alias("status"), F.lit(0.0).alias("score"), F.lit(0).alias("errors"), F.when(F.col("doc_id") % 17 != 0, F.col("n_chars")).alias("tokens"))
    wanted = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("completed"))).otherwise(F.array(F.lit("completed"), F.lit("review"))).alias("statuses"), F.lit(None).cast("double").alias("score"))
    return A.acceptance(A.evaluated(actual, wanted, "doc_id"), "tokens")


@query("""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents), c AS (SELECT doc_id, t, p % 12 * 9 - 9 AS conf FROM w WHERE trim(t) <> '')
SELECT doc_id, round(sum(conf * length(t)) / sum(length(t)), 6) AS confidence FROM c WHERE conf >= 0 GROUP BY 1""")
def weighted_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """The confidence of pages of recognised words, by their lengths; negative ones do not count."""
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("p", "text"))
    scored = words.withColumn("conf", (F.col("p") + 1) % 12 * 9 - 9)
    return A.weighted_confidence(scored, ["doc_id"]).select("doc_id", F.round("confidence", 6).alias("confidence"))


@query("""
SELECT p_name AS key, min(p_brand) AS value FROM part GROUP BY p_name, p_type HAVING count(DISTINCT p_brand) = 1""".replace("p_name AS key", "p_name || '/' || p_type AS key"))
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that mean one value only."""
    part = table(spark, sf, "part")
    return A.unique_groups(part, F.concat_ws("/", "p_name", "p_type"), F.col("p_brand"))


@query("""
SELECT l_orderkey, count(DISTINCT l_linenumber) = count(*) AS unique_lines, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def unique_check(spark: SparkSession, sf: str) -> DataFrame:
    """A10, A17."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.countDistinct("l_linenumber") == F.count(F.lit(1))).alias("unique_lines"), F.countDistinct("l_partkey").alias("parts"))


@query("""
SELECT doc_id, line_no, CAST(count(*) FILTER (WHERE h) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (
  SELECT doc_id, CAST(p - 1 AS INTEGER) AS line_no, length(line) <= 40 AND line <> '' AS h FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents))""")
def line_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Which segment each line lies in; here short lines begin one."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    short = F.when((F.length("line") <= 40) & (F.col("line") != ""), F.lit(1))
    return R.running_heading(lines.withColumn("h", short), ["doc_id"], "line_no", "h").select("doc_id", "line_no", "segment")


@query("""
SELECT user_id, max(event_id) + 1 AS next_revision FROM events GROUP BY 1""")
def next_revision(spark: SparkSession, sf: str) -> DataFrame:
    """M10, A4."""
    from sievework.operators.changes import with_next_revision

    return with_next_revision(table(spark, sf, "events"), "user_id", "event_id")


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(e, b), 6) AS similarity FROM e WHERE b IS NOT NULL""")
def adjacent_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector and the one before it."""
    from sievework.functions.vectors import cosine

    pairs = R.with_previous(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), ["label"], "vec_id", "embedding")
    return pairs.where("previous IS NOT NULL").select("vec_id", F.round(cosine(F.col("embedding"), F.col("previous")), 6).alias("similarity"))


@query("""
WITH r AS (SELECT doc_id AS id, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS role, doc_id % 2 AS v FROM documents WHERE lang <> 'fr' AND doc_id % 7 <> 0 AND doc_id % 5 <> 1),
a AS (SELECT doc_id AS id, doc_id % 3 % 2 AS v, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) + 100 + doc_id % 11 // 10 AS rubric, n_chars FROM documents)
SELECT r.id, r.role AS role_id, CAST(a.n_chars % 101 AS DOUBLE) AS score FROM r JOIN a ON a.id = r.id AND a.v = r.v AND a.rubric = r.role + 100 WHERE r.role % 4 <> 3 AND r.role % 9 <> 8""")
def assessments_that_count(spark: SparkSession, sf: str) -> DataFrame:
    """Of the record's version and its group's rubric; groups are open, records complete and no copies."""
    d, docs = F.col("doc_id"), table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    role = F.regexp_extract("source", r"\d+", 0).cast("int")
    records = docs.select(d.alias("id"), role.alias("role_id"), (d % 2).alias("version"), (F.col("lang") != "fr").alias("active"), F.when(d % 7 == 0, d).alias("duplicate_of"), F.when(d % 5 == 1, "review").otherwise("completed").alias("status"))
    groups = docs.select(role.alias("id")).distinct().select("id", (F.col("id") + 100).alias("rubric_id"), (F.col("id") % 4 != 3).alias("active"), (F.col("id") % 9 == 8).alias("paused"))
    done = docs.select(d.alias("application_id"), (d % 3 % 2).alias("version"), (role + 100 + F.floor(d % 11 / 10)).cast("int").alias("rubric_id"), (F.col("n_chars") % 101).cast("double").alias("score"), F.lit("").alias("body"), F.lit(None).cast("timestamp").alias("created"))
    return R.current_assessments(records, groups, done).select("id", "role_id", "score")
