"""Queries: filters, joins, sets, snapshots and changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import predicates as P
from sievework.operators import changes as C
from sievework.operators import joins as J
from sievework.operators import quality as Q
from sievework.plans.registry import query
from sievework.plans.session import table, tables, workspace


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'retry' END AS state,
       coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'none') AS priority
FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND (o_orderstatus <> 'F' OR o_totalprice > 300000) AND o_custkey IS NOT NULL AND o_orderstatus IN ('F', 'O', 'P')""")
def state_filter_case(spark: SparkSession, sf: str) -> DataFrame:
    """F1-F3, F6-F8."""
    o = table(spark, sf, "orders")
    kept = o.where(~F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & ((F.col("o_orderstatus") != "F") | (F.col("o_totalprice") > 300000)) & F.col("o_custkey").isNotNull() & F.col("o_orderstatus").isin("F", "O", "P"))
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("retry")
    return kept.select("o_orderkey", "o_custkey", state.alias("state"), P.filled(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")), "none").alias("priority"))


@query("""
SELECT doc_id, source FROM documents WHERE lower(source) NOT IN ('src0', 'src7') AND source NOT LIKE 'src1%'""")
def exclude_reserved(spark: SparkSession, sf: str) -> DataFrame:
    """F16, F4."""
    kept = P.is_source(F.col("source"), generated=F.col("source").startswith("src1"), reserved=["SRC0", "Src7"])
    return table(spark, sf, "documents").select("doc_id", "source").where(kept)


@query("""
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build') AND c_acctbal >= 0 AND c_acctbal <= 5000""")
def ui_directory_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F12, L7."""
    found = P.directory_match(" BUILD ", "c_name", "c_mktsegment", score=F.col("c_acctbal"), low=0, high=5000)
    return table(spark, sf, "customer").where(found).select("c_custkey", "c_name", "c_mktsegment").orderBy("c_name", "c_custkey")


@query("""
SELECT d.doc_id FROM documents d WHERE EXISTS (
  SELECT 1 FROM (SELECT doc_id, sha256(text) AS h, doc_id % 2 = 0 AS active, CAST(doc_id AS DOUBLE) AS expires FROM documents WHERE doc_id % 7 = 0) b
  WHERE b.h = sha256(d.text) AND b.active AND b.expires > 100)""")
def hold_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """documents whose contents an active hold names."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    holds = docs.where("doc_id % 7 = 0").select(F.lit("document").alias("kind"), "h", (F.col("doc_id") % 2 == 0).alias("active"), F.col("doc_id").cast("double").alias("expires"))
    return J.only_of(docs, holds.where(P.hold_active(F.col("kind"), "document", F.col("active"), F.col("expires"), F.lit(100.0))), ["h"]).select("doc_id")


@query("""
SELECT p_partkey, CASE WHEN p_size < 25 THEN 'Incompatible resume: rubric score ' || p_size || '/100 is below the 25/100 review threshold. HR review required.' END AS reason FROM part""")
def low_score_flag(spark: SparkSession, sf: str) -> DataFrame:
    """equality passes."""
    return table(spark, sf, "part").select("p_partkey", P.low_score_reason(F.col("p_size").cast("double"), 25).alias("reason"))


@query("""
SELECT o_orderkey, least(3600.0::DOUBLE, 15.0::DOUBLE * pow(2.0, o_orderkey % 12)) AS wait, CASE WHEN o_orderkey % 12 >= 5 THEN 'failed' ELSE 'retry' END AS state,
       CAST(o_custkey + (floor(greatest(0, o_orderkey - o_custkey) / 300.0) + 1) * 300 AS DOUBLE) AS tick, o_orderkey - o_custkey > 650 AS offline, o_orderkey - o_custkey > 600 AS missed FROM orders""")
def retry_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """V8, V9, R8."""
    n, now, at = F.col("o_orderkey") % 12, F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", P.backoff_seconds(n).alias("wait"), P.retry_state(n).alias("state"), P.following_tick(at.cast("double"), now.cast("double"), 300).alias("tick"), P.is_offline(at, now).alias("offline"), P.missed_scan(at, now, 300).alias("missed"))


@query("""
SELECT c.c_mktsegment, o.o_orderstatus, count(*) AS n, round(sum(l.l_extendedprice), 2) AS total
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = o.o_orderstatus
WHERE c.c_acctbal > 0 GROUP BY 1, 2""")
def three_way_current(spark: SparkSession, sf: str) -> DataFrame:
    """An inner join of three tables with a condition between columns."""
    customer, orders, lineitem = tables(spark, sf, "customer", "orders", "lineitem")
    rows = customer.where("c_acctbal > 0").join(orders, F.col("c_custkey") == F.col("o_custkey")).join(lineitem, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") == F.col("o_orderstatus")))
    return rows.groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


_RECORDS = """
r AS (SELECT doc_id AS id, doc_id % 10 <> 3 AS active, CASE WHEN doc_id % 4 = 0 AND doc_id > 10 THEN doc_id - doc_id % 10 + 3 WHEN doc_id % 4 = 1 AND doc_id > 10 THEN doc_id // 10 * 8 END AS duplicate_of,
      CASE WHEN doc_id % 4 = 2 THEN 'completed' ELSE 'queued' END AS status FROM documents)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    copy = F.when((d % 4 == 0) & (d > 10), d - d % 10 + 3).when((d % 4 == 1) & (d > 10), F.floor(d / 10) * 8)
    return table(spark, sf, "documents").select(d.alias("id"), (d % 10 != 3).alias("active"), copy.cast("long").alias("duplicate_of"), F.when(d % 4 == 2, "completed").otherwise("queued").alias("status"))


@query(f"""
WITH {_RECORDS}
SELECT a.id, a.duplicate_of FROM r a JOIN r b ON a.duplicate_of = b.id WHERE a.active AND (NOT b.active OR b.duplicate_of IS NOT NULL)""")
def self_join_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """J3."""
    return C.orphans(_records(spark, sf)).select("id", "duplicate_of")


@query(f"""
WITH {_RECORDS}, o AS (SELECT a.id FROM r a JOIN r b ON a.duplicate_of = b.id WHERE a.active AND (NOT b.active OR b.duplicate_of IS NOT NULL))
SELECT r.id, CASE WHEN o.id IS NOT NULL THEN 'queued' ELSE r.status END AS status, CASE WHEN o.id IS NULL THEN r.duplicate_of END AS duplicate_of FROM r LEFT JOIN o ON o.id = r.id""")
def promote_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """M8."""
    return C.promoted(_records(spark, sf)).select("id", "status", "duplicate_of")


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def semi_in_subquery(spark: SparkSession, sf: str) -> DataFrame:
    """J4, F9."""
    customer, orders = tables(spark, sf, "customer", "orders")
    return J.only_of(customer.select("c_custkey", "c_name"), orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""
SELECT DISTINCT d.source FROM documents d WHERE d.n_chars > 20000 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""")
def anti_not_exists(spark: SparkSession, sf: str) -> DataFrame:
    """J5, A10."""
    docs, labels = tables(spark, sf, "documents", "labels")
    return J.missing(docs.where("n_chars > 20000").select("doc_id", "source"), labels.where("toxic = 1"), ["doc_id"]).select("source").distinct()


@query("""
SELECT u.id FROM (SELECT DISTINCT user_id AS id FROM events) u WHERE NOT EXISTS (
  SELECT 1 FROM events e WHERE e.user_id = u.id AND e.event_id > 9000 * (SELECT count(*) FROM events) / 10000 AND e.event_type NOT IN ('purchase', 'error', 'signup'))""")
def terminal_records(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with jobs, none of which is to run."""
    events = table(spark, sf, "events")
    limit = events.agg((F.lit(9000) * F.count(F.lit(1)) / 10000).alias("limit"))
    state = F.when(F.col("event_id") <= F.col("limit"), "done").otherwise(F.when(F.col("event_type").isin("purchase", "error", "signup"), "done").otherwise("queued"))
    jobs = events.join(limit).select(F.col("user_id").alias("application_id"), state.alias("state"))
    return C.terminal_records(events.select(F.col("user_id").alias("id")).distinct(), jobs)


@query("""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def left_lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    docs, labels = tables(spark, sf, "documents", "labels")
    return J.with_default(docs.select("doc_id"), labels, "doc_id", "quality", -1)


@query("""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def quote_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """By the words of a quote, then checked."""
    docs, benchmark = tables(spark, sf, "documents", "benchmark")
    return J.quotes_in(docs, benchmark, "doc_id", "text", "item_id", "text")


_SNAPSHOTS = """
k AS (SELECT o_orderkey AS id, o_orderstatus AS version, o_orderpriority AS name FROM orders WHERE o_orderkey % 11 <> 0),
n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS version, CASE WHEN o_orderkey % 7 = 0 THEN 'renamed' ELSE o_orderpriority END AS name FROM orders WHERE o_orderkey % 13 <> 0)"""


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("version"), F.col("o_orderpriority").alias("name"))
    moved = C.updated_where(C.updated_where(o, F.col("id") % 5 == 0, version=F.lit("X")), F.col("id") % 7 == 0, name=F.lit("renamed"))
    return o.where("id % 11 <> 0"), moved.where("id % 13 <> 0")


@query(f"""
WITH {_SNAPSHOTS}
SELECT coalesce(n.id, k.id) AS id, CASE WHEN k.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'removed' WHEN k.version IS DISTINCT FROM n.version THEN 'changed'
       WHEN k.name IS DISTINCT FROM n.name THEN 'renamed' ELSE 'unchanged' END AS change FROM n FULL JOIN k ON n.id = k.id""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """R2, J9, U3."""
    return C.snapshot_diff(*_snapshots(spark, sf), "id", "version", "name")


@query(f"""
WITH {_SNAPSHOTS}, a AS (SELECT version, name, count(*) AS n FROM k GROUP BY 1, 2), b AS (SELECT version, name, count(*) AS n FROM n GROUP BY 1, 2)
SELECT coalesce(a.version, b.version) AS version, coalesce(a.name, b.name) AS name, CAST(coalesce(a.n, 0) AS BIGINT) AS in_a, CAST(coalesce(b.n, 0) AS BIGINT) AS in_b
FROM a FULL JOIN b ON a.version = b.version AND a.name = b.name WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_compare(spark: SparkSession, sf: str) -> DataFrame:
    """J11."""
    a, b = _snapshots(spark, sf)
    return Q.multiset_difference(a.select("version", "name"), b.select("version", "name"))


@query(f"""
WITH {_SNAPSHOTS}
SELECT coalesce(n.id, k.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.version ELSE k.version END AS version, CASE WHEN n.id IS NOT NULL AND k.id IS NOT NULL THEN k.name || '>' || n.name WHEN n.id IS NOT NULL THEN n.name ELSE k.name END AS name
FROM n FULL JOIN k ON n.id = k.id""")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """M1."""
    old, new = _snapshots(spark, sf)
    return C.upserted(old, new, ["id"], {"name": F.concat("t.name", F.lit(">"), "c.name")})


@query(f"""
WITH {_SNAPSHOTS} SELECT * FROM k UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM k)""")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """M2."""
    return C.inserted_if_absent(*_snapshots(spark, sf), ["id"])


@query(f"""
WITH {_SNAPSHOTS} SELECT * FROM n UNION ALL SELECT * FROM k WHERE id NOT IN (SELECT id FROM n)""")
def insert_replace(spark: SparkSession, sf: str) -> DataFrame:
    """M3."""
    return C.replaced(*_snapshots(spark, sf), ["id"])


@query("""
WITH d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)
SELECT 'lineitem' AS name, count(*) AS deleted FROM lineitem WHERE l_orderkey IN (SELECT id FROM d)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey IN (SELECT id FROM d)""")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """M5: what each table loses."""
    orders, lineitem = tables(spark, sf, "orders", "lineitem")
    gone = orders.where("o_orderstatus = 'F' AND o_totalprice > 400000").select(F.col("o_orderkey").alias("id"))
    return C.cascaded_delete({"lineitem": lineitem, "orders": orders}, gone, {"lineitem": "l_orderkey", "orders": "o_orderkey"})[1]


@query("""
WITH d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM d)""")
def cascade_kept(spark: SparkSession, sf: str) -> DataFrame:
    """M5: what stays."""
    orders, lineitem = tables(spark, sf, "orders", "lineitem")
    gone = orders.where("o_orderstatus = 'F' AND o_totalprice > 400000").select(F.col("o_orderkey").alias("id"))
    return C.cascaded_delete({"lineitem": lineitem}, gone, {"lineitem": "l_orderkey"})[0]["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 'queued' ELSE o_orderstatus END AS state,
       CASE WHEN o_orderstatus = 'P' AND o_totalprice < 100000 THEN 0 ELSE CAST(o_custkey AS BIGINT) END AS attempts FROM orders""")
def guarded_update(spark: SparkSession, sf: str) -> DataFrame:
    """M4, M11."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("attempts"), "o_totalprice")
    return C.updated_where(o.withColumn("_test", (F.col("state") == "P") & (F.col("o_totalprice") < 100000)), F.col("_test"), state=F.lit("queued"), attempts=F.lit(0).cast("long")).select("o_orderkey", "state", "attempts")


@query("""
WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'v2' ELSE 'v1' END AS version FROM orders WHERE o_orderkey % 2 = 0)
SELECT o.o_orderkey AS id, CASE WHEN c.version = 'v2' THEN 'v2' ELSE 'v1' END AS version, CASE WHEN c.version = 'v2' THEN 'queued' ELSE o.o_orderstatus END AS status,
       CASE WHEN c.version = 'v2' THEN 0 ELSE CAST((SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS BIGINT) END AS chunks
FROM orders o LEFT JOIN c ON c.id = o.o_orderkey""")
def invalidate_changed(spark: SparkSession, sf: str) -> DataFrame:
    """M6: records with a new version start again and lose what hangs on them."""
    orders, lineitem = tables(spark, sf, "orders", "lineitem")
    records = orders.select(F.col("o_orderkey").alias("id"), F.lit("v1").alias("version"), F.col("o_orderstatus").alias("status"), F.lit("ready").alias("index_status"))
    changed = records.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, "v2").otherwise("v1").alias("version"))
    fresh, chunks = C.invalidated(records, lineitem.select(F.col("l_orderkey").alias("application_id")), changed)
    counts = chunks.groupBy("application_id").agg(F.count(F.lit(1)).alias("chunks"))
    return fresh.join(counts, F.col("id") == F.col("application_id"), "left").select("id", "version", "status", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


@query("""
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'failed' WHEN label = 4 THEN 'ready' ELSE 'pending' END AS index_status FROM embeddings""")
def reindex_other_models(spark: SparkSession, sf: str) -> DataFrame:
    """What another model indexed waits again; what failed stays so."""
    e = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, "failed").otherwise("ready").alias("index_status"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("index_model"))
    return C.reindexed(e, "m4").select("vec_id", "index_status")


def _low(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as records, each assessed under two rubrics, of which its role has one in force."""
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    records = part.select(k.alias("id"), (k % 3).cast("int").alias("role_id"), F.lit("v").alias("version"), (k % 5 != 0).alias("active"), F.when(k % 2 == 0, "completed").otherwise("queued").alias("status"), F.lit(None).cast("string").alias("review_reason"))
    roles = records.select("role_id").distinct().select(F.col("role_id").alias("id"), F.when(F.col("role_id") == 0, 1).otherwise(2).alias("rubric_id"))
    size = F.col("p_size").cast("double")
    scored = part.select(k.alias("application_id"), F.lit("v").alias("version"), F.explode(F.array(F.struct(F.lit(1).alias("r"), size.alias("s")), F.struct(F.lit(2).alias("r"), (F.lit(50.0) - size).alias("s")))).alias("e")).select("application_id", "version", F.col("e.r").alias("rubric_id"), F.col("e.s").alias("score"))
    old = scored.where("application_id % 4 = 0").select("application_id", F.lit("u").alias("version"), "rubric_id", F.lit(0.0).alias("score"))  # of a version that is gone
    jobs = part.select(k.alias("application_id"), F.when(k % 7 == 0, "superseded").otherwise("done").alias("state"), F.lit("done").alias("step"), F.lit(2).alias("attempts"))
    return C.low_scores_to_review(records, roles, scored.unionByName(old), jobs, 25)


_LOW = """
WITH s AS (SELECT p_partkey, p_partkey % 2 = 0 AS completed, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 50 - p_size END AS score, p_partkey % 5 <> 0 AS active FROM part),
l AS (SELECT *, completed AND active AND score < 25 AS low FROM s)"""


@query(_LOW + """
SELECT p_partkey, CASE WHEN low THEN 'review' WHEN completed THEN 'completed' ELSE 'queued' END AS status,
       CASE WHEN low THEN 'Incompatible resume: rubric score ' || score || '/100 is below the 25/100 review threshold. HR review required.' END AS review_reason FROM l""")
def low_scores_to_review(spark: SparkSession, sf: str) -> DataFrame:
    """The score under the rubric in force decides."""
    return _low(spark, sf)[0].select(F.col("id").alias("p_partkey"), "status", "review_reason")


@query(_LOW + """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'superseded' WHEN low THEN 'queued' ELSE 'done' END AS state, CASE WHEN low AND p_partkey % 7 <> 0 THEN 'report' ELSE 'done' END AS step,
       CASE WHEN low AND p_partkey % 7 <> 0 THEN 0 ELSE 2 END AS attempts FROM l""")
def low_scores_reported(spark: SparkSession, sf: str) -> DataFrame:
    """M9: their jobs go back to the report."""
    return _low(spark, sf)[1].select(F.col("application_id").alias("p_partkey"), "state", "step", "attempts")


@query("""
SELECT event_id, user_id FROM events WHERE event_type IN ('signup', 'view') AND value <= 20 ORDER BY value, event_id LIMIT 10""")
def due_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """R9, L1, L3."""
    jobs = table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "retry").otherwise("done").alias("state"), F.col("value").alias("next_try"))
    return C.due(jobs, F.lit(20.0), 10).select(F.col("id").alias("event_id"), "user_id")


@query("""
SELECT event_id, CASE WHEN event_id % 7 + 1 >= 5 THEN 'failed' ELSE 'retry' END AS state, event_id % 7 + 1 AS attempts, 1000 + least(3600.0::DOUBLE, 15 * pow(2.0, event_id % 7 + 1)) AS next_try
FROM events WHERE event_type = 'error'""")
def failed_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """R5."""
    jobs = table(spark, sf, "events").where("event_type = 'error'").select("event_id", (F.col("event_id") % 7).alias("attempts"))
    return C.failed_attempt(jobs, F.lit(1000.0)).select("event_id", "state", "attempts", "next_try")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus = l.l_linestatus AND o.o_custkey % 3 = l.l_linenumber % 3
WHERE o.o_orderpriority <> '5-LOW'""")
def fenced_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results made for a version or generation that is not current are left out."""
    orders, lineitem = tables(spark, sf, "orders", "lineitem")
    jobs = orders.select(F.col("o_orderkey").alias("application_id"), F.col("o_orderstatus").alias("version"), F.lit(1).alias("rubric_id"), (F.col("o_custkey") % 3).cast("long").alias("generation"), F.when(F.col("o_orderpriority") == "5-LOW", "superseded").otherwise("queued").alias("state"))
    results = lineitem.select(F.col("l_orderkey").alias("application_id"), F.col("l_linestatus").alias("version"), F.lit(1).alias("rubric_id"), (F.col("l_linenumber") % 3).cast("long").alias("generation"), "l_linenumber", "l_partkey")
    return C.fenced(results, jobs).select(F.col("application_id").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("""
SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def union_of_sets(spark: SparkSession, sf: str) -> DataFrame:
    """U1, U2."""
    customer, orders = tables(spark, sf, "customer", "orders")
    return orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).unionByName(customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))).distinct()


@query("""
WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(s, lambda x: x % 2 = 0), ',') AS even, array_to_string(list_filter(s, lambda x: x % 2 <> 0), ',') AS odd,
       len(list_filter(s, lambda x: x % 2 <> 0)) = 0 AS is_subset, len(list_filter(s, lambda x: x IN (1, 2, 3))) > 0 AS overlaps FROM a""")
def array_sets(spark: SparkSession, sf: str) -> DataFrame:
    """U3-U6, as arrays."""
    from sievework.functions.nested import is_subset

    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"), F.array_sort(F.collect_set(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")))).alias("e"))
    return a.select("l_orderkey", F.array_join(F.array_intersect("s", "e"), ",").alias("even"), F.array_join(F.array_except("s", "e"), ",").alias("odd"), is_subset(F.col("s"), F.col("e")).alias("is_subset"), F.arrays_overlap("s", F.array(*[F.lit(x).cast("long") for x in (1, 2, 3)])).alias("overlaps"))


@query("""
SELECT user_id, event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS BIGINT) AS in_span FROM events""")
def request_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of a key within an hour."""
    from sievework.streaming.jobs import request_rate as rate

    events = table(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return rate(events, "user_id", F.col("s"), "event_id", 3600).drop("s")


@query("""
SELECT count(*) AS used, CAST(greatest(0, 200 - count(*)) AS BIGINT) AS remaining FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' AND event_type = 'click'""")
def request_budget(spark: SparkSession, sf: str) -> DataFrame:
    """R10."""
    from sievework.streaming.jobs import budget_left

    return budget_left(table(spark, sf, "events").where("event_type = 'click'"), "ts", "2024-01-15", 200)


@query("""
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS assessments, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS views
FROM events GROUP BY 1""")
def daily_window_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over the events' file, run to its end."""
    from sievework.streaming import jobs

    events = table(spark, sf, "events")
    stream = jobs.watched(spark, f"{sf}/events.parquet*", events.schema)
    kind = F.col("event_type")
    name = f"daily_{uuid.uuid4().hex}"
    jobs.run_to_end(jobs.daily_counts(stream, "ts", {"assessments": kind == "purchase", "views": kind == "view"}), name, workspace(spark, name))
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "assessments", "views")
