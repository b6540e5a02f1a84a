"""Queries: text, nested rows, vectors, passages, contacts, questions and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import nested as N
from sievework.functions import text as T
from sievework.functions import vectors as X
from sievework.functions import vocabulary as V
from sievework.operators import aggregates as A
from sievework.operators import chunking as K
from sievework.operators import joins as J
from sievework.operators import reports as REP
from sievework.operators import search as S
from sievework.operators.contacts import with_contacts
from sievework.operators.nearest import nearest_for_each
from sievework.operators.ranking import ranked
from sievework.operators.search_index import SearchIndex
from sievework.plans.registry import query
from sievework.plans.session import table, tables, workspace


@query(r"""
SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(m, lambda x: x)), 'ASC'), lambda x: x), ' ') AS emails, CAST(len(list_distinct(m)) AS INTEGER) AS n FROM (
  SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}') AS m FROM documents) WHERE len(m) > 0""")
def emails_extract(spark: SparkSession, sf: str) -> DataFrame:
    """T1, U6; sorted here, as DuckDB's distinct keeps no order."""
    found = table(spark, sf, "documents").select("doc_id", T.emails("text", None).alias("e")).where(F.size("e") > 0)
    return found.select("doc_id", F.array_join(F.array_sort("e"), " ").alias("emails"), F.size("e").alias("n"))


def _term_sql(*terms: str, op: str) -> str:
    return f" {op} ".join(rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_]){t}([^\p{{L}}\p{{N}}_]|$)')" for t in terms)


@query(f"SELECT doc_id FROM documents WHERE {_term_sql('then', 'edan', op='AND')}")
def token_match_and(spark: SparkSession, sf: str) -> DataFrame:
    """Whole tokens, all of them."""
    return table(spark, sf, "documents").where(T.has_term("text", "then") & T.has_term("text", "EDAN")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_term_sql('über', 'être', 'él', op='OR')}")
def token_match_or(spark: SparkSession, sf: str) -> DataFrame:
    """Whole tokens, any of them, with letters of other alphabets than ASCII."""
    return table(spark, sf, "documents").where(T.has_term("text", "über") | T.has_term("text", "être") | T.has_term("text", "él")).select("doc_id")


_STOPS = ", ".join(f"'{w}'" for w in sorted({*V.QUESTION_STOP_WORDS, "the", "le"}))


@query(rf"""
SELECT conv_id, turn, array_to_string(CASE WHEN regexp_matches(text, '"[^"]+"') THEN regexp_extract_all(lower(text), '"([^"]+)"', 1)[1:12] ELSE list_filter(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_+#.]+'), lambda w: regexp_replace(w, '\.+$', '')),
       lambda w: NOT list_contains([{_STOPS}], w) AND NOT regexp_matches(w, '^[0-9]+$') AND length(w) > 1)[1:12] END, ' ') AS terms FROM conversations WHERE role = 'user'""")
def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted phrases or, without any, telling words."""
    asked = table(spark, sf, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(T.terms_of("text", ["the", "le"]), " ").alias("terms"))


_TITLES = ", ".join(f"'{t}'" for t in V.SECTION_TITLES)


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
m AS (SELECT doc_id, p, CASE p % 4 WHEN 0 THEN ' Work Experience: ' WHEN 1 THEN 'KEY SKILLS' WHEN 2 THEN 'project' ELSE line END AS line FROM l),
c AS (SELECT doc_id, p, trim(regexp_replace(trim(line), ':+$', '')) AS core FROM m)
SELECT doc_id, CAST(p - 1 AS INTEGER) AS line_no, core AS heading FROM c WHERE core <> '' AND length(core) <= 60 AND (lower(core) IN ({_TITLES})
  OR (core = upper(core) AND regexp_matches(core, '[A-Za-z]') AND len(regexp_extract_all(lower(core), '[a-z]+')) BETWEEN 1 AND 5 AND list_has_any(regexp_extract_all(lower(core), '[a-z]+'), [{_TITLES}])))""")
def heading_flags(spark: SparkSession, sf: str) -> DataFrame:
    """T11, over lines of documents, some of them replaced by titles and near-titles."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    k = F.col("line_no") % 4
    mixed = lines.withColumn("line", F.when(k == 3, " Work Experience: ").when(k == 0, "KEY SKILLS").when(k == 1, "project").otherwise(F.col("line")))
    return mixed.select("doc_id", "line_no", T.heading_of("line").alias("heading")).where("heading IS NOT NULL")


@query(r"""
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '=' || text WHEN 1 THEN chr(9) || text WHEN 2 THEN '  -' || text WHEN 3 THEN chr(7) || '@' || text ELSE text END AS t FROM documents),
c AS (SELECT doc_id, left(regexp_replace(t, '[\x00-\x08\x0B-\x1F]', '', 'g'), 32000) AS t FROM d)
SELECT doc_id, sha256(CASE WHEN regexp_matches(t, '^\s*[=+\-@]') OR regexp_matches(t, '^[\t\r\n]') THEN '''' || t ELSE t END) AS cell FROM c""")
def csv_safe(spark: SparkSession, sf: str) -> DataFrame:
    """T12, over texts that begin like formulas."""
    k, t = F.col("doc_id") % 5, F.col("text")
    put = F.when(k == 0, F.concat(F.lit("="), t)).when(k == 1, F.concat(F.lit("\t"), t)).when(k == 2, F.concat(F.lit("  -"), t)).when(k == 3, F.concat(F.lit("\x07@"), t)).otherwise(t)
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.sheet_safe(put), 256).alias("cell"))


@query("""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS at,
       'https://drive.google.com/file/d/' || user_id || '/view' AS link FROM events""")
def iso_utc(spark: SparkSession, sf: str) -> DataFrame:
    """T13, T14."""
    at = F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", T.iso_utc(at).alias("at"), T.source_link(F.col("user_id").cast("string")).alias("link"))


@query(r"""
SELECT doc_id, CAST((length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) + 2) // 3 + 2 * length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS BIGINT) AS tokens,
       (length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) + 2) // 3 + 2 * length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) <= 4096 AS fits FROM documents""")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    """T15."""
    n = T.token_estimate("text")
    return table(spark, sf, "documents").select("doc_id", n.alias("tokens"), (n <= 4096).alias("fits"))


@query("""
SELECT doc_id, sha256(text) AS hash, CASE WHEN doc_id % 3 = 0 THEN md5(text) WHEN doc_id % 3 = 1 THEN source ELSE CAST(n_chars AS VARCHAR) END AS version FROM documents""")
def sha_version(spark: SparkSession, sf: str) -> DataFrame:
    """T17."""
    k = F.col("doc_id") % 3
    version = T.content_version(F.when(k == 0, F.md5("text")).otherwise(""), F.when(k == 1, F.col("source")), F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), version.alias("version"))


@query("""
SELECT c_custkey, upper(left(n, 1)) || upper(left(split_part(n, ' ', 2), 1)) AS initials, regexp_full_match(lower(c_mktsegment), '[a-z0-9_]{1,40}') AS is_identifier,
       lower(regexp_extract(n || '.Pdf', '(\\.[^./]+)$', 1)) IN ('.pdf', '.docx', '.txt') AS readable
FROM (SELECT c_custkey, c_mktsegment, lower(replace(c_name, '#', ' ')) AS n FROM customer)""".replace("\\\\", "\\"))
def name_labels(spark: SparkSession, sf: str) -> DataFrame:
    """T19, T20, T22."""
    n = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")))
    return table(spark, sf, "customer").select("c_custkey", T.initials(n).alias("initials"), T.is_identifier(F.lower("c_mktsegment")).alias("is_identifier"), T.is_readable_name(F.concat(n, F.lit(".Pdf"))).alias("readable"))


@query("""
WITH p AS (SELECT doc_id, text, CAST(ceil(length(text) / 900.0) AS INTEGER) AS n FROM documents WHERE length(text) <= 13500),
q AS (SELECT doc_id, text, n, unnest(range(1, n + 1)) AS part FROM p)
SELECT doc_id, CAST(part AS INTEGER) AS part, sha256(substr(text, (part - 1) * 900 + 1, 900)) AS hash, round(100.0 / n, 6)::DOUBLE AS weight FROM q""")
def equal_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of more than 15 parts have none."""
    parts = table(spark, sf, "documents").select("doc_id", F.explode(T.equal_parts("text")).alias("p"))
    return parts.select("doc_id", "p.part", F.sha2("p.text", 256).alias("hash"), F.round("p.weight", 6).alias("weight"))


@query("""
SELECT l_orderkey, coalesce(string_agg(CASE WHEN l_returnflag <> 'R' THEN 'part ' || l_partkey END, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS matched,
       coalesce(string_agg(CASE WHEN l_returnflag <> 'A' THEN l_partkey || ': ' || l_linestatus END, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS missing FROM lineitem GROUP BY 1""")
def join_nested_text(spark: SparkSession, sf: str) -> DataFrame:
    """T18, N4."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))).alias("f"))
    f = F.col("f")
    return rows.select("l_orderkey", N.joined(f, lambda x: F.concat(F.lit("part "), x.l_partkey.cast("string")), lambda x: x.l_returnflag != "R").alias("matched"), N.joined(f, lambda x: F.concat(x.l_partkey.cast("string"), F.lit(": "), x.l_linestatus), lambda x: x.l_returnflag != "A").alias("missing"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS high,
       '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS body FROM events""")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """N1, N2."""
    k = N.parsed(F.col("props"), "struct<k:bigint>")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), (k > 50).alias("high"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("body"))


@query("""
WITH f AS (SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40)
SELECT o_orderkey AS record_id, coalesce(CAST(l_partkey AS VARCHAR), '') AS quote,
       'c' || row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS citation_id FROM f""")
def explode_outer_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """A record without evidence has one blank row."""
    orders, lineitem = tables(spark, sf, "orders", "lineitem")
    cited = lineitem.where("l_quantity > 40").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("e"))
    rows = orders.select("o_orderkey").join(cited, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.posexplode_outer("e").alias("i", "c"))
    return rows.select(F.col("o_orderkey").alias("record_id"), F.coalesce(F.col("c.l_partkey").cast("string"), F.lit("")).alias("quote"), F.concat(F.lit("c"), (F.coalesce("i", F.lit(0)) + 1).cast("string")).alias("citation_id"))


@query("""
WITH c AS (SELECT l_orderkey, l_linestatus, list(DISTINCT l_suppkey) AS ids FROM lineitem GROUP BY 1, 2),
k AS (SELECT l_orderkey, len(list_filter(ids, lambda x: x % 5 = 0)) = 0 AS ok FROM c)
SELECT l_orderkey, CAST(count(*) FILTER (WHERE ok) AS INTEGER) AS kept, CAST(count(*) FILTER (WHERE NOT ok) AS INTEGER) AS dropped FROM k GROUP BY 1""")
def grounded_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that cite suppliers; those divisible by five were not given."""
    claims = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.collect_list("l_suppkey").alias("ids"))
    rows = claims.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linestatus").alias("text"), F.col("ids").alias("citation_ids"))).alias("claims"))
    known = F.filter(F.flatten(F.col("claims.citation_ids")), lambda x: x % 5 != 0)
    return rows.select("l_orderkey", N.grounded_claims(F.col("claims"), known).alias("g")).select("l_orderkey", F.size("g.kept").alias("kept"), F.col("g.dropped").alias("dropped"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_orderkey % 7 = 0 THEN 'C-' || l_linenumber WHEN l_orderkey % 3 = 0 THEN 'c' || (l_linenumber % 2) ELSE 'c' || l_linenumber END AS id,
  CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_quantity AS DOUBLE) * 100 / sum(l_quantity) OVER (PARTITION BY l_orderkey) ELSE CAST(l_quantity AS DOUBLE) * 3 END AS w FROM lineitem),
o AS (SELECT l_orderkey, count(*) AS n, bool_and(regexp_full_match(id, '[a-z0-9_]{1,40}')) AS named, count(DISTINCT id) = count(*) AS once, bool_and(w > 0 AND w <= 100) AS weighed, abs(sum(w) - 100) <= 1e-5 AS whole FROM l GROUP BY 1)
SELECT l_orderkey, concat_ws('; ', CASE WHEN n NOT BETWEEN 1 AND 15 THEN '1 to 15 criteria' END, CASE WHEN NOT named THEN 'identifier' END, CASE WHEN NOT once THEN 'identifiers repeat' END,
  CASE WHEN NOT weighed THEN 'weight' END, CASE WHEN NOT whole THEN 'weights do not add up to 100' END) AS errors FROM o""")
def rubric_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rubrics, their lines as criteria; some have bad or repeated identifiers, or weights that are off."""
    line, key, q = F.col("l_linenumber").cast("string"), F.col("l_orderkey"), F.col("l_quantity").cast("double")
    ident = F.when(key % 7 == 0, F.concat(F.lit("C-"), line)).when(key % 3 == 0, F.concat(F.lit("c"), (F.col("l_linenumber") % 2).cast("string"))).otherwise(F.concat(F.lit("c"), line))
    lines = table(spark, sf, "lineitem").select(key, ident.alias("id"), q.alias("q"))
    rubrics = lines.groupBy("l_orderkey").agg(F.sum("q").alias("t"), F.collect_list(F.struct("id", F.lit("").alias("description"), F.col("q").alias("weight"))).alias("c"))
    weighed = F.transform("c", lambda x: F.struct(x.id.alias("id"), x.description.alias("description"), F.when(key % 2 == 0, x.weight * 100 / F.col("t")).otherwise(x.weight * 3).alias("weight")))
    return rubrics.select("l_orderkey", F.array_join(N.rubric_errors(weighed), "; ").alias("errors"))


@query("""
SELECT l_orderkey, list_filter(list_sort(list({n: l_linenumber, p: l_partkey, s: l_suppkey, q: l_quantity})), lambda x: x.q > 30)[1].p AS part FROM lineitem GROUP BY 1""")
def first_in_array(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of each order with a large quantity, or null."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("lines"))
    return rows.select("l_orderkey", N.first_of(F.col("lines"), lambda x: x.l_quantity > 30)["l_partkey"].alias("part"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}', '', 'g'), '(?:\B\+|\b)\d[\d ()/.\-]{6,}\d\b', '', 'g')) AS hash FROM documents""")
def contacts_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without addresses and telephone numbers."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.without_contacts(F.col("text")), 256).alias("hash"))


@query("""
WITH n AS (SELECT count(*) AS n FROM benchmark), s AS (SELECT d.doc_id, b.item_id, b.text AS quote, d.text FROM documents d, n JOIN benchmark b ON contains(d.text, b.text) OR b.item_id = d.doc_id % n.n)
SELECT doc_id, item_id, CASE WHEN (doc_id + item_id) % 3 = 0 THEN 'c1: positive match needs evidence' WHEN contains(text, quote) THEN '' ELSE 'c1: citation is not in the inspected source section' END AS errors FROM s""")
def evidence_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with every benchmark item that it quotes, and one more; a third of the findings lack their quote."""
    docs, benchmark = tables(spark, sf, "documents", "benchmark")
    quoted = J.quotes_in(docs, benchmark, "doc_id", "text", "item_id", "text")
    other = docs.select("doc_id", (F.col("doc_id") % benchmark.count()).alias("item_id"))
    pairs = quoted.union(other).distinct()
    rows = pairs.join(docs.select("doc_id", "text"), "doc_id").join(benchmark.select("item_id", F.col("text").alias("quote")), "item_id")
    cited = F.array(F.struct(F.lit("p1-0").alias("section_id"), F.col("quote")))
    finding = F.struct(F.lit("c1").alias("criterion_id"), F.lit("partial").alias("level"), F.when((F.col("doc_id") + F.col("item_id")) % 3 == 0, F.slice(cited, 1, 0)).otherwise(cited).alias("evidence"))
    every = F.array(F.lit("p1-0"))
    return rows.select("doc_id", "item_id", F.array_join(N.evidence_errors(F.array(finding), F.array(F.lit("c1")), F.create_map(F.lit("p1-0"), F.col("text")), every, every), "; ").alias("errors"))


@query("""
WITH w AS (SELECT doc_id, text, unnest(range(0, CAST(length(text) AS BIGINT), 1600)) AS s FROM documents)
SELECT doc_id, 'p1-' || s AS chunk_id, CAST(s AS INTEGER) AS "start", sha256(substr(text, s + 1, 1600)) AS hash,
       'page/part 1, characters ' || s || '–' || (s + length(substr(text, s + 1, 1600))) AS location
FROM w WHERE regexp_matches(substr(text, s + 1, 1600), '[^\\s]')""".replace("\\\\", "\\"))
def chunks_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """C1, C6, T16."""
    chunks = K.chunked(table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("page")), "fixed")
    return chunks.select("doc_id", "chunk_id", "start", F.sha2("chunk_text", 256).alias("hash"), "location")


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a title before every eighth line, as their prose has none."""
    lines = F.split("text", "\n", -1)
    text = F.array_join(F.transform(lines, lambda x, i: F.when(i % 8 == 3, F.concat(F.lit("Skills:\n"), x)).otherwise(x)), "\n")
    return table(spark, sf, "documents").select("doc_id", text.alias("text"), F.lit(1).alias("page"))


@query("""
WITH RECURSIVE t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 8 = 3 THEN 'Skills:' || chr(10) || x ELSE x END), chr(10)) AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM t),
o AS (SELECT doc_id, line = 'Skills:' AS h, p, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pos FROM l),
b AS (SELECT doc_id, pos, h FROM o WHERE h OR p = 1),
s AS (SELECT b.doc_id, b.pos, lead(b.pos, 1, length(t.text)) OVER (PARTITION BY b.doc_id ORDER BY b.pos) AS stop, CASE WHEN b.h THEN 'Skills' END AS heading, t.text FROM b JOIN t ON t.doc_id = b.doc_id),
c AS (
  SELECT doc_id, heading, text, stop, pos AS "start", CASE WHEN stop - pos <= 1600 THEN stop WHEN strpos(reverse(substr(text, pos + 2, 1599)), chr(10)) > 0 THEN pos + 1601 - strpos(reverse(substr(text, pos + 2, 1599)), chr(10)) ELSE pos + 1600 END AS "end" FROM s WHERE pos < stop
  UNION ALL
  SELECT doc_id, heading, text, stop, "end", CASE WHEN stop - "end" <= 1600 THEN stop WHEN strpos(reverse(substr(text, "end" + 2, 1599)), chr(10)) > 0 THEN "end" + 1601 - strpos(reverse(substr(text, "end" + 2, 1599)), chr(10)) ELSE "end" + 1600 END FROM c WHERE "end" < stop)
SELECT doc_id, 'p1-' || "start" AS chunk_id, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", heading, sha256(substr(text, "start" + 1, "end" - "start")) AS hash FROM c""")
def chunks_structure(spark: SparkSession, sf: str) -> DataFrame:
    """C2."""
    return K.chunked(_titled(spark, sf)).select("doc_id", "chunk_id", "start", "end", "heading", F.sha2("chunk_text", 256).alias("hash"))


def _paragraphed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a title before every fortieth line and a blank line after every third."""
    lines = F.split("text", "\n", -1)
    text = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i % 40 == 3, "Skills:\n").otherwise(""), x, F.when(i % 3 == 2, "\n").otherwise(""))), "\n")
    return table(spark, sf, "documents").select("doc_id", text.alias("text"), F.lit(1).alias("page"))


_WORDS = ("the", "der", "le", "que")


@query("""
WITH RECURSIVE t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 40 = 3 THEN 'Skills:' || chr(10) ELSE '' END || x || CASE WHEN (i - 1) % 3 = 2 THEN chr(10) ELSE '' END), chr(10)) AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p, length(text) AS whole FROM t),
o AS (SELECT doc_id, line = 'Skills:' AS h, p, regexp_full_match(line, '\\s*') AS blank, whole, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, length(line) AS n FROM l),
b AS (SELECT doc_id, pos, h FROM o WHERE h OR p = 1),
s AS (SELECT b.doc_id, b.pos, lead(b.pos, 1, length(t.text)) OVER (PARTITION BY b.doc_id ORDER BY b.pos) AS stop, CASE WHEN b.h THEN 'Skills' END AS heading, t.text FROM b JOIN t ON t.doc_id = b.doc_id),
e AS (SELECT s.doc_id, s.pos, least(o.pos + o.n + 1, o.whole) AS fin FROM s JOIN o ON o.doc_id = s.doc_id AND o.blank AND least(o.pos + o.n + 1, o.whole) > s.pos AND least(o.pos + o.n + 1, o.whole) < s.stop WHERE s.stop - s.pos > 1200 UNION SELECT doc_id, pos, stop FROM s WHERE stop - pos > 1200),
g AS (SELECT e.doc_id, e.pos, e.fin, lag(e.fin, 1, e.pos) OVER (PARTITION BY e.doc_id, e.pos ORDER BY e.fin) AS a, row_number() OVER (PARTITION BY e.doc_id, e.pos ORDER BY e.fin) AS i FROM e),
w AS (SELECT g.*, lower(substr(t.text, g.a + 1, g.fin - g.a)) AS x FROM g JOIN t ON t.doc_id = g.doc_id),
v AS (SELECT *, [""" + ", ".join(f"CAST((length(x) - length(replace(x, '{w}', ''))) / {len(w)} AS DOUBLE)" for w in _WORDS) + """, 1.0::DOUBLE] AS v FROM w),
k AS (SELECT *, coalesce(list_inner_product(v, lag(v) OVER q) / sqrt(list_inner_product(v, v) * list_inner_product(lag(v) OVER q, lag(v) OVER q)) >= 0.6, false) AS alike FROM v WINDOW q AS (PARTITION BY doc_id, pos ORDER BY i)),
f AS (SELECT doc_id, pos, i, pos AS grp, fin AS before FROM k WHERE i = 1
  UNION ALL SELECT k.doc_id, k.pos, k.i, CASE WHEN k.fin - f.grp <= 1600 AND (k.alike OR f.before - f.grp < 200) THEN f.grp ELSE f.before END, k.fin FROM f JOIN k ON k.doc_id = f.doc_id AND k.pos = f.pos AND k.i = f.i + 1),
u AS (SELECT DISTINCT doc_id, pos, grp FROM f UNION SELECT doc_id, pos, pos FROM s WHERE pos < stop),
r AS (SELECT s.doc_id, s.heading, s.text, u.grp AS pos, lead(u.grp, 1, s.stop) OVER (PARTITION BY u.doc_id, u.pos ORDER BY u.grp) AS stop FROM u JOIN s ON s.doc_id = u.doc_id AND s.pos = u.pos AND s.pos < s.stop),
c AS (
  SELECT doc_id, heading, text, stop, pos AS "start", CASE WHEN stop - pos <= 1600 THEN stop WHEN strpos(reverse(substr(text, pos + 2, 1599)), chr(10)) > 0 THEN pos + 1601 - strpos(reverse(substr(text, pos + 2, 1599)), chr(10)) ELSE pos + 1600 END AS "end" FROM r WHERE pos < stop
  UNION ALL
  SELECT doc_id, heading, text, stop, "end", CASE WHEN stop - "end" <= 1600 THEN stop WHEN strpos(reverse(substr(text, "end" + 2, 1599)), chr(10)) > 0 THEN "end" + 1601 - strpos(reverse(substr(text, "end" + 2, 1599)), chr(10)) ELSE "end" + 1600 END FROM c WHERE "end" < stop)
SELECT doc_id, 'p1-' || "start" AS chunk_id, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", heading, sha256(substr(text, "start" + 1, "end" - "start")) AS hash FROM c""")
def chunks_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs are embedded once each, by a bag of words in batches; what is embedded goes to the cache."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[float(t.lower().count(w)) for w in _WORDS] + [1.0] for t in texts]

    none = spark.createDataFrame([], "key string, embedding array<double>")
    return K.hybrid_chunks(_paragraphed(spark, sf), ["doc_id"], none, embed, "bag")[0].select("doc_id", "chunk_id", "start", "end", "heading", F.sha2("chunk_text", 256).alias("hash"))


@query("SELECT doc_id, true AS exact FROM documents")
def chunks_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Passages put together are the text."""
    docs = _titled(spark, sf)
    return K.is_exact_partition(docs, K.chunked(docs), "doc_id")


@query("""
WITH w AS (SELECT doc_id, length(substr(text, s + 1, 1600)) AS n, substr(text, s + 1, 1600) AS c FROM (SELECT doc_id, text, unnest(range(0, CAST(length(text) AS BIGINT), 1600)) AS s FROM documents))
SELECT doc_id, count(*) AS chunks, min(n) AS min_chars, round(avg(n), 1) AS mean_chars, max(n) AS max_chars, count(*) FILTER (WHERE n > 1600) AS over_max FROM w WHERE trim(c) <> '' GROUP BY 1""")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A14."""
    chunks = K.fixed_chunks(table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("page")))
    return A.size_stats(chunks, ["doc_id"], "chunk_text")


@query("""
WITH c AS (SELECT doc_id, CAST(ceil(length(text) / 100.0) AS BIGINT) AS n FROM documents)
SELECT doc_id, n AS sections, n = 0 OR n > 160 AS needs_review FROM c""")
def section_budget(spark: SparkSession, sf: str) -> DataFrame:
    """C5, with windows of 100 so that some documents have too many."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("page"))
    windows = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / 100).cast("int"))).alias("i"))
    return K.section_budget(docs, windows, "doc_id").select("doc_id", "sections", "needs_review")


@query(r"""
WITH d AS (SELECT doc_id, doc_id % 4 AS k, text FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'Ada Byron' WHEN 1 THEN 'Zoë O’Neil' WHEN 3 THEN 'Max Frisch' END AS name,
       array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}'), CASE k WHEN 1 THEN ['zoe@example.org'] ELSE [] END))), ' ') AS emails, false AS identity_verified FROM d""")
def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """A label, a header, or a file's name behind a header that has none; a name that is withheld is none."""
    k = F.col("doc_id") % 4
    no_name = "Name\nnot provided\n" + "1: -\n" * 20
    head = F.when(k == 0, "Full name: Ada Byron\n").when(k == 1, "Curriculum vitae\nZoë O’Neil | zoe@example.org | +49 30 1234567\n").otherwise(no_name)
    rows = table(spark, sf, "documents").select("doc_id", F.concat(head, "text").alias("text"), F.concat(F.lit("cv_Max_Frisch_"), F.when(k == 3, "").otherwise(F.col("doc_id").cast("string")), F.lit(".txt")).alias("file"))
    return with_contacts(rows, filename="file").select("doc_id", "contact.name", F.array_join(F.array_sort("contact.emails"), " ").alias("emails"), "contact.identity_verified")


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS other, CASE WHEN list_sum(list_transform(b.e, lambda x: x * x)) = 0 THEN 0 ELSE list_cosine_similarity(a.e, b.e) END AS s FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT vec_id, round(max(s), 6) AS best, round(min(s), 6) AS least, round(avg(s), 6) AS mean, count(*) AS others FROM p GROUP BY 1""")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """V1: a stated set of queries against all vectors."""
    e = table(spark, sf, "embeddings")
    found = J.cosine_stats(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding")
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in ("best", "least", "mean")], "others")


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0)
SELECT v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.e), 6) AS similarity, round(1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.e), 6) AS distance
FROM embeddings v, q WHERE v.label IN (1, 3, 5) AND v.vec_id <> 0 ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.e) DESC, v.vec_id LIMIT 8""")
def knn_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Filters come before distances."""
    e = table(spark, sf, "embeddings")
    q = list(e.where("vec_id = 0").select("embedding").first()[0])  # the question's vector
    near = S.nearest(e, q, 8, F.col("label").isin(1, 3, 5) & (F.col("vec_id") != 0), ident="vec_id")
    return near.select("vec_id", F.round("similarity", 6).alias("similarity"), F.round(X.cosine_distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), 6).alias("distance"))


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS question, b.vec_id, list_cosine_similarity(a.e, b.e) AS s FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.label = b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY s DESC, vec_id) AS rank FROM p)
SELECT question, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 6) AS similarity FROM r WHERE rank <= 8""")
def knn_each(spark: SparkSession, sf: str) -> DataFrame:
    """The eight nearest of each of a set of questions, within its label."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    found, _ = nearest_for_each(e.where("vec_id % 50 = 0"), e)
    return found.select("question", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("""
WITH v AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN [] WHEN 1 THEN list_append(CAST(embedding AS DOUBLE[]), 'nan'::DOUBLE) WHEN 2 THEN list_append(CAST(embedding AS DOUBLE[]), 'inf'::DOUBLE) ELSE CAST(embedding AS DOUBLE[]) END AS e FROM embeddings)
SELECT vec_id, len(e) > 0 AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AS valid FROM v""")
def vector_valid(spark: SparkSession, sf: str) -> DataFrame:
    """V4."""
    k, e = F.col("vec_id") % 4, F.col("embedding").cast("array<double>")
    bad = F.when(k == 0, F.array().cast("array<double>")).when(k == 1, F.concat(e, F.array(F.lit(float("nan"))))).when(k == 2, F.concat(e, F.array(F.lit(float("inf"))))).otherwise(e)
    return table(spark, sf, "embeddings").select("vec_id", X.is_valid(bad).alias("valid"))


@query("""
SELECT doc_id, '[' || CAST((length(t) - length(replace(t, 'the', ''))) / 3 AS INTEGER) || '.0,' || CAST((length(t) - length(replace(t, 'que', ''))) / 3 AS INTEGER) || '.0,1.0]' AS vector FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def bow_embed(spark: SparkSession, sf: str) -> DataFrame:
    """V7, V5."""
    return table(spark, sf, "documents").select("doc_id", X.literal(X.bag_of_words(F.col("text"), ["the", "que"])).alias("vector"))


@query("""
SELECT lang, count(*) AS n, CAST(round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents) * 100) AS BIGINT) AS percent FROM documents GROUP BY 1""")
def bar_percents(spark: SparkSession, sf: str) -> DataFrame:
    """V10."""
    counts = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("lang", "n", X.bar_percent(F.col("n"), F.col("total")).alias("percent"))


def _frames(spark: SparkSession, sf: str) -> S.Frames:
    docs, labels = tables(spark, sf, "documents", "labels")
    rows = docs.join(labels, "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "review").when(F.col("quality") == 1, "completed").otherwise("queued")
    records = rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("Name "), F.col("doc_id").cast("string")).alias("name"), status.alias("status"), F.when(F.col("doc_id") % 9 == 0, F.lit(1).cast("long")).alias("duplicate_of"), F.col("doc_id").cast("string").alias("file_id"), F.lit("done").alias("job_state"))
    sections = docs.select(F.col("doc_id").alias("record_id"), F.lit("p1-0").alias("section_id"), F.lit("page/part 1").alias("location"), "text")
    scored = records.where("status = 'completed' AND duplicate_of IS NULL").select("id", (F.col("id") % 50).alias("score"), F.lit(0).alias("_g"))
    return S.Frames(records, sections, ranked(scored, ["_g"], "score", "id").drop("_g"))


_CARDS = """
WITH r AS (SELECT d.doc_id AS id, d.text, CASE WHEN l.toxic = 1 THEN 'review' WHEN l.quality = 1 THEN 'completed' ELSE 'queued' END AS status, d.doc_id % 9 = 0 AS dup FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
k AS (SELECT id, id % 50 AS score, rank() OVER (ORDER BY id % 50 DESC) AS rank, count(*) OVER (PARTITION BY id % 50) > 1 AS tie FROM r WHERE status = 'completed' AND NOT dup)
SELECT r.id, 'Name ' || r.id AS name, r.status, k.score, k.rank, coalesce(k.tie, false) AS tie, 'https://drive.google.com/file/d/' || r.id || '/view' AS link FROM r LEFT JOIN k ON k.id = r.id"""


@query(f"{_CARDS} WHERE NOT r.dup AND ({_term_sql('then', 'onal', op='OR')})")
def answer_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """A plain question: exact terms."""
    return S.plan(S.parse_question('Who has "then" or "onal"?'), _frames(spark, sf))


@query(f"{_CARDS} WHERE k.rank = 2")
def answer_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """An ordinal of the ranking: all that share it."""
    return S.plan(S.parse_question("Which is the second in rank?"), _frames(spark, sf))


@query(f"{_CARDS} WHERE r.status = 'review'")
def answer_status(spark: SparkSession, sf: str) -> DataFrame:
    """A list by status, duplicates too."""
    return S.plan(S.parse_question("List all applicants in review"), _frames(spark, sf))


@query(f"{_CARDS} WHERE k.rank IS NOT NULL ORDER BY k.rank, r.id LIMIT 3")
def answer_top_three(spark: SparkSession, sf: str) -> DataFrame:
    """L5, L6."""
    return S.plan(S.parse_question("Show the top three"), _frames(spark, sf))


@query(f"{_CARDS} WHERE contains('compare name 12 with name 13', 'name ' || r.id)")
def answer_compare(spark: SparkSession, sf: str) -> DataFrame:
    """A comparison of records named in full; 1 is in "Name 12", so its name is too."""
    return S.plan(S.parse_question("compare Name 12 with Name 13"), _frames(spark, sf))


@query(f"{_CARDS} WHERE r.id IN (12, 13)")
def answer_selected(spark: SparkSession, sf: str) -> DataFrame:
    """A comparison of records that are chosen by their identifiers."""
    return S.plan(S.parse_question("compare 12 and 13", selected=(12, 13)), _frames(spark, sf))


@query(f"{_CARDS} WHERE k.rank = 2 AND (SELECT count(*) FROM r JOIN k ON r.id = k.id WHERE k.rank = 2) > 1")
def answer_compare_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """A comparison of those that share a rank; of one there is none."""
    return S.plan(S.parse_question("Compare the second in rank"), _frames(spark, sf))


@query(_CARDS.replace(" FROM r LEFT JOIN k", ", 'semantic excerpt suggestions' AS mode FROM r LEFT JOIN k") + """
JOIN (SELECT vec_id FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) WHERE vec_id IN (SELECT id FROM r WHERE NOT dup)
      ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, 'v' || vec_id LIMIT 8) n ON n.vec_id = r.id""")
def answer_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """Words find nothing, so the nearest vectors of records in scope answer; those of duplicates do not."""
    frames = _frames(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("section_id"), F.lit("").alias("location"), F.lit("").alias("text"), "embedding")
    q = list(table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0])
    frames.vectors = vectors
    cards, _, mode = S.answer(S.parse_question("xylophone zeppelin"), frames, lambda _: q)
    return cards.withColumn("mode", F.lit(mode))


@query("""
WITH n AS (SELECT vec_id FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0)
  ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, 'v' || vec_id LIMIT 8)
SELECT 'c' || row_number() OVER (ORDER BY 'v' || vec_id) AS citation_id, vec_id AS record_id, 'v' || vec_id AS section_id, 'place ' || vec_id AS location FROM n""")
def answer_citations(spark: SparkSession, sf: str) -> DataFrame:
    """What backs an answer, with running identifiers."""
    frames, e = _frames(spark, sf), table(spark, sf, "embeddings")
    ident = F.col("vec_id").cast("string")
    frames.vectors = e.select(F.col("vec_id").alias("record_id"), F.concat(F.lit("v"), ident).alias("section_id"), F.concat(F.lit("place "), ident).alias("location"), F.lit("").alias("text"), "embedding")
    q = list(e.where("vec_id = 0").select("embedding").first()[0])
    cited = S.answer(S.parse_question("xylophone zeppelin"), frames, lambda _: q)[1]
    return S.numbered_passages(cited, "section_id").select("citation_id", "record_id", "section_id", "location")


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records, their lines as findings, suppliers as criteria."""
    orders, lineitem = tables(spark, sf, "orders", "lineitem")
    level = F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "N", "partial").otherwise("not_demonstrated")
    cited = F.when(F.col("l_quantity") > 40, F.array(F.struct(F.lit("p1-0").alias("section_id"), F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("quote")))).otherwise(F.array().cast("array<struct<section_id:string,quote:string>>"))
    finding = F.struct(F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.when(F.col("l_linestatus") == "O", "open").otherwise("final").alias("criterion_id"), level.alias("level"), cited.alias("evidence"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("missing_information"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("explanation"))
    found = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    return orders.where("o_orderstatus = 'F'").join(found, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("name"), F.floor("o_totalprice").alias("score"), F.lit("completed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("assessed_at"), F.col("o_orderkey").cast("string").alias("file_id"), "findings")


_LINES = """
WITH f AS (SELECT l.*, CASE l_returnflag WHEN 'A' THEN 'supported' WHEN 'N' THEN 'partial' ELSE 'not_demonstrated' END AS level, CASE l_linestatus WHEN 'O' THEN 'open orders' ELSE 'final orders' END AS criterion FROM lineitem l JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')"""


@query(f"""
{_LINES}, t AS (SELECT l_orderkey, coalesce(string_agg(CASE WHEN level <> 'not_demonstrated' THEN criterion END, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS matched,
  coalesce(string_agg(CASE WHEN level <> 'not_demonstrated' AND l_quantity > 40 THEN 'q' || l_partkey END, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS quotes,
  coalesce(string_agg(CASE WHEN level = 'supported' THEN 'e' || l_partkey END, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS strengths,
  coalesce(string_agg(CASE WHEN level <> 'supported' THEN criterion || ': m' || l_partkey END, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS missing FROM f GROUP BY 1)
SELECT rank() OVER (ORDER BY floor(o_totalprice) DESC) AS "Rank", CASE WHEN count(*) OVER (PARTITION BY floor(o_totalprice)) > 1 THEN 'Tie' ELSE '' END AS "Tie", o_orderkey AS "Application ID", 'Name not provided' AS "Candidate name",
  CAST(floor(o_totalprice) AS BIGINT) AS "Score", matched AS "Matched skills", quotes AS "Relevant evidence / projects", strengths AS "Strengths", missing AS "Requirements not demonstrated", 'completed' AS "Assessment status",
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS "Processed date", 'https://drive.google.com/file/d/' || o_orderkey || '/view' AS "CV link" FROM orders JOIN t ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def report_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """S11, S12, T18."""
    rows = _report(spark, sf).withColumn("criteria", F.create_map(F.lit("open"), F.lit("open orders"), F.lit("final"), F.lit("final orders"))).withColumn("_g", F.lit(0))
    return REP.safe_sheet(REP.ranked_sheet(ranked(rows, ["_g"], "score", "id")))


@query(f"""
{_LINES}
SELECT l_orderkey AS "Application ID", criterion AS "Criterion", CASE criterion WHEN 'open orders' THEN 60.0::DOUBLE ELSE 40.0::DOUBLE END AS "Weight",
  CASE criterion WHEN 'open orders' THEN 60.0::DOUBLE ELSE 40.0::DOUBLE END * CASE level WHEN 'supported' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS "Awarded points", 'e' || l_partkey AS "Explanation",
  CASE WHEN l_quantity > 40 THEN 'q' || l_partkey ELSE '' END AS "Cited CV text", CASE WHEN l_quantity > 40 THEN 'page/part 1' ELSE '' END AS "Source location" FROM f""")
def report_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """N3, N7, J7."""

    def criterion(text: str, weight: float):
        return F.struct(F.lit(text).alias("description"), F.lit(weight).alias("weight"))

    rows = _report(spark, sf).withColumn("criteria", F.create_map(F.lit("open"), criterion("open orders", 60.0), F.lit("final"), criterion("final orders", 40.0))).withColumn("sections", F.create_map(F.lit("p1-0"), F.lit("page/part 1")))
    return REP.evidence_sheet(rows)


@query("""
SELECT doc_id AS "Application ID", source AS "Filename", CASE WHEN doc_id % 3 = 0 THEN 'review' ELSE 'completed' END AS "Status",
       CASE WHEN doc_id % 6 = 0 THEN 'low score' WHEN doc_id % 4 = 1 THEN 'Duplicate of application ' || (doc_id + 1) ELSE 'Pending assessment' END AS "Reason", 'https://drive.google.com/file/d/' || doc_id || '/view' AS "CV link"
FROM documents WHERE lang <> 'fr' AND (doc_id % 3 = 0 OR doc_id % 4 = 1)""")
def report_review(spark: SparkSession, sf: str) -> DataFrame:
    """F6, F8."""
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select(d.alias("id"), F.col("source").alias("filename"), F.when(d % 3 == 0, "review").otherwise("completed").alias("status"), (F.col("lang") != "fr").alias("active"), F.when(d % 4 == 1, d + 1).alias("duplicate_of"), F.when(d % 6 == 0, "low score").otherwise("").alias("review_reason"), d.cast("string").alias("file_id"))
    return REP.review_sheet(rows)


@query("""
SELECT CAST(user_id AS VARCHAR) AS "File ID", user_id AS "Application ID", 'v' || (event_id % 2) AS "Content version", 1 AS "Rubric version", CASE WHEN event_id % 2 = 0 AND user_id < 50 THEN 'm' || (user_id % 3) ELSE '' END AS "Model",
       event_type AS "Job state", 'assess' AS "Step", 0 AS "Retries", strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS "Updated UTC", '' AS "Error time UTC", CASE WHEN event_type = 'error' THEN props ELSE '' END AS "Error type", 7 AS "Report revision" FROM events""")
def report_log(spark: SparkSession, sf: str) -> DataFrame:
    """One join instead of a look-up for each row."""
    e = table(spark, sf, "events")
    jobs = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("application_id"), F.concat(F.lit("v"), (F.col("event_id") % 2).cast("string")).alias("version"), F.lit(1).alias("rubric_id"), F.col("event_type").alias("state"), F.lit("assess").alias("step"), F.lit(0).alias("attempts"), F.col("ts").cast("timestamp").alias("updated"), F.lit(None).cast("timestamp").alias("error_at"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    users = e.select(F.col("user_id").alias("id")).distinct()
    records = users.withColumn("file_id", F.col("id").cast("string"))
    done = users.where("id < 50").select(F.col("id").alias("application_id"), F.lit("v0").alias("version"), F.lit(1).alias("rubric_id"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"))
    return REP.log_sheet(jobs, records, done, 7)


@query("""
WITH q AS (SELECT item_id, 1 AS words, string_split(text, ' ')[3] AS quote FROM benchmark UNION ALL SELECT item_id, 2, array_to_string(string_split(text, ' ')[4:5], ' ') FROM benchmark
  UNION ALL SELECT item_id, 4, substr(array_to_string(string_split(text, ' ')[2:5], ' '), 2) FROM benchmark)
SELECT d.doc_id, q.item_id, CAST(q.words AS INTEGER) AS words FROM documents d JOIN q ON contains(d.text, q.quote)""")
def short_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of one to four words, of which some begin inside a word."""
    docs, benchmark = tables(spark, sf, "documents", "benchmark")
    w = F.split("text", " ", -1)
    kinds = [(1, F.get(w, F.lit(2))), (2, F.array_join(F.slice(w, 4, 2), " ")), (4, F.substring(F.array_join(F.slice(w, 2, 4), " "), 2, 1 << 20))]
    quotes = benchmark.select("item_id", F.explode(F.array(*[F.struct(F.lit(n).alias("words"), q.alias("quote")) for n, q in kinds])).alias("q")).select((F.col("item_id") * 10 + F.col("q.words")).alias("quote_id"), F.col("q.quote").alias("quote"))
    found = J.quotes_in(docs, quotes, "doc_id", "text", "quote_id", "quote")
    return found.select("doc_id", F.floor(F.col("quote_id") / 10).alias("item_id"), (F.col("quote_id") % 10).cast("int").alias("words"))


#: Questions: terms, and whether one is enough.
_ASKED = {"word": (["then"], False), "and": (["then", "onal"], False), "or": (["onal", "password"], True), "phrase": (["apache license"], False), "case": (["THE"], False), "mark": (["@example", "license,"], True), "none": (["xylophone"], False)}


def _holds(term: str) -> str:
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in term)
    return rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]){quoted}($|[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}])')"


@query("WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 1 THEN 'an Apache License, v. 2 then' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 3 OR doc_id % 9 = 1)\n" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS question, doc_id FROM t WHERE " + (" OR " if any_term else " AND ").join(_holds(t) for t in terms) for name, (terms, any_term) in _ASKED.items()))
def search_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index of all documents after some were taken away, some changed, a batch came twice and segments were merged."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    index = SearchIndex(spark, workspace(spark, "index"), 16)
    gone, changed = docs.where("doc % 11 = 3").select("doc", F.lit(None).cast("string").alias("text")), docs.where("doc % 9 = 1").select("doc", F.lit("an Apache License, v. 2 then").alias("text"))
    for n, batch in enumerate((docs, gone, changed, changed)):
        index.apply(batch, min(n, 2))
    index.merge(3)
    now = docs.join(gone.select("doc"), "doc", "left_anti").join(changed.select("doc"), "doc", "left_anti").unionByName(changed)
    found = [index.search(terms, any_term, now).select(F.lit(name).alias("question"), F.col("doc").alias("doc_id")) for name, (terms, any_term) in _ASKED.items()]
    return reduce(DataFrame.unionByName, found)
