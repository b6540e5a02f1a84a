"""Queries: parameterised SQL, mirrors, ledgers, manifests and schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import quality as Q
from sievework.plans.registry import query
from sievework.plans.session import table, workspace
from sievework.sources import folders, readers, writers


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS average FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_acctbal > 100 GROUP BY 1")
def sql_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """SQL with named parameters."""
    sql = "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS average FROM {c} WHERE array_contains(:nations, c_nationkey) AND c_acctbal > :least GROUP BY 1"
    return readers.rows(spark, sql, {"nations": [1, 2, 3], "least": 100}, c=table(spark, sf, "customer"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def without_text(spark: SparkSession, sf: str) -> DataFrame:
    """all columns but one; the scan does not read it."""
    return table(spark, sf, "documents").drop("text")


@query("""
SELECT 'nation' AS name, count(*) AS a, count(*) AS b, true AS match, CAST(0 AS INTEGER) AS examples FROM nation UNION ALL SELECT 'supplier', count(*), count(*), false, 2 FROM supplier
UNION ALL SELECT 'customer', count(*), count(*) - count(*) FILTER (WHERE c_custkey % 10 = 0), false, CAST(least(20, count(*) FILTER (WHERE c_custkey % 10 = 0)) AS INTEGER) FROM customer""")
def mirror_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Tables mirrored, read back and compared; in one a row has drifted, which counts on both sides, in
    another rows are missing, and a report shows the first 20."""
    folder = workspace(spark, "mirror")
    frames = {n: table(spark, sf, n) for n in ("nation", "supplier", "customer")}
    writers.mirror(frames | {"leases": frames["nation"]}, folder)
    back = {n: readers.of_schema(spark, f"{folder}/{n}", f.schema) for n, f in frames.items()}
    back["supplier"] = back["supplier"].withColumn("s_acctbal", F.when(F.col("s_suppkey") == 7, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    back["customer"] = back["customer"].where("c_custkey % 10 <> 0")
    found = Q.compare_stores(frames, back)
    return spark.createDataFrame([(n, r["a"], r["b"], r["match"], len(r["examples"])) for n, r in found.items()], "name string, a long, b long, match boolean, examples int")


@query("""
SELECT s_nationkey, count(*) AS before, CAST(0 AS BIGINT) AS after, count(*) AS again FROM supplier GROUP BY 1""")
def mirror_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a mirror by nation, what is left once it is dropped, and those of a new mirror in its place, which may not be there before."""
    folder, own = workspace(spark, "mirror") + "/m", table(spark, sf, "supplier")

    def held(name: str) -> DataFrame:
        rows = readers.of_schema(spark, f"{folder}/supplier", own.schema) if writers.exists(spark, f"{folder}/supplier") else own.limit(0)
        counts = rows.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias(name))
        counts.write.parquet(f"{folder}-{name}")  # kept, as the mirror goes
        return spark.read.schema(counts.schema).parquet(f"{folder}-{name}")

    writers.mirror({"supplier": own}, folder)
    before = held("before")
    writers.drop_mirror(spark, folder)
    after = held("after")
    writers.mirror({"supplier": own}, folder)
    return before.join(after, "s_nationkey", "left").join(held("again"), "s_nationkey", "left").select("s_nationkey", "before", F.coalesce("after", F.lit(0)).alias("after"), "again")


@query("""
SELECT item_id, sha256(text || chr(10)) AS hash, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS length, '' AS error FROM benchmark
UNION ALL SELECT -1, NULL, CAST(4 AS BIGINT), 'Text contains binary content'""")
def text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Texts written as files, listed, and read if they did not change meanwhile; one of them is no text."""
    folder = workspace(spark, "texts")
    rows = table(spark, sf, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame([(-1, "a\0b")], "item_id long, text string"))
    rows.repartition("item_id").write.partitionBy("item_id").text(folder)
    item = F.regexp_extract("path", "item_id=(-?[0-9]+)/", 1).cast("long")
    listed = readers.listing(spark, folder, "*.txt", 1 << 20).select("path", "length")
    read = f"{workspace(spark, 'read')}/texts"
    same = readers.unchanged(spark, folder, lambda: readers.text_documents(spark, folder).write.parquet(read), "*.txt")
    texts = spark.read.schema("path string, text string, error string").parquet(read).join(same, "path", "left_semi")
    return listed.join(texts, "path").select(item.alias("item_id"), F.sha2("text", 256).alias("hash"), "length", F.coalesce("error", F.lit("")).alias("error"))


@query("""
SELECT 'n' || (event_id % 50) AS key, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS k FROM events GROUP BY 1""")
def settings_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Settings as JSON values; what was set last holds."""
    folder = workspace(spark, "settings")
    e = table(spark, sf, "events").select(F.concat(F.lit("n"), (F.col("event_id") % 50).cast("string")).alias("key"), F.col("props").alias("value"), F.col("event_id").alias("at"))
    for part in (e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0")):
        writers.put_settings(part, folder)
    return readers.settings(spark, folder).select("key", F.from_json("value", "k long")["k"].alias("k"))


@query("""
SELECT doc_id AS "Application ID", CASE WHEN doc_id % 4 = 0 THEN chr(39) || '=' || source WHEN doc_id % 4 = 1 THEN '"' || source || '", x' ELSE source END AS "Filename" FROM documents""")
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet written as CSV, with cells that look like formulas or hold quotes, and read back."""
    folder, k, name = workspace(spark, "report"), F.col("doc_id") % 4, F.col("source")
    sheet = table(spark, sf, "documents").select(F.col("doc_id").alias("Application ID"), F.when(k == 0, F.concat(F.lit("="), name)).when(k == 1, F.concat(F.lit('"'), name, F.lit('", x'))).otherwise(name).alias("Filename"))
    writers.write_report({"Review": sheet}, folder)
    return spark.read.option("header", True).option("escape", '"').schema(sheet.schema).csv(f"{folder}/Review")


@query("""
SELECT event_type AS model, count(*) * 2 AS events, CAST(sum(user_id) * 2 AS BIGINT) AS sections FROM events GROUP BY 1""")
def ledger_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a ledger of JSON lines twice, and read back."""
    folder = workspace(spark, "ledger")
    events = table(spark, sf, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_type").alias("model"), F.col("user_id").alias("sections"))
    for _ in range(2):
        writers.append_ledger(events, folder)
    return readers.ledger(spark, folder).groupBy("model").agg(F.count(F.lit(1)).alias("events"), F.sum("sections").alias("sections"))


@query("SELECT s_suppkey, n_name AS body FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = s_suppkey % 5")
def manifest_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a JSON manifest by a composite key."""
    folder = workspace(spark, "manifest")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("role_id"), F.col("n_regionkey").alias("jd_hash"), F.col("n_name").alias("body"))
    nation.agg(F.to_json(F.collect_list(F.struct(*nation.columns)))).coalesce(1).write.text(folder)  # one array, as a manifest is
    wanted = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("role_id"), (F.col("s_suppkey") % 5).cast("int").alias("jd_hash"))
    return readers.manifest(spark, folder, "role_id int, jd_hash int, body string", wanted, ["role_id", "jd_hash"]).select("s_suppkey", "body")


@query("""
SELECT column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'bigint' WHEN data_type = 'DOUBLE' THEN 'double precision' ELSE 'text' END AS type, column_name = 'l_orderkey' AS key
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def schema_types(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of a table with their types in a mirror."""
    return spark.createDataFrame(readers.schema_plan(table(spark, sf, "lineitem"), ["l_orderkey"]), "name string, type string, key boolean")


@query("SELECT count(*) AS rows FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0)")
def append_only(spark: SparkSession, sf: str) -> DataFrame:
    """Rows were added and none was changed; else an error."""
    before = table(spark, sf, "events")
    return Q.assert_append_only(before, before.unionByName(before.where("event_id % 10 = 0"))).agg(F.count(F.lit(1)).alias("rows"))


def _files(rows: DataFrame) -> None:
    """Writes, renames and removes files: dir, name, text (null: none), was (a name it had)."""

    def act(batches):
        for r in batches:
            at, path = folders.opened(f"{r['dir']}/{r['name']}")
            if r["was"]:
                at.move(folders.opened(f"{r['dir']}/{r['was']}")[1], path)
            elif r["text"] is None:
                at.delete_file(path)
            else:
                at.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with at.open_output_stream(path) as f:
                    f.write(r["text"].encode())

    rows.foreachPartition(act)


@query("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS m, s_name || chr(10) || s_suppkey AS text FROM supplier),
c AS (SELECT 1 AS scan, 's' || k || '.txt' AS name, 'new' AS change, NULL AS was, text FROM s WHERE m <> 4
  UNION ALL SELECT 2, CASE WHEN m = 3 THEN 'r' ELSE 's' END || k || '.txt', CASE m WHEN 1 THEN 'changed' WHEN 2 THEN 'removed' WHEN 3 THEN 'renamed' ELSE 'new' END, CASE WHEN m = 3 THEN 's' || k || '.txt' END, text || CASE WHEN m = 1 THEN '!' ELSE '' END FROM s WHERE m IN (1, 2, 3, 4))
SELECT scan, name, change, was, md5(text) AS version, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM c""")
def folder_scans(spark: SparkSession, sf: str) -> DataFrame:
    """A watched folder over three scans, the stream starting again for each: files that are new, changed,
    removed and renamed; touched ones are not changed, and the third scan finds nothing."""
    where = workspace(spark, "folder")
    k = F.col("s_suppkey")
    m = k % 6
    text = F.concat("s_name", F.lit("\n"), k.cast("string"))
    rows = table(spark, sf, "supplier").select(m.alias("m"), F.lit(f"{where}/in").alias("dir"), F.concat(F.lit("s"), k.cast("string"), F.lit(".txt")).alias("name"), text.alias("text"), F.lit(None).cast("string").alias("was"), k)
    _files(rows.where("m <> 4"))
    number = {}

    def apply(batch: DataFrame, n: int) -> None:
        number["scan"] = number.get("scan", 0) + 1
        found = folders.with_renames(batch).select(F.lit(number["scan"]).alias("scan"), "name", "change", F.element_at(F.split("was", "/"), -1).alias("was"), "version", "length")
        found.write.mode("overwrite").parquet(f"{where}/out/{n}")

    def scan() -> None:
        stream = folders.folder_stream(spark, f"{where}/in", f"{where}/state", suffixes=".txt")
        stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    scan()
    changed = rows.withColumn("text", F.when(m == 2, None).when(m == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    moved = changed.withColumns({"was": F.when(m == 3, F.col("name")), "name": F.when(m == 3, F.concat(F.lit("r"), k.cast("string"), F.lit(".txt"))).otherwise(F.col("name"))})
    _files(moved)  # those of 0 and 5 are written again as they were
    scan()
    scan()
    return spark.read.schema("scan int, name string, change string, was string, version string, length long").parquet(f"{where}/out/*")


@query("""
WITH l AS (SELECT event_type, event_id, '{"model":"' || event_type || '","tokens":' || event_id || '}' AS line FROM events),
t AS (SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY event_type ORDER BY event_id DESC) AS reach FROM l)
SELECT event_type AS model, count(*) AS lines, min(event_id) AS earliest FROM t WHERE reach <= 5000 GROUP BY 1""")
def ledger_tails(spark: SparkSession, sf: str) -> DataFrame:
    """The last 5,000 bytes of each file of a ledger, one a type; the line that the cut parts is left out."""
    folder = workspace(spark, "ledger")
    lines = table(spark, sf, "events").select(F.col("event_type").alias("kind"), "event_id", F.to_json(F.struct(F.col("event_type").alias("model"), F.col("event_id").alias("tokens"))).alias("value"))
    lines.repartition("kind").sortWithinPartitions("kind", "event_id").select("kind", "value").write.partitionBy("kind").text(folder)
    return folders.ledger_tail(spark, folder, most=5000).groupBy("model").agg(F.count(F.lit(1)).alias("lines"), F.min("tokens").alias("earliest"))


def docx_body(lines: list[str], header: str, kind: int) -> bytes:
    """A small DOCX: paragraphs, of which the second lies in a table in a table, and a header; kind 1 has a text box, 2 is cut."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    paragraphs = [f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines]
    if len(paragraphs) > 1:
        paragraphs[1] = f"<w:tbl><w:tr><w:tc><w:tbl><w:tr><w:tc>{paragraphs[1]}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    if kind == 1:
        paragraphs.append("<w:p><w:txbxContent>box</w:txbxContent></w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {space}><w:body>{''.join(paragraphs)}</w:body></w:document>")
        archive.writestr("word/header1.xml", f"<w:hdr {space}><w:p><w:r><w:t>{escape(header)}</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()[: 60 if kind == 2 else None]


@query("""
SELECT item_id, CASE WHEN item_id % 7 NOT IN (1, 2) THEN sha256(text || chr(10) || 'item ' || item_id) END AS hash, CASE item_id % 7 WHEN 1 THEN 'DOCX has content that cannot be read in full' WHEN 2 THEN 'not a DOCX' ELSE '' END AS error
FROM (SELECT item_id, regexp_replace(text, ' ', chr(10)) AS text FROM benchmark)""")
def docx_files(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as DOCX files with nested tables and headers, read back; some have a text box, some are cut off."""
    folder = workspace(spark, "docx")

    def write(rows) -> None:
        for r in rows:
            at, path = folders.opened(f"{folder}/{r['item_id']}.docx")
            at.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with at.open_output_stream(path) as f:
                f.write(docx_body(r["text"].split(" ", 1), f"item {r['item_id']}", r["item_id"] % 7))

    table(spark, sf, "benchmark").select("item_id", "text").foreachPartition(write)
    item = F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long")
    return readers.docx_documents(spark, folder).select(item.alias("item_id"), F.sha2("text", 256).alias("hash"), F.coalesce("error", F.lit("")).alias("error"))
