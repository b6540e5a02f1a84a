from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sievework.sources import readers, writers
from sievework.streaming import jobs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str, **more: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, xml in more.items():
            z.writestr(f"word/{name}.xml", xml)
    return out.getvalue()


def test_docx():
    p = "<w:p><w:r><w:t>Jane</w:t></w:r><w:r><w:t> Doe</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    assert readers.docx_text(docx(p + table, header1=f"<w:hdr {W}>{p}</w:hdr>")) == ("Jane Doe\ncell\nJane Doe", None)
    assert readers.docx_text(b"nope")[1] == "not a DOCX"
    assert readers.docx_text(docx("<w:drawing/>"))[0] is None
    assert readers.docx_text(docx(p, footnotes=f"<w:footnotes {W}>{p}</w:footnotes>"))[1] == "DOCX has notes"


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfh\xc3\xa9")
    (tmp_path / "b.txt").write_bytes(b"x\0y")
    (tmp_path / "c.TXT").write_bytes(b"\xff\xfe")
    (tmp_path / "d.docx").write_bytes(docx("<w:p><w:r><w:t>d</w:t></w:r></w:p>"))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    got = {r.path[-5:].lstrip("/"): (r.text, r.error) for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("hé", None)
    assert got["b.txt"] == (None, "Text contains binary content") and got["c.TXT"] == (None, "not UTF-8")
    assert got[".docx"] == ("d", None) and got["e.pdf"] == (None, "unsupported format")
    assert readers.listing(spark, str(tmp_path), "*.txt", 3).count() == 1


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert readers.ledger(spark, path).count() == 0
    df = spark.createDataFrame([(1.0, "m", 2, 100, "local", "document", None), (2.0, "m", 1, 100, "voyage", "query", 42)], readers.LEDGER_SCHEMA)
    writers.append_ledger(df, path)
    (tmp_path / "ledger" / "torn.json").write_text('{"at": 3, "model"\n[1]\n"x"\n\n')
    assert sorted(r.at for r in readers.ledger(spark, path).collect()) == [1.0, 2.0]


def test_sql_and_schema(spark):
    df = spark.range(5)
    assert readers.one(spark, "SELECT count(*) AS n FROM {t} WHERE id > :low", {"low": 2}, t=df).n == 2
    assert readers.schema_plan(spark.createDataFrame([], "a int, b double, c string"), ["a"]) == [("a", "bigint", True), ("b", "double precision", False), ("c", "text", False)]


def test_embedding_cache(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, text string")
    cached = df.where("id = 2").select(readers.cache_key("m", "document", F.col("text")).alias("key"), F.array(F.lit(9.0)).alias("embedding"))
    rows, fresh = readers.embedded(df, cached, lambda texts: [[float(len(t))] for t in texts], "m")
    assert {r.id: r.embedding for r in rows.collect()} == {1: [1.0], 2: [9.0], 3: [1.0]} and fresh.count() == 1


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"role_id": "r", "jd_hash": "h", "body": "x"}]')
    wanted = spark.createDataFrame([("r", "h"), ("r", "i")], "role_id string, jd_hash string")
    assert readers.manifest(spark, str(tmp_path / "m.json"), "role_id string, jd_hash string, body string", wanted, ["role_id", "jd_hash"]).count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1"), (2, 'a "b", c')], "id int, x string")
    writers.write_report({"sheet": df}, str(tmp_path / "r"))
    assert sorted(r.x for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r/sheet")).collect()) == ["'=1", 'a "b", c']
    path = str(tmp_path / "mirror")
    assert writers.mirror({"t": df, "leases": df}, path) == ["t"]
    with pytest.raises(FileExistsError):
        writers.mirror({"t": df}, path)
    writers.mirror({"t": df}, path, reset=True)
    assert writers.drop_mirror(spark, path) and not writers.exists(spark, path)
    assert writers.snapshot(df, str(tmp_path / "s"), ["id"]).count() == 2


def test_stream_merge(spark, tmp_path):
    schema = "id long, v string, at long"
    source = str(tmp_path / "in")
    start = spark.createDataFrame([(1, "a", 0), (9, "z", 0)], schema)
    spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "x", 1)], schema).coalesce(1).write.parquet(source)
    merged = jobs.MergedTable(spark, str(tmp_path / "out"), start, ["id"], "at", bucket_rows=1)
    stream = jobs.watched(spark, source, schema)
    stream.writeStream.foreachBatch(merged.apply).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    merged.apply(spark.read.schema(schema).parquet(source), 0)  # sent again
    assert sorted(tuple(r) for r in merged.read().collect()) == [(1, "c", 2), (2, "x", 1), (9, "z", 0)]
    for _ in range(2):
        merged.apply(spark.createDataFrame([(2, "y", 5), (3, "n", 5)], schema), 1)
    assert sorted(tuple(r) for r in merged.read().collect()) == [(1, "c", 2), (2, "y", 5), (3, "n", 5), (9, "z", 0)]
    assert len(merged.manifest(1)) == 8 and sum(n == 1 for n, _ in merged.manifest(1).values()) <= 2  # other buckets are as they were


def test_merged_table_grows_and_cleans_up(spark, tmp_path):
    schema, path = "id long, k string, v long", str(tmp_path / "t")
    merged = jobs.MergedTable(spark, path, spark.createDataFrame([(None, None, 0), (1, "a", 0)], schema), ["id", "k"], "v", bucket_rows=50)
    want = {(None, None): 0, (1, "a"): 0}
    for n in range(4):
        rows = [(i, "a", n) for i in range(n * 60)] + [(None, None, n), (None, "a", n), (1, None, n)]
        for _ in range(2):
            merged.apply(spark.createDataFrame(rows, schema), n)
        want |= {(i, k): v for i, k, v in rows}
        assert {(r.id, r.k): r.v for r in merged.read().collect()} == want and merged.read().count() == len(want)
    assert len(merged.manifest(3)) == 4  # of 123 rows before the batch, 50 a bucket
    assert merged.batches() == [2, 3]
    left = {(int(p.parent.name.split("=")[1]), int(p.name.split("=")[1])) for p in (tmp_path / "t" / "data").glob("batch=*/_bucket=*")}
    named = {(n, b) for m in (2, 3) for b, (n, rows) in merged.manifest(m).items() if rows}
    assert left == named


def test_versions_around_a_read(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(name)

    def meanwhile():
        (tmp_path / "a.txt").write_text("longer")
        (tmp_path / "b.txt").unlink()
        (tmp_path / "d.txt").write_text("d")

    kept = lambda between, **x: [r.path[-5] for r in readers.unchanged(spark, str(tmp_path), between, **x).collect()]
    assert kept(meanwhile) == ["c"] and sorted(kept(lambda: None)) == ["a", "c", "d"] and sorted(kept(lambda: None, max_bytes=3)) == ["c", "d"]


def test_settings(spark, tmp_path):
    path = str(tmp_path / "s")
    for at, value in enumerate(['{"x": 1}', "2"]):
        writers.put_settings(spark.createDataFrame([("k", value, at)], "key string, value string, at long"), path)
    assert readers.setting(spark, path, "k") == "2" and readers.setting(spark, path, "l", "0") == "0"


def test_stream_repeats_and_attempts(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", False), (1, "2024-01-01 00:01:00", False), (2, "2024-01-01 00:02:00", True)], "id long, at string, ok boolean").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(source)
    jobs.run_to_end(jobs.without_repeats(jobs.watched(spark, source, df.schema), ["id"], "at"), "once", str(tmp_path / "a"), "append")
    assert spark.table("once").count() == 2
    jobs.run_to_end(jobs.attempts(jobs.watched(spark, source, df.schema), "id", "at"), "tried", str(tmp_path / "b"), "update")
    assert sorted(tuple(r) for r in spark.table("tried").collect()) == [(1, 2, "retry"), (2, 0, "queued")]
