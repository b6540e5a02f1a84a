"""The schedule of the mix stage decides places in the packed result."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as pipeline
from sievework.llm import mixing
from sievework.llm.packing import _rank_by_place, pack_documents, pack_in_order, with_place


def test_weights_change_packing(spark, tmp_path):
    rows = [(i, f"text {i} " * (1 + i % 5) * 20, "a" if i % 4 else "b") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "in"))
    found = []
    for k, weights in enumerate([{"a": 0.9, "b": 0.1}, {"a": 0.1, "b": 0.9}]):
        mixing.in_mix_order(spark.read.parquet(str(tmp_path / "in")), weights, block_rows=4).write.parquet(str(tmp_path / str(k)))
        packed = pipeline.pack(spark, spark.read.parquet(str(tmp_path / str(k))), "").collect()
        assert {r.doc_id for r in packed} == set(range(160))
        n = 1 + max(r.sequence_id for r in packed)
        assert {r.sequence_id for r in packed} == set(range(n))
        early = [r.doc_id for r in packed if r.sequence_id < n // 2]
        found.append((sorted((r.doc_id, r.sequence_id, r.offset) for r in packed), sum(i % 4 == 0 for i in early) / len(early)))
    assert found[0][0] != found[1][0] and found[0][1] < found[1][1]


def test_order_is_followed(spark, tmp_path):
    df = spark.createDataFrame([(i, "a" + " word" * (7 * i % 30)) for i in range(400)], "doc_id long, text string")
    df_order, rows = "doc_id", df.collect()
    random.Random(5).shuffle(rows)
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, df.schema).repartition(3).write.parquet(path)
    table = spark.read.parquet(path)
    at = {r[df_order]: (r["file"], r["row"]) for r in table.select(df_order, "_metadata.file_name", "_metadata.row_index").toDF(df_order, "file", "row").collect()}
    got = pack_in_order(table, capacity=64).collect()
    assert len(got) == 400 and len({(r.sequence_id, r.offset) for r in got}) == 400
    first, by_length = {}, {}
    for r in got:
        first[r.sequence_id] = min(first.get(r.sequence_id, ("~",)), at[r.doc_id])
        by_length.setdefault(r.length, []).append(at[r.doc_id])
    assert [first[s] for s in sorted(first)] == sorted(first.values())
    assert sorted(first) == list(range(len(first)))


def order_of(df):
    """What pack_in_order() should give a piece for each of: place in the table, as row."""
    return [(r.doc_id, r.text) for r in with_place(df.select("doc_id", "text", "_metadata")).orderBy("place").collect()]


@pytest.mark.parametrize("kind", ["several files a part", "two writes", "other names"])
def test_every_row_once(spark, tmp_path, kind):
    rows = [(None if i % 50 == 9 else i, None if i % 7 == 0 else "w " * (i % 40), "x", 1) for i in range(200)] + [(3, "same", "x", 1)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, place string, piece int").coalesce(2)
    path = str(tmp_path / "docs")
    if kind == "several files a part":
        df.write.option("maxRecordsPerFile", 20).parquet(path)
    else:
        df.write.parquet(path)
    if kind == "two writes":
        df.write.mode("append").parquet(path)
    if kind == "other names":
        for k, f in enumerate(sorted((tmp_path / "docs").glob("part-*"))):
            f.rename(f.with_name(f"data{k}.parquet"))
    table = spark.read.parquet(path)
    n = len(rows) * (2 if kind == "two writes" else 1)
    got = pack_in_order(table, capacity=64).collect()
    plain = pack_documents(table, capacity=64).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, plain)) and sum(r.piece == 0 for r in got) == n
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and len({r.sequence_id for r in got}) == len({r.sequence_id for r in plain})
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= 64
        ends[r.sequence_id] = r.offset + r.length
    if kind == "several files a part":
        assert sorted(map(str, order_of(table))) == sorted(str((a, b)) for a, b, *_ in rows)
        names = [r[0] for r in table.select("_metadata.file_name").distinct().collect()]
        assert len(names) > 4
    if kind == "other names":
        assert pack_in_order(table.where("false")).count() == 0


def test_ranks_over_ranges_and_stretches(spark):
    places = [(k, (f << 40) + i * step) for k in (0, 1) for f in (0, 2) for i, step in ((i, 5000) for i in range(300))] + [(0, 1 << 30), (0, (1 << 30) + 1)]
    df = spark.createDataFrame(places, "k int, place long")
    got = sorted((r.k, r.place, r.n) for r in _rank_by_place(df, "k", ["place"], "n").collect())
    want = [(k, p, n) for k in (0, 1) for n, p in enumerate(sorted(p for q, p in places if q == k))]
    assert got == sorted(want)
