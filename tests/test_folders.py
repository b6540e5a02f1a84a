"""Changes of a folder, as batch and stream, and tails of ledgers."""

from __future__ import annotations

import os

import pytest

from sievework.sources import folders, readers
from sievework.streaming import jobs


def seen(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_stream_of_changes(spark, tmp_path):
    top, state = tmp_path / "in", str(tmp_path / "state")
    (top / "sub").mkdir(parents=True)
    for k in range(12):
        (top / ("sub" if k % 2 else "") / f"f{k}.txt").write_text(f"text {k}")
    (top / "_hidden.txt").write_text("x")
    (top / "other.bin").write_text("x")

    def scan():
        stream = folders.folder_stream(spark, str(top), state, suffixes=".txt", content="true", maxBytes="100", pages="3")
        return jobs.into_files(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))

    first = scan()
    assert seen(first, "name", "change", "content") == sorted((f"f{k}.txt", "new", f"text {k}".encode()) for k in range(12))
    assert seen(scan(), "name") == seen(first, "name")  # nothing new, nothing repeated
    (top / "f0.txt").write_text("longer text")
    os.utime(top / "f2.txt", ns=(1, 1))  # touched, not changed
    (top / "f4.txt").unlink()
    (top / "f6.txt").rename(top / "sub" / "moved.txt")
    (top / "new.txt").write_text("n")
    (top / "large.txt").write_text("y" * 101)
    after = [r for r in seen(scan(), "name", "change", "error", "path") if r[1] != "new" or r[0] in ("new.txt", "moved.txt", "large.txt")]
    assert [r[:3] for r in after] == [("f0.txt", "changed", None), ("f4.txt", "removed", None), ("f6.txt", "removed", None), ("large.txt", "new", "too large"), ("moved.txt", "new", None), ("new.txt", "new", None)]
    assert len(os.listdir(state)) <= 2  # scans that are over are dropped


def test_renames(spark, tmp_path):
    rows = [("/a", "a", "removed", 1, 5, "v"), ("/b", "b", "new", 1, 5, "v"), ("/c", "c", "new", 1, 6, "v"), ("/d", "d", "removed", 1, 7, "w"), ("/e", "e", "changed", 1, 5, "v"), ("/f", "f", "new", 1, 5, "v")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], folders.CHANGE)
    assert seen(folders.with_renames(df), "path", "change") == [("/b", "renamed"), ("/c", "new"), ("/d", "removed"), ("/e", "changed"), ("/f", "new")]
    assert folders.with_renames(df).where("change = 'renamed'").first()["was"] == "/a"
    assert folders.with_renames(df.limit(0)).count() == 0


def test_page_read_again(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("a")
    stream = folders._Stream({"path": str(tmp_path / "in"), "state": str(tmp_path / "state"), "pages": "1", "content": "true"})
    page = folders.Page(0, 0, 5)
    once = list(stream.read(page))
    (tmp_path / "in" / "b").write_text("b")
    assert list(stream.read(page)) == once and len(once) == 1  # a batch that is read again gives what it gave
    (tmp_path / "in" / "a").write_text("other")
    again = list(stream.read(page))
    assert [(r[0], r[2], r[5], r[7]) for r in again] == [(once[0][0], "new", once[0][5], "changed since")]
    assert [(r[1], r[2]) for r in stream.read(folders.Page(0, 5, 6))] == [("a", "changed"), ("b", "new")]


def test_file_that_changes_while_it_is_read(tmp_path, monkeypatch):
    path = tmp_path / "in" / "a"
    path.parent.mkdir()
    path.write_text("a")
    scan = folders._Scan({"path": str(tmp_path / "in"), "pages": "1"})
    stat, calls = folders._stat, []

    def other(at, p):
        calls.append(p)
        if len(calls) == 2:
            path.write_text("meanwhile")
        return stat(at, p)

    monkeypatch.setattr(folders, "_stat", other)
    assert scan.changes({}, 0) == ([], {})
    assert [r[2] for r in scan.changes({}, 0)[0]] == ["new"]


def test_batch(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.txt").write_text(str(k))
    assert seen(folders.folder_changes(spark, str(tmp_path), pages="2"), "name", "change", "length") == [(f"{k}.txt", "new", 1) for k in range(5)]
    assert folders.folder_changes(spark, str(tmp_path / "none")).count() == 0


def test_tails(spark, tmp_path):
    lines = [f'{{"model":"m{k}é","tokens":{k}}}' for k in range(40)]
    body = "\n".join(lines[:20] + ["[1]", "torn {", ""] + lines[20:]).encode() + b'\n\xff\xfe\n{"model":"cut'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ledger.jsonl").write_bytes(body)
    spark.conf.set("spark.sql.shuffle.partitions", "4")

    def plain(n):
        start = max(0, len(body) - n)
        rest = body[start:] if not start or body[start - 1 : start] == b"\n" else body[start:].partition(b"\n")[2]
        return sorted(k for k, line in enumerate(lines) if line.encode() in rest.split(b"\n"))

    edges = [len(body) - body.index("é".encode()) - 1, len(body) - body.index(lines[30].encode()), len(body) - body.index(lines[30].encode()) - 1]
    for n in [1, 12, 300, *edges, len(body), 10**6]:
        got = readers_tokens(folders.ledger_tail(spark, str(tmp_path / "in"), most=n))
        assert got == plain(n), n
    assert readers.ledger(spark, str(tmp_path / "in")).count() == 40


def readers_tokens(df):
    return sorted(r.tokens for r in df.collect())


@pytest.mark.parametrize("path", ["/tmp/x", "file:/tmp/x", "file:///tmp/x"])
def test_paths(path):
    assert folders.opened(path)[1] == "/tmp/x"
