"""Folders as sources: changes from scan to scan, as a batch or a stream, and the last bytes of ledgers.

Executors list, read and compare; the driver knows a scan's number only. Files are opened through pyarrow's file systems
(local and shared mounts, HDFS, S3, GCS), as these read parts of files and take a file's state before and after.
"""

from __future__ import annotations

import hashlib
import json
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from sievework.sources.readers import LEDGER_SCHEMA, parsed_lines

CHANGE = "path string, name string, change string, length long, modified long, version string, content binary, error string"
TAIL_BYTES = 5_000_000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A path with or without a scheme as a file system and the path in it."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _stat(at: fs.FileSystem, path: str) -> tuple[int, int] | None:
    info = at.get_file_info(path)
    return (info.size, info.mtime_ns) if info.type == fs.FileType.File else None


class Page(InputPartition):
    """One page of a folder's listing between two scans."""

    def __init__(self, page: int, start: int, end: int):
        super().__init__((page, start, end))
        self.page, self.start, self.end = page, start, end


class _Scan:
    """What batch and stream readers share. Options: path; state (a shared folder for what scans saw); pages; suffixes,
    comma-separated; maxBytes of a file whose content is wanted; content (true or false)."""

    def __init__(self, options: dict):
        self.path, self.state = options["path"], options.get("state")
        self.pages = int(options.get("pages", 8))
        self.suffixes = tuple(s for s in options.get("suffixes", "").lower().split(",") if s)
        self.most, self.content = int(options.get("maxbytes", 20 << 20)), options.get("content", "false").lower() == "true"

    def listed(self, page: int) -> dict[str, tuple[int, int]]:
        """Size and time of the page's files; hidden and unfinished ones, which begin with . or _, are no sources."""
        at, top = opened(self.path)
        found = at.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        own = (i for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")) and i.base_name.lower().endswith(self.suffixes or ""))
        return {i.path: (i.size, i.mtime_ns) for i in own if zlib.crc32(i.path.encode()) % self.pages == page}

    def _place(self, scan: int, page: int) -> str:
        return f"{self.state.rstrip('/')}/{scan}/{page}.json"

    def known(self, scan: int, page: int) -> dict[str, list] | None:
        """path -> [size, time, version] as a scan saw its page; None if it did not get there."""
        at, path = opened(self._place(scan, page))
        if at.get_file_info(path).type != fs.FileType.File:
            return None
        with at.open_input_stream(path) as f:
            return json.loads(f.read())

    def keep(self, scan: int, page: int, seen: dict[str, list]) -> None:
        at, path = opened(self._place(scan, page))
        at.create_dir(path.rsplit("/", 1)[0], recursive=True)
        draft = f"{path}.{hashlib.sha256(str(time.time_ns()).encode()).hexdigest()[:12]}"
        with at.open_output_stream(draft) as f:
            f.write(json.dumps(seen).encode())
        at.move(draft, path)

    def read_file(self, path: str, listed: tuple[int, int]) -> tuple[str, bytes | None, str | None] | None:
        """(version, content, error) of a file that is the same before and after it is read; None if it is not."""
        at, _ = opened(self.path)
        if _stat(at, path) != listed:
            return None
        large = self.content and listed[0] > self.most
        digest, parts = hashlib.md5(usedforsecurity=False), []
        try:
            with at.open_input_stream(path) as f:
                while part := f.read(1 << 20):
                    digest.update(part)
                    if self.content and not large:
                        parts.append(part)
        except OSError:
            return None
        if _stat(at, path) != listed:
            return None
        return digest.hexdigest(), b"".join(parts) if self.content and not large else None, "too large" if large else None

    def changes(self, before: dict[str, list], page: int) -> tuple[list[tuple], dict[str, list]]:
        """(rows of CHANGE, what the page holds now). A file of the same size and time is not read again. One that changes
        while it is read is left for the next scan, as it was known."""
        rows, seen = [], {}
        now = self.listed(page)
        for path, listed in sorted(now.items()):
            old = before.get(path)
            if old and tuple(old[:2]) == listed:
                seen[path] = old
                continue
            got = self.read_file(path, listed)
            if got is None:
                if old:
                    seen[path] = old
                continue
            version, content, error = got
            seen[path] = [*listed, version]
            if not old or old[2] != version:
                rows.append((path, path.rsplit("/", 1)[-1], "changed" if old else "new", listed[0], listed[1], version, content, error))
        rows += [(p, p.rsplit("/", 1)[-1], "removed", old[0], old[1], old[2], None, None) for p, old in sorted(before.items()) if p not in now]
        return rows, seen


class _Batch(DataSourceReader):
    """All files as new, or with the option `since` what changed after that scan."""

    def __init__(self, options: dict):
        self.scan, self.since = _Scan(options), int(options.get("since", 0))

    def partitions(self) -> list[Page]:
        return [Page(k, self.since, 0) for k in range(self.scan.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        known = self.scan.known(self.since, partition.page) if self.since else {}
        yield from self.scan.changes(known or {}, partition.page)[0]


class _Stream(DataSourceStreamReader):
    """Offsets are scans. What a scan saw of a page is kept before its rows go out, so a batch that is read again after a
    failure or a restart gives the changes between the same two listings."""

    def __init__(self, options: dict):
        self.scan, self.every = _Scan(options), float(options.get("interval", 0))
        if not self.scan.state:
            raise ValueError("a stream of changes needs the option state")

    def initialOffset(self) -> dict:
        return {"scan": 0}

    def latestOffset(self) -> dict:
        now = time.time_ns()
        return {"scan": int(now / 1e9 // self.every) if self.every else now}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(k, start["scan"], end["scan"]) for k in range(self.scan.pages)] if start["scan"] != end["scan"] else []

    def read(self, partition: Page) -> Iterator[tuple]:
        s, page = self.scan, partition.page
        before = (s.known(partition.start, page) if partition.start else {}) or {}
        seen = s.known(partition.end, page)
        if seen is None:
            rows, seen = s.changes(before, page)
            s.keep(partition.end, page, seen)
            yield from rows
            return
        for path, (size, modified, version) in sorted(seen.items()):  # read again: from what was kept
            old = before.get(path)
            if old and old[2] == version:
                continue
            got = s.read_file(path, (size, modified)) if s.content else (version, None, None)
            content, error = (got[1], got[2]) if got and got[0] == version else (None, "changed since")
            yield path, path.rsplit("/", 1)[-1], "changed" if old else "new", size, modified, version, content, error
        for path, old in sorted(before.items()):
            if path not in seen:
                yield path, path.rsplit("/", 1)[-1], "removed", old[0], old[1], old[2], None, None

    def commit(self, end: dict) -> None:
        """Scans before a committed one are not asked for again."""
        at, top = opened(self.scan.state)
        for i in at.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            if i.base_name.isdigit() and int(i.base_name) < end["scan"]:
                at.delete_dir(i.path)


class FolderChanges(DataSource):
    """What changed in a folder since the scan before: new, changed and removed files.

    Pages of the listing are partitions: a task lists the folder, keeps the names of its page, reads those whose size or
    time differs from what is known, and compares. A file's size and time are taken before and after its bytes are read.
    `version` is the MD5 of the content; a file that was only touched is not changed.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGE

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def folder_changes(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A batch of the changes; all files, without `since`."""
    spark.dataSource.register(FolderChanges)
    return spark.read.format("folder_changes").options(path=path, **options).load()


def folder_stream(spark: SparkSession, path: str, state: str, **options: str) -> DataFrame:
    """A stream of the changes: a scan for each trigger, or for each `interval` seconds."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").options(path=path, state=state, **options).load()


def with_renames(changes: DataFrame) -> DataFrame:
    """R2: of one scan's changes, a new file of the size, time and version of a removed one is that one, renamed.

    A renamed file has its old path in `was`; the removed row goes. Of several alike the paths pair in order: files of one
    content and time are few.
    """
    alike = ["length", "modified", "version"]
    order = Window.partitionBy("change", *alike).orderBy("path")
    numbered = changes.withColumn("_n", F.when(F.col("change").isin("new", "removed"), F.row_number().over(order)))
    gone = numbered.where("change = 'removed'").select(*[F.col(c).alias(f"_{c}") for c in alike], F.col("_n").alias("_m"), F.col("path").alias("was"))
    same = [F.col(c) == F.col(f"_{c}") for c in alike]
    moved = numbered.where("change = 'new'").join(gone, [*same, F.col("_n") == F.col("_m")], "left")
    new = moved.withColumn("change", F.when(F.col("was").isNotNull(), "renamed").otherwise("new")).select(*changes.columns, "was")
    left = numbered.where("change = 'removed'").join(new.where("change = 'renamed'").select(F.col("was").alias("_was")), F.col("path") == F.col("_was"), "left_anti")
    rest = numbered.where("change NOT IN ('new', 'removed')").unionByName(left)
    return new.unionByName(rest.select(*changes.columns, F.lit(None).cast("string").alias("was")))


def _tails(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, own = opened(path)
                start = max(0, size - most)
                with at.open_input_file(own) as f:
                    f.seek(max(0, start - 1))  # with the byte before, which tells whether a line starts there
                    body = f.read(size - max(0, start - 1))
                if start:
                    cut = body.find(b"\n")
                    body = body[cut + 1 :] if cut >= 0 else b""
                lines = []
                for raw in body.split(b"\n"):
                    try:
                        lines.append(raw.decode())
                    except UnicodeDecodeError:
                        continue
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(lines, pa.string())], ["path", "value"])

    return run


def ledger_tail(spark: SparkSession, path: str, schema: str = LEDGER_SCHEMA, most: int = TAIL_BYTES, pattern: str = "*") -> DataFrame:
    """What the last `most` bytes of each file of a ledger hold, without a line that the cut parts.

    Only these bytes are read. Torn lines, such as the last one of a file that is being written, and lines that are no JSON
    object or no UTF-8 are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parsed_lines(files.repartition(n).mapInArrow(_tails(most), "path string, value string"), schema)
