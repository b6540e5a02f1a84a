"""Exact deduplication by content sort.

Rows are range-partitioned on their normalised bytes by sampled splitters and sorted outside memory, which puts equal
texts side by side; comparing whole neighbouring texts then finds the groups.

A splitter is the first 32 characters, a hash of the whole text and the identifier, never a whole text: what is
sampled and sent to every task stays small however long documents are, and a group of copies, whatever its size, is
cut at identifiers and spread over as many partitions as its rows need. Groups that a cut runs through are the first
and last of their partitions; these few runs are merged by whole text afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import SPACE_CLASS, documents, stored

_RUN = "id long, n_chars long, head boolean, run long, size long, best_id long, best_n long, sha string, edge_text string"
_ARROW = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("head", pa.bool_()), ("run", pa.int64()), ("size", pa.int64()), ("best_id", pa.int64()), ("best_n", pa.int64()), ("sha", pa.string()), ("edge_text", pa.string())])


class _Runs:
    """Groups equal neighbours of one sorted partition; holds identifiers and lengths of one run, and one text."""

    def __init__(self, partition: int):
        self.next_run = partition << 40
        self.out: list[tuple] = []
        self.ready: list[pa.RecordBatch] = []
        self.waiting: list[tuple] = []  # runs of the current hash: known to touch an edge only when the partition ends
        self.first_hash = self.hash = None
        self.text = None
        self.ids: list = []
        self.lengths: list = []

    def add(self, ident, length, hashed, text) -> None:
        if self.ids and text == self.text:
            self.ids.append(ident)
            self.lengths.append(length)
            return
        self.close()
        if self.hash != hashed or self.first_hash is None:
            self.settle(edge=self.hash is not None and self.hash == self.first_hash)
            self.hash = hashed
            if self.first_hash is None:
                self.first_hash = hashed
        self.text, self.ids, self.lengths = text, [ident], [length]

    def close(self) -> None:
        if self.ids:
            self.waiting.append((self.text, self.ids, self.lengths))
            self.ids = []

    def settle(self, edge: bool) -> None:
        for text, ids, lengths in self.waiting:
            at = min(range(len(ids)), key=lambda i: (-lengths[i], ids[i] is None, ids[i] or 0))
            sha = hashlib.sha256(text.encode()).hexdigest()
            for i, ident in enumerate(ids):
                self.out.append((ident, lengths[i], i == at, self.next_run, len(ids), ids[at], lengths[at], sha, text if edge and not i else None))
                if len(self.out) >= 4096:
                    self.ready.append(self._packed())
            self.next_run += 1
        self.waiting = []

    def end(self) -> None:
        self.close()
        self.settle(edge=True)

    def _packed(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        columns = list(zip(*out)) or [()] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW)], schema=_ARROW)

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What is settled, packed some rows at a time, as a run may be a partition long."""
        while self.ready:
            yield self.ready.pop(0)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    runs = _Runs(TaskContext.get().partitionId())
    for batch in batches:
        ids, lengths, hashes, texts = (batch.column(i) for i in range(4))
        for lo in range(0, batch.num_rows, 512):
            part = slice(lo, lo + 512)
            for row in zip(ids[part].to_pylist(), lengths[part].to_pylist(), hashes[part].to_pylist(), texts[part].to_pylist()):
                runs.add(*row)
            yield from runs.taken()
    runs.end()
    yield from runs.taken()
    yield runs._packed()


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after deleting every character of [\\x20\\x09-\\x0D]; a null text counts as empty, so
    empty, blank and null texts form one group. Of equal texts the row with most code points in the original text,
    then the smallest identifier, stays; a null identifier comes last. Of wholly repeated rows exactly one is kept. Rows of
    one identifier, or of none, are as many as they are: a row's place among them also cuts partitions. Long texts are read whole.
    Identifiers are whole numbers, or strings of such. An empty table gives an empty result. Other columns of `df` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, SPACE_CLASS + "+", "").alias("norm"))
    rows = rows.select("id", "n_chars", F.xxhash64("norm").alias("hash"), "norm", F.substring("norm", 1, 32).alias("prefix"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange("prefix", "hash", "id", "place").sortWithinPartitions("prefix", "hash", "norm", "id").select("id", "n_chars", "hash", "norm")
    runs = stored(dealt.mapInArrow(_find_runs, _RUN), "exact-runs")

    best = F.struct(-F.col("best_n"), F.col("best_id").isNull(), F.col("best_id").alias("id"), F.col("run").alias("run"))
    merged = (
        runs.where("edge_text is not null").groupBy("edge_text").agg(F.sum("size").alias("whole"), F.min(best).alias("best"), F.collect_list("run").alias("runs"))
        .select(F.explode("runs").alias("run"), "whole", F.col("best.id").alias("keep"), F.col("best.run").alias("keep_run"))
    )
    # The runs at the edges of range partitions: two a partition (more only where 64-bit hashes collide), 40 bytes each.
    found = runs.drop("edge_text").join(F.broadcast(merged), "run", "left")
    cut = F.col("whole").isNotNull()
    return found.select(
        F.col("id").alias(id_col),
        F.when(cut, F.col("keep")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("whole", "size").alias("group_size"),
        (F.col("head") & F.coalesce(F.col("keep_run") == F.col("run"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_groups() of all documents; a null text is empty."""
    return exact_groups(documents(spark, sf_dir))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM g
"""
