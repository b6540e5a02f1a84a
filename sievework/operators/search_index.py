"""A kept lexical index, so that a question reads the postings of its words and no texts.

A posting is a word of a document with its places, as differences, and what stands between each of them and the next
word. Postings lie in buckets by word, sorted, so a question opens a few files and, by their statistics, few parts of
them. A batch of changed documents is a segment of its own with a list of the documents that it replaces or takes away;
merging writes the living postings of all segments as one. A manifest names the segments that count, so a batch that
comes again changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.text import has_term

BUCKETS = 64
#: Postings of a word are dealt to so many parts of its bucket, as a word may be in every document.
PARTS = 4

_POSTING = "token string, doc long, gaps array<int>, after array<bigint>, segment long, bucket int"
_WORD = r"(?U)(\w+)(\W*)"


def folded(word: Column) -> Column:
    """Case is folded as in lower case; marks stay."""
    return F.lower(word)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc, token, after: lists in the order of the text) as postings; a document's words never leave its task."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            words = part.column("token").flatten().dictionary_encode()
            doc, sizes = pc.list_parent_indices(part.column("token")).to_numpy().astype(np.int64), pc.list_value_length(part.column("token")).to_numpy()
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            code = words.indices.to_numpy().astype(np.int64)
            order = np.argsort(doc * max(1, len(words.dictionary)) + code, kind="stable")
            doc, code, pos = doc[order], code[order], pos[order]
            first = np.ones(len(doc), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
            at = np.flatnonzero(first)
            gaps = np.where(first, pos, pos - np.roll(pos, 1)).astype(np.int32)
            ends = pa.array(np.append(at, len(doc)), pa.int32())
            after = part.column("after").flatten().take(pa.array(order))
            lists = (pa.ListArray.from_arrays(ends, x) for x in (pa.array(gaps), after))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[at])), part.column("doc").take(pa.array(doc[at])), *lists], ["token", "doc", "gaps", "after"])


def postings(docs: DataFrame) -> DataFrame:
    """(token, doc, gaps, after) of documents (doc long, text): a row for each different word of each. Nothing is shuffled."""
    words, between = (F.regexp_extract_all("text", F.lit(_WORD), i) for i in (1, 2))
    lists = docs.where("text IS NOT NULL").select("doc", F.transform(words, folded).alias("token"), F.transform(between, lambda s: F.xxhash64(s)).alias("after"))
    return lists.mapInArrow(_grouped, "token string, doc long, gaps array<int>, after array<bigint>")


class SearchIndex:
    """An index at `path`, a folder that all tasks share. Commits are numbered by the caller, upwards."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        where, fs = self._fs("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"manifests/{n}/_SUCCESS")[0]))

    def segments(self, before: int | None = None) -> list[int]:
        """The segments that count after the last commit, or after the last one before a number."""
        done = [n for n in self.commits() if before is None or n < before]
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{done[-1]}").first()[0]) if done else []

    def _commit(self, n: int, segments: list[int]) -> None:
        self.spark.createDataFrame([(json.dumps(segments),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/{n}")

    def _write(self, n: int, found: DataFrame) -> None:
        bucketed = found.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int"))
        dealt = bucketed.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(PARTS))).sortWithinPartitions("bucket", "token", "doc")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/segments/{n}/postings")

    def apply(self, batch: DataFrame, n: int) -> None:
        """Documents (doc long, text) replace what is there; a null text takes a document away. A document has one row."""
        docs = batch.select(F.col("doc").cast("long").alias("doc"), "text").where("doc IS NOT NULL")
        self._write(n, postings(docs.where("text IS NOT NULL")))
        docs.select("doc", F.lit(n).cast("long").alias("until")).write.mode("overwrite").parquet(f"{self.path}/segments/{n}/replaced")
        self._commit(n, [*self.segments(n), n])

    def _postings(self, segments: list[int], tokens: list[str] | None) -> DataFrame:
        """Living postings of the segments, or of some words only: their buckets, and in these the parts that can hold them."""
        if not segments:
            return self.spark.createDataFrame([], _POSTING)
        kept = None
        if tokens is not None:
            named = self.spark.createDataFrame([(t,) for t in sorted(set(tokens))], "t string").select(F.pmod(F.xxhash64("t"), F.lit(self.buckets)).cast("int")).distinct()
            kept = [r[0] for r in named.collect()]  # of a question's few words
        frames = []
        for s in segments:
            own = self.spark.read.schema(_POSTING.replace(", segment long", "")).option("basePath", f"{self.path}/segments/{s}/postings").parquet(f"{self.path}/segments/{s}/postings")
            if kept is not None:
                own = own.where(F.col("bucket").isin(*kept) & F.col("token").isin(*sorted(set(tokens))))
            frames.append(own.withColumn("segment", F.lit(s).cast("long")))
        every = reduce(DataFrame.unionByName, frames)
        if len(segments) == 1:
            return every
        gone = self.spark.read.schema("doc long, until long").parquet(*[f"{self.path}/segments/{s}/replaced" for s in segments[1:]])
        dead = gone.groupBy("doc").agg(F.max("until").alias("until")).withColumnRenamed("doc", "_doc")
        return every.join(dead, F.col("doc") == F.col("_doc"), "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("_doc", "until")

    def merge(self, n: int) -> None:
        """One segment of all that lives; others are no longer read."""
        held = self.segments(n)
        self._write(n, self._postings(held, None).select("token", "doc", "gaps", "after"))
        self.spark.createDataFrame([], "doc long, until long").write.mode("overwrite").parquet(f"{self.path}/segments/{n}/replaced")
        self._commit(n, [n])

    def holding(self, term: str, texts: DataFrame | None = None) -> DataFrame:
        """Documents that hold a term as has_term() does: as whole words, whatever their case.

        Words of a phrase must follow each other with just what stands between them. A term that begins or ends with
        something else than a word, such as c++, is looked up by its words and then checked in the `texts` (doc, text) of what they
        leave; one without words is looked for in all of them.
        """
        words, between = re.findall(r"\w+", term), re.findall(r"(?<=\w)\W+(?=\w)", term)
        edges = bool(re.match(r"\W", term) or re.search(r"\W$", term))
        if (edges or not words) and texts is None:
            raise ValueError(f"{term!r} needs the texts")
        if not words:
            return texts.where(has_term("text", term)).select("doc")
        low = [w.lower() for w in words]
        found = self._postings(self.segments(), low)
        if len(words) == 1:
            docs = found.select("doc").distinct()
        else:
            asked = self.spark.createDataFrame([(j, w, s) for j, (w, s) in enumerate(zip(low, [*between, None]))], "j int, w string, s string").select("j", "w", F.when(F.col("s").isNotNull(), F.xxhash64("s")).alias("h"))
            # Places are sums of differences: a window over a document's own postings of a word.
            steps = found.select("token", "doc", F.posexplode(F.arrays_zip("gaps", "after")).alias("i", "x"))
            running = Window.partitionBy("token", "doc").orderBy("i")
            at = steps.select("token", "doc", F.struct(F.sum("x.gaps").over(running).alias("pos"), F.col("x.after").alias("after")).alias("x")).select("token", "doc", F.col("x.pos").alias("pos"), F.col("x.after").alias("after"))
            met = at.join(F.broadcast(asked), F.col("token") == F.col("w")).where(F.col("h").isNull() | (F.col("h") == F.col("after")))  # a term's few words
            docs = met.groupBy("doc", (F.col("pos") - F.col("j")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words)).select("doc").distinct()
        return texts.join(docs, "doc", "left_semi").where(has_term("text", term)).select("doc") if edges else docs

    def search(self, terms: list[str], any_term: bool = False, texts: DataFrame | None = None) -> DataFrame:
        """Documents that hold all terms, or any of them."""
        each = [self.holding(t, texts).select("doc", F.lit(k).alias("k")) for k, t in enumerate(dict.fromkeys(terms))]
        if not each:
            return self.spark.createDataFrame([], "doc long")
        met = reduce(DataFrame.unionByName, each).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
        return met.where(F.col("n") >= (1 if any_term else len(each))).select("doc")
