"""Token counts by source, language and tokenizer version, maintained by deltas.

A ledger is a folder. Every batch of changes adds one part to it: what the batch made of each document (its counts, or
that it is gone), and the signed change of the totals that follows: new counts come in, and what earlier batches had
counted for the same documents goes out. Totals are additive, so reading them adds up small tables and never recounts.

Parts are sorted by document and cut into files by their size. A batch looks up its documents in the stretches of
identifiers that it covers, and files and row groups outside these are skipped by their statistics: new and neighbouring
documents read a share of the state, documents from everywhere all of its narrow rows (some tens of bytes a document,
never a text). Every MERGE batches the parts are merged into one that has each living document once, so a look-up opens
a bounded number of parts, however many batches there were.

A batch counts only once its marker is there, which is written last; so does a merged part. Applying a committed batch
again does nothing; applying one that was broken off writes its parts anew. Both leave the same totals, so a driver that
loses track can send its batches again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import documents, shared_dir
from sievework.llm.langid import remainder
from sievework.llm.packing import byte_bpe

TOKENIZERS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Parts that are merged into one.
MERGE = 8
#: Stretches of identifiers that a look-up asks for at most, and bytes of a row group, which is what they skip.
STRETCHES, GROUP_BYTES = 64, 4 << 20
_STATE = "key string, source string, lang string, version string, tokens long, live boolean, place long"


def version_of(path: str) -> str:
    """The file's name and the beginning of its SHA-256: other contents are another version."""
    with open(path, "rb") as f:
        return f"{path.rpartition('/')[2].partition('.')[0]}@{hashlib.sha256(f.read()).hexdigest()[:12]}"


def _count(paths: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodings = {version: byte_bpe(path) for version, path in paths.items()}
        for batch in batches:
            keys, sources, langs, texts, live, place = (batch.column(c) for c in ("key", "source", "lang", "text", "live", "place"))
            counts = {v: [] for v in encodings}
            for text, alive in zip(texts, live.to_pylist()):
                content = text.as_py() or "" if alive else ""
                for version, encoding in encodings.items():
                    counts[version].append(len(encoding.encode_to_numpy(content, allowed_special="all")))
            for version, n in counts.items():
                yield pa.RecordBatch.from_arrays([keys, sources, langs, pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64()), live, place], ["key", "source", "lang", "version", "tokens", "live", "place"])

    return run


class TokenLedger:
    """A ledger at `path`, a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: list[str], *, merge: int = MERGE):
        self.spark, self.path, self.merge_after = spark, path.rstrip("/"), merge
        self.versions = {version_of(p): p for p in tokenizers}

    def _marked(self, folder: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{n}/_SUCCESS")))

    def committed(self) -> list[str]:
        """Names of the committed batches' folders, in the order of their commits."""
        return self._marked("commits")

    def parts(self) -> list[str]:
        """Names of the parts that hold all that is committed: the last merged one, and the batches after it."""
        merged, batches = self._marked("merges"), self.committed()
        return [f"merged-{merged[-1]}", *batches[int(merged[-1]) :]] if merged else batches

    def apply(self, batch_id: str, changes: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", live_col: str | None = None, order_col: str | None = None) -> bool:
        """Apply a batch; False if it was committed before.

        Each row of `changes` says what its document is now: its text, source and language or, where `live_col` is
        false, that it is deleted. Of several rows of one document the last by `order_col` holds, then the one with most
        tokens. A null identifier stands for its row's contents, so such rows can be added and are counted once. A null
        text has no tokens; null sources and languages are groups like others. Deleting what is not there does nothing. Long texts are counted
        whole; columns that are not named here, whatever their names, are ignored. An empty batch is committed and changes nothing.
        """
        token = hashlib.sha256(batch_id.encode()).hexdigest()[:16]
        done = self.committed()
        if any(n.partition("-")[2] == token for n in done):
            return False
        before, name = self.parts(), f"{len(done):08d}-{token}"
        text, source, lang = F.col(text_col), F.col(source_col).cast("string"), F.col(lang_col).cast("string")
        contents = F.concat(F.lit("#"), F.sha2(F.to_json(F.struct(text.alias("t"), source.alias("s"), lang.alias("l"))), 256))
        rows = changes.select(
            F.coalesce(F.col(id_col).cast("string"), contents).alias("key"), source.alias("source"), lang.alias("lang"), text.alias("text"),
            (F.coalesce(F.col(live_col), F.lit(True)) if live_col else F.lit(True)).alias("live"),
            (F.col(order_col).cast("long") if order_col else F.lit(0).cast("long")).alias("place"),
        )
        counted = rows.mapInArrow(_count(self.versions), _STATE)
        last = F.max_by(F.struct("source", "lang", "tokens", "live"), F.struct("place", "tokens", "live", "source", "lang"))
        state = counted.groupBy("key", "version").agg(last.alias("v")).select("key", "version", "v.*", F.lit(len(done)).cast("long").alias("batch"))
        self._write_state(state, name)
        now = self._state([name])
        changed = now.withColumn("sign", F.lit(1))
        if before:
            ours = self._state(before, self.stretches(name)).join(now.select("key", "version"), ["key", "version"], "left_semi")
            changed = changed.unionByName(self._latest(ours).withColumn("sign", F.lit(-1)))
        self._write_totals(changed.where("live"), name)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")
        if len(before) + 1 > self.merge_after:
            self.merge()
        return True

    def merge(self) -> None:
        """Put all parts into one, which has each living document once. The old ones stay for those who are reading them."""
        n = len(self.committed())
        if not n:
            return
        names, part = self.parts(), f"{n:08d}"
        self._write_state(self._latest(self._state(names)).where("live"), f"merged-{part}")
        self._write_totals(self._state([f"merged-{part}"]).withColumn("sign", F.lit(1)), f"merged-{part}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/merges/{part}")

    def _write_state(self, state: DataFrame, name: str) -> None:
        dealt = state.repartitionByRange("key", "version").sortWithinPartitions("key", "version")  # as many files as the size asks for
        dealt.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{self.path}/state/{name}")

    def stretches(self, name: str, most: int = STRETCHES) -> list[tuple[str, str]]:
        """The identifiers of a part, as at most so many stretches: one or more for each of its files, which are sorted."""
        pieces = self._state([name]).groupBy("_metadata.file_path", F.floor(F.col("_metadata.row_index") / (1 << 17))).agg(F.min("key").alias("a"), F.max("key").alias("b")).select("a", "b")
        found = sorted((r["a"], r["b"]) for r in pieces.collect())  # a row for each 131,072 of a batch
        step = -(-len(found) // most) or 1
        return [(found[k][0], max(b for _, b in found[k : k + step])) for k in range(0, len(found), step)]

    def _write_totals(self, changed: DataFrame, name: str) -> None:
        deltas = changed.groupBy("source", "lang", "version").agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")).where("docs <> 0 or tokens <> 0")
        deltas.write.mode("overwrite").parquet(f"{self.path}/totals/{name}")

    def _state(self, names: list[str], stretches: list[tuple[str, str]] | None = None) -> DataFrame:
        schema = "key string, version string, source string, lang string, tokens long, live boolean, batch long"
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/state/{n}") for n in names])
        if stretches is None:
            return rows
        return rows.where(reduce(lambda x, y: x | y, [F.col("key").between(a, b) for a, b in stretches], F.lit(False)))

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        """What the last batch made of each document."""
        rest = [c for c in rows.columns if c not in ("key", "version")]
        return rows.groupBy("key", "version").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("key", "version", "r.*")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens of all that is committed; groups without documents are left out."""
        schema = "source string, lang string, version string, docs long, tokens long"
        names = self.parts()
        parts = self.spark.read.schema(schema).parquet(*[f"{self.path}/totals/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)
        summed = parts.groupBy("source", "lang", "version").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        return summed.select("source", "lang", F.col("version").alias("tokenizer_version"), "n_docs", "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of all documents after batches that insert, revise, delete, bring back and repeat.

    One document in 16 first comes with another text and source, and one in 16 is deleted and comes back; a quarter is
    sent again as it was, and the first batch is sent twice. In the end each document counts as the table has it.
    """
    import public_tokenizers

    ledger = TokenLedger(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}", [public_tokenizers.path(n) for n in TOKENIZERS])
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang", F.lit(True).alias("live"))
    part = remainder("doc_id", 16)
    draft = F.when(part == 5, F.concat(F.lit("draft: "), "source")).otherwise(F.col("text"))
    first = docs.withColumn("text", draft).withColumn("source", F.when(part == 5, "drafts").otherwise(F.col("source"))).where(part < 12)
    gone = docs.withColumn("live", part != 9).withColumn("text", F.when(part != 9, F.col("text")))
    ledger.apply("first", first, live_col="live")
    ledger.apply("second", gone.where((part >= 12) | (part < 4) | part.isin(5, 9)), live_col="live")
    ledger.apply("third", docs.where(part == 9), live_col="live")
    ledger.apply("first", first, live_col="live")
    return ledger.totals()
