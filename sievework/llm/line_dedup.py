"""Line deduplication.

Lines are exploded to hashes of their keys, distinct documents are counted per hash, and the lines of keys that are in
too many documents go from all but one of them; what is left is put together again by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import documents, stored

MIN_KEY = 20
MIN_DOCS = 3


def line_key(line: bytes) -> bytes:
    """The line without [\\x20\\x09-\\x0D] at both ends, with A-Z lower-cased (exactly what bytes do)."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least)


def _hashes(text: bytes, least: int) -> list[bytes | None]:
    """Per line, the 128-bit hash of its key; None for keys too short to count."""
    digest = xxhash.xxh3_128_digest
    return [digest(key) if _long_enough(key := line_key(line), least) else None for line in text.split(b"\n")]


def _explode(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids, keys, counts = part.column(0), [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    own = {h for h in _hashes(text, least) if h} if text else ()
                    keys.extend(own)
                    counts.append(len(own))
                halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                rows = np.repeat(np.arange(part.num_rows), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), ids.take(pa.array(rows))], ["h1", "h2", "id"])

    return run


def _reassemble(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                kept, n_lines, n_dropped = [], [], []
                for text, first, second in zip(part.column("_text").cast(pa.binary()).to_pylist(), part.column("_h1"), part.column("_h2")):
                    lines = text.split(b"\n")
                    n_lines.append(len(lines))
                    if first.is_valid:
                        gone = np.stack([first.values.to_numpy(), second.values.to_numpy()], 1)
                        drop = {row.tobytes() for row in gone}
                        left = [line for line, h in zip(lines, _hashes(text, least)) if h is None or h not in drop]
                        n_dropped.append(len(lines) - len(left))
                        kept.append(b"\n".join(left))
                    else:
                        n_dropped.append(0)
                        kept.append(text)
                out = part.drop_columns(["_text", "_h1", "_h2"])
                for name, values, kind in (("n_lines", n_lines, pa.int64()), ("n_dropped", n_dropped, pa.int64()), ("kept_text", pa.array(kept, pa.binary()).cast(pa.string()), None)):
                    out = out.append_column(name, pa.array(values, kind) if kind else values)
                yield out

    return run


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, carry: bool = False, min_key: int = MIN_KEY, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept_text; with `carry` also `row`, all columns but the text.

    Keys of at least `min_key` code points that are in at least `min_docs` different documents lose all their lines
    except in the document with the largest identifier. A null or empty text is one empty line. Rows with one
    identifier are one document; a null identifier is a document too, the smallest. A document whose lines all go
    keeps an empty text. Long texts are read whole; a text's lines are held at once. Identifiers are whole numbers, or
    strings of such. Columns of any names travel in `row`. An empty table gives an empty result.

    The hash has 128 bits. Counting goes through (key, document), so a line that is everywhere is counted by many
    tasks; the join back to its documents is one that adaptive execution splits.
    """
    ident = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = df.select(ident.alias("id"), F.col(text_col)).mapInArrow(_explode(min_key), "h1 long, h2 long, id long")
    pairs = lines.distinct()
    # Stored, so that the join below has an exchange of its own on either side: only then is a hot line's part split.
    common = stored(pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n"), "common-lines")
    drops = (
        lines.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("h"))
        .select(F.col("id").alias("_id"), F.col("h.h1").alias("_h1"), F.col("h.h2").alias("_h2"))
    )
    rest = [F.struct(*[df[f"`{c}`"] for c in df.columns if c != text_col]).alias("row")] if carry else []
    whole = df.select(F.col(id_col).alias("id"), *rest, text.alias("_text"))
    joined = whole.join(drops, F.col("id").cast("long").eqNullSafe(F.col("_id")), "left").drop("_id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema if f.name != "_text")
    return joined.mapInArrow(_reassemble(min_key), f"{kinds}, n_lines long, n_dropped long, kept_text string").withColumnRenamed("id", id_col)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines() of all documents; a null text is one empty line."""
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT m.doc_id, m.pos, m.line, c.keeper IS NOT NULL AND c.keeper <> m.doc_id AS gone
  FROM keyed m LEFT JOIN common c ON m.k = c.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
