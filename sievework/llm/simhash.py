"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into seven blocks. Two that differ in at most four bits agree in at least three whole blocks, so
joining on every choice of three blocks (35 keys of 27 or 28 bits) meets every close pair; Hamming distance is then
checked. Equal fingerprints count as one from the start: neither copies nor their number reach the join.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import documents, stored
from sievework.llm.components import connected_components
from sievework.llm.tiles import TILE, link_in_tiles

WORDS = 4
SEED = 42
DISTANCE = 4
BLOCKS = 7


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of a text in UTF-8: a bit is set if it is in over half of the shingles' hashes; 0 without words."""
    split = text.lower().split()
    if not split:
        return 0
    if len(split) <= words:
        return xxhash.xxh64_intdigest(b" ".join(split), SEED)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    starts = np.concatenate([[0], ends[:-words]])
    digest = xxhash.xxh64_digest
    counts, total = np.zeros(64, np.int64), len(starts)
    for lo in range(0, total, 1 << 16):
        spans = zip(starts[lo : lo + (1 << 16)].tolist(), (ends[words - 1 :][lo : lo + (1 << 16)] - 1).tolist())
        raw = b"".join([digest(joined[a:b], SEED) for a, b in spans])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of the 64-bit hashes of a set of shingles; 0 of none."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        raw = hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8)
        counts += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = np.array([fingerprint(t.as_py() or b"", words) for t in part.column("text").cast(pa.binary())], np.uint64)
                yield part.drop_columns(["text"]).append_column("fp", pa.array(found.view(np.int64)))

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, row_hash: bool = False) -> DataFrame:
    """(id, h1, h2, fp) for every row: h1 and h2 are 128 bits of all its columns, if asked, and fp a signed long. A null text is empty."""
    hashed = _row_hash(df) if row_hash else [F.lit(0).cast("long")] * 2
    own = df.select(F.col(id_col).cast("long"), *hashed, F.col(text_col)).toDF("id", "h1", "h2", "text")
    return own.mapInArrow(_fingerprints(words), "id long, h1 long, h2 long, fp long")


def _row_hash(df: DataFrame) -> list[Column]:
    columns = [F.array_sort(F.map_entries(df[f"`{f.name}`"])) if f.dataType.typeName() == "map" else df[f"`{f.name}`"] for f in df.schema]  # a map has no hash
    return [F.xxhash64(*columns).alias("_h1"), F.xxhash64(F.lit(1), *columns).alias("_h2")]


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """A mask for each choice of blocks - distance blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(choice) for choice in itertools.combinations(parts, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _close(distance: int):
    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count((a ^ b).view(np.uint64)) <= distance

    return close


def fingerprint_links(fps: DataFrame, *, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the fingerprints that differ in at most `distance` bits: those of `fps` (fp long, distinct; stored)."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(block_masks(distance, blocks))])
    members = fps.select(F.explode(keys).alias("key"), F.col("fp").alias("node"))
    return link_in_tiles(members, _close(distance), tile=tile)


def fingerprint_components(fps: DataFrame, *, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(node, root) for every fingerprint that links with another: those of `fps` (fp long, distinct; stored)."""
    return connected_components(fingerprint_links(fps, distance=distance, blocks=blocks, tile=tile))


def _components_of(marked: DataFrame, distance: int) -> DataFrame:
    """(fp, best) for every fingerprint: best is the (no_id, id, h1, h2) of its component that comes first."""
    mine = F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")
    fps = stored(marked.groupBy("fp").agg(F.min(mine).alias("first")), "distinct-fingerprints")
    linked = fingerprint_components(fps.select("fp"), distance=distance)
    rooted = fps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("best"))
    return rooted.join(least, "root").select("fp", "best")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id: the smallest id reachable over links, its own included.

    Documents link when their fingerprints differ in at most `distance` bits. Texts of fewer words than a shingle hash
    whole; texts without words, null or empty ones too, share fingerprint 0 and link like any other. A null identifier
    is never the smallest unless a component has no other. Repeated rows link with each other. Long texts are hashed
    whole. Identifiers are whole numbers, or strings of such. Other columns, whatever their names, are ignored. An empty
    table gives an empty result.
    """
    marked = stored(fingerprints(df, id_col, text_col, words=words), "fingerprints")
    found = _components_of(marked, distance).select(F.col("fp").alias("_fp"), F.col("best.id").alias("component_id"))
    return marked.join(found, F.col("fp") == F.col("_fp")).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of `df` that stay when one row of each component does: that with the smallest identifier; see near_duplicates().

    Rows that are alike in every column are one row. Columns are those of `df`, whatever their names.
    """
    marked = stored(fingerprints(df, id_col, text_col, words=words, row_hash=True), "fingerprints")
    best = _components_of(marked, distance).select("best.h1", "best.h2").distinct()
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *_row_hash(df))
    left = rows.join(best, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")), "left_semi")
    once = left.withColumn("_n", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("_h1")))
    return once.where("_n = 1").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents: four-word shingles, four bits."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
