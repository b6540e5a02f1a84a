"""Near-duplicates by SimHash and the exact Jaccard similarity of word shingles, with MinHash bands for what SimHash cannot reach.

A text is its set of shingles; texts of the same set count as one from the start. Sets meet first by their SimHash
fingerprints: those that differ in at most four bits, found by pigeonhole blocks. That finds the closest copies, and one
pair in eighteen at a similarity of 0.8. So what is still apart meets by a signature of 40 bands of five minima: two sets
of similarity 0.8 share no band once in 8 million pairs, and more similar ones are missed less. Whether a candidate of
either kind links is decided on the whole sets, never on fingerprints or signatures. Close fingerprints give a forest, not
pairs; where an edge of it fails that check, the bands still compare the sets that hung on it.

A bucket may hold any share of the sets. First each member meets one centre of its bucket: the one that meets most others
over all bands, which is the text that a group of edited copies was made from, if it is there. Then members of a bucket
that are still in different components meet each other in tiles of bounded size, each pair in the first band it shares;
pairs whose signatures agree too little for the threshold (by more than six standard deviations) are not compared. A tile
gives a forest of links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import stored
from sievework.llm.components import connected_components
from sievework.llm.simhash import SEED, _row_hash, fingerprint_links, fingerprint_of
from sievework.llm.tiles import TILE, into_tiles, whole_groups

WORDS = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 5
#: Standard deviations of a signature's agreement below that of the threshold.
MARGIN = 6.5


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted, distinct 64-bit hashes of the shingles of a text in UTF-8; a shorter text is one shingle, one without words none."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(b" ".join(split[i : i + words]), SEED) for i in range(max(1, len(split) - words + 1))])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


@cache
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def minima(grams: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set that is not empty."""
    factor, plus = _factors()
    short, least = (grams >> np.uint64(32)).astype(np.uint32), None
    for lo in range(0, len(short), 2048):
        now = (short[lo : lo + 2048, None] * factor + plus).min(0)
        least = now if least is None else np.minimum(least, now)
    return least


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets have at least that Jaccard similarity; two empty ones have 1."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    union = len(np.unique(np.concatenate([a, b])))
    return len(a) + len(b) - union >= similarity * union - 1e-9


_SIGNED = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SIGNED_TYPES = "id long, h1 long, h2 long, node long, fp long, signature binary, bands array<long>"


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, rows = batch.slice(lo, 512), []
                for text in part.column("text").cast(pa.binary()):
                    grams = shingles(text.as_py() or b"", words)
                    least = minima(grams) if len(grams) else np.zeros(0, np.uint32)
                    held = least.tobytes()
                    bands = [xxhash.xxh64_intdigest(held[i * 4 * ROWS : (i + 1) * 4 * ROWS], i) for i in range(BANDS if held else 0)]
                    rows.append((xxhash.xxh64_intdigest(grams.tobytes(), SEED), fingerprint_of(grams), least.astype(np.uint8).tobytes(), np.array(bands, np.uint64).view(np.int64)))
                nodes, fps, signatures, keys = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h1"), part.column("h2"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=_SIGNED)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingles(t.as_py() or b"", words).tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(grams, pa.binary())], ["node", "grams"])

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda name: (np.frombuffer(x.as_py(), np.uint64) for x in batch.column(name))
            kept = pa.array([similar(a, b, similarity) for a, b in zip(of("grams_a"), of("grams_b"))], pa.bool_())
            yield batch.select(["a", "b"]).filter(kept)

    return run


def _links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(_verify(similarity), "a long, b long")


def _intersections(ids: list[np.ndarray], i: int, others: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many members of set i each of the others has; `seen` is a scratch array over all members, false before and after."""
    seen[ids[i]] = True
    found = np.array([np.count_nonzero(seen[ids[j]]) for j in others])
    seen[ids[i]] = False
    return found


def _linked(similarity: float):
    """Links of a tile between sets of different roots, as a forest."""
    n = BANDS * ROWS
    least = n * similarity - MARGIN * (n * similarity * (1 - similarity)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, 3):
            signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, n)
            keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            node, root, chunk, tile_a, tile_b, band = (table.column(c).to_numpy() for c in ("node", "root", "chunk", "tile_a", "tile_b", "band"))
            for lo, hi in zip(at[:-1], at[1:]):
                part = np.unique(root[lo:hi], return_inverse=True)[1]
                if part.max() == 0:
                    continue
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("grams").slice(lo, hi - lo)]
                sizes = np.array([len(x) for x in sets])
                once, place = np.unique(np.concatenate(sets), return_inverse=True)
                ids, seen = np.split(place, np.cumsum(sizes)[:-1]), np.zeros(len(once), bool)
                across, found = tile_a[lo] != tile_b[lo], []
                for i in range(hi - lo - 1):
                    j = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
                    if across:  # members of one chunk meet in that chunk's own tile
                        j = j[chunk[lo + j] != chunk[lo + i]]
                    j = j[np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]) - 1e-9]
                    j = j[(signatures[lo + j] == signatures[lo + i]).sum(1) >= least]
                    j = j[~(keys[lo + j, : band[lo]] == keys[lo + i, : band[lo]]).any(1)]  # else an earlier band compares them
                    if not len(j):
                        continue
                    common = _intersections(ids, i, j, seen)
                    for k in j[common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9]:
                        if part[k] != part[i]:
                            part[part == part[k]] = part[i]
                            found.append((node[lo + i], node[lo + k]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return run


def _fingerprint_pairs(signed: DataFrame, tile: int) -> DataFrame:
    """Pairs (a, b) that connect the sets whose fingerprints differ in few bits; of sets with one fingerprint, one stands for it."""
    own = stored(signed.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints")
    same = signed.select("node", F.col("fp").alias("_fp")).join(own, F.col("fp") == F.col("_fp")).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    edges = fingerprint_links(own.select("fp"), tile=tile).select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct()
    for end, name in (("_a", "a"), ("_b", "b")):
        edges = edges.join(own.select("fp", F.col("first").alias(name)), F.col(end) == F.col("fp")).drop("fp", end)
    return same.union(edges.select("a", "b"))


def _apart(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The pairs (a, b) that `rooted` (node, root) has in different components."""
    for name in ("a", "b"):
        of = rooted.select(F.col("node").alias(f"_n{name}"), F.col("root").alias(f"_r{name}"))
        pairs = pairs.join(of, F.col(name) == F.col(f"_n{name}"), "left")
    return pairs.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")


def similar_components(signed: DataFrame, texts: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(node, root) for every set that links with another: `signed` (node long, h1, h2, fp, signature, bands; a node once;
    stored). `texts` (h1, h2, text) are read again for the sets that meet by a fingerprint or share a band, whose shingles
    alone are kept."""
    near = stored(_fingerprint_pairs(signed, tile), "fingerprint-pairs")
    every = signed.select(F.posexplode("bands").alias("band", "key"), "node")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "_key")
    members = stored(every.join(shared, F.col("key") == F.col("_key")).select("key", "band", "node", "n"), "band-members")
    known = stored(members.groupBy("node").agg(F.sum("n").alias("meets")), "band-nodes")
    centre = members.join(known, "node").groupBy("key").agg(F.max(F.struct("meets", F.xxhash64("node").alias("h"), "node")).alias("c")).select(F.col("key").alias("_key"), F.col("c.node").alias("centre"))
    members = stored(members.join(stored(centre, "centres"), F.col("key") == F.col("_key")).select("key", "band", "node", "centre"), "band-members")
    met = known.select(F.col("node").alias("_node")).union(near.select("a")).union(near.select("b")).distinct()
    wanted = stored(signed.join(met, F.col("node") == F.col("_node"), "left_semi").select("node", F.col("h1").alias("_h1"), F.col("h2").alias("_h2")), "wanted-sets")
    found = texts.join(wanted, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("node", "text").mapInArrow(_sets(words), "node long, grams binary")
    sets = stored(found.dropDuplicates(["node"]), "shingle-sets")  # rows that are alike have one set
    closest = stored(_links(near, sets, similarity), "links")
    pairs = members.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    first = stored(closest.union(_links(_apart(pairs, connected_components(closest)), sets, similarity)), "links")
    rooted = members.select("key", "band", "node").join(connected_components(first).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted-members")
    open_ = rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count(F.lit(1)).alias("_n")).where("_a <> _b and _n > 2").select(F.col("key").alias("_key"))
    still = stored(rooted.join(open_, F.col("key") == F.col("_key"), "left_semi"), "open-members")
    full = signed.select(F.col("node").alias("_node"), "signature", "bands").join(sets.withColumnRenamed("node", "_same"), F.col("_node") == F.col("_same"))
    held = stored(still.join(full, F.col("node") == F.col("_node")).select("key", "band", "node", "root", "signature", "bands", "grams", F.octet_length("grams").alias("size")), "open-sets")
    tiles = into_tiles(held, tile=tile, size="size").select("key", "tile_a", "tile_b", "chunk", "band", "node", "root", "signature", "bands", "grams")
    return connected_components(stored(first.union(tiles.mapInArrow(_linked(similarity), "a long, b long")), "links"))


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """The rows of `df` that stay when one row of each component does: that with the smallest identifier.

    Rows link when their texts' shingle sets have at least that Jaccard similarity; texts without words, null or empty
    ones too, have equal sets. A null identifier is the smallest only where there is no other. Rows that are alike in
    every column are one row. Columns are those of `df`, whatever their names. Texts are read whole, however long.
    Identifiers are whole numbers, or strings of such. An empty table gives an empty result.
    """
    own = df.select(F.col(id_col).cast("long"), *_row_hash(df), F.col(text_col)).toDF("id", "h1", "h2", "text")
    marked = own.mapInArrow(_signed(words), _SIGNED_TYPES)
    mine = F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")
    signed = marked.groupBy("node").agg(F.min(mine).alias("first"), F.any_value("fp").alias("fp"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands"))
    signed = stored(signed.select("node", "first", "first.h1", "first.h2", "fp", "signature", "bands"), "distinct-sets")
    linked = similar_components(signed, own.select("h1", "h2", "text"), words=words, similarity=similarity, tile=tile).select(F.col("node").alias("_node"), "root")
    rooted = signed.select("node", "first").join(linked, F.col("node") == F.col("_node"), "left").select("first", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best")).select("best.h1", "best.h2").distinct()
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *_row_hash(df))
    left = rows.join(best, (F.col("_h1") == F.col("h1")) & (F.col("_h2") == F.col("h2")), "left_semi")
    numbered = left.withColumn("_n", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("_h1")))
    return numbered.where("_n = 1").select("row.*")
