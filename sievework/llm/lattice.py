"""Embedding near-duplicates by lattice hashing.

A vector of unit length is projected at random to two blocks of eight dimensions; each block is decoded to its nearest
point of the lattice E8, and the two points together are its cell in that table. Close vectors that a cell wall parts
are met by probing: a vector also visits the cells that lie nearest to it, one block moved to a neighbouring point. Two
vectors meet in a table if one of them visits or shares the other's home. Whatever meets is verified by cosine in double
precision; only pairs at or above the threshold link.

Buckets are compared in tiles of bounded size, and a tile gives its vectors' link counts and the few edges that connect
what it connects, never its pairs. A pair that meets more than once counts where it meets first, which both sides can
tell from their cells.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import stored
from sievework.llm.components import connected_components
from sievework.llm.tiles import forest, into_tiles, whole_groups

THRESHOLD = 0.93
TABLES = 8
BLOCKS = 2
#: Neighbouring points probed in each block, one block at a time.
PROBES = 4
#: Cells are as fine as the vectors are stretched. A pair at cosine 0.93 meets in one table of these with a chance of about 0.48.
STRETCH = 3.5
SEED = 20240
#: Rows with vectors are wide and a crowded cell has all its pairs compared: chunks are small, so that tiles are many and even.
TILE = 256


def decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8: round, and where the sum is odd, round the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 moved by one half."""
    whole, half = decode_d8(x), decode_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@cache
def neighbours() -> np.ndarray:
    """The 240 points of E8 next to the origin."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            point = np.zeros(8)
            point[[i, j]] = a, b
            found.append(point)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in s) % 2 == 0]
    return np.array(found)


@cache
def projections(dim: int, tables: int, blocks: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables, dim, 8 * blocks) with orthonormal columns where dim allows, and a random shift for each table."""
    rng = np.random.default_rng([seed, dim])
    width = 8 * blocks
    made = []
    for _ in range(tables):
        q, _ = np.linalg.qr(rng.normal(size=(max(dim, width), max(dim, width))))
        made.append(q[:dim, :width] * (np.sqrt(max(dim, 8 * blocks) / 64)))
    return np.array(made), rng.random((tables, width))


def _hash(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of twice the coordinates, which are whole numbers."""
    out = np.full(points.shape[:-1], 0x243F6A8885A308D3, np.uint64) + salt.astype(np.uint64)
    for k in range(points.shape[-1]):
        out = (out ^ points[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def cells(unit: np.ndarray, labels: np.ndarray, *, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, stretch: float = STRETCH, seed: int = SEED) -> np.ndarray:
    """(vectors, tables, 1 + blocks * probes) cell hashes; the first is home. The label is part of a cell."""
    n, dim = unit.shape
    project, shift = projections(dim, tables, blocks, seed)
    out = np.empty((n, tables, 1 + blocks * probes), np.int64)
    around = neighbours()
    for t in range(tables):
        x = unit @ project[t] * stretch + shift[t]
        points = np.concatenate([decode_e8(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)], 1)
        salt = labels * 1000 + t
        out[:, t, 0] = _hash(2 * points, salt)
        for b in range(blocks):
            rest = x[:, 8 * b : 8 * b + 8] - points[:, 8 * b : 8 * b + 8]
            toward = np.argpartition(-(rest @ around.T), probes, 1)[:, :probes]
            for k in range(probes):
                moved = points.copy()
                moved[:, 8 * b : 8 * b + 8] += around[toward[:, k]]
                out[:, t, 1 + b * probes + k] = _hash(2 * moved, salt)
    return out


def _units(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors over their length, as doubles), a group for each dimension; all are usable and not null."""
    sizes = pc.list_value_length(vectors).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        own = vectors if len(at) == len(sizes) else vectors.take(pa.array(at))
        x = pc.list_flatten(own).to_numpy().astype(np.float64).reshape(len(at), size)
        x = x / np.abs(x).max(1, keepdims=True)  # keeps the squares of huge or tiny numbers in range
        yield at, x / np.sqrt((x * x).sum(1, keepdims=True))


def _salt(labels: np.ndarray, dim: int) -> np.ndarray:
    return labels + 100_003 * dim


def _visits(settings: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                for at, x in _units(part.column(2)):
                    found = cells(x, _salt(labels[at], x.shape[1]), **settings)
                    home = np.zeros(found.shape, bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), pa.array(np.repeat(ids[at], found[0].size)), pa.array(home.reshape(-1))], ["key", "node", "home"])

    return run


_PAIRS = 1 << 18


def _verify(threshold: float, settings: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, 3):
            sizes = np.diff(at)
            group = np.repeat(np.arange(len(sizes)), sizes)
            held = np.flatnonzero(np.repeat(sizes > 1, sizes))
            rows = table.take(pa.array(held))
            columns = {c: rows.column(c).to_numpy() for c in ("key", "tile_a", "tile_b", "chunk", "node", "label", "copies")} | {"group": group[held]}
            for part, x in _units(rows.column("vector").combine_chunks()) if len(held) else ():
                order = np.lexsort((columns["node"][part], columns["group"][part]))
                yield from _linked(x[order], {c: v[part][order] for c, v in columns.items()})

    def _linked(x: np.ndarray, c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        near: list[tuple[np.ndarray, np.ndarray]] = []
        for apart in range(1, len(x)):
            i = np.flatnonzero(c["group"][apart:] == c["group"][:-apart])
            if not len(i):
                break
            j = i + apart
            # Two of one chunk meet in that chunk's own tile.
            own = (c["label"][i] == c["label"][j]) & (c["node"][i] != c["node"][j]) & ((c["chunk"][i] != c["chunk"][j]) | (c["tile_a"][i] == c["tile_b"][i]))
            i, j = i[own], j[own]
            close = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            near.append((i[close], j[close]))
            if sum(len(a) for a, _ in near) > _PAIRS:
                yield from _counted(x, c, near)
                near = []
        yield from _counted(x, c, near)

    def _counted(x: np.ndarray, c: dict[str, np.ndarray], near: list) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([p[k] for p in near] or [np.zeros(0, np.int64)]) for k in (0, 1))
        if not len(a):
            return
        involved = np.unique(np.concatenate([a, b]))
        found = cells(x[involved], _salt(c["label"][involved], x.shape[1]), **settings)
        p, q = np.searchsorted(involved, a), np.searchsorted(involved, b)
        # Where a pair meets first: by table, then at the smaller one's home if the other visits it, else at the other's.
        first, left = np.zeros(len(a), bool), np.arange(len(a))
        for t in range(found.shape[1]):
            here = found[:, t]
            to_a, to_b = ((here[m[left]] == here[k[left], :1]).any(1) for k, m in ((p, q), (q, p)))
            first[left] = np.where(to_a, here[p[left], 0], here[q[left], 0]) == c["key"][a[left]]
            first[left[~(to_a | to_b)]] = False
            left = left[~(to_a | to_b)]
        a, b = a[first], b[first]
        if len(a):
            links = np.bincount(a, c["copies"][b], len(x)) + np.bincount(b, c["copies"][a], len(x))
            root = forest(len(x), a, b)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(c["node"][at]), pa.array(links[at].astype(np.int64)), pa.array(c["node"][root[at]])], ["node", "links", "top"])

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, threshold: float = THRESHOLD, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, stretch: float = STRETCH, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Only vectors with equal labels that are not null are compared. Vectors that are null, empty, zero or hold a null,
    NaN or infinite component link with nothing, and neither do vectors of different sizes. Rows with one identifier
    are told apart; a null identifier links, but never names a component that has another. Identical vectors of a label
    are hashed and verified once and counted by their number, so copies cost nothing. A row is kept if its identifier
    names its component. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    settings = {"tables": tables, "blocks": blocks, "probes": probes, "stretch": stretch, "seed": seed}
    vector = F.col(vector_col)
    if df.schema[vector_col].dataType.elementType.typeName() not in ("float", "double"):
        vector = vector.cast("array<double>")
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(label_col).cast("string")).alias("label"), F.col(label_col).isNotNull().alias("labelled"), vector.alias("vector"))
    usable = F.col("labelled") & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # Copies are told by 128 bits of label and components; one vector stands for them.
    marked = stored(rows.select("uid", "id", "label", "usable", "vector", F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit(1), "vector", "label").alias("h2")), "vectors")
    classes = stored(
        marked.where("usable").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("uid").alias("node"), F.min("id").alias("first"), F.min_by(F.struct("label", "vector"), "uid").alias("v"))
        .select("h1", "h2", "node", "copies", "first", "v.label", "v.vector"),
        "vector-classes",
    )
    visits = stored(classes.select("node", "label", "vector").mapInArrow(_visits(settings), "key long, node long, home boolean"), "cells")
    crowded = stored(visits.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("homely")).where("n > 1 and homely").select("key"), "crowded-keys")
    members = stored(visits.join(crowded, "key", "left_semi").select("key", "node"), "crowded-cells")
    tiled = into_tiles(members, tile=tile, deal=False).join(classes.select("node", "label", "copies", "vector"), "node")
    dealt = tiled.repartition("key", "tile_a", "tile_b").sortWithinPartitions("key", "tile_a", "tile_b")
    links = stored(dealt.select("key", "tile_a", "tile_b", "chunk", "node", "label", "copies", "vector").mapInArrow(_verify(threshold, settings), "node long, links long, top long"), "links")

    roots = connected_components(links.select(F.col("node").alias("a"), F.col("top").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    each = classes.select("h1", "h2", "node", "copies", "first").join(roots, "node", "left").join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = each.groupBy("root").agg(F.min("first").alias("least"))
    of_class = stored(each.join(least, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("class_links"), "least"), "vector-components")
    alone = marked.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    grouped = marked.where("usable").select("id", "h1", "h2").join(of_class, ["h1", "h2"]).select("id", F.col("class_links").alias("n_links"), F.col("least").alias("component_id"))
    return grouped.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors() of all embeddings, at a cosine of 0.93 within a label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT l.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, l.component_id, l.vec_id = l.component_id AS kept
FROM least l LEFT JOIN n ON l.vec_id = n.vec_id
"""
