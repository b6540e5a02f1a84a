"""Comparing the members of buckets in tiles of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import stored

#: A bucket is dealt into chunks of about so many members.
TILE = 512
#: Or of so many bytes, where members differ in size.
TILE_BYTES = 8 << 20


def into_tiles(members: DataFrame, *, tile: int = TILE, deal: bool = True, size: str | None = None, most: int = TILE_BYTES) -> DataFrame:
    """`members` (key long, node long, ...) with chunk, tile_a, tile_b: every two members of a bucket meet in some tile.

    A bucket of up to `tile` members is one tile. A larger one is dealt by hash into chunks, and each two chunks make a
    tile, so that no task sees a whole bucket and no pair is lost. With `size`, a column of bytes, chunks are also of
    about `most` bytes. With `deal` the rows are shuffled by tile and sorted.
    """
    chunks = F.ceil(F.count(F.lit(1)) / tile)
    if size:
        chunks = F.greatest(chunks, F.ceil(F.sum(F.col(size).cast("long")) / most))
    # Stored, so that few large buckets are broadcast by their known size, and many meet their members in a join that can be split.
    large = stored(members.groupBy("key").agg(chunks.cast("int").alias("_m")).where("_m > 1").withColumnRenamed("key", "_key"), "large-buckets")
    cut = members.join(large, F.col("key") == F.col("_key"), "left").drop("_key")
    cut = cut.withColumn("chunk", F.when(F.col("_m") > 1, F.pmod(F.xxhash64("node", F.lit("tile")), F.col("_m"))).otherwise(0).cast("int"))
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))

    def tile_of(k: Column) -> Column:
        return F.struct(F.least("chunk", k).alias("a"), F.greatest("chunk", k).alias("b"))

    every = F.when(F.col("_m") > 1, F.transform(F.sequence(F.lit(0), F.col("_m") - 1), tile_of)).otherwise(one)
    dealt = cut.withColumn("_t", F.explode(every)).withColumn("tile_a", F.col("_t.a")).withColumn("tile_b", F.col("_t.b")).drop("_t", "_m")
    if not deal:
        return dealt
    return dealt.repartition("key", "tile_a", "tile_b").sortWithinPartitions("key", "tile_a", "tile_b")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows alike in the first `keys` columns, with where each group starts (and the end)."""
    rest: pa.Table | None = None

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in range(keys):
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        at = starts(table)
        cut = int(at[-2]) if len(at) > 1 else 0
        if cut:
            yield table.slice(0, cut).combine_chunks(), at[:-1]
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        rest = rest.combine_chunks()
        yield rest, starts(rest)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _link(close: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, 3):
            sizes = np.diff(at)
            held = np.repeat(sizes > 1, sizes)
            node, group = table.column("node").to_numpy()[held], np.repeat(np.arange(len(sizes)), sizes)[held]
            order = np.lexsort((node, group))
            node, group = node[order], group[order]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for apart in range(1, int(sizes.max(initial=0))):
                i = np.flatnonzero(group[apart:] == group[:-apart])
                if not len(i):
                    break
                i = i[close(node[i], node[i + apart])]
                found.append((i, i + apart))
                if sum(len(x) for x, _ in found) > 1 << 21:  # enough held: the forest stands for them
                    found = [_as_star(len(node), found)]
            if found:
                child, top = _as_star(len(node), found)
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[top])], ["a", "b"])

    return run


def _as_star(n: int, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    root = forest(n, np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def link_in_tiles(members: DataFrame, close: Callable[[np.ndarray, np.ndarray], np.ndarray], *, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect just what the close pairs of each bucket connect, a few for a node and not all pairs.

    `members`: (key long, node long), a node once a bucket. `close` takes arrays of nodes and tells which pairs link.
    """
    return into_tiles(members, tile=tile).select("key", "tile_a", "tile_b", "node").mapInArrow(_link(close), "a long, b long")
