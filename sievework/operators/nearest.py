"""The k nearest vectors of each of many questions, within its scope, exactly.

Angles between vectors obey the triangle inequality. Every vector lies in the cell of its nearest pivot, and a cell of a
scope knows the least and the greatest angle of its vectors to the pivot; so the best similarity that a question can find
there is bounded. A question first meets the cell of its best bound, which gives it k similarities, and then only those
cells of its scope that can hold a better one. Lists of k are found in tasks of bounded size and merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.vectors import is_valid

#: Rows of a cell and questions that meet in a task, about.
BLOCK, BATCH = 2048, 512
#: Rows that pivots are drawn from, and pivots at most: what every task is told.
SAMPLE, PIVOTS = 2048, 64


def _units(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors of length one), a group for each size."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = pc.list_flatten(vectors.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        x = x / np.abs(x).max(1, keepdims=True)  # keeps the squares of huge or tiny numbers in range
        yield at, x / np.sqrt((x * x).sum(1, keepdims=True))


def drawn_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Rows of a sample, each as far from those before it as any."""
    at, near = [0], sample @ sample[0]
    while len(at) < min(number, len(sample)):
        at.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[at[-1]])
    return sample[at]


def _angles(pivots: np.ndarray):
    """Rows (ident, scope, vector) with their angles to all pivots and the nearest of them; vectors of another size have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles: list = [None] * batch.num_rows
            cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for at, x in _units(batch.column(2)):
                if x.shape[1] == pivots.shape[1]:
                    found = np.arccos(np.clip(x @ pivots.T, -1, 1))
                    cell[at], angle[at] = found.argmin(1), found.min(1)
                    for k, row in zip(at, found):
                        angles[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles, pa.list_(pa.float64())), pa.array(cell), pa.array(angle)], ["ident", "scope", "vector", "angles", "cell", "angle"])

    return run


def _compare(k: int):
    """The k most similar rows of a block for each question of a batch; ties by identifier. A row of a question's own identifier is not its neighbour."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        left = left.sort_by("ident")
        mine = {x.shape[1]: (at, x) for at, x in _units(left.column("vector").combine_chunks())} if left.num_rows else {}
        for at, q in _units(right.column("vector").combine_chunks()) if right.num_rows else ():
            if q.shape[1] not in mine:
                continue
            place, x = mine[q.shape[1]]
            own = left.column("ident").to_numpy()[place]
            found = np.round(q @ x.T, 12)
            found[right.column("question").to_numpy()[at][:, None] == own[None, :]] = -2  # itself
            order = np.argsort(-found, axis=1, kind="stable")[:, :k]
            values = np.take_along_axis(found, order, 1)
            row, column = np.nonzero(values > -2)
            out.append(pa.table({"question": right.column("question").take(pa.array(at[row])), "ident": pa.array(own[order[row, column]]), "similarity": pa.array(values[row, column]), "compared": pa.array(np.where(column == 0, len(place), 0))}))
        return pa.concat_tables(out) if out else pa.table({"question": pa.array([], pa.int64()), "ident": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})

    return run


def nearest_for_each(questions: DataFrame, vectors: DataFrame, k: int = 8, scope: tuple[str, ...] = ("label",), ident: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, block: int = BLOCK, batch: int = BATCH, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((question, rank, ident, similarity), (question, compared)): the k nearest of each question by cosine, ties by identifier,
    and with how many vectors it was compared.

    Both frames have `ident` (a long, unique among the questions), the `scope` columns, which must be equal, and `vector`. Nulls in any of
    them, and vectors that are empty, without length or not all finite, take no part; sizes must be equal too. A question
    with fewer than k vectors in its scope has them all. `folder` is one that all tasks share, for what is read twice.
    """
    from sievework.plans.session import workspace

    spark = vectors.sparkSession
    folder = folder or workspace(spark, "nearest")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def usable(df: DataFrame) -> DataFrame:
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (ident, *scope)])
        v = F.col(vector).cast("array<double>")
        rows = df.where(present & is_valid(v) & F.exists(v, lambda x: x != 0))
        return rows.select(F.col(ident).cast("long").alias("ident"), F.to_json(F.struct(*scope)).alias("scope"), v.alias("vector"))

    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("ident"), "ident").limit(SAMPLE).select("vector").toArrow()  # a bounded sample
    groups = {x.shape[1]: x for _, x in _units(sample.column("vector").combine_chunks())} if sample.num_rows else {}
    usual = max(groups.values(), key=len) if groups else np.ones((1, 1))
    placed = f"ident long, scope string, vector array<double>, angles array<double>, cell int, angle double"
    drawn = drawn_pivots(usual, pivots)
    located = kept(rows.mapInArrow(_angles(drawn), placed).drop("angles"), "cells")
    asked = kept(usable(questions).mapInArrow(_angles(drawn), placed).withColumnRenamed("ident", "question").drop("cell", "angle"), "questions")

    # Cells by scope: joined, not sent, as there may be many scopes.
    cells = kept(located.groupBy("scope", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")), "directory")
    parts = F.ceil(F.col("n") / block).cast("int")
    sized = cells.select("scope", "cell", parts.alias("parts"))
    blocks = kept(located.join(sized, ["scope", "cell"]).withColumn("part", F.pmod(F.xxhash64("ident"), F.col("parts")).cast("int")).select("scope", "cell", "part", "ident", "vector"), "blocks")
    away = F.get("angles", F.col("cell"))
    apart = F.greatest(F.lit(0.0), away - F.col("high"), F.col("low") - away)
    bound = F.when((F.col("cell") < 0) | F.col("angles").isNull(), 1.0).otherwise(F.cos(F.greatest(F.lit(0.0), apart - 1e-9)) + 1e-9)  # a vector without angles may be anywhere
    batches = max(1, -(-asked.count() // batch))
    meets = kept(asked.join(cells, "scope").select("question", "scope", "cell", "n", bound.alias("bound"), parts.alias("parts"), F.pmod(F.xxhash64("question"), F.lit(batches)).cast("int").alias("batch")), "meetings")

    def compared(chosen: DataFrame) -> DataFrame:
        each = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(asked.select("question", "vector"), "question")
        tile = ["scope", "cell", "part", "batch"]
        tiles = each.select(*[F.col(c).alias(f"_{c}") for c in tile]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in tile[:3]])
        left = blocks.join(tiles, same).select("scope", "cell", "part", F.col("_batch").alias("batch"), "ident", "vector")
        return left.groupBy(*tile).cogroup(each.groupBy(*tile)).applyInArrow(_compare(k), "question long, ident long, similarity double, compared long")

    order = Window.partitionBy("question").orderBy(F.desc("similarity"), "ident")
    best = Window.partitionBy("question").orderBy(F.desc("bound"), F.desc("n"), "cell")
    first = meets.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    found = kept(compared(first), "first")
    enough = found.groupBy("question").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(F.lit(-2.0)).alias("enough"))  # k rows of one block at least: no more than its cell's k-th
    rest = meets.join(first.select("question", F.col("cell").alias("_first")), "question").where("cell <> _first").join(enough, "question", "left").where(F.col("bound") >= F.coalesce("enough", F.lit(-2.0)) - 1e-9)
    both = kept(found.unionByName(compared(rest.select(*meets.columns))), "found")
    lists = both.select("question", "ident", "similarity", F.row_number().over(order).cast("int").alias("rank")).where(F.col("rank") <= k)
    return lists.select("question", "rank", F.col("ident").alias(ident), "similarity"), both.groupBy("question").agg(F.sum("compared").alias("compared"))
