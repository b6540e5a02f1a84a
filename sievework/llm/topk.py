"""Exact search for the k largest inner products by a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance to it; the vectors of a pivot, sorted by that distance, are
cut into annuli. By the triangle inequality a vector of an annulus lo..hi is at least max(0, d - hi, lo - d) away from a
query that is d away from the pivot, and since 2 q.x = |q|^2 + |x|^2 - |q - x|^2, that bounds its inner product from
above. A query expands its annuli by falling bounds, first a few, then more each time, and stops when the next bound is
below its k-th best score. Nothing is left out: what the bounds cannot exclude is compared.

Rounds are joins: annuli are blocks of bounded size, queries lie in batches of bounded size, and a block meets a batch in
a task of its own, where whole numbers are multiplied exactly. Vectors alike are one entry of the index. How many annuli
the bounds exclude depends on the data; where distances are all alike, as in random directions, they exclude none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import stored
from sievework.llm.vectors import exact_dot, matrix, quantised, usable

K, SCALE = 20, 64
#: Rows of a block and queries of a batch, about.
BLOCK, BATCH = 1024, 512
#: Pivots at most, and annuli at most of all pivots: what a task knows of the index. Larger annuli have more blocks.
PIVOTS, ANNULI = 128, 1 << 14
#: Rows that pivots are fitted on, and the largest vectors among them. All rows are indexed; other sizes have no pivot.
SAMPLE, MOST_DIM = 2048, 4096
#: Annuli that a query opens in its first round, and how many times more in each round after.
FIRST, GROWTH = 4, 16

_FOUND = "q long, score long, least long, node long"


def fit_pivots(x: np.ndarray, number: int, rounds: int = 4) -> np.ndarray:
    """Whole-number centres of a sample: Lloyd's rounds from evenly spaced rows. Whole, so that distances to them are exact."""
    x = np.unique(x, axis=0)
    own = x[np.linspace(0, len(x) - 1, min(number, len(x))).astype(int)]
    for _ in range(rounds):
        near = ((own * own).sum(1)[None, :] - 2 * exact_dot(x, own)).argmin(1)
        own = np.array([np.rint(x[near == c].mean(0)).astype(np.int64) if (near == c).any() else own[c] for c in range(len(own))])
    return np.unique(own, axis=0)


@dataclass(frozen=True)
class Directory:
    """What a task knows of the index. Of each annulus: pivot (-1 for sizes without one), least and greatest distance, the
    greatest squared length, and its number of blocks."""

    pivots: dict[int, np.ndarray]  # by size of the vectors
    first: dict[int, int]  # number of a size's first pivot
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    blocks: np.ndarray

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distances to the pivots of this size: roots of exact squares, so the same whenever they are found."""
        own = self.pivots[x.shape[1]]
        return np.sqrt(((x * x).sum(1)[:, None] - 2 * exact_dot(x, own) + (own * own).sum(1)[None, :]).astype(np.float64))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(annuli that may hold vectors of this size, the most that an inner product with one of them can be)."""
        dim = x.shape[1]
        if dim not in self.pivots:
            at = np.flatnonzero(self.pivot < 0)
            return at, np.full((len(x), len(at)), np.inf)
        start = self.first[dim]
        at = np.flatnonzero((self.pivot >= start) & (self.pivot < start + len(self.pivots[dim])))
        d = self.away(x)[:, self.pivot[at] - start]
        apart = np.maximum(0, np.maximum(d - self.high[at], self.low[at] - d) * (1 - 1e-9) - 1e-6)
        squares = (x * x).sum(1)[:, None].astype(np.float64) + self.length[at]
        return at, (squares - apart * apart) / 2 + squares * 1e-9 + 1e-6


def _sizes(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors), a group for each size."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, matrix(vectors.take(pa.array(at)), int(size))


def _locate(directory: Directory):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, away, length = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for at, x in _sizes(batch.column("x")):
                length[at] = (x * x).sum(1)
                if x.shape[1] in directory.pivots:
                    d = directory.away(x)
                    near = d.argmin(1)
                    pivot[at], away[at] = directory.first[x.shape[1]] + near, d[np.arange(len(x)), near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away), pa.array(length)], [*batch.schema.names, "pivot", "away", "length"])

    return run


def _expand(directory: Directory, done: int, take: int):
    """The annuli `done` .. `done + take` of each query in the order of their bounds, as far as they may matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column("enough").to_numpy()
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for at, x in _sizes(part.column("x")):
                    annuli, bound = directory.bounds(x)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, done : done + take]
                    row, place = np.nonzero(np.take_along_axis(bound, order, 1) >= least[lo + at][:, None])
                    if len(row):
                        ring = annuli[order[row, place]]
                        own = part.take(pa.array(at[row]))
                        yield pa.RecordBatch.from_arrays([own.column("q"), own.column("batch"), own.column("enough"), own.column("x"), pa.array(ring.astype(np.int32)), pa.array(directory.blocks[ring].astype(np.int32))], ["q", "batch", "enough", "x", "annulus", "blocks"])

    return run


def best_of(scores: np.ndarray, enough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest of each row that are not below `enough`; of equal ones the first columns."""
    floor = enough
    if scores.shape[1] > k:
        floor = np.maximum(enough, np.partition(scores, -k, axis=1)[:, -k])
    row, column = np.nonzero(scores >= floor[:, None])
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, np.arange(len(scores)))
    first = np.arange(len(row)) - starts[row] < k
    return row[first], column[first]


def _compare(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        left = left.sort_by([("least", "ascending"), ("node", "ascending")])  # nulls last
        mine = {x.shape[1]: (at, x) for at, x in _sizes(left.column("x").combine_chunks())}
        for at, q in _sizes(right.column("x").combine_chunks()):
            if q.shape[1] in mine:
                place, x = mine[q.shape[1]]
                scores = exact_dot(q, x)
                row, column = best_of(scores, right.column("enough").to_numpy()[at], k)
                own = left.take(pa.array(place[column]))
                out.append(pa.table({"q": right.column("q").take(pa.array(at[row])), "score": pa.array(scores[row, column]), "least": own.column("least"), "node": own.column("node")}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("q", "score", "least", "node")})

    return run


_LEAST = -(1 << 63)


def _first_ids(rows: DataFrame, k: int) -> DataFrame:
    """(h1, h2, ids): the k smallest identifiers of the rows of a class, a null one last; in three steps, so that a class of any size is shared."""
    held = rows.withColumn("_salt", F.pmod(F.xxhash64("id", F.rand(7)), F.lit(256)).cast("int"))
    for salts in (256, 16, 1):
        w = Window.partitionBy("h1", "h2", F.pmod("_salt", F.lit(salts))).orderBy(F.col("id").asc_nulls_last())
        held = held.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    return held.groupBy("h1", "h2").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))), lambda e: e["id"]).alias("ids"))


def top_k(df: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, scale: int = SCALE, block: int = BLOCK, batch: int = BATCH, pivots: int | None = None, first: int = FIRST, growth: int = GROWTH, counts: list[tuple[int, int]] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each row where `asked` holds the k rows of the largest inner products, its own left out.

    Components become floor(scale * x). Ties go to the smaller identifier, a null one last. Vectors that are null or hold
    a null, NaN or infinite component take no part; vectors of different sizes are not compared. A query with fewer than
    k candidates has them all, with none no row. Rows are told apart even if they have one identifier: each is a query or a
    candidate of its own, but identical rows are interchangeable. Null `asked` is no. A score that does not fit a long is an
    error. Columns but those that are named are not looked at. An empty table gives an empty result.

    `counts`, if given, gets for each round how many pairs of a query and an annulus were opened, and how many there are.
    """
    spark, many = df.sparkSession, k + 1  # one more, as a query's own row is found too
    vector = F.col(vector_col)
    x = quantised(vector, scale)
    rows = df.where(usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), x.alias("x"))
    rows = stored(rows.withColumns({"h1": F.xxhash64(F.size("x"), "x"), "h2": F.xxhash64(F.lit(1), "x", F.size("x"))}), "searched")  # copies are told by 128 bits
    classes = stored(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.max("asked").alias("asked"), F.min_by("x", F.lit(0)).alias("x")).withColumn("node", F.monotonically_increasing_id()), "search-classes")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked")).first()
    if not size["asked"]:
        return empty

    sample = matrix_by_size(classes.where(F.size("x").between(1, MOST_DIM)).orderBy(F.xxhash64("h1"), "h2").limit(SAMPLE).select("x").toArrow())
    number = pivots or min(PIVOTS, max(4, int(size["n"] ** 0.5 / 8)))
    fitted = {dim: fit_pivots(v, max(1, number * len(v) // SAMPLE if len(sample) > 1 else number)) for dim, v in sample.items()}
    starts, at = {}, 0
    for dim, v in fitted.items():
        starts[dim], at = at, at + len(v)
    none = np.zeros(0)
    located = stored(classes.mapInArrow(_locate(Directory(fitted, starts, none, none, none, none, none)), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in classes.schema)}, pivot int, away double, length double"), "search-index")

    # Annuli: the distances of a pivot's vectors, cut at quantiles.
    each = max(1, min(ANNULI // (at + 1), -(-size["n"] // (block * (at + 1)))))
    cuts = located.groupBy("pivot").agg(F.percentile_approx("away", [(i + 1) / each for i in range(each - 1)] or [0.5]).alias("cuts")).collect()  # a row a pivot
    cut = spark.createDataFrame([(r["pivot"], r["cuts"] if each > 1 else []) for r in cuts], "pivot int, cuts array<double>")
    ringed = located.join(F.broadcast(cut), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("away"))))
    rings = ringed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high"), F.max("length").alias("length")).orderBy("pivot", "ring").collect()  # ANNULI at most, and one
    column = {c: np.array([r[c] for r in rings]) for c in ("pivot", "low", "high", "length", "n")}
    directory = Directory(fitted, starts, column["pivot"], column["low"], column["high"], column["length"], -(-column["n"] // block))
    named = spark.createDataFrame([(r["pivot"], r["ring"], i, int(b)) for i, (r, b) in enumerate(zip(rings, directory.blocks))], "pivot int, ring int, annulus int, blocks int")
    index = ringed.join(F.broadcast(named), ["pivot", "ring"]).select("annulus", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "least", "x")
    index = stored(index, "search-blocks")

    # Queries of neighbouring pivots share a batch; those of a large one are dealt to several.
    held, dealt, full = [], 0, 0
    for r in located.where("asked").groupBy("pivot").count().orderBy("pivot").collect():
        if full and full + r["count"] > batch:
            dealt, full = dealt + 1, 0
        parts = -(-r["count"] // batch)
        held.append((r["pivot"], dealt, parts))
        dealt, full = (dealt + parts, 0) if parts > 1 else (dealt, full + r["count"])
    batches = spark.createDataFrame(held, "pivot int, _first int, _parts int")
    queries = stored(located.where("asked").join(F.broadcast(batches), "pivot").select(F.col("node").alias("q"), (F.col("_first") + F.pmod(F.xxhash64("node"), F.col("_parts"))).cast("int").alias("batch"), "x"), "search-queries")

    best, done, take = None, 0, first
    while done < len(rings):
        now = queries.withColumn("enough", F.lit(_LEAST)) if best is None else queries.join(best.select("q", "enough"), "q", "left").withColumn("enough", F.coalesce("enough", F.lit(_LEAST)))
        opened = stored(now.select("q", "batch", "enough", "x").mapInArrow(_expand(directory, done, take), "q long, batch int, enough long, x array<bigint>, annulus int, blocks int"), "search-opened")
        number = opened.count()
        if counts is not None:
            counts.append((number, size["asked"] * len(rings)))
        if number:
            right = opened.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
            tiles = right.select(F.col("annulus").alias("_annulus"), F.col("block").alias("_block"), F.col("batch").alias("_batch")).distinct()
            left = index.join(tiles, (F.col("annulus") == F.col("_annulus")) & (F.col("block") == F.col("_block"))).select("annulus", "block", F.col("_batch").alias("batch"), "node", "least", "x")
            tile = ["annulus", "block", "batch"]
            found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(_compare(many), _FOUND)
            if best is not None:
                found = found.union(best.select("q", F.explode("best").alias("b")).select("q", "b.score", "b.least", "b.node"))
            w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("least").asc_nulls_last(), "node")
            kept = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= many)
            # Classes are no more than rows, so the score of the last of `many` classes is one that as many rows have.
            best = stored(kept.groupBy("q").agg(F.collect_list(F.struct("score", "least", "node")).alias("best"), F.when(F.count(F.lit(1)) >= many, F.min("score")).otherwise(F.lit(_LEAST)).alias("enough")), "search-best")
        elif done:
            break
        done, take = done + take, take * growth

    # Classes become rows again: the first identifiers of each; then each asking row takes its list without itself.
    repeated = classes.where("copies > 1").select("h1", "h2", F.col("node").alias("_node"))
    ids = stored(_first_ids(rows.join(repeated.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "id"), many).join(repeated, ["h1", "h2"]).select("_node", "ids"), "search-copies")
    entries = stored(best.select("q", F.explode("best").alias("b")).select("q", "b.*"), "search-entries")
    each_row = entries.join(ids, F.col("node") == F.col("_node"), "left").select("q", "score", (F.col("q") == F.col("node")).alias("own"), F.explode(F.coalesce("ids", F.array("least"))).alias("id"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "own")
    listed = each_row.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= many)
    lists = stored(listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_n", "score", "id", "own"))).alias("list")), "search-lists")
    named = classes.where("asked").select("h1", "h2", F.col("node").alias("_q")).join(lists, F.col("_q") == F.col("q")).select("h1", "h2", "list")
    asking = rows.where("asked").select("h1", "h2", F.col("id").alias("query_id")).join(stored(named, "search-results"), ["h1", "h2"])
    self_at = F.array_position(F.transform("list", lambda e: e["own"] & e["id"].eqNullSafe(F.col("query_id"))), True)
    without = F.slice(F.filter("list", lambda e, i: i + 1 != F.col("_self")), 1, k)
    out = asking.withColumn("_self", self_at).select("query_id", F.posexplode(without).alias("_r", "_e"))
    return out.select("query_id", (F.col("_r") + 1).alias("rank"), F.col("_e.id").alias("vec_id"), F.col("_e.score").alias("score"))


def matrix_by_size(table: pa.Table) -> dict[int, np.ndarray]:
    """Vectors of a bounded table by their size."""
    return {x.shape[1]: x for _, x in _sizes(table.column("x").combine_chunks())} if table.num_rows else {}


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every row whose identifier is divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.u, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.u <> v.u AND len(q.x) = len(v.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
