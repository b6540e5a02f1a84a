"""Joins of texts with quotes, and differences of keyed sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = 3
#: Keys of quotes that may go to every task, 8 bytes each; with more of them texts send all of their keys.
_MOST_KEYS = 1 << 20
#: What stands for an empty quote, which is in every text.
_EMPTY = -(1 << 62)


def grams_of(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """The different runs of 1, 2 or 3 characters of a text, each as one number; exactly, as a character has 21 bits. 0 asks for the empty one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    found = [np.array([_EMPTY])] if 0 in sizes else []
    if 3 in sizes and len(c) >= 3:
        found.append(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
    if 2 in sizes and len(c) >= 2:
        found.append(-1 - (c[:-1] << 21 | c[1:]))
    if 1 in sizes and len(c):
        found.append(-1 - (c | 1 << 43))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _grams(sizes: tuple[int, ...], known=None):
    """Rows (ident, text) as (ident, gram): all grams of these sizes, or those that are `known` (a broadcast sorted array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = known.value if known is not None else None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            at, found, held = [], [], 0
            for k in range(batch.num_rows):
                body = texts[k].as_py()
                if body is not None:
                    g = grams_of(body.decode("utf-8", "replace"), sizes)
                    if asked is not None:
                        g = g[np.isin(g, asked, assume_unique=True)]
                    at.append(np.full(len(g), k))
                    found.append(g)
                    held += len(g)
                if at and (held > 1 << 18 or k == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(found))], ["ident", "gram"])
                    at, found, held = [], [], 0

    return run


def _anchored(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(_t, _q) of texts (_t, _text) that hold the rarest gram of a quote (_q, _quote).

    Texts are read twice: to count in how many of them each gram of a quote is, and to find the grams that were chosen.
    """
    spark = texts.sparkSession
    kinds = [f"ident {x.schema[c].dataType.simpleString()}, gram long" for x, c in ((texts, "_t"), (quotes, "_q"))]
    size = F.least(F.lit(3), F.length("_quote"))
    sizes = tuple(r[0] for r in quotes.select(size).distinct().collect())  # at most 0 to 3
    own = quotes.repartition("_q").select("_q", "_quote", size.alias("_n"))
    parts = [own.where(F.col("_n") == n).select("_q", "_quote").mapInArrow(_grams((n,)), kinds[1]) for n in sizes]
    asked = reduce(DataFrame.unionByName, parts).withColumnRenamed("ident", "_q")

    def in_texts(wanted: DataFrame) -> DataFrame:
        """Grams of the texts; where those wanted are few by their count, no other leaves a task."""
        few = wanted.limit(_MOST_KEYS + 1).toArrow().column(0).to_numpy() if wanted.count() <= _MOST_KEYS else None
        known = spark.sparkContext.broadcast(np.sort(few)) if few is not None else None
        return texts.select("_t", "_text").mapInArrow(_grams(sizes, known), kinds[0]).withColumnRenamed("ident", "_t")

    held = in_texts(asked.select("gram").distinct()).groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    rated = asked.join(held, "gram", "left")
    anchors = rated.groupBy("_q").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "gram")).alias("_a")).where("_a.df > 0").select("_q", F.col("_a.gram").alias("gram"))
    return in_texts(anchors.select("gram").distinct()).join(anchors, "gram").select("_t", "_q")


def quotes_in(texts: DataFrame, quotes: DataFrame, text_id: str, text: str, quote_id: str, quote: str) -> DataFrame:
    """(text_id, quote_id) where the quote is a substring of the text, case and all. An empty quote is in every text; null is in none.

    A quote of five or more blank-separated words holds its second to fourth as whole words, so those are joined on. A
    shorter one is anchored at its rarest run of three characters, by how many texts hold each. `contains` only checks
    what meets there: no text is compared with every quote, and the plan is the same however many quotes there are. Where
    keys are few enough by their count, tasks know them and drop all others before the shuffle. Pairs are identifiers;
    texts and quotes are fetched for the check.
    """
    q = quotes.where(F.col(quote).isNotNull()).select(F.col(quote_id).alias("_q"), F.col(quote).alias("_quote"), F.split(quote, " ", -1).alias("_w"))
    short, long = F.size("_w") < _WORDS + 2, F.size("_w") >= _WORDS + 2
    n = q.agg(F.count_if(short).alias("short"), F.count_if(long).alias("long")).first()
    body = texts.where(F.col(text).isNotNull()).select(F.col(text_id).alias("_t"), F.col(text).alias("_text"))
    kinds = ", ".join(f"{c} {f.schema[c].dataType.simpleString()}" for f, c in ((body, "_t"), (q, "_q")))
    pairs = texts.sparkSession.createDataFrame([], kinds)
    if n["long"]:
        keyed = q.where(long).select("_q", F.xxhash64(*[F.get("_w", F.lit(1 + k)) for k in range(_WORDS)]).alias("_key"))
        grams = body.select("_t", F.split("_text", " ", -1).alias("_w")).where(F.size("_w") >= _WORDS)
        keys = grams.select("_t", F.explode(F.transform(F.sequence(F.lit(0), F.size("_w") - _WORDS), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(_WORDS)]))).alias("_key"))
        if n["long"] <= _MOST_KEYS:
            keys = keys.join(F.broadcast(keyed.select("_key").distinct()), "_key", "left_semi")
        pairs = pairs.unionByName(keys.join(keyed, "_key").select("_t", "_q").distinct())
    if n["short"]:
        pairs = pairs.unionByName(_anchored(body, q.where(short).select("_q", "_quote")))
    found = pairs.join(q.select("_q", "_quote"), "_q").join(body, "_t").where(F.contains("_text", F.col("_quote")))
    return found.select(F.col("_t").alias(text_id), F.col("_q").alias(quote_id))


def in_blocks(queries: DataFrame, df: DataFrame, query_id: str, ident: str, block: int = 512, chunk: int = 4096) -> DataFrame:
    """Every row of a stated set of queries beside every row of `df`, in tiles of about `block` and `chunk` rows.

    What follows should aggregate: tiles are spread over all tasks, and no side is sent whole to any of them.
    """
    left, right = _tiled(queries, df, query_id, ident, block, chunk)
    return left.join(right, ["_block", "_chunk"]).drop("_block", "_chunk")


def _tiled(queries: DataFrame, df: DataFrame, query_id: str, ident: str, block: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with _block and _chunk: every row of one meets every row of the other in one tile."""
    n, m = max(1, -(-queries.count() // block)), max(1, -(-df.count() // chunk))

    def dealt(x: DataFrame, key: str, own: str, of: int, other: str, copies: int) -> DataFrame:
        return x.withColumn(own, F.pmod(F.xxhash64(key), F.lit(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    return dealt(queries, query_id, "_block", n, "_chunk", m), dealt(df, ident, "_chunk", m, "_block", n)


def _by_size(vectors: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, vectors, norms) for each size of vectors; those that are null, empty or hold a null are left out."""
    column = vectors.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().copy()
    holes = pc.is_null(pc.list_flatten(column)).to_numpy(zero_copy_only=False)
    sizes[pc.list_parent_indices(column).to_numpy()[holes]] = 0
    found = []
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        x = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        found.append((at, x, np.sqrt((x * x).sum(1))))
    return found


_STRIPE = 256


def _cosine_tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """(id, best, least, total, others) of the cosines of each vector on the left with those on the right, its own id left out."""
    schema = pa.schema([("id", pa.int64()), ("best", pa.float64()), ("least", pa.float64()), ("total", pa.float64()), ("others", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    ids, others = left.column("id").to_numpy(), right.column("id").to_numpy()
    order = np.argsort(others, kind="stable")
    lo, hi = (np.searchsorted(others[order], ids, side) for side in ("left", "right"))
    mine, theirs, rows = _by_size(left.column("vector")), _by_size(right.column("vector")), []
    for start in range(0, len(ids), _STRIPE):
        cos = np.zeros((min(_STRIPE, len(ids) - start), len(others)))
        for at, a, na in mine:
            part = slice(*np.searchsorted(at, [start, start + _STRIPE]))
            for to, b, nb in theirs:
                if a.shape[1] == b.shape[1] and len(at[part]):
                    with np.errstate(all="ignore"):
                        length, dots = np.outer(na[part], nb), a[part] @ b.T
                        cos[np.ix_(at[part] - start, to)] = np.divide(dots, length, out=np.zeros_like(dots), where=~(length <= 0))
        best, least, total = cos.max(1), np.fmin.reduce(cos, axis=1), cos.sum(1)
        for i in np.flatnonzero(hi[start : start + _STRIPE] > lo[start : start + _STRIPE]):
            rest = np.delete(cos[i], order[lo[start + i] : hi[start + i]])
            best[i], least[i], total[i] = (rest.max(), np.fmin.reduce(rest), rest.sum()) if len(rest) else (0.0, 0.0, 0.0)
        rows.append((best, least, total))
    best, least, total = (np.concatenate(x) for x in zip(*rows))
    n = len(others) - (hi - lo)
    return pa.table([ids, best, least, total, n], schema=schema).filter(pa.array(n > 0))


def cosine_stats(queries: DataFrame, df: DataFrame, ident: str, vector: str, block: int = 4096, chunk: int = 4096) -> DataFrame:
    """V1: (ident, best, least, mean, others) of the cosines of each of a stated set of queries with all rows of `df` of another identifier.

    Every pair is computed, in double precision, as a product of matrices: tiles of about `block` queries and `chunk` rows
    are spread over all tasks, and a tile gives a row for a query, not one for a pair. Cosines are those of
    vectors.cosine(): 0 for vectors of different sizes, null ones, and those without length. Identifiers are whole
    numbers; rows without one meet nothing.
    """
    asked, every = (x.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL") for x in (queries, df))
    left, right = _tiled(asked, every, "id", "id", block, chunk)
    tiles = ["_block", "_chunk"]
    pairs = left.groupBy(*tiles).cogroup(right.groupBy(*tiles)).applyInArrow(_cosine_tile, "id long, best double, least double, total double, others long")
    found = pairs.groupBy("id").agg(F.max("best").alias("best"), F.min("least").alias("least"), (F.sum("total") / F.sum("others")).alias("mean"), F.sum("others").alias("others"))
    return found.select(F.col("id").cast(queries.schema[ident].dataType).alias(ident), "best", "least", "mean", "others")


_SALTS = 64


def join_counted(df: DataFrame, counted: DataFrame, keys: list[str], n: str, spread: str, hot: int = 1000) -> DataFrame:
    """Every row of `df` with the row of `counted` that has its keys; null keys are equal. `counted` has unique keys, and
    in `n` how many rows of `df` each has.

    Keys that hold at least one in `hot` of all rows are at most `hot` many by that definition. They are broadcast to mark
    their rows, which are then dealt out by a hash of `spread` over copies of the counted row; other keys meet as they are.
    """
    rest = [c for c in counted.columns if c not in keys]
    total = counted.agg(F.sum(n).alias("_total"))  # one row
    salts = F.when(F.col(n) * hot >= F.col("_total"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    named = counted.join(F.broadcast(total)).select(*[F.col(k).alias(f"_{k}") for k in keys], *rest, salts.alias("_salts"))
    large = named.where(F.size("_salts") > 1).select(*[F.col(f"_{k}").alias(f"_h{k}") for k in keys], F.lit(True).alias("_hot"))
    marked = df.join(F.broadcast(large), reduce(lambda a, b: a & b, [df[k].eqNullSafe(large[f"_h{k}"]) for k in keys]), "left")
    dealt = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(_SALTS))).otherwise(0).cast("int"))
    copies = named.withColumn("_copy", F.explode("_salts"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return dealt.join(copies, same & (F.col("_salt") == F.col("_copy"))).select(*df.columns, *rest)


def missing(known: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `known` whose keys are not in `current`."""
    return known.join(current.select(*keys), keys, "left_anti")


def only_of(df: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in `allowed`."""
    return df.join(allowed.select(*keys), keys, "left_semi")


def with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default) -> DataFrame:
    """Each row with a looked-up value, or the default."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
