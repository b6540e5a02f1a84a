"""Passages of documents, with exact offsets.

`fixed` is native. For `structure` and `hybrid` native expressions describe a page's lines: how long each is, whether it
is a heading, whether it is blank. Where passages begin follows from these numbers alone, in an Arrow UDF over arrays;
only an embedder sees text there. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions import vocabulary as V
from sievework.functions.text import heading_of, let, location_label, stripped
from sievework.functions.vectors import dot

PASSAGE = "array<struct<start:int,end:int,heading:string>>"
Embedder = Callable[[str], list[float]]


def line_facts(text: Column) -> Column:
    """Of each line of a text its code points with the line end, its heading (T11) if it is one, and whether it is blank."""
    def facts(lines: Column) -> Column:
        return F.transform(lines, lambda x, i: F.struct((F.length(x) + (i < F.size(lines) - 1).cast("int")).alias("size"), heading_of(x).alias("title"), (stripped(x) == "").alias("blank")))

    return let(F.split(text, "\n", -1), facts)


def sized(stops: np.ndarray, start: int, end: int, most: int = V.MAX_CHARS) -> list[int]:
    """Where pieces of at most `most` code points begin between two offsets; each is as long as whole lines allow.

    `stops` are the offsets at which lines end. A lone line end is no piece.
    """
    begins = [start]
    while end - begins[-1] > most:
        reach = begins[-1] + most
        stop = int(stops[np.searchsorted(stops, reach, "right") - 1]) if stops[0] <= reach else 0
        begins.append(stop if stop > begins[-1] + 1 else reach)
    return begins


def likeness(vectors: list[list[float] | None]) -> np.ndarray:
    """V1 of each vector with the one before it; 0 where one is missing, of another size, or without length."""
    found = np.zeros(len(vectors))
    for i, (a, b) in enumerate(pairwise(vectors), 1):
        if a and b and len(a) == len(b):
            x, y = np.asarray(a, float), np.asarray(b, float)
            found[i] = x @ y / max(np.sqrt((x @ x) * (y @ y)), 1e-300)
    return found


def _embedded(embed: Embedder, part: str) -> list[float] | None:
    try:
        return embed(part)
    except Exception:  # whatever an embedder raises: its part is like no other
        return None


def related(ends: np.ndarray, start: int, alike: np.ndarray) -> list[int]:
    """Where groups of paragraphs begin. A paragraph stays with the ones before it while they fit together and it is
    like the last of them, or they are short."""

    def begin(group: int, i: int) -> int:
        before = int(ends[i - 1])
        stays = ends[i] - group <= V.MAX_CHARS and (alike[i] or before - group < V.MIN_CHARS)
        return group if stays else before

    return sorted(set(accumulate(range(1, len(ends)), begin, initial=start)))


def passages(sizes: list[int], titles: list[str | None], blank: list[bool], text: str | None = None, embed: Embedder | None = None) -> list[tuple[int, int, str | None]]:
    """C2, and with an embedder C3: (start, end, heading) of the passages of one page; together they are the page.

    A section begins with each heading; long ones are split into C4's paragraphs, which end with a blank line, if there
    is an embedder; what is still too long is cut at line ends.
    """
    stops = np.cumsum(np.asarray(sizes, np.int64))
    whole = int(stops[-1]) if len(stops) else 0
    starts = stops - np.asarray(sizes, np.int64)
    heads = [(int(at), title) for at, title, size in zip(starts, titles, sizes) if title is not None and size]
    if whole and (not heads or heads[0][0]):
        heads.insert(0, (0, None))
    edges = stops[np.asarray(blank, bool)] if embed else stops[:0]
    out = []
    for (start, title), (end, _) in pairwise([*heads, (whole, None)]):
        groups = [start]
        if embed and end - start > V.TARGET_CHARS:
            ends = np.unique(np.append(edges[(edges > start) & (edges < end)], end))
            parts = [_embedded(embed, text[a:b]) for a, b in pairwise([start, *ends.tolist()])]
            groups = related(ends, start, likeness(parts) >= V.SIMILAR)
        begins = [at for a, b in pairwise([*groups, end]) for at in sized(stops, a, b)]
        out += [(a, b, title) for a, b in pairwise([*begins, end])]
    return out


def _with_labels(df: DataFrame, page: str) -> DataFrame:
    p = F.col(page)
    return df.withColumn("chunk_id", F.concat(F.lit("p"), p.cast("string"), F.lit("-"), F.col("start").cast("string"))).withColumn("location", location_label(p, F.col("start"), F.col("end"), F.col("heading")))


def fixed_chunks(df: DataFrame, text: str = "text", page: str = "page", size: int = V.MAX_CHARS) -> DataFrame:
    """Windows of `size` code points; blank ones are left out. All columns but the text stay."""
    t = F.coalesce(F.col(text), F.lit(""))
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    cut = df.withColumn("start", F.explode(starts)).withColumn("chunk_text", F.substring(t, F.col("start") + 1, F.lit(size)))
    kept = cut.where(F.col("chunk_text").rlike(r"(?U)\S")).withColumn("end", F.col("start") + F.length("chunk_text")).withColumn("heading", F.lit(None).cast("string"))
    return _with_labels(kept, page).drop(text)


def structure_chunks(df: DataFrame, text: str = "text", page: str = "page", embed: Embedder | None = None) -> DataFrame:
    """One row for each passage. Blank ones stay, so that passages put together are the page."""
    t = F.coalesce(F.col(text), F.lit(""))

    @F.pandas_udf(PASSAGE)
    def cut(sizes: pd.Series, titles: pd.Series, blank: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "heading": h} for a, b, h in passages(*row, embed)] for row in zip(sizes, titles, blank, texts)], dtype=object)

    facts = df.withColumn("_f", line_facts(t))
    cuts = facts.withColumn("_p", F.explode(cut("_f.size", "_f.title", "_f.blank", t if embed else F.lit(None).cast("string")))).drop("_f")
    rows = cuts.select("*", F.col("_p.start").alias("start"), F.col("_p.end").alias("end"), F.col("_p.heading").alias("heading")).withColumn("chunk_text", F.substring(t, F.col("start") + 1, F.col("end") - F.col("start")))
    return _with_labels(rows.drop("_p"), page).drop(text)


SPANS = "array<struct<start:int,end:int,heading:string,ends:array<int>>>"


def spans(sizes: list[int], titles: list[str | None], blank: list[bool]) -> list[dict]:
    """Sections of one page, by numbers only: start, end, heading, and C4's paragraph ends where it is long and has several."""
    stops = np.cumsum(np.asarray(sizes, np.int64))
    whole = int(stops[-1]) if len(stops) else 0
    starts = stops - np.asarray(sizes, np.int64)
    heads = [(int(at), title) for at, title, size in zip(starts, titles, sizes) if title is not None and size]
    if whole and (not heads or heads[0][0]):
        heads.insert(0, (0, None))
    edges = stops[np.asarray(blank, bool)]
    out = []
    for (start, title), (end, _) in pairwise([*heads, (whole, None)]):
        ends = np.unique(np.append(edges[(edges > start) & (edges < end)], end)).tolist() if end - start > V.TARGET_CHARS else []
        out.append({"start": start, "end": end, "heading": title, "ends": ends if len(ends) > 1 else []})
    return out


def pieces(sizes: list[int], sections: list[dict], groups: dict[int, list[int]]) -> list[dict]:
    """Passages of a page: groups of paragraphs, which begin at the given places of a section, cut at line ends where too long."""
    stops = np.cumsum(np.asarray(sizes, np.int64))
    out = []
    for s in sections:
        starts = groups.get(s["start"]) or [s["start"]]
        begins = [at for a, b in pairwise([*starts, s["end"]]) for at in sized(stops, a, b)]
        out += [{"start": a, "end": b, "heading": s["heading"]} for a, b in pairwise([*begins, s["end"]])]
    return out


def group_starts(start: Column, paragraphs: Column) -> Column:
    """Where groups begin, folded over a section's paragraphs (end, alike) in order: one stays with those before it while
    they fit together and it is like the last of them, or they are short."""
    first = F.struct(start.alias("group"), F.element_at(paragraphs, 1)["end"].alias("before"), F.array(start).alias("starts"))

    def step(acc: Column, p: Column) -> Column:
        stays = (p["end"] - acc["group"] <= V.MAX_CHARS) & (p["alike"] | (acc["before"] - acc["group"] < V.MIN_CHARS))
        return F.struct(F.when(stays, acc["group"]).otherwise(acc["before"]).alias("group"), p["end"].alias("before"), F.when(stays, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["before"])).alias("starts"))

    return F.aggregate(F.slice(paragraphs, 2, F.greatest(F.lit(0), F.size(paragraphs) - 1)), first, step, lambda acc: acc["starts"])


def hybrid_chunks(df: DataFrame, key: list[str], cached: DataFrame, embed: Callable[[list[str]], list[list[float]]], identity: str, text: str = "text", page: str = "page", batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """C3, C4, V6, S16 in two phases: (passages as structure_chunks() gives them, vectors to add to the cache).

    Long sections are cut into paragraphs, which become rows; different ones are embedded in batches, each once, and not if
    the cache (key, embedding) has them. Then a fold groups them by how alike neighbours are. `key` names columns that tell pages apart,
    none of them null. Only the embedder sees text in Python. An embedder that fails stops the job, one that has no vector
    for a text gives null or an empty one: that paragraph is like no other.
    """
    from sievework.plans.session import workspace
    from sievework.sources.readers import embedded

    folder = workspace(df.sparkSession, "paragraphs")

    def kept(x: DataFrame, name: str) -> DataFrame:
        x.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(x.schema).parquet(f"{folder}/{name}")

    @F.pandas_udf(SPANS)
    def sections(sizes: pd.Series, titles: pd.Series, blank: pd.Series) -> pd.Series:
        return pd.Series([spans(*row) for row in zip(sizes, titles, blank)], dtype=object)

    @F.pandas_udf(PASSAGE)
    def cut(sizes: pd.Series, found: pd.Series, at: pd.Series, starts: pd.Series) -> pd.Series:
        rows = zip(sizes, found, at, starts)
        return pd.Series([pieces(z, f, {int(k): list(v) for k, v in zip(a, g)} if a is not None else {}) for z, f, a, g in rows], dtype=object)

    t = F.coalesce(F.col(text), F.lit(""))
    own = [*dict.fromkeys([*key, page])]
    facts = df.withColumn("_f", line_facts(t)).withColumn("_s", sections("_f.size", "_f.title", "_f.blank"))
    long = facts.select(*own, t.alias("_t"), F.explode(F.filter("_s", lambda s: F.size(s["ends"]) > 0)).alias("_x"))
    begins = F.concat(F.array("_x.start"), F.slice(F.col("_x.ends"), 1, F.size("_x.ends") - 1))
    rows = long.select(*own, "_t", F.col("_x.start").alias("_section"), F.posexplode(F.arrays_zip(begins.alias("a"), F.col("_x.ends").alias("b"))).alias("_i", "_p"))
    paragraphs = kept(rows.select(*own, "_section", "_i", F.col("_p.b").alias("_end"), F.substring("_t", F.col("_p.a") + 1, F.col("_p.b") - F.col("_p.a")).alias("_text")), "rows")
    vectors, fresh = embedded(paragraphs, cached, embed, identity, text="_text", batch=batch)
    fresh = kept(fresh, "fresh")
    known = cached.select("key", "embedding").unionByName(fresh)
    vectors = embedded(paragraphs, known, embed, identity, text="_text", batch=batch)[0]
    section = Window.partitionBy(*own, "_section").orderBy("_i")  # a section's paragraphs
    before = F.lag("embedding").over(section)
    alike = F.coalesce(similar(F.col("_before"), F.col("embedding")), F.lit(False))
    folded = (
        vectors.withColumn("_before", before).select(*own, "_section", "_i", "_end", alike.alias("_alike"))
        .groupBy(*own, "_section").agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_end").alias("end"), F.col("_alike").alias("alike")))).alias("_ps"))
        .select(*own, "_section", group_starts(F.col("_section"), F.col("_ps")).alias("_starts"))
        .groupBy(*own).agg(F.collect_list(F.struct("_section", "_starts")).alias("_g"))
    )
    joined = facts.join(folded, own, "left")
    cuts = joined.withColumn("_p", F.explode(cut("_f.size", "_s", "_g._section", "_g._starts"))).drop("_f", "_s", "_g")
    out = cuts.select(*df.columns, F.col("_p.start").alias("start"), F.col("_p.end").alias("end"), F.col("_p.heading").alias("heading")).withColumn("chunk_text", F.substring(t, F.col("start") + 1, F.col("end") - F.col("start")))
    return _with_labels(out, page).drop(text).withColumn("strategy", F.lit(V.STRATEGY_LABELS["hybrid"])), fresh


def similar(a: Column, b: Column) -> Column:
    """V1 at the threshold of C3, with one root, so that whole numbers do not suffer."""
    square = dot(a, a) * dot(b, b)
    return (F.size(a) == F.size(b)) & (square > 0) & (dot(a, b) / F.sqrt(F.when(square > 0, square)) >= V.SIMILAR)


def chunked(df: DataFrame, strategy: str = "structure", text: str = "text", page: str = "page", embed: Embedder | None = None) -> DataFrame:
    """Passages by a strategy's name, with the label of its version."""
    if strategy not in V.STRATEGY_LABELS:
        raise ValueError(f"unknown strategy: {strategy}")
    rows = fixed_chunks(df, text, page) if strategy == "fixed" else structure_chunks(df, text, page, embed if strategy == "hybrid" else None)
    return rows.withColumn("strategy", F.lit(V.STRATEGY_LABELS[strategy]))


def section_budget(df: DataFrame, chunks: DataFrame, key: str, most: int = V.SECTION_BUDGET) -> DataFrame:
    """Documents with no passage, or with too many, need review."""
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    reason = F.when(n == 0, "No readable text was extracted").when(n > most, "Too many sections")
    return df.select(key).join(counts, key, "left").select(key, n.cast("long").alias("sections"), reason.isNotNull().alias("needs_review"), reason.alias("reason"))


def is_exact_partition(df: DataFrame, chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Whether a document's passages, in order, are its text."""
    whole = chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "chunk_text"))), lambda c: c["chunk_text"]), "").alias("_whole"))
    return df.select(key, text).join(whole, key, "left").select(key, (F.coalesce("_whole", F.lit("")) == F.coalesce(text, F.lit(""))).alias("exact"))
