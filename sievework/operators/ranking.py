"""Ranking, latest and canonical rows, and the joins that decide what may be ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.operators.joins import join_counted


def current_assessments(records: DataFrame, groups: DataFrame, assessments: DataFrame) -> DataFrame:
    """Records with the assessment that counts: of the record's version and its group's rubric.

    Records are active, completed and no duplicates; groups active and not paused. Groups are few, so they join first
    and small; the assessment join is on the whole key.
    """
    open_groups = groups.where("active AND NOT paused").select(F.col("id").alias("role_id"), F.col("rubric_id").alias("rubric_id"))
    eligible = records.where("active AND duplicate_of IS NULL AND status = 'completed'").join(open_groups, "role_id")
    scored = assessments.select("application_id", "version", "rubric_id", "score", "body", F.col("created").alias("assessed_at"))
    return eligible.join(scored, (eligible.id == scored.application_id) & (eligible.version == scored.version) & (eligible.rubric_id == scored.rubric_id)).drop(scored.application_id).drop(scored.version).drop(scored.rubric_id)


def ranked(df: DataFrame, partition: list[str], score: str, ident: str) -> DataFrame:
    """Competition rank (1, 1, 3) by falling score, and whether the score is shared. No score comes last. `ident` tells rows apart.

    Scores are counted first, combining before the shuffle, and only different scores are put in order; so a group may
    hold any share of the rows. The counts come back by join_counted(), as one score may do so too.
    """
    keys = [*partition, score]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*partition).orderBy(F.col(score).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(*keys, "_n", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("long").alias("rank"), (F.col("_n") > 1).alias("tie"))
    return join_counted(df, placed, keys, "_n", ident).drop("_n")


def latest(df: DataFrame, partition: list[str], order: str) -> DataFrame:
    """The row of each key with the largest `order`: an aggregate, so a hot key combines before it is shuffled."""
    rest = [c for c in df.columns if c not in partition]
    return df.groupBy(*partition).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*partition, "_r.*")


def with_canonical(df: DataFrame, partition: list[str], ident: str) -> DataFrame:
    """The smallest identifier of each key beside every row; also R4, deduplication by content.

    The smallest is an aggregate and comes back by join_counted(); a window would bring a hot key to one task.
    """
    first = df.groupBy(*partition).agg(F.min(ident).alias("canonical_id"), F.count(F.lit(1)).alias("_n"))
    return join_counted(df, first, partition, "_n", ident).drop("_n").withColumn("is_duplicate", F.col("canonical_id") != F.col(ident))


def at_rank(df: DataFrame, rank: int) -> DataFrame:
    """All rows of a rank; ties above can leave it empty."""
    return df.where(F.col("rank") == rank)


def top_with_ties(df: DataFrame, partition: list[str], score: str, ident: str, most: int = 3) -> DataFrame:
    """For each key, how many rows a cut at `most` shows and whether it parts rows of one rank.

    Only counts of scores are put in order, as in ranked(). The cut parts a score that has rows on both sides of it.
    """
    counts = df.groupBy(*partition, score).agg(F.count(ident).alias("_n"))
    above = Window.partitionBy(*partition).orderBy(F.col(score).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    parted = (F.col("_above") < most) & (F.col("_above") + F.col("_n") > most)
    return placed.groupBy(*partition).agg(F.least(F.lit(most), F.sum("_n")).cast("long").alias("shown"), F.max(parted).alias("tie_beyond_limit"))


def with_previous(df: DataFrame, partition: list[str], order: str, value: str, width: int = 4096) -> DataFrame:
    """Each row with the `value` of the row before it in its key, as `previous`; `order` is a whole number, unique in a key.

    Rows look back within ranges of `width` numbers; the first of a range gets the last value of the range before, from
    a table with a row for each range. So a key may hold any share of the rows.
    """
    keys = [*partition, "_range"]
    dealt = df.withColumn("_range", F.floor(F.col(order) / width))
    last = dealt.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"))
    edges = last.select(*[F.col(k).alias(f"_e{k}") for k in keys], F.lag("_last").over(Window.partitionBy(*partition).orderBy("_range")).alias("_edge"))
    within = Window.partitionBy(*keys).orderBy(order)
    looked = dealt.withColumn("_n", F.row_number().over(within)).withColumn("_before", F.lag(F.struct(F.col(value).alias("v"))).over(within))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e{k}")) for k in keys])
    return looked.join(edges, same & (F.col("_n") == 1), "left").select(*df.columns, F.coalesce("_before", "_edge")["v"].alias("previous"))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first rows of an order, taken without sorting all."""
    return df.orderBy(*order).limit(n)


def top_n_each(df: DataFrame, partition: list[str], n: int, *order: Column) -> DataFrame:
    """L4 for each key: tasks keep their own first rows before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def running_heading(lines: DataFrame, partition: list[str], position: str, heading: str) -> DataFrame:
    """The number of headings up to each line: which segment it lies in."""
    before = Window.partitionBy(*partition).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("segment", F.count(heading).over(before))


def in_name_order(df: DataFrame, name: str, ident: str, language: str = "UNICODE") -> DataFrame:
    """By name as a dictionary has it (accents and case decide only between names that are alike without), no name last, ties by identifier."""
    return df.orderBy(F.collate(F.col(name), language).asc_nulls_last(), ident)
