"""Checks of what must hold, and comparison of two stores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, or an error that names a few repeated keys."""
    if found := violations(df, keys).limit(5).collect():
        raise ValueError(f"{keys} repeat: {[tuple(r[k] for k in keys) for r in found]}")
    return df


def assert_append_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """`after`, or an error if rows of `before` are missing or changed."""
    if before.exceptAll(after).limit(1).count():
        raise ValueError("rows of an append-only table were changed or removed")
    return after


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, how often each side has them, where that differs; nulls are equal. One aggregate over both sides."""
    columns = a.columns
    both = a.select("*", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return both.groupBy(*columns).agg(F.sum("_a").alias("in_a"), F.sum("_b").alias("in_b")).where("in_a <> in_b")


def compare_stores(a: dict[str, DataFrame], b: dict[str, DataFrame], examples: int = 20) -> dict[str, dict]:
    """For each table both counts, whether they match, and a few rows that differ."""
    out = {}
    for name, left in a.items():
        right = b[name]
        few = multiset_difference(left, right).limit(examples).collect()
        out[name] = {"a": left.count(), "b": right.count(), "match": not few, "examples": [r.asDict() for r in few]}
    return out


def is_full(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """How many rows lack each column: one row."""
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
