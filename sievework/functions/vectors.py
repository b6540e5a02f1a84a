"""Vectors as arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import java_quote


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """V1: cosine similarity; 0 for vectors of different sizes, null ones, and those without length.

    Norms that are already columns need not be computed again.
    """
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (length > 0), F.try_divide(dot(a, b), length)), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """V3."""
    return 1 - cosine(a, b)


def is_valid(v: Column) -> Column:
    """V4: not empty, and every component a finite number."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def literal(v: Column) -> Column:
    """V5: [a,b,c]."""
    return F.to_json(v)


def bag_of_words(text: Column, vocabulary: Iterable[str]) -> Column:
    """V7: how often each word's letters occur in the lower-cased text, and 1."""
    low = F.lower(text)
    return F.array(*[F.regexp_count(low, F.lit(java_quote(w.lower()))).cast("double") for w in vocabulary], F.lit(1.0))


def bar_percent(n: Column, of: Column) -> Column:
    """A share as whole per cent; 0 of nothing is 0."""
    return F.coalesce(F.round(F.try_divide(n.cast("double"), of.cast("double")) * 100), F.lit(0.0)).cast("long")
