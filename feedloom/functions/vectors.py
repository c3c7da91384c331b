"""Vectors and ranking scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def valid(v: Column, size: int) -> Column:
    """Whether a vector has this dimension and finite members only."""
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def recency(published: Column, now: Column) -> Column:
    """Up to 5 % more for new items, falling off by months; 1 without a date."""
    days = F.greatest((F.unix_micros(now) - F.unix_micros(published)) / 86_400_000_000.0, F.lit(0.0))
    return F.when(published.isNull(), 1.0).otherwise(1 + 0.05 / (1 + days / 30))


def fused(semantic: Column, lexical: Column, same_feed: Column, fresh: Column) -> Column:
    """Reciprocal-rank fusion of two list positions, less a tenth for items of the same feed."""
    part = lambda weight, place: F.coalesce(F.lit(weight) / (60 + place), F.lit(0.0))
    return (part(0.7, semantic) + part(0.3, lexical)) * F.when(same_feed, 0.9).otherwise(1.0) * fresh


def qualifies(similarity: Column, lexical_rank: Column, strong: float, weak: float, lexical: float) -> Column:
    """Near by vector, or less near but with a common term, or by terms alone."""
    return F.coalesce((similarity >= strong) | ((similarity >= weak) & lexical_rank.isNotNull()) | (similarity.isNull() & (lexical_rank >= lexical)), F.lit(False))
