"""Distances between double arrays as column expressions, and set similarities from counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mahalanobis(point: Column, centre: Column, sd: Column) -> Column:
    """Diagonal; a dimension with sd 0 is not scaled."""
    scaled = F.zip_with(F.zip_with(point, centre, lambda x, y: x - y), sd, lambda d, s: F.when(s == 0, d).otherwise(d / s))
    return F.sqrt(_sum(F.transform(scaled, lambda d: d * d)))


def jaccard(common: Column, n1: Column, n2: Column) -> Column:
    return F.try_divide(common, n1 + n2 - common)


def cosine(common: Column, n1: Column, n2: Column) -> Column:
    """Of sets, from counts; 0 if one is empty."""
    return F.coalesce(F.try_divide(common, F.sqrt(n1) * F.sqrt(n2)), F.lit(0.0))


def positional(a: Column, b: Column) -> Column:
    """Share of places where two lists agree."""
    return F.try_divide(_sum(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0))), F.size(a))
