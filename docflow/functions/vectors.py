"""Functions of vectors as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    """P18."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def cosine(a: Column, b: Column) -> Column:
    """P19; null if a norm is 0."""
    both = norm(a) * norm(b)
    return F.when(both > 0, inner_product(a, b) / both)


def mean(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x) / F.size(v)


def std(v: Column) -> Column:
    """Population standard deviation."""
    m = mean(v)
    return F.transform(F.array(m), lambda c: F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + (x - c) * (x - c)) / F.size(v)))[0]


def features(v: Column) -> list[Column]:
    """P17."""
    low, high = F.array_min(doubles(v)), F.array_max(doubles(v))
    return [norm(v).alias("norm"), mean(v).alias("mean"), std(v).alias("std"), low.alias("min_value"), high.alias("max_value"), (high - low).alias("value_range")]


def dimension(v: Column) -> Column:
    """0 for none."""
    return F.coalesce(F.size(v), F.lit(0))


def sigmoid(x: Column) -> Column:
    """P15."""
    return 1 / (1 + F.exp(-x))
