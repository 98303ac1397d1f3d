"""Vectors as arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NULL for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_pool(tokens: DataFrame, key: str) -> DataFrame:
    """(key, pooled) from (key, mask, vector): the mean of the vectors, weighed by the mask, over at least one."""
    parts = tokens.select(key, "mask", F.posexplode("vector").alias("i", "x"))
    mean = F.sum(F.col("x").cast("double") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))
    by_dim = parts.groupBy(key, "i").agg(mean.alias("x"))
    return by_dim.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("pooled"))


def rounded(x: Column, decimals: int) -> Column:
    """Rounded half away from zero; what is below zero stays so, as -0.0, which Spark's round loses."""
    near = F.round(x, decimals)
    return F.when((near == 0) & (x < 0), F.lit(-0.0)).otherwise(near)


def softmax(logits: Column) -> Column:
    """Shifted by the largest, so that no exponent overflows."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
