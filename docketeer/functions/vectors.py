"""Vector functions over array<double> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def centroid(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Mean vector for each group; partial sums by position, so a group's vectors are never gathered."""
    flat = df.select(*group, F.posexplode(vector).alias("i", "x"))
    means = flat.groupBy(*group, "i").agg(F.avg("x").alias("x"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy(*group).agg(F.transform(pairs, lambda p: p["x"]).alias(vector))
