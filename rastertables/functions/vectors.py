"""Column expressions on array<float> vectors. Everything stays in the JVM."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v divided by its length; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda e: e.cast("double") / n)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mean_vector(df: DataFrame, keys: list[str], vec: str = "vec", out: str = "vec") -> DataFrame:
    """Element-wise mean of vectors per key: positions are exploded, averaged with map-side combine and put back in
    order, so a hot key is pre-aggregated in every task before the shuffle."""
    parts = df.select(*keys, F.posexplode(vec).alias("pos", "e"))
    means = parts.groupBy(*keys, "pos").agg(F.avg(F.col("e").cast("double")).alias("e"), F.count("*").alias("n"))
    return means.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda s: s["e"]).alias(out),
        F.max("n").alias("n"))
