"""Exact quantiles per group without putting a group into one task.

Values are first counted per (group, value), with map-side combine. The counts are summed into ordered buckets, 4096
per power of two, running bucket totals tell which buckets hold the wanted ranks, and only the values of those buckets
are looked at one by one. A window therefore runs over bucket totals, whose number does not grow with the rows, or over
the distinct values of one bucket (at most 2048 for 32-bit floats).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _coarse(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.log2(F.abs(v) * F.lit(2.0 ** 40) + 1.0) * 4096)).cast("long")


def _ranks(total: Column, probs: dict[str, float], method: str) -> Column:
    """array<struct<name, side, k>>: the zero-based ranks each wanted quantile needs."""
    out = []
    for name, p in probs.items():
        if method == "lower":
            k = (F.ceil(total * F.lit(float(p))) - 1).cast("long")
            out.append(F.struct(F.lit(name).alias("name"), F.lit(0).alias("side"), F.greatest(k, F.lit(0).cast("long")).alias("k"),
                                F.lit(0.0).alias("frac")))
        else:
            h = (total - 1) * F.lit(float(p))
            frac = h - F.floor(h)
            out.append(F.struct(F.lit(name).alias("name"), F.lit(0).alias("side"), F.floor(h).cast("long").alias("k"), frac.alias("frac")))
            out.append(F.struct(F.lit(name).alias("name"), F.lit(1).alias("side"), F.ceil(h).cast("long").alias("k"), frac.alias("frac")))
    return F.array(*out)


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], method: str = "linear") -> DataFrame:
    """One row per group with a column per entry of probs.

    method "linear" interpolates between the two neighbouring ranks, "lower" takes the value whose cumulative share
    first reaches the probability. Nulls and NaNs are left out."""
    counts = (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
              .select(*keys, F.col(value).cast("double").alias("_v"))
              .groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
              .withColumn("_b", _coarse(F.col("_v"))))
    totals = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    by_key = Window.partitionBy(*keys)
    ahead = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("_cum", F.sum("_n").over(ahead)).withColumn("_total", F.sum("_n").over(by_key))
    totals = totals.withColumn("_t", _ranks(F.col("_total"), probs, method))
    # Ranks counted from the start of the bucket that holds them
    hit = totals.select(*keys, "_b", F.filter("_t", lambda t: (t["k"] >= F.col("_cum") - F.col("_n")) & (t["k"] < F.col("_cum"))).alias("_t"),
                        (F.col("_cum") - F.col("_n")).alias("_before"))
    hit = hit.where(F.size("_t") > 0).withColumn("_t", F.transform("_t", lambda t: F.struct(
        t["name"].alias("name"), t["side"].alias("side"), (t["k"] - F.col("_before")).alias("k"), t["frac"].alias("frac")))).drop("_before")
    kept = counts.join(hit, [*keys, "_b"])
    group = [*keys, "_b"]
    ahead = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = kept.withColumn("_cum", F.sum("_n").over(ahead))
    found = kept.select(*keys, "_v", F.explode(F.filter("_t", lambda t: (t["k"] >= F.col("_cum") - F.col("_n")) & (t["k"] < F.col("_cum")))).alias("t"))
    cols = []
    for name in probs:
        lo = F.max(F.when((F.col("t.name") == name) & (F.col("t.side") == 0), F.col("_v")))
        if method == "lower":
            cols.append(lo.alias(name))
            continue
        hi = F.max(F.when((F.col("t.name") == name) & (F.col("t.side") == 1), F.col("_v")))
        frac = F.max(F.when(F.col("t.name") == name, F.col("t.frac")))
        cols.append((lo + (hi - lo) * frac).alias(name))
    return found.groupBy(*keys).agg(*cols)
