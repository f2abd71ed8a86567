"""Dense numbering inside groups of any size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def banded_ordinal(df: DataFrame, keys: list[str], band: Column, order: list, out: str) -> DataFrame:
    """Number rows 0..n-1 per group in (band, order) order. Only band totals are accumulated over a whole group;
    the rows themselves are numbered inside (group, band), so no task holds a whole group."""
    rows = df.withColumn("_band", band)
    totals = rows.groupBy(*keys, "_band").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = totals.select(*keys, "_band", (F.sum("_n").over(w) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy(*keys, "_band").orderBy(*order)
    numbered = rows.withColumn("_in_band", F.row_number().over(inside) - 1)
    return (numbered.join(starts, [*keys, "_band"])
            .withColumn(out, (F.col("_start") + F.col("_in_band")).cast("long")).drop("_band", "_start", "_in_band"))


def hashed_ordinal(df: DataFrame, keys: list[str], identity: list[str], out: str, bands: int = 4096) -> DataFrame:
    """Stable numbering 0..n-1 per group where any fixed order will do."""
    return banded_ordinal(df, keys, F.pmod(F.xxhash64(*identity), F.lit(bands)), [F.xxhash64(*identity), *identity], out)


def uniform(*identity) -> Column:
    """Number in [0, 1) that depends only on the given columns: the same row gets the same draw on any cluster."""
    return F.shiftrightunsigned(F.xxhash64(*identity), 11).cast("double") / F.lit(float(1 << 53))


def normal(*identity) -> Column:
    """Standard normal draw by Box and Muller from two hashed uniforms."""
    u1 = F.greatest(uniform(*identity, F.lit("a")), F.lit(1e-16))
    u2 = uniform(*identity, F.lit("b"))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)
