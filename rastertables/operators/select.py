"""Ordering, picking and splitting slices and result rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outward_order(slices: DataFrame, start: DataFrame, by: list[str] = ["volume_id"]) -> DataFrame:
    """Processing order that starts at the slice nearest the reference and alternates above and below. start: by + ref_z;
    groups without a reference slice are processed in plain order."""
    w = Window.partitionBy(*by).orderBy("z")
    s = slices.select(*by, "z").distinct().withColumn("_i", F.row_number().over(w)).join(start.select(*by, "ref_z"), by, "left")
    gap = F.when(F.col("ref_z").isNotNull(), F.struct(F.abs(F.col("z") - F.col("ref_z")).alias("d"), F.col("_i").alias("i")))
    s = s.join(s.groupBy(*by).agg(F.min(gap)["i"].alias("_s")), by)
    # Above comes before below at the same distance
    order = Window.partitionBy(*by).orderBy(F.coalesce(F.abs(F.col("_i") - F.col("_s")), F.col("_i")), F.when(F.col("_i") >= F.col("_s"), 0).otherwise(1))
    return s.withColumn("step", F.row_number().over(order)).select(*by, "z", "step")


def evenly_spaced(items: DataFrame, k: int, by: list[str] = ["volume_id"], order: str = "z") -> DataFrame:
    """At most k items per group, evenly spaced by position (half goes to even), ends included."""
    n = F.count("*").over(Window.partitionBy(*by))
    r = items.withColumns({"_i": F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1, "_n": n})
    m = F.least(F.lit(k), F.col("_n"))
    at = F.transform(F.sequence(F.lit(0), m.cast("int") - 1), lambda j: F.bround(j * (F.col("_n") - 1) / F.greatest(m - 1, F.lit(1))).cast("int"))
    return r.where(F.array_contains(at, F.col("_i"))).drop("_i", "_n")


def interleaved_split(items: DataFrame, names: list[str], by: list[str] = ["volume_id"], order: str = "z") -> DataFrame:
    """Items dealt to the named parts in turn."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return items.withColumn("split", F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names)) + 1))


def reference_picks(slices: DataFrame, extents: DataFrame, n: int, by: list[str] = ["volume_id"]) -> DataFrame:
    """n target slices over the central 80 %, each replaced by the nearest slice with a non-empty reference that no
    earlier target took, among the slices nearest to the target (3, or a twentieth of the stack). slices: by, z, filled;
    slices it lacks are empty, and count among the nearest all the same. extents: by, n_z."""
    e = extents.select(*by, "n_z")
    last = F.col("n_z") - 1
    lo, hi = F.floor(last * 0.1).cast("int"), F.bround(last * 0.9).cast("int")
    m = F.greatest(F.lit(1), F.least(F.lit(n), hi - lo + 1))
    targets = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.bround(lo + j * (hi - lo) / F.greatest(m - 1, F.lit(1))).cast("int"))))
    reach = F.greatest(F.lit(3), F.floor(F.col("n_z") / 20).cast("int"))
    cand = slices.join(e.withColumns({"_targets": targets, "_reach": reach}), by).select(*by, "z", "filled", "n_z", "_reach", F.posexplode("_targets").alias("_k", "_t"))
    # How many slices of the whole stack are nearer to the target, the lower one first at equal distance
    d, t = F.abs(F.col("z") - F.col("_t")), F.col("_t")
    nearer = F.least(F.col("n_z") - 1, t + d - 1) - F.greatest(F.lit(0), t - d + 1) + 1
    rank = F.greatest(nearer, F.lit(0)) + F.when((F.col("z") > t) & (t - d >= 0), 1).otherwise(0) + 1
    cand = cand.withColumn("_rank", rank).where((F.col("_rank") <= F.col("_reach")) & F.col("filled"))
    options = cand.groupBy(*by, "_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "z"))), lambda s: s["z"]).alias("_zs"))
    per = options.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_zs"))), lambda s: s["_zs"]).alias("_all"))
    # Targets are at most n per volume: serve them in order, each taking its first free slice
    empty = F.array().cast("array<int>")
    picked = F.aggregate("_all", empty, lambda acc, zs: F.concat(acc, F.slice(F.array_except(zs, acc), 1, 1)))
    return per.select(*by, F.explode(picked).alias("z"))


def newest(df: DataFrame, by: list[str], k: int, when: str = "created", beyond: bool = False) -> DataFrame:
    """The k newest rows per group, or those beyond them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(when), F.desc("run_id")))
    r = df.withColumn("_k", rank)
    return r.where(F.col("_k") > k if beyond else F.col("_k") <= k).drop("_k")


def worst_median_best(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(value, tie)
    n = F.count("*").over(Window.partitionBy(*by))
    r = df.withColumns({"_i": F.row_number().over(w), "_n": n})
    case: Column = F.explode(F.filter(F.array(F.when(F.col("_i") == 1, "worst"), F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, "median"), F.when(F.col("_i") == F.col("_n"), "best")),
                                      lambda c: c.isNotNull()))
    return r.withColumn("case", case).drop("_i", "_n")


def top_settings(df: DataFrame, by: list[str], setting: str, value: str, k: int) -> DataFrame:
    m = df.groupBy(*by, setting).agg(F.avg(value).alias("score"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), setting)
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_slice(wanted: DataFrame, processed: DataFrame, steps: DataFrame, by: list[str] = ["volume_id"]) -> DataFrame:
    """Nearest processed slice within half a step; ties go to the lower slice. A wanted slice only looks at the slices
    that can be near enough, through an equi-join on the slice number."""
    w = wanted.join(steps, by).withColumn("_z", F.explode(F.sequence(F.ceil(F.col("z") - F.col("step") / 2).cast("int"), F.floor(F.col("z") + F.col("step") / 2).cast("int"))))
    p = processed.select(*by, F.col("z").alias("_z")).distinct()
    return w.join(p, [*by, "_z"]).groupBy(*by, "z").agg(F.min(F.struct(F.abs(F.col("z") - F.col("_z")).alias("d"), "_z"))["_z"].alias("nearest_z"))
