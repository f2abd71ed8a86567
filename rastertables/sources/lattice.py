"""Raster tables derived from the order tables: every 2500 order keys form one volume of 7 slices of 40 x 48 cells,
so the number of volumes grows with the data. Channel 0 is the quantity per cell, channel 1 the price."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import by_shuffle, fit_shuffles, spread

DEPTH, HEIGHT, WIDTH = 7, 40, 48
VOXEL_UM = (2.0, 0.5, 0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    fit_shuffles(spark, li.count())
    return (li.groupBy(
        F.concat(F.lit("v"), F.expr("cast(l_orderkey div 2500 as string)")).alias("volume_id"),
        (F.col("l_linenumber") - 1).cast("int").alias("z"),
        F.expr("cast((l_suppkey * 11 + l_partkey div 48) % 40 as int)").alias("y"),
        F.expr("cast(l_partkey % 48 as int)").alias("x"))
        .agg(F.sum("l_quantity").alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("p")))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per volume with its extent."""
    li = table(spark, sf_dir, "lineitem")
    return (li.select(F.concat(F.lit("v"), F.expr("cast(l_orderkey div 2500 as string)")).alias("volume_id")).distinct()
            .select("volume_id", F.lit(DEPTH).alias("n_z"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width")))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes(spark, sf_dir).withColumn("z", F.explode(F.sequence(F.lit(0), F.col("n_z") - 1)))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of every slice, 0 where nothing was recorded. Recorded cells meet the image rows as one map per row, so
    the empty cells are made after the last exchange."""
    line = ["volume_id", "z", "y"]
    lines = spread(slices(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))), line, WIDTH)
    recorded = lattice(spark, sf_dir).groupBy(*line).agg(F.map_from_entries(F.collect_list(F.struct("x", F.struct("q", "p")))).alias("_cells"))
    cells = lines.join(recorded, line, "left").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    cell = F.try_element_at("_cells", F.col("x"))
    return by_shuffle(cells.select(*line, "x", *[F.coalesce(cell[c], F.lit(0.0)).alias(c) for c in ("q", "p")]))


def plane(spark: SparkSession, sf_dir: str, channel: str = "q") -> DataFrame:
    return dense(spark, sf_dir).select("volume_id", "z", "y", "x", F.col(channel).alias("value"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask cells of the first channel."""
    return lattice(spark, sf_dir).where("q >= 30").select("volume_id", "z", "y", "x")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask cells of the second channel."""
    return lattice(spark, sf_dir).where("p >= 35000").select("volume_id", "z", "y", "x")


def patch_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows laid out as patch grids of 10 x 10 cells, 100 vectors a slice."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("e"), F.expr("cast(vec_id div 500 as string)")).alias("volume_id"),
        F.expr("cast(vec_id % 500 div 100 as int)").alias("z"),
        F.expr("cast(vec_id % 100 div 10 as int)").alias("gy"),
        F.expr("cast(vec_id % 10 as int)").alias("gx"),
        F.col("embedding").alias("vec"), "label", "vec_id")


# The same views as common table expressions for the comparison database
SQL = {
    "lattice": """lattice AS (SELECT 'v' || CAST(l_orderkey // 2500 AS VARCHAR) AS volume_id, CAST(l_linenumber - 1 AS INTEGER) AS z,
 CAST((l_suppkey * 11 + l_partkey // 48) % 40 AS INTEGER) AS y, CAST(l_partkey % 48 AS INTEGER) AS x,
 sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY 1, 2, 3, 4)""",
    "slices": """slices AS (SELECT v.volume_id, CAST(zz.z AS INTEGER) AS z FROM (SELECT DISTINCT volume_id FROM lattice) v CROSS JOIN range(7) zz(z))""",
    "dense": """dense AS (SELECT s.volume_id, s.z, CAST(yy.y AS INTEGER) AS y, CAST(xx.x AS INTEGER) AS x, coalesce(l.q, 0) AS q, coalesce(l.p, 0) AS p
 FROM slices s CROSS JOIN range(40) yy(y) CROSS JOIN range(48) xx(x)
 LEFT JOIN lattice l ON l.volume_id = s.volume_id AND l.z = s.z AND l.y = yy.y AND l.x = xx.x)""",
    "pred": "pred AS (SELECT volume_id, z, y, x FROM lattice WHERE q >= 30)",
    "ref": "ref AS (SELECT volume_id, z, y, x FROM lattice WHERE p >= 35000)",
    "patches": """patches AS (SELECT 'e' || CAST(vec_id // 500 AS VARCHAR) AS volume_id, CAST(vec_id % 500 // 100 AS INTEGER) AS z,
 CAST(vec_id % 100 // 10 AS INTEGER) AS gy, CAST(vec_id % 10 AS INTEGER) AS gx, CAST(embedding AS DOUBLE[]) AS vec, label, vec_id FROM embeddings)""",
}


def with_views(*names: str, extra: str = "", recursive: bool = False) -> str:
    """WITH clause holding the named views and any further expressions."""
    need = list(names)
    if "dense" in need and "slices" not in need:
        need.insert(0, "slices")
    if any(n in ("slices", "dense", "pred", "ref") for n in need) and "lattice" not in need:
        need.insert(0, "lattice")
    order = [n for n in SQL if n in need]
    parts = [SQL[n] for n in order] + ([extra] if extra else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
