"""Polygons: text labels, point-in-polygon joins and rasters. Corners are array<struct<x, y>>."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import SLICE
from .grid import as_col


def parse_polygons(text: Column, cls: str = "0") -> Column:
    """array<array<struct<x, y>>> of the lines of one class with at least three corners."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.split(F.trim(s), r"\s+"))
    kept = F.filter(lines, lambda p: (F.size(p) >= 7) & (p[0] == cls))
    corners = lambda p: F.transform(F.sequence(F.lit(0), ((F.size(p) - 1) / 2).cast("int") - 1),
                                    lambda i: F.struct(F.get(p, 2 * i + 1).cast("double").alias("x"), F.get(p, 2 * i + 2).cast("double").alias("y")))
    return F.transform(kept, corners)


def _edges(poly: Column) -> Column:
    following = F.concat(F.slice(poly, 2, F.size(poly) - 1), F.slice(poly, 1, 1))
    return F.zip_with(poly, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def polygon_area(poly: Column) -> Column:
    return F.abs(F.aggregate(_edges(poly), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def contains(poly: Column, y: Column, x: Column) -> Column:
    """Even-odd rule: a ray to the right crosses the outline an odd number of times."""
    def crosses(e):
        return ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])
    return F.aggregate(_edges(poly), F.lit(0), lambda s, e: s + F.when((e["ay"] > y) != (e["by"] > y), crosses(e).cast("int")).otherwise(0)) % 2 == 1


def polygon_runs(polygons: DataFrame, height: Column, width: Column, poly: str = "poly") -> DataFrame:
    """Scan conversion: the columns of polygons but the corners, y, x0, x1 (exclusive) for every stretch of an image row that
    lies inside by the even-odd rule. An image row's crossings with the edges are sorted and paired; the work is edges times
    rows, whatever the polygon's width, and nothing is shuffled. Fewer than three corners give no runs."""
    others = [c for c in polygons.columns if c not in (poly, "y", "x0", "x1")]
    p = polygons.where(F.size(poly) >= 3).withColumn("_edges", F.filter(_edges(F.col(poly)), lambda e: e["ay"] != e["by"]))
    lo = F.aggregate("_edges", F.lit(float("inf")), lambda s, e: F.least(s, e["ay"], e["by"]))
    hi = F.aggregate("_edges", F.lit(float("-inf")), lambda s, e: F.greatest(s, e["ay"], e["by"]))
    p = p.where(F.size("_edges") > 0).withColumns({"_y0": F.greatest(F.ceil(lo).cast("int"), F.lit(0)), "_y1": F.least(F.ceil(hi).cast("int"), as_col(height)) - 1, "_w": as_col(width)})
    rows = p.where("_y0 <= _y1").select(*others, "_edges", "_w", F.explode(F.sequence("_y0", "_y1")).alias("y"))
    y = F.col("y").cast("double")
    met = F.filter("_edges", lambda e: (e["ay"] > y) != (e["by"] > y))
    crossings = F.sort_array(F.transform(met, lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    rows = rows.withColumn("_c", crossings).where(F.size("_c") > 0)   # An outline crosses a row an even number of times
    at = lambda k: F.least(F.greatest(F.ceil(F.get("_c", k)).cast("int"), F.lit(0)), F.col("_w"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("_c") - 2, F.lit(2)), lambda k: F.struct(at(k).alias("x0"), at(k + 1).alias("x1")))
    return rows.select(*others, "y", F.inline(F.filter(pairs, lambda r: r["x0"] < r["x1"])))


def polygon_rows(polygons: DataFrame, height: Column, width: Column, keys: list[str] = SLICE, poly: str = "poly") -> DataFrame:
    """The pixels (y, x) inside every polygon, with the polygon's other columns but its corners."""
    runs = polygon_runs(polygons, height, width, poly)
    return runs.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))).drop("x0", "x1")


def rasterise(polygons: DataFrame, height: Column, width: Column, keys: list[str] = SLICE, poly: str = "poly") -> DataFrame:
    """Instance map: polygons are numbered by falling area, and a pixel belongs to the smallest one over it."""
    p = polygons.withColumn("_area", polygon_area(F.col(poly)))
    px = polygon_rows(p, height, width, keys, poly)
    return px.groupBy(*keys, "y", "x").agg(F.min_by("polygon_id", F.struct("_area", "polygon_id")).alias("polygon_id"))


def region_mask(regions: DataFrame, height: Column, width: Column, keys: list[str] = ["volume_id"], poly: str = "roi") -> DataFrame:
    """Pixels of a region of interest; fewer than three corners means no region. Regions that overlap are joined as runs."""
    from .runs import covered, decode_runs
    return decode_runs(covered(polygon_runs(regions.select(*keys, poly), height, width, poly), 1, keys)).select(*keys, "y", "x")
