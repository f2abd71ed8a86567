"""Measurements per mask, object, slice and stack, and agreement between masks."""
from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.quantiles import group_quantiles
from ..session import SLICE, materialize
from . import components as C
from . import distance as D
from . import runs as R
from .grid import as_col

# Perimeter weights by neighbourhood code (Benkrid and Crookes 2000)
PERIMETER = {1.0: (5, 7, 15, 17, 25, 27), math.sqrt(2): (21, 33), (1 + math.sqrt(2)) / 2: (13, 23)}


# ---------- overlap ----------

def overlap_counts(pred: DataFrame, ref: DataFrame, extents: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """n_pred, n_ref and n_both per slice from runs: the common pixels come from one sweep, not from a pixel join."""
    out = extents.select(*keys).distinct()
    for runs, name in ((pred, "n_pred"), (ref, "n_ref"), (R.intersection(pred, ref, keys), "n_both")):
        out = out.join(R.area(runs, keys, name), keys, "left")
    return out.fillna(0, ["n_pred", "n_ref", "n_both"])


def dice(empty: float = 1.0) -> Column:
    """2 |A and B| / (|A| + |B|); two empty masks score the given value."""
    total = F.col("n_pred") + F.col("n_ref")
    return F.when(total == 0, F.lit(empty)).otherwise(2 * F.col("n_both") / total)


def iou() -> Column:
    either = F.col("n_pred") + F.col("n_ref") - F.col("n_both")
    return F.when(either == 0, 1.0).otherwise(F.col("n_both") / either)


def compare(pred: DataFrame, ref: DataFrame, extents: DataFrame, spacing=(1.0, 1.0), roi: DataFrame | None = None, keys: list[str] = SLICE) -> DataFrame:
    """Dice, IoU and HD95 per slice, inside a region when one is given."""
    if roi is not None:
        pred, ref = R.intersection(pred, roi, keys), R.intersection(ref, roi, keys)
    o = overlap_counts(pred, ref, extents, keys).withColumns({"dice": dice(), "iou": iou()})
    return o.join(D.hd95(pred, ref, extents, spacing, keys).withColumnRenamed("hd95", "hd95_um"), keys, "left")


def error_areas(pred: DataFrame, ref: DataFrame, extents: DataFrame, px_area: float, keys: list[str] = SLICE) -> DataFrame:
    """Area found without reference and reference area not found."""
    o = overlap_counts(pred, ref, extents, keys)
    return o.select(*keys, ((F.col("n_pred") - F.col("n_both")) * px_area).alias("false_positive_um2"), ((F.col("n_ref") - F.col("n_both")) * px_area).alias("false_negative_um2"))


# ---------- objects ----------

def perimeter(labelled: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Perimeter per component from the neighbourhood codes of its border pixels. Every border pixel adds its weight to
    the eight places around it and to its own, so the codes are one aggregation and need no join."""
    by = [*keys, "comp"]
    border = R.decode_runs(R.boundary(labelled.select(*by, "y", "x0", "x1"), by))
    near = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit({0: 1, 1: 2, 2: 10}[abs(dy) + abs(dx)]).alias("w"))
                     for dy, dx in itertools.product((-1, 0, 1), repeat=2)])
    codes = (border.withColumn("n", F.explode(near)).groupBy(*by, (F.col("y") + F.col("n.dy")).alias("y"), (F.col("x") + F.col("n.dx")).alias("x"))
             .agg(F.sum("n.w").alias("code")))
    weight = F.lit(0.0)
    for w, members in PERIMETER.items():
        weight = F.when(F.col("code").isin(*members), F.lit(w)).otherwise(weight)
    return codes.groupBy(*by).agg(F.sum(weight).alias("perimeter"))


def _hull_area(rows: list) -> float:
    """Pixels whose centre lies in the convex hull of an object, pixels taken as diamonds of half a pixel."""
    ys = np.array([r["y"] for r in rows], float)
    lo, hi = np.array([r["lo"] for r in rows], float), np.array([r["hi"] for r in rows], float)
    pts = np.concatenate([np.c_[ys, lo - 0.5], np.c_[ys, hi + 0.5], np.c_[ys - 0.5, lo], np.c_[ys + 0.5, lo], np.c_[ys - 0.5, hi], np.c_[ys + 0.5, hi]])
    pts = pts[np.lexsort((pts[:, 1], pts[:, 0]))]

    def chain(p, side):
        out: list = []
        for q in p:
            while len(out) > 1 and side * ((out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(q)
        return np.array(out)

    right, left = chain(pts, -1.0), chain(pts, 1.0)
    y = np.arange(ys.min(), ys.max() + 1)
    a = np.minimum(np.interp(y, left[:, 0], left[:, 1]), np.interp(y, right[:, 0], right[:, 1]))
    b = np.maximum(np.interp(y, left[:, 0], left[:, 1]), np.interp(y, right[:, 0], right[:, 1]))
    return float((np.floor(b + 1e-9) - np.ceil(a - 1e-9) + 1).sum())


@F.pandas_udf(DoubleType())
def convex_area(rows: pd.Series) -> pd.Series:
    return rows.map(_hull_area)


def object_table(labelled: DataFrame, image: DataFrame | None = None, pixel_um=(1.0, 1.0), keys: list[str] = SLICE, neighbours: bool = True) -> DataFrame:
    """One row per object: area, centroid, perimeter, ellipse, solidity, nearest neighbour and mean intensity.

    Moments come from run sums (closed forms over a run), so pixels are only expanded where an image is read. The hull
    sees at most one (first, last) pair per image row of an object."""
    labelled = materialize(labelled)
    by = [*keys, "comp"]
    py, px = pixel_um
    iso = math.sqrt(py * px)
    n = (F.col("x1") - F.col("x0")).cast("double")
    a, b = F.col("x0").cast("double"), (F.col("x1") - 1).cast("double")
    sx = n * (a + b) / 2
    square = lambda m: m * (m + 1) * (2 * m + 1) / 6
    m = labelled.groupBy(*by).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("y")).alias("my"), F.sum(sx).alias("mx"), F.sum(n * F.col("y") * F.col("y")).alias("myy"),
        F.sum(square(b) - square(a - 1)).alias("mxx"), F.sum(F.col("y") * sx).alias("mxy"))
    m = m.withColumns({"cy": F.col("my") / F.col("n"), "cx": F.col("mx") / F.col("n")})
    vy, vx = F.col("myy") / F.col("n") - F.col("cy") ** 2, F.col("mxx") / F.col("n") - F.col("cx") ** 2
    cov = F.col("mxy") / F.col("n") - F.col("cy") * F.col("cx")
    root = F.sqrt(((vy - vx) / 2) ** 2 + cov ** 2)
    m = m.withColumns({"_l1": F.greatest((vy + vx) / 2 + root, F.lit(0.0)), "_l2": F.greatest((vy + vx) / 2 - root, F.lit(0.0))})
    extent = labelled.groupBy(*by, "y").agg(F.min("x0").alias("lo"), (F.max("x1") - 1).alias("hi"))
    hull = extent.groupBy(*by).agg(F.collect_list(F.struct("y", "lo", "hi")).alias("_rows")).select(*by, convex_area("_rows").alias("_hull"))
    t = m.join(perimeter(labelled, keys), by, "left").join(hull, by, "left")
    out = t.select(
        *by, (F.col("n") * py * px).alias("area_um2"), (F.col("cy") * py).alias("centroid_y_um"), (F.col("cx") * px).alias("centroid_x_um"),
        (F.coalesce("perimeter", F.lit(0.0)) * iso).alias("perimeter_um"),
        F.when(F.col("_l1") < 1e-12, 0.0).otherwise(F.sqrt(1 - F.col("_l2") / F.col("_l1"))).alias("eccentricity"),
        (F.col("n") / F.col("_hull")).alias("solidity"), (4 * F.sqrt("_l1") * iso).alias("major_axis_um"), (4 * F.sqrt("_l2") * iso).alias("minor_axis_um"),
        F.sqrt(4 * F.col("n") * py * px / math.pi).alias("equivalent_diameter_um"))
    if neighbours:
        out = D.nearest_neighbour(materialize(out), keys, ["centroid_y_um", "centroid_x_um"], 8.0 * iso)
    if image is not None:
        mean = R.decode_runs(labelled).join(image, [*keys, "y", "x"]).groupBy(*by).agg(F.avg("value").alias("mean_intensity"))
        out = out.join(mean, by, "left")
    return out


def channel_intensities(labelled: DataFrame, channels: DataFrame, names: list, keys: list[str] = SLICE) -> DataFrame:
    """Mean and summed intensity per object and channel; channels has keys, y, x, channel, value."""
    px = R.decode_runs(labelled).join(channels, [*keys, "y", "x"])
    agg = []
    for c in names:
        v = F.when(F.col("channel") == c, F.col("value"))
        agg += [F.avg(v).alias(f"{c}_mean"), F.sum(v).alias(f"{c}_integrated")]
    return px.groupBy(*keys, "comp").agg(*agg)


def instance_overlap(a: DataFrame, b: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Common pixels of every overlapping pair of labels, from pixel rows (keys, y, x, label)."""
    j = a.select(*keys, "y", "x", F.col("label").alias("p")).join(b.select(*keys, "y", "x", F.col("label").alias("g")), [*keys, "y", "x"])
    return j.groupBy(*keys, "p", "g").agg(F.count("*").alias("n"))


def instance_iou(pred: DataFrame, gt: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    sizes = lambda d, k, n: d.groupBy(*keys, F.col("label").alias(k)).agg(F.count("*").alias(n))
    o = instance_overlap(pred, gt, keys).join(sizes(pred, "p", "np"), [*keys, "p"]).join(sizes(gt, "g", "ng"), [*keys, "g"])
    return o.withColumn("iou", F.col("n") / (F.col("np") + F.col("ng") - F.col("n") + 1e-9))


def greedy_pairs(pairs: DataFrame, iou_min: float = 0.5, keys: list[str] = SLICE) -> DataFrame:
    """One-to-one pairs taken in the order IoU, predicted id, expert id (all descending). A pair that is the first
    choice of both its objects can be taken at once; such rounds give the same pairs as the sorted loop."""
    open_ = materialize(pairs.where(F.col("iou") >= iou_min).select(*keys, "p", "g", "iou"))
    taken = None
    while not open_.isEmpty():
        rank = F.struct("iou", "p", "g")
        best_p = open_.groupBy(*keys, "p").agg(F.max(rank).alias("_bp"))
        best_g = open_.groupBy(*keys, "g").agg(F.max(rank).alias("_bg"))
        now = open_.join(best_p, [*keys, "p"]).join(best_g, [*keys, "g"]).where((F.col("_bp") == rank) & (F.col("_bg") == rank))
        now = materialize(now.select(*keys, "p", "g", "iou"))
        taken = now if taken is None else taken.unionByName(now)
        open_ = materialize(open_.join(now.select(*keys, "p"), [*keys, "p"], "left_anti").join(now.select(*keys, "g"), [*keys, "g"], "left_anti"))
    return taken if taken is not None else open_


def match_counts(pred: DataFrame, gt: DataFrame, extents: DataFrame, iou_min: float = 0.5, keys: list[str] = SLICE) -> DataFrame:
    """tp, fp and fn per slice at an IoU threshold."""
    tp = greedy_pairs(instance_iou(pred, gt, keys), iou_min, keys).groupBy(*keys).agg(F.count("*").alias("tp"))
    n = lambda d, name: d.groupBy(*keys).agg(F.countDistinct("label").alias(name))
    out = extents.select(*keys).distinct().join(tp, keys, "left").join(n(pred, "n_pred"), keys, "left").join(n(gt, "n_gt"), keys, "left").fillna(0, ["tp", "n_pred", "n_gt"])
    return out.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")})


def best_iou_per_object(pred: DataFrame, gt: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Mean over the expert objects of the best IoU with any predicted object; objects nobody found score 0."""
    best = instance_iou(pred, gt, keys).groupBy(*keys, "g").agg(F.max("iou").alias("iou"))
    every = gt.select(*keys, F.col("label").alias("g")).distinct()
    return every.join(best, [*keys, "g"], "left").fillna(0.0, ["iou"]).groupBy(*keys).agg(F.avg("iou").alias("miou"), F.count("*").alias("n_gt"))


def pooled_f1(rows: DataFrame, by: list[str]) -> DataFrame:
    s = rows.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumns({"precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp"), F.col("tp") + F.col("fn"))})
    return s.withColumn("f1", div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


# ---------- slices and stacks ----------

def summarize_slices(runs: DataFrame, extents: DataFrame, image: DataFrame | None = None, pixel_um=(1.0, 1.0), roi: DataFrame | None = None,
                     keys: list[str] = SLICE) -> DataFrame:
    """Area, share, object counts and sizes, and intensity inside and outside, one row per slice, empty masks too."""
    if roi is not None:
        runs = R.intersection(runs, roi, keys)
    px = pixel_um[0] * pixel_um[1]
    lab = C.label_components(runs, extents, 8, keys)
    sizes = C.component_sizes(lab, keys).withColumn("a", F.col("n_px") * px)
    s = sizes.groupBy(*keys).agg(F.sum("a").alias("area_um2"), F.count("*").alias("n_objects"), F.avg("a").alias("mean_object_area_um2"), F.max("a").alias("largest_object_area_um2"))
    s = s.join(group_quantiles(sizes, keys, "a", {"median_object_area_um2": 0.5}), keys)
    total = R.area(roi, keys, "_t") if roi is not None else extents.select(*keys, (F.col("height").cast("long") * F.col("width")).alias("_t"))
    out = extents.select(*keys).distinct().join(total, keys, "left").join(s, keys, "left").fillna(0).withColumn("image_area_um2", F.col("_t") * px)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"area_fraction": safe(F.col("area_um2"), F.col("image_area_um2")), "objects_per_mm2": safe(F.col("n_objects"), F.col("image_area_um2") / 1e6)}).drop("_t")
    if image is not None:
        inside = R.decode_runs(lab).select(*keys, "y", "x", F.lit(True).alias("_in"))
        img = image.select(*keys, "y", "x", "value")
        if roi is not None:
            img = img.join(R.decode_runs(roi).select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")
        i = img.join(inside, [*keys, "y", "x"], "left").groupBy(*keys).agg(
            F.avg(F.when(F.col("_in"), F.col("value"))).alias("mean_intensity_inside"), F.avg(F.when(F.col("_in").isNull(), F.col("value"))).alias("mean_intensity_outside"))
        out = out.join(i.withColumn("contrast_ratio", F.col("mean_intensity_inside") / F.greatest("mean_intensity_outside", F.lit(1e-6))
                                    + F.when(F.col("mean_intensity_outside").isNotNull(), 0.0)), keys, "left")
    return out


def slice_step(slices: DataFrame, by: list[str] = ["volume_id"]) -> DataFrame:
    """Median distance between processed slices, cut to a whole number; 1 for a single slice."""
    gaps = slices.select(*by, "z").distinct().withColumn("_g", F.col("z") - F.lag("z").over(Window.partitionBy(*by).orderBy("z")))
    q = group_quantiles(gaps, by, "_g", {"_m": 0.5})
    return slices.select(*by).distinct().join(q, by, "left").select(*by, F.coalesce(F.col("_m").cast("int"), F.lit(1)).alias("step"))


def summarize_stacks(per_slice: DataFrame, dz: Column, by: list[str] = ["volume_id"]) -> DataFrame:
    """Volume from slice areas and means over the stack; per_slice may carry a slice step."""
    return per_slice.groupBy(*by).agg(
        F.count("*").alias("n_slices"), (F.sum("area_um2") * F.max(dz)).alias("volume_um3"), F.avg("area_fraction").alias("mean_area_fraction"),
        F.sum("n_objects").alias("total_objects_counted"), F.max(dz).alias("slice_spacing_um"))


def objects_3d(labelled: DataFrame, voxel_um=(1.0, 1.0, 1.0), keys: list[str] = ["volume_id"], neighbours: bool = True) -> DataFrame:
    """One row per solid object. labelled: runs with z and comp from 6-connected labelling. The stack ends are the first
    and last processed slices, given as columns z_min and z_max."""
    vz, vy, vx = voxel_um
    n = F.col("x1") - F.col("x0")
    per = labelled.groupBy(*keys, "comp", "z").agg(F.sum(n).alias("n"), F.sum(n * F.col("y")).alias("sy"), F.sum(n * (F.col("x0") + F.col("x1") - 1) / 2).alias("sx"),
                                                   F.first("z_min").alias("z_min"), F.first("z_max").alias("z_max"))
    o = per.groupBy(*keys, "comp").agg(
        (F.sum("n") * vz * vy * vx).alias("volume_um3"), F.countDistinct("z").alias("n_slices"), F.min("z").alias("z_first"), F.max("z").alias("z_last"),
        (F.sum(F.col("n") * F.col("z")) / F.sum("n") * vz).alias("centroid_z_um"), (F.sum("sy") / F.sum("n") * vy).alias("centroid_y_um"), (F.sum("sx") / F.sum("n") * vx).alias("centroid_x_um"),
        (F.max("n") * vy * vx).alias("max_area_um2"), ((F.min("z") == F.min("z_min")) | (F.max("z") == F.max("z_max"))).alias("touches_stack_edge"))
    return D.nearest_neighbour(materialize(o), keys, ["centroid_z_um", "centroid_y_um", "centroid_x_um"], 8.0 * vy) if neighbours else o


def roll_up_objects(objects: DataFrame, by: list[str] = ["volume_id"]) -> DataFrame:
    m = group_quantiles(objects, by, "volume_um3", {"median_object_volume_um3": 0.5})
    nn = group_quantiles(objects, by, "nearest_neighbour_um", {"median_nearest_neighbour_um": 0.5})
    n = objects.groupBy(*by).agg(F.count("*").alias("n_objects_3d"), F.sum((~F.col("touches_stack_edge")).cast("long")).alias("n_objects_3d_inside"))
    return n.join(m, by, "left").join(nn, by, "left")


def derived(summary: DataFrame, voxel_um=(1.0, 1.0, 1.0), n_pixels: int | Column = 1) -> DataFrame:
    """Objects per cubic millimetre of the processed part of the stack."""
    volume = as_col(n_pixels) * voxel_um[1] * voxel_um[2] * F.col("n_slices") * F.col("slice_spacing_um") / 1e9
    return summary.withColumn("objects_per_mm3", F.when(volume > 0, F.col("n_objects_3d") / volume))


# ---------- histology ----------

def histomorphometry(bone: DataFrame, cells: DataFrame, extents: DataFrame, pixel_um=(1.0, 1.0), contact_um: float = 3.0, roi: DataFrame | None = None,
                     keys: list[str] = SLICE) -> tuple[DataFrame, DataFrame]:
    """Bone and cell measures per slice, and a table of cells with their distance to bone."""
    py, px = pixel_um
    iso, area = math.sqrt(py * px), py * px
    full = extents.select(*keys, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.lit(0).alias("x0"), F.col("width").alias("x1"))
    region = roi if roi is not None else full
    if roi is not None:
        cells = R.intersection(cells, roi, keys)
    surface_all = materialize(R.surface_boundary(bone, extents, keys))
    surface = R.intersection(surface_all, region, keys)
    lab = C.label_components(bone, extents, 8, keys)
    per = perimeter(lab, keys).groupBy(*keys).agg(F.sum("perimeter").alias("_per"))
    e = extents.select(*keys, "height", "width").distinct()
    rim = bone.join(e, keys).select(*keys, F.when((F.col("y") == 0) | (F.col("y") == F.col("height") - 1), F.col("x1") - F.col("x0")).otherwise(
        (F.col("x0") == 0).cast("int") + (F.col("x1") == F.col("width")).cast("int")).alias("n"))
    rim = rim.groupBy(*keys).agg(F.sum("n").alias("_rim"))
    near = D.distance_to_mask(surface, cells, extents, pixel_um, keys).where(F.col("dist") <= contact_um).groupBy(*keys).agg(F.count("*").alias("_covered"))
    objects = C.label_components(cells, extents, 8, keys)
    dist = D.distance_to_mask(objects.select(*keys, "y", "x0", "x1"), bone, extents, pixel_um, keys)
    inside = R.decode_runs(objects).join(dist, [*keys, "y", "x"], "left")
    table = inside.groupBy(*keys, "comp").agg(
        (F.count("*") * area).alias("area_um2"), (F.avg("y") * py).alias("centroid_y_um"), (F.avg("x") * px).alias("centroid_x_um"),
        F.min("dist").alias("distance_to_bone_um"), F.avg(F.coalesce((F.col("dist") == 0).cast("double"), F.lit(0.0))).alias("overlap_with_bone"))
    table = materialize(table.withColumn("on_bone", F.coalesce(F.col("distance_to_bone_um") <= contact_um, F.lit(False))))
    per_slice = table.groupBy(*keys).agg(F.count("*").alias("cells_total"), F.sum(F.col("on_bone").cast("long")).alias("n_oc"))
    median = group_quantiles(table, keys, "distance_to_bone_um", {"median_distance_to_bone_um": 0.5})
    s = e.select(*keys)
    for runs, name in ((region, "_t"), (R.intersection(bone, region, keys), "_b"), (surface, "_s"), (surface_all, "_sa")):
        s = s.join(R.area(runs, keys, name), keys, "left")
    s = s.join(per, keys, "left").join(rim, keys, "left").join(near, keys, "left").join(per_slice, keys, "left").fillna(0).join(median, keys, "left")
    length = F.greatest(F.col("_per") - F.col("_rim"), F.lit(0.0)) * iso
    if roi is not None:
        length = F.when(F.col("_sa") > 0, length * F.col("_s") / F.col("_sa")).otherwise(length)
    share = F.when(F.col("_s") > 0, F.col("_covered") / F.col("_s")).otherwise(0.0)
    s = s.withColumns({"_pm": length / 1000, "_share": share, "_tar": F.col("_t") * area / 1e6, "_bar": F.col("_b") * area / 1e6})
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = s.select(*keys, F.col("_tar").alias("t_ar_mm2"), F.col("_bar").alias("b_ar_mm2"), (100 * ratio(F.col("_bar"), F.col("_tar"))).alias("b_ar_t_ar_pct"), F.col("_pm").alias("b_pm_mm"),
                   (100 * F.col("_share")).alias("oc_pm_b_pm_pct"), (F.col("_share") * F.col("_pm")).alias("oc_pm_mm"), "n_oc", ratio(F.col("n_oc"), F.col("_pm")).alias("n_oc_b_pm_per_mm"),
                   ratio(F.col("n_oc"), F.col("_tar")).alias("n_oc_t_ar_per_mm2"), "cells_total", (100 * ratio(F.col("n_oc"), F.col("cells_total"))).alias("cells_on_bone_pct"), "median_distance_to_bone_um")
    return out, table


def bone_measures(histology: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Area share, surface density and plate-model thickness."""
    return histology.select(*keys, "b_ar_t_ar_pct", F.when(F.col("t_ar_mm2") > 0, F.col("b_pm_mm") / F.col("t_ar_mm2")).alias("b_pm_t_ar_per_mm"),
                            F.when(F.col("b_pm_mm") > 0, 2 * F.col("b_ar_mm2") * 1e6 / (F.col("b_pm_mm") * 1e3)).alias("tb_th_um"))


def corner_areas(spacing=(1.0, 1.0, 1.0)) -> list[float]:
    """Surface area inside a 2 x 2 x 2 cell for each of the 256 corner codes, built by rule: on every face the crossed
    edges are joined around its set corners, the joints form closed loops, and a loop's area is that of its triangles."""
    corners = list(itertools.product((0, 1), repeat=3))
    faces = [[c for c in _ring(axis, side)] for axis in range(3) for side in (0, 1)]
    scale = np.array(spacing, float)
    out = []
    for code in range(256):
        on = {c: bool(code >> i & 1) for i, c in enumerate(corners)}
        links: dict = {}
        for ring in faces:
            for i in range(4):
                if on[ring[i]] and not on[ring[i - 1]]:      # A stretch of set corners starts here
                    j = i
                    while on[ring[(j + 1) % 4]]:
                        j += 1
                    a, b = frozenset((ring[i - 1], ring[i])), frozenset((ring[j % 4], ring[(j + 1) % 4]))
                    links.setdefault(a, []).append(b)
                    links.setdefault(b, []).append(a)
        area, seen = 0.0, set()
        for start in list(links):
            if start in seen:
                continue
            loop, here, last = [], start, None
            while here not in seen:
                seen.add(here)
                loop.append(np.mean([np.array(c, float) for c in here], axis=0) * scale)
                step = [n for n in links[here] if n != last] or [last]
                last, here = here, step[0]
            centre = np.mean(loop, axis=0)
            area += sum(0.5 * np.linalg.norm(np.cross(loop[k - 1] - centre, loop[k] - centre)) for k in range(len(loop)))
        out.append(float(area))
    return out


def _ring(axis: int, side: int) -> list[tuple]:
    u, v = [a for a in range(3) if a != axis]
    ring = []
    for s, t in ((0, 0), (0, 1), (1, 1), (1, 0)):
        c = [0, 0, 0]
        c[axis], c[u], c[v] = side, s, t
        ring.append(tuple(c))
    return ring


def solid_measures(voxels: DataFrame, extents: DataFrame, spacing=(1.0, 1.0, 1.0), keys: list[str] = ["volume_id"]) -> DataFrame:
    """Volume, surface, thickness, number and spacing of a solid structure. voxels: set cells (keys, z, y, x); extents:
    keys, n_z, height, width. The mask is continued past the block's faces, so cut faces are not surface. Every voxel
    adds its bit to the cells it is a corner of; codes come out of one aggregation."""
    voxel = float(np.prod(spacing))
    e = extents.select(*keys, "n_z", "height", "width")
    v = voxels.select(*keys, "z", "y", "x").join(e, keys)
    for axis, n in (("z", "n_z"), ("y", "height"), ("x", "width")):
        i = F.col(axis)
        v = v.withColumn(axis, F.explode(F.concat(F.array(i), F.when(i == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")),
                                                  F.when(i == F.col(n) - 1, F.array(F.col(n))).otherwise(F.array().cast("array<int>")))))
    bits = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(1 << i).alias("bit"))
                               for i, (a, b, c) in enumerate(itertools.product((0, 1), repeat=3))]))
    cells = (v.select(*keys, "z", "y", "x", bits.alias("k")).groupBy(*keys, (F.col("z") - F.col("k.a")).alias("z"), (F.col("y") - F.col("k.b")).alias("y"), (F.col("x") - F.col("k.c")).alias("x"))
             .agg(F.sum("k.bit").cast("int").alias("code")))
    # Cells that stick out of the padded block have missing corners; they are no part of the surface
    cells = cells.join(e, keys).where((F.col("z") >= -1) & (F.col("z") < F.col("n_z")) & (F.col("y") >= -1) & (F.col("y") < F.col("height")) & (F.col("x") >= -1) & (F.col("x") < F.col("width")))
    table = F.array(*[F.lit(a) for a in corner_areas(spacing)])
    surface = cells.groupBy(*keys, "code").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.sum(F.element_at(table, F.col("code") + 1) * F.col("_n")).alias("bs"))
    count = voxels.groupBy(*keys).agg((F.count("*") * voxel).alias("bv"))
    m = e.join(count, keys, "left").join(surface, keys, "left").fillna(0.0, ["bv", "bs"])
    m = m.withColumn("tv", F.col("n_z").cast("double") * F.col("height") * F.col("width") * voxel)
    m = m.withColumn("th", F.when(F.col("bs") > 0, 2 * F.col("bv") / F.col("bs")))
    m = m.withColumn("tbn", F.when(F.col("th") > 0, F.col("bv") / F.col("tv") / F.col("th")))
    return m.select(*keys, (F.col("bv") / 1e9).alias("bv_mm3"), (100 * F.col("bv") / F.col("tv")).alias("bv_tv_pct"), F.when(F.col("bv") > 0, 1e3 * F.col("bs") / F.col("bv")).alias("bs_bv_per_mm"),
                    F.col("th").alias("tb_th_um"), (1e3 * F.col("tbn")).alias("tb_n_per_mm"), (1 / F.col("tbn") - F.col("th")).alias("tb_sp_um"))
