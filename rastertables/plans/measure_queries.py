"""Queries for measurements."""
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import measure as M
from ..operators import runs as R
from ..operators import select as P
from ..operators import stats as T
from ..session import materialize
from ..sources import lattice as L
from .grid_queries import PX, r6, s6
from .mask_queries import bright, closure, masks
from .registry import query

SL = ["volume_id", "z"]
UM = (0.5, 0.5)
COUNTS = """cnt AS (SELECT s.volume_id, s.z, (SELECT count(*) FROM pred p WHERE p.volume_id = s.volume_id AND p.z = s.z) AS n_pred,
 (SELECT count(*) FROM ref p WHERE p.volume_id = s.volume_id AND p.z = s.z) AS n_ref,
 (SELECT count(*) FROM pred p JOIN ref r USING (volume_id, z, y, x) WHERE p.volume_id = s.volume_id AND p.z = s.z) AS n_both FROM slices s)"""
DICE, IOU = "2.0 * n_both / (n_pred + n_ref)", "1.0 * n_both / (n_pred + n_ref - n_both)"


@query("m1_dice_iou", L.with_views("pred", "ref", "slices", extra=COUNTS) + f"SELECT volume_id, z, n_pred, n_ref, n_both, {s6(DICE, 'dice')}, {s6(IOU, 'iou')} FROM cnt")
def m1(spark, sf):
    o = M.overlap_counts(*masks(spark, sf), L.slices(spark, sf))
    return o.select(*SL, "n_pred", "n_ref", "n_both", r6(M.dice(), "dice"), r6(M.iou(), "iou"))


@query("j2_prediction_reference_join", L.with_views("pred", "ref") + """
SELECT volume_id, z, y, x, p.volume_id IS NOT NULL AS predicted, r.volume_id IS NOT NULL AS expected FROM pred p FULL JOIN ref r USING (volume_id, z, y, x)""")
def j2(spark, sf):
    p = L.predicted(spark, sf).withColumn("_p", F.lit(True))
    r = L.reference(spark, sf).withColumn("_r", F.lit(True))
    return p.join(r, PX, "full").select(*PX, F.col("_p").isNotNull().alias("predicted"), F.col("_r").isNotNull().alias("expected"))


def region(spark, sf):
    """Left half of every slice."""
    return L.slices(spark, sf).select(*SL, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.lit(0).alias("x0"), F.lit(24).alias("x1"))


@query("m2_compare_in_region")
def m2(spark, sf):
    return M.compare(*masks(spark, sf), L.slices(spark, sf), UM, region(spark, sf))


@query("p11_region_clip", L.with_views("pred") + "SELECT * FROM pred WHERE x < 24")
def p11(spark, sf):
    return R.decode_runs(R.intersection(masks(spark, sf)[0], region(spark, sf))).select(*PX)


@query("p24_error_areas", L.with_views("pred", "ref", "slices", extra=COUNTS) + f"SELECT volume_id, z, {s6('(n_pred - n_both) * 0.25', 'false_positive_um2')}, {s6('(n_ref - n_both) * 0.25', 'false_negative_um2')} FROM cnt")
def p24(spark, sf):
    return M.error_areas(*masks(spark, sf), L.slices(spark, sf), 0.25)


@query("m5_dice_3d_reduced", L.with_views("dense", extra="""c AS (SELECT volume_id, z // 2 AS z, y // 4 AS y, x // 4 AS x, avg(CASE WHEN q >= 30 THEN 1.0 ELSE 0 END) >= 0.25 AS a, avg(CASE WHEN p >= 35000 THEN 1.0 ELSE 0 END) >= 0.25 AS b FROM dense WHERE z < 6 GROUP BY 1, 2, 3, 4)""")
       + f"SELECT volume_id, {s6('2.0 * count(*) FILTER (a AND b) / greatest(1, count(*) FILTER (a) + count(*) FILTER (b))', 'dice')} FROM c GROUP BY 1")
def m5(spark, sf):
    from ..operators import grid as G
    cell = lambda c, t: G.block_mean(L.dense(spark, sf).select(*PX, (F.col(c) >= t).cast("double").alias("value")), L.DEPTH, L.HEIGHT, L.WIDTH, 2, 4).where("value >= 0.25").drop("value")
    a, b = R.encode_runs(cell("q", 30)), R.encode_runs(cell("p", 35000))
    o = _volume_counts(spark, sf, a, b)
    return o.select("volume_id", r6(M.dice(0.0), "dice"))


def _volume_counts(spark, sf, a, b):
    return M.overlap_counts(a, b, L.slices(spark, sf)).groupBy("volume_id").agg(*[F.sum(c).alias(c) for c in ("n_pred", "n_ref", "n_both")])


# ---------- objects ----------
BRIGHT = "bright AS (SELECT volume_id, z, y, x FROM lattice WHERE q >= 50)"
PAIR = BRIGHT + ", dear AS (SELECT volume_id, z, y, x FROM lattice WHERE p >= 70000), " + closure("bright", 8, "a") + ", " + closure("dear", 8, "b") + """,
pa AS (SELECT volume_id, z, y, x, dense_rank() OVER (PARTITION BY volume_id, z ORDER BY comp) AS label FROM a), pb AS (SELECT volume_id, z, y, x, dense_rank() OVER (PARTITION BY volume_id, z ORDER BY comp) AS label FROM b),
ov AS (SELECT volume_id, z, pa.label AS p, pb.label AS g, count(*) AS n FROM pa JOIN pb USING (volume_id, z, y, x) GROUP BY 1, 2, 3, 4),
iou AS (SELECT o.*, n / (np + ng - n + 1e-9) AS iou FROM ov o JOIN (SELECT volume_id, z, label AS p, count(*) AS np FROM pa GROUP BY 1, 2, 3) USING (volume_id, z, p) JOIN (SELECT volume_id, z, label AS g, count(*) AS ng FROM pb GROUP BY 1, 2, 3) USING (volume_id, z, g)),
mc AS (SELECT s.volume_id, s.z, (SELECT count(*) FROM iou i WHERE i.volume_id = s.volume_id AND i.z = s.z AND iou >= 0.5) AS tp,
 (SELECT count(DISTINCT label) FROM pa i WHERE i.volume_id = s.volume_id AND i.z = s.z) AS n_pred, (SELECT count(DISTINCT label) FROM pb i WHERE i.volume_id = s.volume_id AND i.z = s.z) AS n_gt FROM slices s)"""


def labelled(spark, sf, cond):
    ext = L.slices(spark, sf)
    runs = R.encode_runs(L.lattice(spark, sf).where(cond).select(*PX))
    return materialize(R.decode_runs(C.number_components(C.label_components(runs, ext, 8), ext)).select(*PX, "label"))


def pair(spark, sf):
    return labelled(spark, sf, "q >= 50"), labelled(spark, sf, "p >= 70000")


@query("j10_instance_overlap", L.with_views("lattice", extra=PAIR.split(",\niou AS")[0], recursive=True) + "SELECT volume_id, z, p, g, n FROM ov")
def j10(spark, sf):
    return M.instance_overlap(*pair(spark, sf))


@query("m6_match_instances", L.with_views("lattice", "slices", extra=PAIR, recursive=True) + "SELECT volume_id, z, tp, n_pred, n_gt, n_pred - tp AS fp, n_gt - tp AS fn FROM mc")
def m6(spark, sf):
    return M.match_counts(*pair(spark, sf), L.slices(spark, sf)).select(*SL, "tp", "n_pred", "n_gt", "fp", "fn")


@query("m7_instance_scores", L.with_views("lattice", "slices", extra=PAIR, recursive=True) + f"""
SELECT volume_id, z, tp, n_pred - tp AS fp, n_gt - tp AS fn, {s6('100.0 * (SELECT count(*) FROM pa WHERE pa.volume_id = mc.volume_id AND pa.z = mc.z) / 1920', 'area_pct')},
 {s6('coalesce(2.0 * (SELECT count(*) FROM pa JOIN pb USING (volume_id, z, y, x) WHERE pa.volume_id = mc.volume_id AND pa.z = mc.z) / nullif((SELECT count(*) FROM pa WHERE pa.volume_id = mc.volume_id AND pa.z = mc.z) + (SELECT count(*) FROM pb WHERE pb.volume_id = mc.volume_id AND pb.z = mc.z), 0), 1)', 'dice')} FROM mc""")
def m7(spark, sf):
    ext = L.slices(spark, sf)
    a, b = pair(spark, sf)
    m = M.match_counts(a, b, ext)
    o = M.overlap_counts(R.encode_runs(a), R.encode_runs(b), ext)
    return m.join(o.drop("n_pred"), SL).join(o.select(*SL, F.col("n_pred").alias("_px")), SL).select(
        *SL, "tp", "fp", "fn", r6(100 * F.col("_px") / 1920, "area_pct"), r6(F.when(F.col("_px") + F.col("n_ref") == 0, 1.0).otherwise(2 * F.col("n_both") / (F.col("_px") + F.col("n_ref"))), "dice"))


@query("c8_scores_by_minimum_size", L.with_views("lattice", extra=BRIGHT + ", " + closure("bright", 8), recursive=True) + """
SELECT volume_id, z, CAST(m.m AS INTEGER) AS min_px, count(*) AS n_objects, CAST(sum(n) AS BIGINT) AS n_px FROM (SELECT volume_id, z, comp, count(*) AS n FROM lab GROUP BY 1, 2, 3) JOIN (VALUES (1), (2), (4)) m(m) ON n >= m.m GROUP BY 1, 2, 3""")
def c8(spark, sf):
    sizes = C.component_sizes(C.label_components(bright(spark, sf), L.slices(spark, sf), 8))
    s = sizes.withColumn("min_px", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).where("n_px >= min_px")
    return s.groupBy(*SL, "min_px").agg(F.count("*").alias("n_objects"), F.sum("n_px").alias("n_px"))


@query("m8_best_iou_per_object", L.with_views("lattice", extra=PAIR.rsplit(",\nmc AS", 1)[0], recursive=True) + f"""
SELECT volume_id, z, {s6('avg(coalesce(i, 0))', 'miou')}, count(*) AS n_gt FROM (SELECT DISTINCT volume_id, z, label AS g FROM pb) LEFT JOIN (SELECT volume_id, z, g, max(iou) AS i FROM iou GROUP BY 1, 2, 3) USING (volume_id, z, g) GROUP BY 1, 2""")
def m8(spark, sf):
    return M.best_iou_per_object(*pair(spark, sf)).select(*SL, r6(F.col("miou"), "miou"), "n_gt")


@query("m9_pooled_f1", L.with_views("lattice", "slices", extra=PAIR, recursive=True) + f"""
SELECT volume_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_pred - tp) AS BIGINT) AS fp, CAST(sum(n_gt - tp) AS BIGINT) AS fn, {s6('2.0 * sum(tp) / (sum(n_pred) + sum(n_gt))', 'f1')} FROM mc GROUP BY 1""")
def m9(spark, sf):
    return M.pooled_f1(M.match_counts(*pair(spark, sf), L.slices(spark, sf)), ["volume_id"]).select("volume_id", "tp", "fp", "fn", r6(F.col("f1"), "f1"))


OBJ = BRIGHT + ", " + closure("bright", 8) + """, sz AS (SELECT volume_id, z, comp, count(*) * 0.25::DOUBLE AS a FROM lab GROUP BY 1, 2, 3),
ob AS (SELECT volume_id, z, sum(a) AS area, count(*) AS n, avg(a) AS mean, quantile_cont(a, 0.5) AS med, max(a) AS big FROM sz GROUP BY 1, 2),
inn AS (SELECT d.volume_id, d.z, avg(p) FILTER (l.comp IS NOT NULL) AS i, avg(p) FILTER (l.comp IS NULL) AS o FROM dense d LEFT JOIN lab l USING (volume_id, z, y, x) GROUP BY 1, 2)"""


@query("m10_slice_summary", L.with_views("dense", extra=OBJ, recursive=True) + f"""
SELECT volume_id, z, {s6('coalesce(area, 0)', 'area_um2')}, {s6('coalesce(area, 0) / 480', 'area_fraction')}, coalesce(n, 0) AS n_objects, {s6('coalesce(n, 0) / (480 / 1e6)', 'objects_per_mm2')}, {s6('coalesce(mean, 0)', 'mean_object_area_um2')},
 {s6('coalesce(med, 0)', 'median_object_area_um2')}, {s6('coalesce(big, 0)', 'largest_object_area_um2')}, {s6('i', 'mean_intensity_inside')}, {s6('o', 'mean_intensity_outside')}, {s6('i / greatest(o, 1e-6)', 'contrast_ratio')}
FROM slices LEFT JOIN ob USING (volume_id, z) LEFT JOIN inn USING (volume_id, z)""")
def m10(spark, sf):
    s = M.summarize_slices(bright(spark, sf), L.slices(spark, sf), L.plane(spark, sf, "p"), UM)
    names = ["area_um2", "area_fraction", "objects_per_mm2", "mean_object_area_um2", "median_object_area_um2", "largest_object_area_um2", "mean_intensity_inside", "mean_intensity_outside", "contrast_ratio"]
    return s.select(*SL, "n_objects", *[r6(F.col(n), n) for n in names])


@query("m11_object_shapes", L.with_views("lattice", extra=BRIGHT + ", " + closure("bright", 8), recursive=True) + f"""
SELECT volume_id, z, comp, {s6('n * 0.25', 'area_um2')}, {s6('cy * 0.5', 'centroid_y_um')}, {s6('cx * 0.5', 'centroid_x_um')}, {s6('4 * sqrt(greatest((vy + vx) / 2 + k, 0)) * 0.5', 'major_axis_um')}, {s6('sqrt(4 * n * 0.25 / pi())', 'equivalent_diameter_um')}
FROM (SELECT *, sqrt(((vy - vx) / 2) ** 2 + c ** 2) AS k FROM (SELECT volume_id, z, comp, count(*) AS n, avg(y) AS cy, avg(x) AS cx, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c FROM lab GROUP BY 1, 2, 3))""")
def m11(spark, sf):
    t = M.object_table(C.label_components(bright(spark, sf), L.slices(spark, sf), 8), None, UM, neighbours=False)
    return t.select(*SL, "comp", *[r6(F.col(n), n) for n in ("area_um2", "centroid_y_um", "centroid_x_um", "major_axis_um", "equivalent_diameter_um")])


@query("m11_object_table")
def m11_full(spark, sf):
    return M.object_table(C.label_components(bright(spark, sf), L.slices(spark, sf), 8), L.plane(spark, sf, "p"), UM)


@query("m11_perimeter", L.with_views("lattice", extra=BRIGHT + ", " + closure("bright", 8) + """,
edge AS (SELECT * FROM lab a WHERE (SELECT count(*) FROM bright n WHERE n.volume_id = a.volume_id AND n.z = a.z AND abs(n.y - a.y) + abs(n.x - a.x) = 1) < 4),
code AS (SELECT a.volume_id, a.z, a.comp, a.y, a.x, sum(CASE abs(b.y - a.y) + abs(b.x - a.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS c FROM edge a JOIN edge b ON b.volume_id = a.volume_id AND b.z = a.z AND greatest(abs(b.y - a.y), abs(b.x - a.x)) <= 1 GROUP BY 1, 2, 3, 4, 5)""", recursive=True)
       + f"SELECT volume_id, z, comp, {s6('sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END)', 'perimeter')} FROM code GROUP BY 1, 2, 3")
def m11_perimeter(spark, sf):
    p = M.perimeter(C.label_components(bright(spark, sf), L.slices(spark, sf), 8))
    return p.select(*SL, "comp", r6(F.col("perimeter"), "perimeter"))


@query("m12_channel_intensities", L.with_views("dense", extra=BRIGHT + ", " + closure("bright", 8), recursive=True) + f"""
SELECT volume_id, z, comp, {s6('avg(q)', 'q_mean')}, {s6('sum(q)', 'q_integrated')}, {s6('avg(p)', 'p_mean')}, {s6('sum(p)', 'p_integrated')} FROM lab JOIN dense USING (volume_id, z, y, x) GROUP BY 1, 2, 3""")
def m12(spark, sf):
    ch = L.dense(spark, sf).select(*PX, F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in "qp"])))
    t = M.channel_intensities(C.label_components(bright(spark, sf), L.slices(spark, sf), 8), ch, ["q", "p"])
    return t.select(*SL, "comp", *[r6(F.col(n), n) for n in ("q_mean", "q_integrated", "p_mean", "p_integrated")])


@query("j1_objects_with_intensities", L.with_views("dense", extra=BRIGHT + ", " + closure("bright", 8), recursive=True) + f"""
SELECT volume_id, z, comp, n AS n_px, {s6('m', 'q_mean')} FROM (SELECT volume_id, z, comp, count(*) AS n FROM lab GROUP BY 1, 2, 3) LEFT JOIN (SELECT volume_id, z, comp, avg(q) AS m FROM lab JOIN dense USING (volume_id, z, y, x) GROUP BY 1, 2, 3) USING (volume_id, z, comp)""")
def j1(spark, sf):
    lab = C.label_components(bright(spark, sf), L.slices(spark, sf), 8)
    ch = L.dense(spark, sf).select(*PX, F.lit("q").alias("channel"), F.col("q").alias("value"))
    t = C.component_sizes(lab).join(M.channel_intensities(lab, ch, ["q"]), [*SL, "comp"], "left")
    return t.select(*SL, "comp", "n_px", r6(F.col("q_mean"), "q_mean"))


@query("m13_stack_summary", L.with_views("dense") + f"""
SELECT volume_id, count(*) AS n_slices, {s6('sum(a) * 2', 'volume_um3')}, {s6('avg(a / 480)', 'mean_area_fraction')} FROM (SELECT volume_id, z, count(*) FILTER (q >= 50) * 0.25 AS a FROM dense GROUP BY 1, 2) GROUP BY 1""")
def m13(spark, sf):
    per = M.summarize_slices(bright(spark, sf), L.slices(spark, sf), None, UM)
    return M.summarize_stacks(per, F.lit(2.0)).select("volume_id", "n_slices", r6(F.col("volume_um3"), "volume_um3"), r6(F.col("mean_area_fraction"), "mean_area_fraction"))


SOLID = BRIGHT + ", " + closure("bright", 6, solid=True) + """, ob AS (SELECT volume_id, comp, count(*) * 0.5::DOUBLE AS volume_um3, count(DISTINCT z) AS n_slices, min(z) AS z_first, max(z) AS z_last, avg(z) * 2 AS cz, avg(y) * 0.5 AS cy, avg(x) * 0.5 AS cx,
 min(z) = 0 OR max(z) = 6 AS touches_stack_edge FROM lab GROUP BY 1, 2), ar AS (SELECT volume_id, comp, max(n) * 0.25 AS max_area_um2 FROM (SELECT volume_id, comp, z, count(*) AS n FROM lab GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def solids(spark, sf):
    lab = C.label_components(bright(spark, sf), L.volumes(spark, sf), 6, ["volume_id"])
    return lab.withColumns({"z_min": F.lit(0), "z_max": F.lit(L.DEPTH - 1)})


@query("m14_objects_3d", L.with_views("lattice", extra=SOLID, recursive=True) + f"""
SELECT volume_id, comp, {s6('volume_um3', 'volume_um3')}, n_slices, z_first, z_last, {s6('cz', 'centroid_z_um')}, {s6('cy', 'centroid_y_um')}, {s6('cx', 'centroid_x_um')}, {s6('max_area_um2', 'max_area_um2')}, touches_stack_edge FROM ob JOIN ar USING (volume_id, comp)""")
def m14(spark, sf):
    o = M.objects_3d(solids(spark, sf), L.VOXEL_UM, neighbours=False)
    return o.select("volume_id", "comp", "n_slices", "z_first", "z_last", "touches_stack_edge", *[r6(F.col(n), n) for n in ("volume_um3", "centroid_z_um", "centroid_y_um", "centroid_x_um", "max_area_um2")])


@query("m15_stack_objects_roll_up", L.with_views("lattice", extra=SOLID + ", nn AS (SELECT a.volume_id, a.comp, min(sqrt((a.cz - b.cz) ** 2 + (a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2)) AS d FROM ob a JOIN ob b ON a.volume_id = b.volume_id AND a.comp <> b.comp GROUP BY 1, 2)", recursive=True) + f"""
SELECT volume_id, count(*) AS n_objects_3d, count(*) FILTER (NOT touches_stack_edge) AS n_objects_3d_inside, {s6('quantile_cont(volume_um3, 0.5)', 'median_object_volume_um3')}, {s6('quantile_cont(d, 0.5)', 'median_nearest_neighbour_um')} FROM ob LEFT JOIN nn USING (volume_id, comp) GROUP BY 1""")
def m15(spark, sf):
    r = M.roll_up_objects(M.objects_3d(solids(spark, sf), L.VOXEL_UM))
    return r.select("volume_id", "n_objects_3d", "n_objects_3d_inside", r6(F.col("median_object_volume_um3"), "median_object_volume_um3"), r6(F.col("median_nearest_neighbour_um"), "median_nearest_neighbour_um"))


@query("p23_objects_per_volume", L.with_views("lattice", extra=SOLID, recursive=True) + f"SELECT volume_id, count(*) AS n_objects_3d, {s6('count(*) / (1920 * 0.25 * 7 * 2 / 1e9)', 'objects_per_mm3')} FROM ob GROUP BY 1")
def p23(spark, sf):
    n = C.component_sizes(solids(spark, sf), ["volume_id"]).groupBy("volume_id").agg(F.count("*").alias("n_objects_3d"))
    d = M.derived(n.withColumns({"n_slices": F.lit(7), "slice_spacing_um": F.lit(2.0)}), L.VOXEL_UM, 1920)
    return d.select("volume_id", "n_objects_3d", r6(F.col("objects_per_mm3"), "objects_per_mm3"))


def _histology(spark, sf):
    bone = R.encode_runs(L.lattice(spark, sf).where("p >= 35000").select(*PX))
    return M.histomorphometry(bone, bright(spark, sf), L.slices(spark, sf), UM, 1.0)


@query("m18_histology_summary")
def m18(spark, sf):
    return _histology(spark, sf)[0]


@query("m18_cells_by_distance", L.with_views("lattice", "ref", extra=BRIGHT + ", " + closure("bright", 8), recursive=True) + f"""
SELECT volume_id, z, comp, {s6('count(DISTINCT l.y * 48 + l.x) * 0.25', 'area_um2')}, {s6('min(sqrt((l.y - r.y) ** 2 + (l.x - r.x) ** 2)) * 0.5', 'distance_to_bone_um')} FROM lab l JOIN ref r USING (volume_id, z) GROUP BY 1, 2, 3""")
def m18_cells(spark, sf):
    return _histology(spark, sf)[1].select(*SL, "comp", r6(F.col("area_um2"), "area_um2"), r6(F.col("distance_to_bone_um"), "distance_to_bone_um"))


@query("m19_bone_measures")
def m19(spark, sf):
    return M.bone_measures(m18(spark, sf))


@query("m20_solid_measures")
def m20(spark, sf):
    return M.solid_measures(L.predicted(spark, sf), L.volumes(spark, sf), L.VOXEL_UM)


@query("m20_volume_share", L.with_views("dense") + f"SELECT volume_id, {s6('count(*) FILTER (q >= 30) * 0.5 / 1e9', 'bv_mm3')}, {s6('100.0 * count(*) FILTER (q >= 30) / count(*)', 'bv_tv_pct')} FROM dense GROUP BY 1")
def m20_share(spark, sf):
    return m20(spark, sf).select("volume_id", r6(F.col("bv_mm3"), "bv_mm3"), r6(F.col("bv_tv_pct"), "bv_tv_pct"))


@query("m22_agreement_frequency", L.with_views("dense") + f"SELECT volume_id, z, y, x, {s6('(CAST(q >= 20 AS INTEGER) + CAST(q >= 30 AS INTEGER) + CAST(q >= 40 AS INTEGER)) / 3.0', 'share')} FROM dense")
def m22(spark, sf):
    draws = L.plane(spark, sf).withColumn("t", F.explode(F.array(F.lit(20), F.lit(30), F.lit(40))))
    return draws.groupBy(*PX).agg(r6(F.avg((F.col("value") >= F.col("t")).cast("double")), "share"))


@query("w2_slice_step", L.with_views("lattice") + """
SELECT volume_id, CAST(floor(quantile_cont(g, 0.5)) AS INTEGER) AS step FROM (SELECT volume_id, z - lag(z) OVER (PARTITION BY volume_id ORDER BY z) AS g FROM (SELECT DISTINCT volume_id, z FROM lattice WHERE z % 2 = 0)) GROUP BY 1""")
def w2(spark, sf):
    return M.slice_step(L.lattice(spark, sf).where("z % 2 = 0"))


# ---------- result tables ----------

def evals(spark, sf):
    """Dice per stack, slice, method and seed: three cuts of one channel with three offsets against the other."""
    cuts = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(s).alias("seed"), F.lit(t + 3 * s).alias("t")) for m, t in (("high", 40), ("low", 20), ("mid", 30)) for s in range(3)])
    d = L.lattice(spark, sf).select(F.col("volume_id").alias("sample"), "z", "q", "p", F.inline(cuts))
    on, ref = F.col("q") >= F.col("t"), F.col("p") >= 35000
    n = lambda c: F.sum(c.cast("int"))
    return d.groupBy("sample", "z", "method", "seed").agg((2 * n(on & ref) / (n(on) + n(ref))).alias("dice"), (n(on) * 0.25).alias("area_pred"), (n(ref) * 0.25).alias("area_gt"))


EV = """ev AS (SELECT volume_id AS sample, z, method, CAST(seed.s AS INTEGER) AS seed, 2.0 * count(*) FILTER (q >= t + 3 * seed.s AND p >= 35000) / (count(*) FILTER (q >= t + 3 * seed.s) + count(*) FILTER (p >= 35000)) AS dice,
 count(*) FILTER (q >= t + 3 * seed.s) * 0.25::DOUBLE AS area_pred, count(*) FILTER (p >= 35000) * 0.25::DOUBLE AS area_gt FROM lattice CROSS JOIN (VALUES ('high', 40), ('low', 20), ('mid', 30)) m(method, t) CROSS JOIN range(3) seed(s) GROUP BY 1, 2, 3, 4)"""


def ev(sql):
    return L.with_views("lattice", extra=EV) + sql


@query("m24_seed_then_sample_means", ev(f"SELECT method, sample, {s6('avg(d)', 'dice')} FROM (SELECT method, sample, z, avg(dice) AS d FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def m24(spark, sf):
    return T.seed_then_sample_means(evals(spark, sf), ["method"], ["z"], "sample", ["dice"]).select("method", "sample", r6(F.col("dice"), "dice"))


@query("m25_two_level_summary", ev(f"SELECT method, {s6('avg(d)', 'mean')}, {s6('stddev_samp(d)', 'sd')}, count(*) AS n_clusters FROM (SELECT method, sample, avg(dice) AS d FROM ev GROUP BY 1, 2) GROUP BY 1"))
def m25(spark, sf):
    return T.two_level_summary(evals(spark, sf), ["method"], "sample", "dice").select("method", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), "n_clusters")


@query("m25_two_level_interval")
def m25_interval(spark, sf):
    return T.two_level_summary(evals(spark, sf), ["method"], "sample", "dice")


@query("m26_pivot_table", ev(f"SELECT sample, {s6('avg(dice) FILTER (method = ' + chr(39) + 'low' + chr(39) + ')', 'low')}, {s6('avg(dice) FILTER (method = ' + chr(39) + 'mid' + chr(39) + ')', 'mid')}, {s6('avg(dice) FILTER (method = ' + chr(39) + 'high' + chr(39) + ')', 'high')} FROM ev GROUP BY 1"))
def m26(spark, sf):
    return evals(spark, sf).groupBy("sample").pivot("method", ["low", "mid", "high"]).agg(F.round(F.avg("dice"), 6))


@query("j4_paired_methods", ev(f"SELECT sample, z, seed, {s6('a.dice', 'a')}, {s6('b.dice', 'b')}, {s6('a.dice - b.dice', 'diff')} FROM (SELECT * FROM ev WHERE method = 'mid') a JOIN (SELECT * FROM ev WHERE method = 'low') b USING (sample, z, seed)"))
def j4(spark, sf):
    p = T.paired(evals(spark, sf), ["sample", "z", "seed"], "method", "mid", "low", "dice")
    return p.select("sample", "z", "seed", *[r6(F.col(c), c) for c in ("a", "b", "diff")])


@query("j5_unstacked_methods", ev(f"SELECT sample, z, {s6('low', 'low')}, {s6('mid', 'mid')}, {s6('high', 'high')}, {s6('mid - low', 'mid_minus_low')}, {s6('high - low', 'high_minus_low')} FROM (SELECT sample, z, avg(dice) FILTER (method = 'low') AS low, avg(dice) FILTER (method = 'mid') AS mid, avg(dice) FILTER (method = 'high') AS high FROM ev GROUP BY 1, 2)"))
def j5(spark, sf):
    u = T.unstacked(evals(spark, sf), ["sample", "z"], "method", ["low", "mid", "high"], "low", "dice")
    return u.select("sample", "z", *[r6(F.col(c), c) for c in u.columns if c not in ("sample", "z")])


@query("m21_relative_error", ev(f"SELECT method, {s6('avg((area_pred - e) / e)', 'mean_relative')}, {s6('avg(abs((area_pred - e) / e))', 'mean_absolute_relative')}, {s6('corr(area_pred, e)', 'r')}, count(*) AS n FROM ev JOIN (SELECT sample, z, seed, area_pred AS e FROM ev WHERE method = 'mid') USING (sample, z, seed) WHERE method <> 'mid' GROUP BY 1"))
def m21(spark, sf):
    r = T.relative_error(evals(spark, sf), ["sample", "z", "seed"], "method", "mid", "area_pred")
    return r.select("method", r6(F.col("mean_relative"), "mean_relative"), r6(F.col("mean_absolute_relative"), "mean_absolute_relative"), r6(F.col("r"), "r"), "n")


@query("m22_condition_spread", ev(f"SELECT method, {s6('avg(dice)', 'mean')}, {s6('stddev_samp(dice)', 'sd')}, {s6('min(dice)', 'low')}, {s6('max(dice)', 'high')}, count(*) AS n FROM ev GROUP BY 1"))
def m22_spread(spark, sf):
    s = T.spread(evals(spark, sf), ["method"], "dice")
    return s.select("method", *[r6(F.col(c), c) for c in ("mean", "sd", "low", "high")], "n")


AGREE = """SELECT method, n, {bias}, {lo}, {hi}, {r}, {icc} FROM (SELECT *, 2 * n * vm / (n - 1) AS msr, n * ((mx - my) ** 2 / 2) AS msc, (n * (vx + vy) - 2 * n * vm) / (n - 1) AS mse FROM (
 SELECT method, count(*) AS n, avg(area_pred - area_gt) AS b, stddev_samp(area_pred - area_gt) AS s, corr(area_pred, area_gt) AS r0, avg(area_pred) AS mx, avg(area_gt) AS my, var_pop(area_pred) AS vx, var_pop(area_gt) AS vy, var_pop((area_pred + area_gt) / 2) AS vm FROM ev GROUP BY 1))"""


def _agree(name):
    @query(name, ev(AGREE.format(bias=s6("b", "bias"), lo=s6("b - 1.96 * s", "limit_low"), hi=s6("b + 1.96 * s", "limit_high"), r=s6("r0", "r"), icc=s6("(msr - mse) / (msr + mse + 2 / n * (msc - mse))", "icc"))))
    def run(spark, sf):
        a = T.agreement(evals(spark, sf), ["method"], "area_pred", "area_gt")
        return a.select("method", "n", *[r6(F.col(c), c) for c in ("bias", "limit_low", "limit_high", "r", "icc")])


_agree("q5_icc")
_agree("q6_agreement")


@query("q8_best_setting", ev(f"SELECT seed, method, {s6('m', 'dice')} FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(m, 12) DESC, method) AS k FROM (SELECT seed, method, avg(d) AS m FROM (SELECT seed, method, sample, avg(dice) AS d FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2)) WHERE k = 1"))
def q8(spark, sf):
    return T.best_setting(evals(spark, sf), ["seed"], "sample", "method", "dice").select("seed", "method", r6(F.col("dice"), "dice"))


NEST = "d AS (SELECT seed, sample, method, avg(dice) FILTER (z % 2 = 0) AS dev, avg(dice) FILTER (z % 2 = 1) AS test FROM ev GROUP BY 1, 2, 3), o AS (SELECT a.seed, a.sample, a.method, avg(b.dev) AS m, any_value(a.test) AS t FROM d a JOIN d b ON a.seed = b.seed AND a.method = b.method AND a.sample <> b.sample GROUP BY 1, 2, 3), w AS (SELECT *, row_number() OVER (PARTITION BY seed, sample ORDER BY round(m, 12) DESC, method) AS k FROM o)"


@query("q9_nested_leave_one_out", L.with_views("lattice", extra=EV + ", " + NEST) + f"SELECT seed, sample, method, {s6('m', 'dev_score')}, {s6('t', 'test_score')} FROM w WHERE k = 1")
def q9(spark, sf):
    e = evals(spark, sf)
    n = T.nested_scores(e.where("z % 2 = 0"), e.where("z % 2 = 1"), ["seed"], "sample", "method", "dice")
    return n.select("seed", "sample", "method", r6(F.col("dev_score"), "dev_score"), r6(F.col("test_score"), "test_score"))


@query("j12_leave_one_group_out", L.with_views("lattice", extra=EV + ", " + NEST) + f"SELECT seed, sample, method, {s6('m', 'dev_score')} FROM w WHERE k = 1")
def j12(spark, sf):
    b = T.leave_one_out_best(evals(spark, sf).where("z % 2 = 0"), ["seed"], "sample", "method", "dice")
    return b.select("seed", "sample", "method", r6(F.col("dev_score"), "dev_score"))


@query("q10_sensitivity_sweep", ev(f"SELECT method, 20 + 3 * seed AS cut, {s6('avg(d)', 'mean')}, {s6('stddev_samp(d)', 'sd')} FROM (SELECT method, seed, sample, avg(dice) AS d FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def q10(spark, sf):
    e = evals(spark, sf).withColumn("cut", 20 + 3 * F.col("seed"))
    return T.two_level_summary(e, ["method", "cut"], "sample", "dice").select("method", "cut", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"))


@query("j11_settings_grid", "SELECT p_size AS size, CAST(a.l AS INTEGER) AS edge, b.p AS position, count(*) AS n FROM part CROSS JOIN range(3) a(l) CROSS JOIN (VALUES (0.5::DOUBLE), (0.7), (0.9)) b(p) GROUP BY 1, 2, 3")
def j11(spark, sf):
    grid = [F.explode(F.array(*[F.lit(v) for v in vs])).alias(n) for n, vs in (("edge", (0, 1, 2)), ("position", (0.5, 0.7, 0.9)))]
    p = L.table(spark, sf, "part").select(F.col("p_size").alias("size"))
    return p.select("*", grid[0]).select("*", grid[1]).groupBy("size", "edge", "position").agg(F.count("*").alias("n"))


@query("q3_hierarchical_bootstrap")
def q3(spark, sf):
    return T.hierarchical_bootstrap(evals(spark, sf), ["method"], "sample", ["z", "seed"], "dice")


@query("q4_bootstrap")
def q4(spark, sf):
    return T.bootstrap(evals(spark, sf), ["method"], ["sample", "z", "seed"], "dice")


@query("q7_paired_difference_share", ev(f"SELECT {s6('avg(d)', 'mean_diff')}, {s6('avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)', 'wins')}, count(*) AS n FROM (SELECT a.dice - b.dice AS d FROM (SELECT * FROM ev WHERE method = 'mid') a JOIN (SELECT * FROM ev WHERE method = 'low') b USING (sample, z, seed))"))
def q7(spark, sf):
    p = T.paired(evals(spark, sf), ["sample", "z", "seed"], "method", "mid", "low", "dice")
    return p.agg(r6(F.avg("diff"), "mean_diff"), r6(F.avg((F.col("diff") > 0).cast("double")), "wins"), F.count("*").alias("n"))


@query("q7_paired_difference_interval")
def q7_interval(spark, sf):
    p = T.paired(evals(spark, sf), ["sample", "z", "seed"], "method", "mid", "low", "dice").withColumn("pair", F.lit("mid-low"))
    return T.hierarchical_bootstrap(p, ["pair"], "sample", ["z", "seed"], "diff")


@query("q11_method_summary", ev(f"SELECT method, {s6('avg(d)', 'dice')}, {s6('avg(b)', 'area_bias')}, {s6('avg(d - c)', 'drop_vs_clean')} FROM (SELECT method, sample, avg(dice) AS d, avg(area_pred - area_gt) AS b FROM ev GROUP BY 1, 2) JOIN (SELECT sample, avg(dice) AS c FROM ev WHERE method = 'mid' GROUP BY 1) USING (sample) GROUP BY 1"))
def q11(spark, sf):
    per = evals(spark, sf).groupBy("method", "sample").agg(F.avg("dice").alias("d"), F.avg(F.col("area_pred") - F.col("area_gt")).alias("b"))
    clean = per.where("method = 'mid'").select("sample", F.col("d").alias("c"))
    return per.join(clean, "sample").groupBy("method").agg(r6(F.avg("d"), "dice"), r6(F.avg("b"), "area_bias"), r6(F.avg(F.col("d") - F.col("c")), "drop_vs_clean"))


def scored(spark, sf):
    return L.table(spark, sf, "documents").join(L.table(spark, sf, "labels"), "doc_id").select("lang", "source", "quality", F.col("n_chars").cast("double").alias("value"))


@query("q1_group_summary", f"SELECT lang, quality, count(*) AS n, {s6('avg(n_chars)', 'mean')}, {s6('stddev_samp(n_chars)', 'sd')}, {s6('quantile_cont(n_chars, 0.5)', 'median')} FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def q1(spark, sf):
    return T.group_summary(scored(spark, sf), ["lang"], "quality", "value").select("lang", "quality", "n", *[r6(F.col(c), c) for c in ("mean", "sd", "median")])


RANK = "r AS (SELECT lang, quality, rank() OVER w + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY n_chars))"


@query("q1_rank_statistic", "WITH " + RANK + f""" SELECT lang, count(DISTINCT quality) AS n_groups, CASE WHEN count(DISTINCT quality) = 2 THEN 'Mann-Whitney U' END AS test,
 {s6('sum(rk) FILTER (quality = 0) - count(*) FILTER (quality = 0) * (count(*) FILTER (quality = 0) + 1) / 2', 'statistic')} FROM r GROUP BY 1""")
def q1_rank(spark, sf):
    return T.rank_tests(scored(spark, sf), ["lang"], "quality", "value").select("lang", "n_groups", "test", r6(F.col("statistic"), "statistic"))


@query("q1_rank_test_p_values")
def q1_p(spark, sf):
    return T.rank_tests(scored(spark, sf), ["lang"], "quality", "value")


@query("q1_kruskal_statistic", """WITH r AS (SELECT quality, lang, rank() OVER (PARTITION BY quality ORDER BY n_chars) + (count(*) OVER (PARTITION BY quality, n_chars) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY quality, n_chars) AS t, count(*) OVER (PARTITION BY quality) AS n FROM documents JOIN labels USING (doc_id)),
 g AS (SELECT quality, lang, sum(rk) AS s, count(*) AS m, sum(rk) ** 2 / count(*) AS rr FROM r GROUP BY 1, 2), k AS (SELECT quality, any_value(n) AS n, sum(t * t - 1) AS ties FROM r GROUP BY 1)
 SELECT quality, count(*) AS n_groups, round(CAST(CASE WHEN count(*) < 2 OR min(m) < 2 THEN NULL WHEN count(*) = 2 THEN arg_min(s, lang) - arg_min(m, lang) * (arg_min(m, lang) + 1) / 2
  ELSE (12.0 / (any_value(n) * (any_value(n) + 1.0)) * sum(rr) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (any_value(n)::DOUBLE ** 3 - any_value(n))) END AS DOUBLE), 5) + 0.0 AS statistic FROM g JOIN k USING (quality) GROUP BY 1""")
def q1_kruskal(spark, sf):
    """The same test with four groups; a group of one, or fewer than two groups, gives no statistic."""
    return T.rank_tests(scored(spark, sf), ["quality"], "lang", "value").select("quality", "n_groups", F.round("statistic", 5).alias("statistic"))


# ---------- picks and orders ----------

# Slices that differ by volume: those with an order-heavy cell; the reference of a volume is its number modulo 9, of every fourth none
HEAVY = "heavy AS (SELECT DISTINCT volume_id, z FROM lattice WHERE q >= 95)"
REFS = "refs AS (SELECT DISTINCT volume_id, CAST(CAST(substr(volume_id, 2) AS INTEGER) % 9 AS INTEGER) AS ref_z FROM lattice WHERE CAST(substr(volume_id, 2) AS INTEGER) % 4 <> 1)"


def heavy_slices(spark, sf):
    return L.lattice(spark, sf).where("q >= 95").select(*SL).distinct()


def reference_slices(spark, sf):
    n = F.substring("volume_id", 2, 9).cast("int")
    return L.volumes(spark, sf).where(n % 4 != 1).select("volume_id", (n % 9).alias("ref_z"))


@query("w1_outward_order", L.with_views("slices", extra=f"{HEAVY}, {REFS}, s AS (SELECT volume_id, z, row_number() OVER (PARTITION BY volume_id ORDER BY z) AS i FROM heavy), "
       "f AS (SELECT volume_id, arg_min(i, abs(z - ref_z) * 1000 + i) AS s FROM s JOIN refs USING (volume_id) GROUP BY volume_id)") + """
SELECT volume_id, z, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY coalesce(abs(i - f.s), i), CASE WHEN i >= f.s THEN 0 ELSE 1 END) AS INTEGER) AS step FROM s LEFT JOIN f USING (volume_id)""")
def w1(spark, sf):
    return P.outward_order(heavy_slices(spark, sf), reference_slices(spark, sf))


@query("w3_evenly_spaced", L.with_views("slices", extra=f"{HEAVY}, s AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY volume_id) AS n FROM heavy)")
       + "SELECT volume_id, z FROM s WHERE i IN (SELECT CAST(round_even(j * (n - 1) / greatest(least(4, n) - 1, 1), 0) AS INTEGER) FROM range(4) t(j) WHERE j < least(4, n))")
def w3(spark, sf):
    return P.evenly_spaced(heavy_slices(spark, sf), 4)


@query("w4_interleaved_split", L.with_views("slices", extra=HEAVY) + "SELECT volume_id, z, CASE WHEN row_number() OVER (PARTITION BY volume_id ORDER BY z) % 2 = 1 THEN 'test' ELSE 'dev' END AS split FROM heavy")
def w4(spark, sf):
    return P.interleaved_split(heavy_slices(spark, sf), ["test", "dev"])


@query("w5_labels_from_reference", L.with_views("slices", extra=f"""h AS (SELECT DISTINCT volume_id, z FROM lattice WHERE q >= 105),
t AS (SELECT * FROM (VALUES (1, 0), (2, 2), (3, 5)) t(k, t)), near AS (SELECT k, t, z, row_number() OVER (PARTITION BY k ORDER BY abs(z - t), z) AS r FROM t CROSS JOIN range(7) s(z)),
o AS (SELECT volume_id, k, list(CAST(near.z AS INTEGER) ORDER BY r) AS zs FROM near JOIN h ON h.z = near.z WHERE r <= 3 GROUP BY ALL),
v AS (SELECT DISTINCT volume_id FROM o), a AS (SELECT volume_id, (SELECT zs FROM o WHERE o.volume_id = v.volume_id AND k = 1) AS z1, (SELECT zs FROM o WHERE o.volume_id = v.volume_id AND k = 2) AS z2, (SELECT zs FROM o WHERE o.volume_id = v.volume_id AND k = 3) AS z3 FROM v),
b AS (SELECT *, z1[1] AS p1 FROM a), c AS (SELECT *, list_filter(z2, lambda x: x IS DISTINCT FROM p1)[1] AS p2 FROM b), e AS (SELECT *, list_filter(z3, lambda x: x IS DISTINCT FROM p1 AND x IS DISTINCT FROM p2)[1] AS p3 FROM c)""") + """
SELECT volume_id, z FROM (SELECT volume_id, unnest([p1, p2, p3]) AS z FROM e) WHERE z IS NOT NULL""")
def w5(spark, sf):
    filled = L.lattice(spark, sf).where("q >= 105").select(*SL).distinct().withColumn("filled", F.lit(True))   # Empty slices have no row
    return P.reference_picks(filled, L.volumes(spark, sf), 3)


@query("w6_reference_check_picks", L.with_views("slices", extra="u AS (SELECT volume_id, z, row_number() OVER (PARTITION BY volume_id ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY volume_id) AS n FROM slices WHERE z NOT IN (0, 3))") + """
SELECT volume_id, z FROM u WHERE i IN (SELECT CAST(round_even(j * 4 / 2.0, 0) AS INTEGER) FROM range(3) t(j))""")
def w6(spark, sf):
    s = L.slices(spark, sf).select(*SL)
    labelled_ = s.where("z IN (0, 3)")
    return P.evenly_spaced(s.join(labelled_, SL, "left_anti"), 3)


def runs(spark, sf):
    o = L.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("volume_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("value"))


@query("w7_prune_old_runs", "SELECT o_orderkey AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k > 2")
def w7(spark, sf):
    return P.newest(runs(spark, sf).where("status = 'F'"), ["volume_id"], 2, beyond=True).select("run_id")


@query("j13_latest_finished_run", "SELECT c_custkey AS volume_id, o_orderkey AS run_id FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey AND k = 1")
def j13(spark, sf):
    latest = P.newest(runs(spark, sf).where("status = 'F'"), ["volume_id"], 1).select("volume_id", "run_id")
    return L.table(spark, sf, "customer").select(F.col("c_custkey").alias("volume_id")).join(latest, "volume_id", "left")


@query("w8_worst_median_best", ev("SELECT sample, method, seed, z, c.c AS \"case\" FROM (SELECT sample, method, seed, z, row_number() OVER w AS i, count(*) OVER (PARTITION BY sample, method, seed) AS n FROM ev WINDOW w AS (PARTITION BY sample, method, seed ORDER BY dice, z)) JOIN (VALUES ('worst'), ('median'), ('best')) c(c) ON (c.c = 'worst' AND i = 1) OR (c.c = 'median' AND i = n // 2 + 1) OR (c.c = 'best' AND i = n)"))
def w8(spark, sf):
    return P.worst_median_best(evals(spark, sf), ["sample", "method", "seed"], "dice", "z").select("sample", "method", "seed", "z", "case")


@query("w9_top_settings", ev(f"SELECT sample, method, {s6('m', 'score')}, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(m, 12) DESC, method) AS k FROM (SELECT sample, method, avg(dice) AS m FROM ev GROUP BY 1, 2)) WHERE k <= 2"))
def w9(spark, sf):
    return P.top_settings(evals(spark, sf), ["sample"], "method", "dice", 2).select("sample", "method", r6(F.col("score"), "score"), "rank")


@query("w10_sorted_output", ev(f"SELECT method, seed, sample, z, {s6('dice', 'dice')} FROM ev ORDER BY method, seed, sample, z"))
def w10(spark, sf):
    return evals(spark, sf).select("method", "seed", "sample", "z", r6(F.col("dice"), "dice")).orderBy("method", "seed", "sample", "z")


@query("j7_nearest_processed_slice", L.with_views("slices") + "SELECT volume_id, z, CASE WHEN z % 4 = 1 THEN z - 1 WHEN z % 4 = 3 THEN z + 1 WHEN z % 4 = 2 THEN z - 2 ELSE z END AS nearest_z FROM slices WHERE CASE WHEN z % 4 = 3 THEN z + 1 ELSE z END <= 6")
def j7(spark, sf):
    s = L.slices(spark, sf).select(*SL)
    done = s.where("z % 4 = 0")
    return P.nearest_slice(s, done, M.slice_step(done))
