"""Queries for sampling, augmentation, learning, whole stacks and streams."""
from pyspark.sql import functions as F

from ..operators import augment as A
from ..operators import components as C
from ..operators import grid as G
from ..operators import learning as ML
from ..operators import runs as R
from ..operators import sampling as N
from ..operators import scoring as SC
from ..operators import stats as T
from ..operators import training as LT
from ..session import ensure_checkpoint_dir, materialize
from ..sources import lattice as L
from . import score_queries as SQ
from . import stack as K
from .grid_queries import PX, r6, s6
from .mask_queries import masks
from .registry import query

SL = ["volume_id", "z"]
H, W = L.HEIGHT, L.WIDTH


def image(spark, sf):
    return L.plane(spark, sf).withColumn("value", F.least(F.col("value") / 100, F.lit(1.0)))


# ---------- sampling ----------

@query("n1_simulated_points")
def n1(spark, sf):
    return N.simulated_points(masks(spark, sf)[0], L.slices(spark, sf), 5, 8, 7, margin=1)


@query("n1_simulated_points_noisy")
def n1_noisy(spark, sf):
    return N.simulated_points(masks(spark, sf)[0], L.slices(spark, sf), 10, 20, 7, noisy=True)


@query("n2_points_over_objects")
def n2(spark, sf):
    return N.points_over_objects(C.label_components(masks(spark, sf)[0], L.slices(spark, sf), 8), L.plane(spark, sf, "p"), L.slices(spark, sf), 10, 20, 3, 1, 1)


@query("n3_points_at_centroids")
def n3(spark, sf):
    return N.centroid_points(C.label_components(masks(spark, sf)[0], L.slices(spark, sf), 8), 5, 1)


@query("n4_prompt_set")
def n4(spark, sf):
    return N.prompts(C.label_components(masks(spark, sf)[0], L.slices(spark, sf), 8), L.slices(spark, sf), margin=1)


@query("n5_extra_point")
def n5(spark, sf):
    return N.pick(L.predicted(spark, sf), 1, 11, "extra")


@query("w11_most_interior_pixels")
def w11(spark, sf):
    return N.interior(C.label_components(masks(spark, sf)[0], L.slices(spark, sf), 8), L.slices(spark, sf))


@query("n6_stratified_items", "SELECT o_orderpriority AS batch, CASE WHEN o_custkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split, least(20, count(*) FILTER (o_orderstatus = 'F')) AS n FROM orders GROUP BY 1, 2")
def n6(spark, sf):
    items = L.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_custkey").alias("well"), F.col("o_orderkey").alias("name"), (F.col("o_orderstatus") == "F").alias("has_object"))
    n = N.stratified_items(items, "batch", 20, 5, 1 << 30)
    return n.groupBy("batch", "split").agg(F.count("*").alias("n"))


def crops(spark, sf):
    edges = R.decode_runs(R.boundary(masks(spark, sf)[0])).select(*PX)
    return N.crop_pixels(image(spark, sf), N.crop_windows(edges, L.slices(spark, sf), 4, 16, 2))


@query("n7_random_crops")
def n7(spark, sf):
    return crops(spark, sf).groupBy(*SL, "crop").agg(F.count("*").alias("n_px"), F.avg("value").alias("mean"))


@query("n8_jittered_crops")
def n8(spark, sf):
    return N.jitter_crops(crops(spark, sf), 4)


# ---------- augmentation ----------
IMG = "img AS (SELECT volume_id, z, y, x, least(q / 100, 1.0) AS v FROM dense)"


def _photometric(name, aug, level, sql=None):
    @query(name, L.with_views("dense", extra=IMG) + f"SELECT volume_id, z, y, x, {s6(sql, 'value')} FROM img" if sql else None)
    def run(spark, sf):
        a = A.photometric(image(spark, sf), aug, level, H, W, 9, (1.0, 1.0), L.predicted(spark, sf))
        return a.select(*PX, r6(F.col("value"), "value"))


_photometric("n9_contrast", "contrast", 2, "0.5 * (v - 0.5) + 0.5 - 0.1")
_photometric("n9_gamma_bright", "gamma_lo", 2, "pow(v, 0.5)")
_photometric("n9_gamma_dark", "gamma_hi", 2, "pow(v, 2.0)")
for _n in ("gauss_noise", "poisson_noise", "blur", "illumination", "dimming", "lowres", "saturation"):
    _photometric(f"n9_{_n}", _n, 1)


def _turn(level, sql):
    @query(f"n10_quarter_turn_level{level}", L.with_views("dense", extra=IMG) + sql)
    def run(spark, sf):
        return A.geometric(image(spark, sf), "rot90_flip", level, H, W).select(*PX, r6(F.col("value"), "value"))


_turn(1, f"SELECT volume_id, z, y, 47 - x AS x, {s6('v', 'value')} FROM img")
_turn(2, f"SELECT volume_id, z, 47 - x AS y, y AS x, {s6('v', 'value')} FROM img")
_turn(3, f"SELECT volume_id, z, 47 - x AS y, 39 - y AS x, {s6('v', 'value')} FROM img")


@query("n10_rotate")
def n10_rotate(spark, sf):
    return A.geometric(image(spark, sf), "rotate", 1, H, W)


@query("n10_elastic_mask")
def n10_elastic(spark, sf):
    m = L.plane(spark, sf).withColumn("value", (F.col("value") >= 30).cast("double"))
    return A.geometric(m, "elastic", 1, H, W, 3).where("value >= 0.5")


@query("n11_quantise", L.with_views("dense", extra=IMG) + "SELECT volume_id, z, y, x, round_even(v * 65536, 0) / 65536 AS value FROM img")
def n11(spark, sf):
    return image(spark, sf).withColumn("value", A.quantise(F.col("value"))).select(*PX, "value")


@query("g24_smooth_field")
def g24(spark, sf):
    return A.smooth_field(L.slices(spark, sf), 8.0, H, W, 5, "field")


@query("m23_augmentation_statistics", L.with_views("dense", extra=IMG) + " UNION ALL ".join(
    f"SELECT 'contrast' AS augmentation, {i} AS level, {s6(f'avg({c} * (v - 0.5) + 0.5 + {b})', 'mean')}, {s6(f'stddev_pop({c} * (v - 0.5) + 0.5 + {b})', 'sd')} FROM img" for i, c, b in ((1, 0.75, 0.05), (2, 0.5, -0.1), (3, 0.3, 0.2))))
def m23(spark, sf):
    out = None
    for level in (1, 2, 3):
        a = A.photometric(image(spark, sf), "contrast", level, H, W).withColumns({"augmentation": F.lit("contrast"), "level": F.lit(level)})
        s = A.intensity_statistics(a, ["augmentation", "level"]).select("augmentation", "level", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"))
        out = s if out is None else out.unionByName(s)
    return out


# ---------- learning ----------

def samples(spark, sf):
    """Embedding patches with a soft target per label."""
    t = F.when(F.col("label") < 3, 1.0).when(F.col("label") == 3, 0.6).otherwise(0.0)
    return L.patch_vectors(spark, sf).select(*SL, "gy", "gx", "vec", t.alias("target"))


@query("l1_linear_classifier")
def l1(spark, sf):
    s = samples(spark, sf)
    return ML.probability(ML.fit_linear(s), s).select(*SL, "gy", "gx", "value")


@query("l2_two_layer_classifier")
def l2(spark, sf):
    s = samples(spark, sf)
    return ML.probability(ML.fit_mlp(s, 64), s).select(*SL, "gy", "gx", "value")


def shares(spark, sf):
    label = F.when(F.col("label") < 3, 1).when(F.col("label") < 6, 2).otherwise(0)
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.when(F.col("_l") == k, 0.9).otherwise(0.05).alias("share")) for k in range(3)])
    return L.patch_vectors(spark, sf).withColumn("_l", label).select(*SL, "gy", "gx", "vec", F.inline(rows))


@query("l3_multi_class_classifier")
def l3(spark, sf):
    return ML.class_probabilities(ML.fit_multi(shares(spark, sf), 3), L.patch_vectors(spark, sf)).select(*SL, "gy", "gx", "probs")


@query("l4_fold_assignment", L.with_views("patches") + "SELECT volume_id, z, CAST(CASE WHEN n <= 6 THEN i ELSE i % 5 END AS INTEGER) AS fold FROM (SELECT volume_id, z, row_number() OVER (ORDER BY volume_id, z) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT volume_id, z FROM patches))")
def l4(spark, sf):
    """The rule of the SQL: every slice its own fold up to six slices, five folds beyond."""
    return ML.folds(L.patch_vectors(spark, sf), rule_l4(L.patch_vectors(spark, sf)))


def rule_l4(slices):
    return None if slices.select(*SL).distinct().count() <= 6 else 5


def held_out(spark, sf):
    """Both kinds of model with and without neighbourhood features, one fold a slice, scored on the image grid."""
    s = samples(spark, sf)
    truth = s.where("target > 0.5").select(*SL, F.explode(F.sequence(F.col("gy") * 2, F.col("gy") * 2 + 1)).alias("y"), "gx").select(*SL, "y", F.explode(F.sequence(F.col("gx") * 2, F.col("gx") * 2 + 1)).alias("x"))
    trained = LT.train_folds(s, 64, n_folds=5, hidden=16, rounds=30)
    return LT.select_candidate(trained, truth, (10, 10), (20, 20))


@query("l5_model_selection")
def l5(spark, sf):
    return held_out(spark, sf)[0]


@query("l9_trained_profile")
def l9_profile(spark, sf):
    """The chosen model with its threshold, and what it makes of all slices."""
    model = materialize(held_out(spark, sf)[1])
    p = LT.predict(model, L.patch_vectors(spark, sf), 64)
    m = model.first()   # One row: a profile
    on = (F.col("value") >= m["threshold"]).cast("long")
    return p.groupBy(*SL).agg(F.sum(on).alias("n_patches")).withColumns({"candidate": F.lit(m["candidate"]), "threshold": F.lit(m["threshold"])})


CAL = "h AS (SELECT volume_id, z, least(q / 100, 1.0) AS v, p >= 35000 AS t FROM dense), d AS (SELECT c.c AS threshold, volume_id, z, CASE WHEN count(*) FILTER (v >= c.c) + count(*) FILTER (t) = 0 THEN 1 ELSE 2.0 * count(*) FILTER (v >= c.c AND t) / (count(*) FILTER (v >= c.c) + count(*) FILTER (t)) END AS dice FROM h CROSS JOIN (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in ML.THRESHOLDS) + ") c(c) GROUP BY 1, 2, 3), m AS (SELECT threshold, avg(dice) AS dice FROM d GROUP BY 1)"


@query("l6_probability_threshold", L.with_views("dense", extra=CAL) + f"SELECT threshold, {s6('dice', 'dice')} FROM m ORDER BY round_even(m.dice, 4) DESC, round(abs(threshold - 0.5), 6), threshold LIMIT 1")
def l6(spark, sf):
    held = L.dense(spark, sf).select(*SL, F.least(F.col("q") / 100, F.lit(1.0)).alias("value"), (F.col("p") >= 35000).alias("truth"))
    return ML.calibrate(held).select("threshold", r6(F.col("dice"), "dice"))


@query("l7_probability_mask")
def l7(spark, sf):
    s = samples(spark, sf)
    p = ML.probability(ML.fit_linear(s), s).select(*SL, "gy", "gx", "value")
    up = G.upsample(p, (10, 10), (70, 70))
    ext = s.select(*SL).distinct().withColumns({"height": F.lit(70), "width": F.lit(70)})
    m = C.clean_up(R.encode_runs(up.where("value >= 0.5").select(*PX)), ext, (1.0, 1.0), 0, 0.0, 20.0)
    return R.area(m)


@query("l8_multi_class_label_map")
def l8(spark, sf):
    p = ML.class_probabilities(ML.fit_multi(shares(spark, sf), 3), L.patch_vectors(spark, sf))
    p = p.select(*SL, "gy", "gx", *[F.col("probs")[k].alias(f"c{k}") for k in range(3)])
    up = G.upsample(p, (10, 10), (70, 70), values=["c0", "c1", "c2"])
    return ML.most_probable(up, ["c0", "c1", "c2"]).groupBy(*SL, "label").agg(F.count("*").alias("n_px"))


@query("l9_train_from_labels")
def l9(spark, sf):
    """Labels of a mask -> context vectors -> cross-validated model and its threshold."""
    from ..operators.grid import z_context
    v = z_context(L.patch_vectors(spark, sf).select(*SL, "gy", "gx", "vec"), 1, 5)
    s = v.join(samples(spark, sf).select(*SL, "gy", "gx", "target"), [*SL, "gy", "gx"])
    held = ML.cross_validate(s, {"linear": ML.fit_linear}, rule_l4(s))
    return ML.select_model(held).join(ML.calibrate(held).select(F.lit("linear").alias("candidate"), "threshold"), "candidate")


@query("l10_export_and_reload_model")
def l10(spark, sf):
    import uuid

    from pyspark.ml.classification import LogisticRegressionModel
    s = samples(spark, sf)
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    ML.save_model(ML.fit_linear(s), path)
    return ML.probability(LogisticRegressionModel.load(path), s).select(*SL, "gy", "gx", "value")


@query("l11_label_regions", L.with_views("patches") + "SELECT volume_id, z, gy, gx FROM patches WHERE gx < 5")
def l11(spark, sf):
    region = L.patch_vectors(spark, sf).select(*SL, "gy", "gx", F.when(F.col("gx") < 5, 0.75).otherwise(0.25).alias("value"))
    return ML.inside_region(samples(spark, sf), region).select(*SL, "gy", "gx")


@query("l12_forest_on_pixels")
def l12(spark, sf):
    f = materialize(G.pixel_features(image(spark, sf), H, W, (1.0,)))
    pts = SQ.click_points(spark, sf)
    rows = materialize(ML.disk_pixels(pts, H, W).join(f, PX))
    m = ML.fit_forest(rows, [c for c in f.columns if c not in PX], 10)
    return m.transform(f).groupBy(*SL).agg(F.sum("prediction").cast("long").alias("n_px"))


@query("l13_held_out_probe")
def l13(spark, sf):
    s = samples(spark, sf)
    m = ML.fit_linear(s.where("z < 3"))
    held = ML.probability(m, s.where("z >= 3")).withColumn("truth", F.col("target") > 0.5)
    return ML.mean_dice(held)


@query("u1_external_segmenter", L.with_views("dense") + "SELECT volume_id, z, y, x FROM dense WHERE q >= 45")
def u1(spark, sf):
    def cut(pdf):
        return pdf[pdf["value"] >= 45][["volume_id", "z", "y", "x"]]
    return ML.external_segmenter(L.plane(spark, sf), cut, "volume_id string, z int, y int, x int", tile=16)


# ---------- stacks ----------

@query("m16_stack_run")
def m16(spark, sf):
    side = SQ.SIDE
    v = L.patch_vectors(spark, sf)
    ext = v.select(*SL).distinct().withColumns({"height": F.lit(side), "width": F.lit(side)})
    return K.run_stack(v, SQ.protos(spark, sf), SQ.points(spark, sf), ext, (10, 10), (side, side), L.VOXEL_UM, 0.8, 5.0, 5.0)["summary"]


# Stacks of two slices: every third has points on its first slice, every third on its second, the others none
STACKS = (L.with_views("patches", extra=SQ.AT.replace(", sampled AS", """, late AS (SELECT volume_id, z, CASE WHEN label = 0 THEN 'pos' ELSE 'neg' END AS polarity, vec_id AS ord, gy * 14 + vec_id % 14 + 0.25 AS y, gx * 14 + vec_id * 5 % 14 + 0.5 AS x
 FROM patches WHERE label < 4 AND z = CAST(substr(volume_id, 2) AS INTEGER) % 3), sampled AS""").replace("FROM pts p JOIN up u", "FROM late p JOIN up u")
 + ", span AS (SELECT volume_id, z, min(v) AS mn, max(v) AS mx FROM up GROUP BY 1, 2), heat AS (SELECT volume_id, z, y, x, (v - mn) / (mx - mn) AS v FROM up JOIN span USING (volume_id, z))" + SQ.OTSU
 + ", chosen AS (SELECT s.volume_id, s.z, coalesce(h.thr, c.thr, mn + o.thr * (mx - mn)) AS thr, mn, mx, CASE WHEN h.thr IS NOT NULL THEN 'clicks' WHEN c.thr IS NOT NULL THEN 'carried over' ELSE 'otsu (no background clicks)' END AS threshold_source"
 " FROM span s LEFT JOIN cal h USING (volume_id, z) LEFT JOIN cal c ON c.volume_id = s.volume_id LEFT JOIN ho o ON o.volume_id = s.volume_id AND o.z = s.z)").replace("// 500", "// 200").replace("% 500", "% 200"))


def short_stacks(spark, sf):
    v = L.patch_vectors(spark, sf)
    v = v.withColumns({"volume_id": F.expr("concat('e', cast(vec_id div 200 as string))"), "z": F.expr("cast(vec_id % 200 div 100 as int)")})
    at = v.where("label < 4").select(*SL, F.when(F.col("label") == 0, "pos").otherwise("neg").alias("polarity"), F.col("vec_id").alias("ord"),
                                     (F.col("gy") * 14 + F.col("vec_id") % 14 + 0.25).alias("y"), (F.col("gx") * 14 + F.col("vec_id") * 5 % 14 + 0.5).alias("x"))
    protos = SC.prototypes(v, at.where("z = 0"), SQ.SIDE, SQ.SIDE, 10, 10)
    return v, protos, at.where(F.col("z") == F.substring("volume_id", 2, 9).cast("int") % 3)


@query("m16_stack_slices", STACKS + f"SELECT volume_id, z, {s6('(thr - mn) / (mx - mn)', 'threshold')}, threshold_source, {s6('count(*) FILTER (v >= thr) * 0.25', 'area_um2')}, {s6('count(*) FILTER (v >= thr) / 19600', 'area_fraction')} FROM chosen JOIN up USING (volume_id, z) GROUP BY volume_id, z, thr, mn, mx, threshold_source")
def m16_slices(spark, sf):
    v, protos, points = short_stacks(spark, sf)
    ext = v.select(*SL).distinct().withColumns({"height": F.lit(SQ.SIDE), "width": F.lit(SQ.SIDE)})
    s = K.run_stack(v, protos, points, ext, (10, 10), (SQ.SIDE, SQ.SIDE), L.VOXEL_UM, 0.8)["slices"]
    return s.select(*SL, r6(F.col("threshold"), "threshold"), "threshold_source", r6(F.col("area_um2"), "area_um2"), r6(F.col("area_fraction"), "area_fraction"))


@query("m16_stack_top_percent", STACKS + f"SELECT volume_id, z, {s6('t', 'threshold')}, {s6('count(*) FILTER (h >= t) * 0.25', 'area_um2')} FROM (SELECT volume_id, z, v AS h FROM heat) JOIN (SELECT volume_id, z, quantile_cont(v, 0.9) AS t FROM heat GROUP BY 1, 2) USING (volume_id, z) GROUP BY volume_id, z, t")
def m16_top(spark, sf):
    v, protos, points = short_stacks(spark, sf)
    ext = v.select(*SL).distinct().withColumns({"height": F.lit(SQ.SIDE), "width": F.lit(SQ.SIDE)})
    s = K.run_stack(v, protos, points, ext, (10, 10), (SQ.SIDE, SQ.SIDE), L.VOXEL_UM, 0.8, mode="top_percent")["slices"]
    return s.select(*SL, r6(F.col("threshold"), "threshold"), r6(F.col("area_um2"), "area_um2"))


@query("m16_measured_stack", L.with_views("dense") + f"SELECT volume_id, count(*) AS n_slices, {s6('sum(a) * 2', 'volume_um3')}, {s6('avg(a) / 480', 'mean_area_fraction')}, {s6('avg(d)', 'mean_dice_vs_reference')} FROM (SELECT volume_id, z, count(*) FILTER (q >= 30) * 0.25 AS a, 2.0 * count(*) FILTER (q >= 30 AND p >= 35000) / (count(*) FILTER (q >= 30) + count(*) FILTER (p >= 35000)) AS d FROM dense GROUP BY 1, 2) GROUP BY 1")
def m16_measured(spark, sf):
    p, r = masks(spark, sf)
    s = K.measure_stack(materialize(p), L.slices(spark, sf), L.VOXEL_UM, None, r)["summary"]
    return s.select("volume_id", "n_slices", *[r6(F.col(c), c) for c in ("volume_um3", "mean_area_fraction", "mean_dice_vs_reference")])


@query("m17_stack_run_structures", L.with_views("dense", extra="l AS (SELECT volume_id, z, CASE WHEN q >= 60 THEN 2 WHEN q >= 40 THEN 1 END AS s FROM dense)") + f"SELECT v.volume_id, CAST(k.k AS INTEGER) AS structure, 7::BIGINT AS n_slices, {s6('count(s) * 0.5', 'volume_um3')} FROM (SELECT DISTINCT volume_id FROM l) v CROSS JOIN (VALUES (0), (1), (2)) k(k) LEFT JOIN l ON l.volume_id = v.volume_id AND (l.s = k.k OR k.k = 0 AND l.s IS NOT NULL) GROUP BY 1, 2")
def m17(spark, sf):
    labels = L.plane(spark, sf).select(*PX, F.when(F.col("value") >= 60, 2).when(F.col("value") >= 40, 1).otherwise(0).alias("label"))
    s = K.run_stack_multi(labels, L.slices(spark, sf), 2, L.VOXEL_UM)["summary"]
    return s.select("volume_id", "structure", "n_slices", r6(F.col("volume_um3"), "volume_um3"))


@query("j3_reference_or_saved_label", L.with_views("lattice") + "SELECT volume_id, z, y, x, CASE WHEN CAST(substr(volume_id, 2) AS INTEGER) % 2 = 0 THEN p >= 35000 ELSE q >= 40 END AS expected FROM lattice")
def j3(spark, sf):
    flag = L.volumes(spark, sf).select("volume_id", (F.substring("volume_id", 2, 9).cast("int") % 2 == 0).alias("has_reference"))
    l = L.lattice(spark, sf)
    channel, saved = l.select(*PX, (F.col("p") >= 35000).alias("_r")), l.select(*PX, (F.col("q") >= 40).alias("_s"))
    j = l.select(*PX).join(flag, "volume_id").join(channel, PX, "left").join(saved, PX, "left")
    return j.select(*PX, F.when(F.col("has_reference"), F.col("_r")).otherwise(F.col("_s")).alias("expected"))


TR = "ds AS (SELECT CAST(substr(volume_id, 2) AS INTEGER) % 3 AS dataset, volume_id, z, q, p >= 35000 AS t FROM lattice), th AS (SELECT dataset, volume_id AS ref_volume, z AS ref_z, quantile_cont(q, 0.6) AS thr FROM ds GROUP BY 1, 2, 3), tr AS (SELECT dataset, ref_volume, ref_z, volume_id, z, 2.0 * count(*) FILTER (q >= thr AND t) / (count(*) FILTER (q >= thr) + count(*) FILTER (t)) AS dice FROM ds JOIN th USING (dataset) GROUP BY 1, 2, 3, 4, 5)"


def transfer_inputs(spark, sf):
    from ..functions.quantiles import group_quantiles
    d = materialize(L.lattice(spark, sf).select((F.substring("volume_id", 2, 9).cast("int") % 3).alias("dataset"), *SL, F.col("q").alias("value"), (F.col("p") >= 35000).alias("truth")))
    t = group_quantiles(d, ["dataset", *SL], "value", {"threshold": 0.6}).withColumnsRenamed({"volume_id": "ref_volume", "z": "ref_z"})
    return d, t, "dataset"


@query("j14_transfer_matrix", L.with_views("lattice", extra=TR) + f"SELECT dataset, ref_volume, ref_z, volume_id, z, {s6('dice', 'dice')}, CASE WHEN ref_volume = volume_id AND ref_z = z THEN 'same slice' WHEN ref_volume = volume_id THEN 'same file' ELSE 'other file' END AS transfer FROM tr")
def j14(spark, sf):
    return K.threshold_transfers(*transfer_inputs(spark, sf)).select("dataset", "ref_volume", "ref_z", *SL, r6(F.col("dice"), "dice"), "transfer")


@query("j15_source_target_means", L.with_views("lattice", extra=TR) + f"SELECT dataset, ref_volume, volume_id, {s6('avg(dice)', 'dice')} FROM tr GROUP BY 1, 2, 3")
def j15(spark, sf):
    return K.transfer_means(*transfer_inputs(spark, sf)).select("dataset", "ref_volume", "volume_id", r6(F.col("dice"), "dice"))


@query("q2_study_table", f"SELECT c_mktsegment AS grp, count(*) AS n, {s6('avg(o_totalprice)', 'mean')}, {s6('quantile_cont(o_totalprice, 0.5)', 'median')} FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey AND k = 1 GROUP BY 1")
def q2(spark, sf):
    runs = L.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("volume_id"), F.col("o_orderkey").alias("run_id"), F.lit("done").alias("status"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("value"))
    v = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("volume_id"), F.col("c_mktsegment").alias("grp"), F.lit(1).alias("one"))
    return T.group_summary(K.study(v, runs, ["value"]), ["one"], "grp", "value").select("grp", "n", r6(F.col("mean"), "mean"), r6(F.col("median"), "median"))


# ---------- streams (the same functions on a table; the tests replay them as streams) ----------

@query("z1_last_save_wins", "SELECT user_id, event_type, value AS payload FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_id % 7 <> 0")
def z1(spark, sf):
    from ..streaming.jobs import latest_saves
    e = L.table(spark, sf, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("seq"), F.col("value").alias("payload"), (F.col("event_id") % 7 == 0).alias("empty"))
    return latest_saves(e, ["user_id", "event_type"]).where("NOT empty").select("user_id", "event_type", "payload")


@query("z2_arriving_files", L.with_views("slices") + "SELECT 'ok' AS status, count(*) AS n FROM slices")
def z2(spark, sf):
    """Array files (path, content) put into the shared folder and picked up by the file stream."""
    import uuid

    from ..sources import files as X
    from ..streaming.jobs import stream_files
    root = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    packed = X.encode_arrays(L.plane(spark, sf), SL, H, W)
    packed.write.parquet(f"{root}/in")
    stream_files(spark.readStream.schema(packed.schema).parquet(f"{root}/in"), X.decode_arrays, f"{root}/out", f"{root}/ck").awaitTermination()
    return spark.read.parquet(f"{root}/out/status").groupBy("status").agg(F.count("*").alias("n"))


@query("z3_latest_job_status", "SELECT user_id AS job, arg_max(event_type, ts) AS status FROM events GROUP BY 1")
def z3(spark, sf):
    from ..streaming.jobs import latest_status
    e = L.table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), "ts")
    return latest_status(e, ["job"]).select("job", "status")


@query("z3_status_throughput", "SELECT date_trunc('hour', ts) AS start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def z3_throughput(spark, sf):
    from ..streaming.jobs import throughput
    e = L.table(spark, sf, "events").select(F.col("event_type").alias("status"), "ts")
    return throughput(e, "1 hour")
