"""Queries for distances, scoring, thresholds and proposals."""
from pyspark.sql import functions as F

from ..functions.vectors import mean_vector
from ..operators import components as C
from ..operators import distance as D
from ..operators import grid as G
from ..operators import runs as R
from ..operators import scoring as S
from ..session import materialize
from ..sources import lattice as L
from .grid_queries import PX, r6, s6, upsample_sql
from .mask_queries import closure, masks
from .registry import query

SIDE = 140   # Image side behind a 10 x 10 patch grid of 14-pixel patches


# ---------- distances ----------
BOUND = """bp AS (SELECT * FROM pred p WHERE (SELECT count(*) FROM pred n WHERE n.volume_id = p.volume_id AND n.z = p.z AND abs(n.y - p.y) + abs(n.x - p.x) = 1) < 4),
br AS (SELECT * FROM ref p WHERE (SELECT count(*) FROM ref n WHERE n.volume_id = p.volume_id AND n.z = p.z AND abs(n.y - p.y) + abs(n.x - p.x) = 1) < 4)"""


def to_sql(a, b):
    return f"(SELECT a.volume_id, a.z, a.y, a.x, min(sqrt(((a.y - b.y) * 0.5) ** 2 + ((a.x - b.x) * 0.5) ** 2)) AS d FROM {a} a JOIN {b} b USING (volume_id, z) GROUP BY 1, 2, 3, 4)"


@query("g19_distance_transform", L.with_views("dense", extra="few AS (SELECT volume_id, z, y, x FROM dense WHERE q >= 30)") + f"""
SELECT a.volume_id, a.z, a.y, a.x, {s6('min(sqrt(((a.y - b.y) * 2.0) ** 2 + ((a.x - b.x) * 0.5) ** 2))', 'dist')} FROM dense a JOIN few b USING (volume_id, z) GROUP BY 1, 2, 3, 4""")
def g19(spark, sf):
    few = R.encode_runs(L.lattice(spark, sf).where("q >= 30").select(*PX))
    return D.distance_transform(few, L.slices(spark, sf), (2.0, 0.5)).select(*PX, r6(F.col("dist"), "dist"))


@query("m3_hd95", L.with_views("pred", "ref", "slices", extra=BOUND) + f"""
SELECT s.volume_id, s.z, {s6('quantile_cont(d, 0.95)', 'hd95')} FROM slices s LEFT JOIN (SELECT * FROM {to_sql('bp', 'ref')} UNION ALL SELECT * FROM {to_sql('br', 'pred')}) t USING (volume_id, z) GROUP BY 1, 2""")
def m3(spark, sf):
    p, r = masks(spark, sf)
    return D.hd95(p, r, L.slices(spark, sf), (0.5, 0.5)).select("volume_id", "z", r6(F.col("hd95"), "hd95"))


@query("m4_surface_dice", L.with_views("pred", "ref", "slices", extra=BOUND) + f"""
SELECT s.volume_id, s.z, {s6('CAST(count(*) FILTER (d <= 0.6) AS DOUBLE) / count(*)', 'nsd')} FROM slices s LEFT JOIN (SELECT * FROM {to_sql('bp', 'br')} UNION ALL SELECT * FROM {to_sql('br', 'bp')}) t USING (volume_id, z) GROUP BY 1, 2""")
def m4(spark, sf):
    p, r = masks(spark, sf)
    return D.surface_dice(p, r, L.slices(spark, sf), 0.6, (0.5, 0.5)).select("volume_id", "z", r6(F.col("nsd"), "nsd"))


@query("j6_nearest_neighbour", L.with_views("lattice", extra="few AS (SELECT volume_id, z, y * 0.5 AS cy, x * 0.5 AS cx FROM lattice WHERE q >= 30)") + f"""
SELECT a.volume_id, a.z, a.cy, a.cx, {s6('min(sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2))', 'nearest')}
FROM few a LEFT JOIN few b ON b.volume_id = a.volume_id AND b.z = a.z AND (b.cy <> a.cy OR b.cx <> a.cx) GROUP BY 1, 2, 3, 4""")
def j6(spark, sf):
    few = L.lattice(spark, sf).where("q >= 30").select("volume_id", "z", (F.col("y") * 0.5).alias("cy"), (F.col("x") * 0.5).alias("cx"))
    nn = D.nearest_neighbour(few, ["volume_id", "z"], ["cy", "cx"], 4.0)
    return nn.select("volume_id", "z", "cy", "cx", r6(F.col("nearest_neighbour_um"), "nearest"))


# ---------- scoring ----------

def points(spark, sf):
    """Clicks on the first slice of every stack: label 0 is the object, labels 1 to 3 are background."""
    p = L.patch_vectors(spark, sf).where("z = 0 AND label < 4")
    return p.select("volume_id", "z", F.when(F.col("label") == 0, "pos").otherwise("neg").alias("polarity"), F.col("vec_id").alias("ord"),
                    (F.col("gy") * 14 + F.col("vec_id") % 14 + 0.25).alias("y"), (F.col("gx") * 14 + F.col("vec_id") * 5 % 14 + 0.5).alias("x"))


POINTS = """pts AS (SELECT volume_id, z, CASE WHEN label = 0 THEN 'pos' ELSE 'neg' END AS polarity, vec_id AS ord, gy * 14 + vec_id % 14 + 0.25 AS y, gx * 14 + vec_id * 5 % 14 + 0.5 AS x FROM patches WHERE z = 0 AND label < 4)"""
PROTO = POINTS + """, protos AS (SELECT p.*, v.vec FROM pts p JOIN patches v ON v.volume_id = p.volume_id AND v.z = p.z AND v.gy = CAST(floor(p.y / 140 * 10) AS INTEGER) AND v.gx = CAST(floor(p.x / 140 * 10) AS INTEGER)),
dots AS (SELECT v.volume_id, v.z, v.gy, v.gx, avg(list_dot_product(v.vec, p.vec) / sqrt(list_dot_product(p.vec, p.vec))) FILTER (p.polarity = 'pos')
 - 0.8 * coalesce(avg(list_dot_product(v.vec, p.vec) / sqrt(list_dot_product(p.vec, p.vec))) FILTER (p.polarity = 'neg'), 0) AS s
 FROM patches v JOIN protos p ON p.volume_id = v.volume_id GROUP BY 1, 2, 3, 4)"""
ROBUST = """, med AS (SELECT volume_id, z, quantile_disc(s, 0.5) AS m FROM dots GROUP BY 1, 2), mad AS (SELECT volume_id, z, quantile_disc(abs(s - m), 0.5) AS k FROM dots JOIN med USING (volume_id, z) GROUP BY 1, 2),
std AS (SELECT volume_id, z, gy, gx, (s - m) / (k * 1.4826 + 1e-6) AS v FROM dots JOIN med USING (volume_id, z) JOIN mad USING (volume_id, z))"""


def protos(spark, sf):
    return S.prototypes(L.patch_vectors(spark, sf), points(spark, sf), SIDE, SIDE, 10, 10)


def scores(spark, sf):
    means = S.mean_prototypes(protos(spark, sf), ["volume_id"])
    return S.score_patches(L.patch_vectors(spark, sf).select("volume_id", "z", "gy", "gx", "vec"), means, ["volume_id"], 0.8)


@query("t1_prototypes_under_points", L.with_views("patches", extra=PROTO) + f"SELECT volume_id, polarity, ord, {s6('vec[1]', 'first')}, {s6('vec[64]', 'last')} FROM protos")
def t1(spark, sf):
    return protos(spark, sf).select("volume_id", "polarity", "ord", r6(F.col("vec")[0], "first"), r6(F.col("vec")[63], "last"))


@query("t2_similarity_score", L.with_views("patches", extra=PROTO) + f"SELECT volume_id, z, gy, gx, {s6('s', 'score')} FROM dots")
def t2(spark, sf):
    return scores(spark, sf).select("volume_id", "z", "gy", "gx", r6(F.col("value"), "score"))


@query("t3_robust_standardise", L.with_views("patches", extra=PROTO + ROBUST) + f"SELECT volume_id, z, gy, gx, {s6('v', 'score')} FROM std")
def t3(spark, sf):
    return S.standardise_robust(scores(spark, sf)).select("volume_id", "z", "gy", "gx", r6(F.col("value"), "score"))


UP = PROTO + ROBUST + ", cells AS (SELECT * FROM std)" + upsample_sql("", 10, 10, 140, 140)


def raw_map(spark, sf):
    means = S.mean_prototypes(protos(spark, sf), ["volume_id"])
    return materialize(S.score_map(L.patch_vectors(spark, sf), means, ["volume_id"], (10, 10), (SIDE, SIDE), 0.8))


AT = UP + """, sampled AS (SELECT p.volume_id, p.z, p.polarity, p.ord, u.v FROM pts p JOIN up u ON u.volume_id = p.volume_id AND u.z = p.z
 AND u.y = least(greatest(CAST(round_even(p.y, 0) AS INTEGER), 0), 139) AND u.x = least(greatest(CAST(round_even(p.x, 0) AS INTEGER), 0), 139)),
cal0 AS (SELECT volume_id, z, count(*) FILTER (polarity = 'pos') AS n_pos, count(*) FILTER (polarity = 'neg') AS n_neg,
 CASE WHEN count(*) FILTER (polarity = 'pos') > 5 THEN quantile_cont(v, 0.1) FILTER (polarity = 'pos') ELSE min(v) FILTER (polarity = 'pos') END AS lo,
 CASE WHEN count(*) FILTER (polarity = 'neg') > 5 THEN quantile_cont(v, 0.9) FILTER (polarity = 'neg') ELSE max(v) FILTER (polarity = 'neg') END AS hi FROM sampled GROUP BY 1, 2),
cal AS (SELECT *, hi + CASE WHEN n_pos > 5 AND n_neg > 5 THEN 0.9 ELSE 0.7 END * (lo - hi) AS thr FROM cal0)"""


@query("t6_sample_at_points", L.with_views("patches", extra=AT) + f"SELECT volume_id, z, polarity, ord, {s6('v', 'value')} FROM sampled")
def t6(spark, sf):
    s = S.sample_points(raw_map(spark, sf), points(spark, sf), SIDE, SIDE)
    return s.select("volume_id", "z", "polarity", "ord", r6(F.col("value"), "value"))


@query("t4_calibrated_threshold", L.with_views("patches", extra=AT) + f"SELECT volume_id, z, n_pos, n_neg, {s6('thr', 'threshold')} FROM cal")
def t4(spark, sf):
    c = S.calibrate_threshold(S.sample_points(raw_map(spark, sf), points(spark, sf), SIDE, SIDE), ["volume_id", "z"])
    return c.select("volume_id", "z", "n_pos", "n_neg", r6(F.col("threshold"), "threshold"))


@query("t5_automatic_position", L.with_views("patches", extra=POINTS) + """
SELECT volume_id, CASE WHEN count(*) FILTER (polarity = 'pos') > 5 AND count(*) FILTER (polarity = 'neg') > 5 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS position FROM pts GROUP BY 1""")
def t5(spark, sf):
    n = points(spark, sf).groupBy("volume_id").agg(F.sum((F.col("polarity") == "pos").cast("int")).alias("n_pos"), F.sum((F.col("polarity") == "neg").cast("int")).alias("n_neg"))
    return n.select("volume_id", S.auto_position(-1).alias("position"))


HEAT = "heat AS (SELECT volume_id, z, y, x, (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w) AS v FROM dense WINDOW w AS (PARTITION BY volume_id, z))"
OTSU = """, hb AS (SELECT volume_id, z, least(CAST(floor(v * 256) AS INTEGER), 255) AS b, count(*) AS n FROM heat GROUP BY 1, 2, 3),
hc AS (SELECT *, (b + 0.5) / 256 AS c FROM hb),
hw AS (SELECT volume_id, z, b, c, sum(n) OVER up AS w1, sum(n * c) OVER up AS s1, sum(n) OVER dn AS w2, sum(n * c) OVER dn AS s2 FROM hc
 WINDOW up AS (PARTITION BY volume_id, z ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY volume_id, z ORDER BY b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
ho AS (SELECT volume_id, z, c AS thr FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, z ORDER BY round(CAST(w1 AS DOUBLE) * w2 * (s1 / w1 - s2 / w2) ** 2, 4) DESC, b) AS k FROM hw WHERE w2 IS NOT NULL) WHERE k = 1)"""


def heat(spark, sf):
    return G.rescale01(L.plane(spark, sf, "p"))


@query("t8_otsu", L.with_views("dense", extra=HEAT + OTSU) + f"SELECT volume_id, z, {s6('thr', 'threshold')} FROM ho")
def t8(spark, sf):
    return S.otsu(heat(spark, sf)).select("volume_id", "z", r6(F.col("threshold"), "threshold"))


@query("t7_threshold_top_percent", L.with_views("dense", extra=HEAT) + """
SELECT h.volume_id, h.z, y, x FROM heat h JOIN (SELECT volume_id, z, quantile_cont(v, 0.8) thr FROM heat GROUP BY 1, 2) t USING (volume_id, z) WHERE v >= thr""")
def t7_top(spark, sf):
    h = heat(spark, sf)
    return S.apply_threshold(h, S.threshold_heat(h, "top_percent", 20.0), ["volume_id", "z"]).select(*PX)


@query("t7_threshold_manual", L.with_views("dense", extra=HEAT) + "SELECT volume_id, z, y, x FROM heat WHERE v >= 0.3")
def t7_manual(spark, sf):
    h = heat(spark, sf)
    return S.apply_threshold(h, S.threshold_heat(h, "manual", manual=0.3), ["volume_id", "z"]).select(*PX)


@query("t7_threshold_otsu_fallback", L.with_views("dense", extra=HEAT + OTSU) + "SELECT volume_id, z, y, x FROM heat JOIN ho USING (volume_id, z) WHERE v >= thr")
def t7_otsu(spark, sf):
    h = heat(spark, sf)
    return S.apply_threshold(h, S.threshold_heat(h, "clicks"), ["volume_id", "z"]).select(*PX)


PICK = AT + """, span AS (SELECT volume_id, z, min(v) AS mn, max(v) AS mx FROM up GROUP BY 1, 2),
chosen AS (SELECT s.volume_id, s.z, coalesce(h.thr, c.thr) AS thr, mn, mx, CASE WHEN h.thr IS NOT NULL THEN 'clicks' ELSE 'carried over' END AS threshold_source
 FROM span s LEFT JOIN cal h USING (volume_id, z) LEFT JOIN cal c ON c.volume_id = s.volume_id AND c.z = 0)"""


def chosen(spark, sf):
    raw = raw_map(spark, sf)
    here = S.calibrate_threshold(S.sample_points(raw, points(spark, sf), SIDE, SIDE), ["volume_id", "z"])
    return raw, S.choose_thresholds(raw, here, here.drop("z"))


@query("t9_score_and_threshold", L.with_views("patches", extra=PICK) + f"""
SELECT volume_id, z, {s6('thr', 'threshold')}, {s6('(thr - mn) / (mx - mn)', 'heat_threshold')}, threshold_source, count(*) FILTER (v >= thr) AS n_px FROM chosen JOIN up USING (volume_id, z) GROUP BY volume_id, z, thr, mn, mx, threshold_source""")
def t9(spark, sf):
    raw, t = chosen(spark, sf)
    n = raw.join(t, ["volume_id", "z"]).groupBy("volume_id", "z").agg(F.sum((F.col("value") >= F.col("threshold")).cast("int")).alias("n_px"))
    return t.join(n, ["volume_id", "z"]).select("volume_id", "z", r6(F.col("threshold"), "threshold"), r6(F.col("heat_threshold"), "heat_threshold"), "threshold_source", "n_px")


@query("t10_carry_points_to_other_slices", L.with_views("patches", extra=PICK) + "SELECT u.volume_id, u.z, y, x FROM up u JOIN chosen c USING (volume_id, z) WHERE u.z > 0 AND v >= thr")
def t10(spark, sf):
    raw, t = chosen(spark, sf)
    return S.apply_threshold(raw.where("z > 0"), t.where("threshold_source = 'carried over'"), ["volume_id", "z"]).select(*PX)


def structure_points(spark, sf):
    """Labels 0, 1 and 2 are structures, label 3 is background."""
    p = L.patch_vectors(spark, sf).where("z = 0 AND label < 4")
    return p.select("volume_id", "z", F.when(F.col("label") < 3, "pos").otherwise("neg").alias("polarity"), F.col("label").alias("structure"), F.col("vec_id").alias("ord"),
                    (F.col("gy") * 14 + 7.0).alias("y"), (F.col("gx") * 14 + 7.0).alias("x"), "vec")


MULTI = """mp AS (SELECT p.volume_id, t.structure, CASE WHEN p.label = t.structure THEN 'pos' ELSE 'neg' END AS polarity, p.gy * 14 + 7 AS y, p.gx * 14 + 7 AS x, p.vec
 FROM patches p CROSS JOIN range(3) t(structure) WHERE p.z = 0 AND p.label < 4),
md AS (SELECT v.volume_id, v.z, p.structure, v.gy, v.gx, avg(list_dot_product(v.vec, p.vec) / sqrt(list_dot_product(p.vec, p.vec))) FILTER (polarity = 'pos') AS sim,
 avg(list_dot_product(v.vec, p.vec) / sqrt(list_dot_product(p.vec, p.vec))) FILTER (polarity = 'pos') - avg(list_dot_product(v.vec, p.vec) / sqrt(list_dot_product(p.vec, p.vec))) FILTER (polarity = 'neg') AS s
 FROM patches v JOIN mp p ON p.volume_id = v.volume_id GROUP BY 1, 2, 3, 4, 5),
mm AS (SELECT volume_id, z, structure, quantile_disc(s, 0.5) AS m FROM md GROUP BY 1, 2, 3), mk AS (SELECT volume_id, z, structure, quantile_disc(abs(s - m), 0.5) AS k FROM md JOIN mm USING (volume_id, z, structure) GROUP BY 1, 2, 3),
ms AS (SELECT volume_id, z, structure, gy, gx, sim, (s - m) / (k * 1.4826 + 1e-6) AS score FROM md JOIN mm USING (volume_id, z, structure) JOIN mk USING (volume_id, z, structure)),
ma AS (SELECT p.volume_id, p.structure, p.polarity, s.score FROM mp p JOIN ms s ON s.volume_id = p.volume_id AND s.structure = p.structure AND s.z = 0 AND s.gy = p.y // 14 AND s.gx = p.x // 14),
mt AS (SELECT volume_id, structure, hi + CASE WHEN n_pos > 5 AND n_neg > 5 THEN 0.9 ELSE 0.7 END * (lo - hi) AS thr FROM (SELECT volume_id, structure, count(*) FILTER (polarity = 'pos') AS n_pos, count(*) FILTER (polarity = 'neg') AS n_neg,
 CASE WHEN count(*) FILTER (polarity = 'pos') > 5 THEN quantile_cont(score, 0.1) FILTER (polarity = 'pos') ELSE min(score) FILTER (polarity = 'pos') END AS lo,
 CASE WHEN count(*) FILTER (polarity = 'neg') > 5 THEN quantile_cont(score, 0.9) FILTER (polarity = 'neg') ELSE max(score) FILTER (polarity = 'neg') END AS hi FROM ma GROUP BY 1, 2))"""


def multi_scores(spark, sf):
    """Standardised score and own similarity per patch and structure, and a calibrated threshold per structure."""
    by, sl = ["volume_id", "structure"], ["volume_id", "z", "structure"]
    rows = S.multi_prototypes(structure_points(spark, sf), ["volume_id"])
    means = S.mean_prototypes(rows, by)
    p = L.patch_vectors(spark, sf).select("volume_id", "z", "gy", "gx", "vec")
    s = S.standardise_robust(S.score_patches(p, means, ["volume_id"], 1.0), sl)
    sim = S.score_patches(p, means.withColumn("neg", F.lit(None).cast("array<double>")), ["volume_id"]).withColumnRenamed("value", "sim")
    cells = s.withColumnRenamed("value", "score").join(sim, [*sl, "gy", "gx"])
    at = S.points_to_cells(rows, SIDE, SIDE, 10, 10).select(*by, "z", "polarity", "ord", "gy", "gx").join(cells, [*sl, "gy", "gx"])
    return cells, S.calibrate_threshold(at.withColumnRenamed("score", "value"), by)


@query("t11_calibrate_structures", L.with_views("patches", extra=MULTI) + f"SELECT volume_id, CAST(structure AS INTEGER) AS structure, {s6('thr', 'threshold')} FROM mt")
def t11(spark, sf):
    return multi_scores(spark, sf)[1].select("volume_id", "structure", r6(F.col("threshold"), "threshold"))


@query("t12_most_similar_structure", L.with_views("patches", extra=MULTI) + """
SELECT volume_id, z, gy AS y, gx AS x, CAST(coalesce((arg_max(structure, sim) FILTER (score >= thr)) + 1, 0) AS INTEGER) AS label FROM ms JOIN mt USING (volume_id, structure) GROUP BY 1, 2, 3, 4""")
def t12(spark, sf):
    cells, t = multi_scores(spark, sf)
    rows = cells.join(t, ["volume_id", "structure"]).withColumnsRenamed({"gy": "y", "gx": "x"}).withColumn("ordinal", F.col("structure"))
    return S.most_similar_passing(rows)


@query("t12_clean_structure_labels")
def t12_clean(spark, sf):
    ext = L.patch_vectors(spark, sf).select("volume_id", "z").distinct().withColumns({"height": F.lit(10), "width": F.lit(10)})
    return S.clean_labels(t12(spark, sf), ext, 3, (1.0, 1.0), 0, 2.0, 2.0)


ALL_POINTS = PROTO + """, fp AS (SELECT *, list_transform(vec, lambda e: e / sqrt(list_dot_product(vec, vec))) AS u FROM protos),
fd AS (SELECT v.volume_id, v.z, v.gy, v.gx, p.polarity, p.ord, list_dot_product(v.vec, p.u) AS d FROM patches v JOIN fp p ON p.volume_id = v.volume_id),
fa AS (SELECT volume_id, z, gy, gx, avg(d) FILTER (polarity = 'pos') - avg(d) FILTER (polarity = 'neg') AS s, sum(d) FILTER (polarity = 'pos') AS sp, sum(d) FILTER (polarity = 'neg') AS sn,
 count(*) FILTER (polarity = 'pos') AS np, count(*) FILTER (polarity = 'neg') AS nn FROM fd GROUP BY 1, 2, 3, 4),
fs AS (SELECT *, min(s) OVER (PARTITION BY volume_id, z) AS lo, max(s) OVER (PARTITION BY volume_id, z) AS hi FROM fa),
fx AS (SELECT f.*, CASE WHEN polarity = 'pos' THEN (sp - d) / (np - 1) - sn / nn WHEN nn > 1 THEN sp / np - (sn - d) / (nn - 1) ELSE sp / np END AS s2 FROM fs f JOIN fd USING (volume_id, z, gy, gx) WHERE NOT (polarity = 'pos' AND np = 1))"""


FLIPS = f"""
SELECT volume_id, z, gy, gx, {s6('avg(CASE WHEN (least(greatest((s2 - lo) / (hi - lo), 0), 1) >= 0.6) <> ((s - lo) / (hi - lo) >= 0.6) THEN 1.0 ELSE 0.0 END)', 'uncertainty')} FROM fx GROUP BY 1, 2, 3, 4"""


def left_out(spark, sf, p):
    thr = p.select("volume_id").distinct().withColumn("threshold", F.lit(0.6))
    u = S.uncertainty(L.patch_vectors(spark, sf), p, ["volume_id"], thr, "leave_one_out")
    return u.select("volume_id", "z", "gy", "gx", r6(F.col("value"), "uncertainty"))


@query("t13_uncertainty_leave_one_out", L.with_views("patches", extra=ALL_POINTS) + FLIPS)
def t13(spark, sf):
    return left_out(spark, sf, protos(spark, sf))


@query("t13_uncertainty_subsets")
def t13_subsets(spark, sf):
    p = protos(spark, sf)
    thr = p.select("volume_id").distinct().withColumn("threshold", F.lit(0.6))
    return S.uncertainty(L.patch_vectors(spark, sf), p, ["volume_id"], thr, "subsets")


@query("t14_probability_uncertainty", L.with_views("dense", extra=HEAT) + """
SELECT volume_id, z, round(avg(least(greatest(1 - 4 * abs(v - 0.5), 0), 1)), 6) + 0.0 AS mean_uncertainty, round(avg(CASE WHEN least(greatest(1 - 4 * abs(v - 0.5), 0), 1) > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS uncertain_share FROM heat GROUP BY 1, 2""")
def t14(spark, sf):
    u = heat(spark, sf).withColumn("u", S.probability_uncertainty(F.col("value")))
    return u.groupBy("volume_id", "z").agg(r6(F.avg("u"), "mean_uncertainty"), r6(F.avg((F.col("u") > 0.05).cast("double")), "uncertain_share"))


@query("t15_suggest_next_point")
def t15(spark, sf):
    u = heat(spark, sf).withColumn("value", S.probability_uncertainty(F.col("value")))
    pts = L.lattice(spark, sf).where("q >= 100").select(*PX)
    return S.suggest_point(u, pts, L.HEIGHT, L.WIDTH)


def click_points(spark, sf):
    l = L.lattice(spark, sf)
    return l.where("q >= 95").select(*PX, F.lit("pos").alias("polarity")).unionByName(l.where("q <= 1").select(*PX, F.lit("neg").alias("polarity")))


MISSED = closure("region", 4) + """, st AS (SELECT l.volume_id, l.z, l.comp, count(*) AS area_px, sum(q - loose) AS strength, max({'q': q, 'ny': -l.y, 'nx': -l.x}) AS peak
 FROM lab l JOIN dense d USING (volume_id, z, y, x) JOIN loose USING (volume_id, z) WHERE (l.volume_id, l.z, l.comp) NOT IN (SELECT volume_id, z, comp FROM lab JOIN pts USING (volume_id, z, y, x)) GROUP BY 1, 2, 3)"""
MISSED_PRE = """pts AS (SELECT volume_id, z, y, x, 'pos' AS polarity FROM lattice WHERE q >= 95 UNION ALL SELECT volume_id, z, y, x, 'neg' FROM lattice WHERE q <= 1),
loose AS (SELECT o.volume_id, o.z, 60 - 0.5 * (60 - coalesce(m, o.q)) AS loose FROM (SELECT volume_id, z, quantile_cont(q, 0.5) AS q FROM dense GROUP BY 1, 2) o
 LEFT JOIN (SELECT volume_id, z, quantile_cont(q, 0.5) AS m FROM dense JOIN pts USING (volume_id, z, y, x) WHERE polarity = 'neg' GROUP BY 1, 2) n USING (volume_id, z)),
big AS (SELECT volume_id, z, y, x FROM dense WHERE q >= 60),
region AS (SELECT d.volume_id, d.z, d.y, d.x FROM dense d JOIN loose USING (volume_id, z) WHERE q >= loose AND NOT EXISTS (SELECT 1 FROM big b WHERE b.volume_id = d.volume_id AND b.z = d.z AND abs(b.y - d.y) + abs(b.x - d.x) <= 2)), """


@query("t16_missed_regions", L.with_views("dense", extra=MISSED_PRE + MISSED, recursive=True) + f"""
SELECT volume_id, z, rank, comp, area_px, {s6('strength / area_px', 'score')}, -peak.ny AS y, -peak.nx AS x FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, z ORDER BY strength DESC, comp) AS rank FROM st) WHERE rank <= 5""")
def t16(spark, sf):
    raw = L.plane(spark, sf)
    big = R.encode_runs(L.lattice(spark, sf).where("q >= 60").select(*PX))
    thr = L.slices(spark, sf).select("volume_id", "z", F.lit(60.0).alias("threshold"))
    m = S.missed_regions(raw, big, thr, click_points(spark, sf), L.slices(spark, sf), L.HEIGHT, L.WIDTH, min_share=0.0)
    return m.select("volume_id", "z", "rank", "comp", "area_px", r6(F.col("score"), "score"), "y", "x")


@query("t17_region_at_point", L.with_views("pred", extra=closure("pred", 4), recursive=True) + """
SELECT volume_id, z, y, x FROM lab WHERE (volume_id, z, comp) IN (SELECT l.volume_id, l.z, l.comp FROM lab l JOIN lattice p USING (volume_id, z, y, x) WHERE q >= 90)""")
def t17(spark, sf):
    lab = R.decode_runs(C.label_components(masks(spark, sf)[0], L.slices(spark, sf), 4))
    return S.region_at(lab, L.lattice(spark, sf).where("q >= 90").select(*PX), L.HEIGHT, L.WIDTH).select(*PX)


def boxes(spark, sf):
    """One box per order-heavy cell, 3 to 9 cells a side."""
    l = L.lattice(spark, sf).where("q >= 80")
    half = (F.col("q") % 4 + 1).cast("int")
    return l.select("volume_id", "z", (F.col("y") * 100 + F.col("x")).alias("box"), F.greatest(F.col("y") - half, F.lit(0)).alias("y0"), F.greatest(F.col("x") - half, F.lit(0)).alias("x0"),
                    F.least(F.col("y") + half, F.lit(39)).alias("y1"), F.least(F.col("x") + half, F.lit(47)).alias("x1"))


BOXES = """boxes AS (SELECT volume_id, z, y * 100 + x AS box, greatest(y - h, 0) AS y0, greatest(x - h, 0) AS x0, least(y + h, 39) AS y1, least(x + h, 47) AS x1
 FROM (SELECT *, CAST(q % 4 + 1 AS INTEGER) AS h FROM lattice WHERE q >= 80))"""


@query("t18_box_prompts", L.with_views("dense", extra=BOXES) + """
SELECT volume_id, z, box, gy, gx, rank FROM (SELECT b.volume_id, b.z, b.box, d.y AS gy, d.x AS gx, count(*) OVER (PARTITION BY b.volume_id, b.z, b.box) AS n,
 row_number() OVER (PARTITION BY b.volume_id, b.z, b.box ORDER BY p, d.y, d.x) AS rank FROM boxes b JOIN dense d ON d.volume_id = b.volume_id AND d.z = b.z AND d.y >= y0 AND d.y < greatest(y0 + 1, y1) AND d.x >= x0 AND d.x < greatest(x0 + 1, x1))
WHERE rank <= least(greatest(floor(n * 0.3), 1), 15)""")
def t18(spark, sf):
    cells = L.plane(spark, sf, "p").withColumnsRenamed({"y": "gy", "x": "gx"})
    return S.box_positives(cells, boxes(spark, sf), L.HEIGHT, L.WIDTH, L.HEIGHT, L.WIDTH).select("volume_id", "z", "box", "gy", "gx", "rank")


@query("j8_pixels_in_boxes", L.with_views("pred", extra=BOXES) + """
SELECT * FROM pred p WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.volume_id = p.volume_id AND b.z = p.z AND p.y BETWEEN y0 AND y1 AND p.x BETWEEN x0 AND x1)""")
def j8_boxes(spark, sf):
    return S.inside_boxes(L.predicted(spark, sf), boxes(spark, sf), bucket=16)


@query("j9_exclude_near_points", L.with_views("pred") + """
SELECT * FROM pred p WHERE NOT EXISTS (SELECT 1 FROM lattice c WHERE c.q >= 80 AND c.volume_id = p.volume_id AND c.z = p.z AND (c.y - p.y) ** 2 + (c.x - p.x) ** 2 < 9)""")
def j9(spark, sf):
    pts = L.lattice(spark, sf).where("q >= 80").select("volume_id", "z", F.col("y").alias("py"), F.col("x").alias("px"))
    return S.exclude_near(L.predicted(spark, sf), pts, 3.0)


def profiles(spark, sf):
    """Every stack's points as a stored profile; every other one belongs to a saved model."""
    return (L.patch_vectors(spark, sf).select("volume_id").distinct()
            .select(F.concat(F.lit("profile-"), "volume_id").alias("profile_id"), F.concat(F.lit("name "), "volume_id").alias("name"),
                    F.when(F.expr("cast(substring(volume_id, 2) as int) % 2 = 1"), "model").alias("model_id"), "volume_id"))


PROFILES = "profiles AS (SELECT DISTINCT 'profile-' || volume_id AS profile_id, 'name ' || volume_id AS name, CASE WHEN CAST(substr(volume_id, 2) AS INTEGER) % 2 = 1 THEN 'model' END AS model_id, volume_id FROM patches)"


@query("t19_profile_kinds", L.with_views("patches", extra=PROFILES) + """
SELECT profile_id, CASE WHEN model_id IS NOT NULL THEN 'learned' WHEN count(DISTINCT label) > 1 THEN 'structures' ELSE 'prototypes' END AS kind, count(DISTINCT label) AS n_structures
FROM profiles JOIN patches USING (volume_id) WHERE label < 3 AND z = 0 GROUP BY profile_id, model_id""")
def t19(spark, sf):
    st = structure_points(spark, sf).where("structure < 3").select(F.concat(F.lit("profile-"), "volume_id").alias("profile_id"), "structure")
    return S.profile_kind(profiles(spark, sf), st).select("profile_id", "kind", "n_structures")


@query("t19_resolve_profile", L.with_views("patches", extra=PROFILES) + """
SELECT spec, CASE WHEN count(profile_id) = 1 THEN min(profile_id) END AS profile_id, CASE WHEN count(profile_id) = 0 THEN 'no profile matches' WHEN count(profile_id) > 1 THEN 'several profiles match' END AS problem
FROM (SELECT DISTINCT name AS spec FROM profiles UNION SELECT DISTINCT 'nothing ' || volume_id FROM profiles) w LEFT JOIN profiles p ON starts_with(p.profile_id, w.spec) OR p.name = w.spec GROUP BY spec""")
def t19_resolve(spark, sf):
    p = profiles(spark, sf)
    wanted = p.select(F.col("name").alias("spec")).union(p.select(F.concat(F.lit("nothing "), "volume_id")))
    return S.resolve_profile(p, wanted)


@query("t20_refine_profile", L.with_views("patches", extra=PROTO) + f"""
SELECT volume_id, polarity, count(*) AS n, {s6('avg(vec[1])', 'first')}, CAST(NULL AS DOUBLE) AS threshold
FROM (SELECT volume_id, polarity, vec FROM protos UNION ALL SELECT volume_id, CASE WHEN label = 0 THEN 'pos' ELSE 'neg' END, vec FROM patches WHERE z = 1 AND label < 4) GROUP BY 1, 2""")
def t20(spark, sf):
    clicked = L.patch_vectors(spark, sf).where("z = 1 AND label < 4").select("volume_id", F.when(F.col("label") == 0, "pos").otherwise("neg").alias("polarity"), F.col("vec_id").alias("ord"), "vec")
    thr = profiles(spark, sf).select("volume_id", F.lit(0.5).alias("threshold"))
    both, t = S.refine_profile(protos(spark, sf), clicked, ["volume_id"], thr)
    m = mean_vector(both, ["volume_id", "polarity"])
    return m.join(t, "volume_id").select("volume_id", "polarity", "n", r6(F.col("vec")[0], "first"), "threshold")


@query("t21_profile_from_points", L.with_views("patches", extra=AT) + f"""
SELECT 'profile-' || volume_id AS profile_id, n_pos, n_neg, {s6('thr', 'raw_threshold')} FROM cal""")
def t21(spark, sf):
    return t4(spark, sf).select(F.concat(F.lit("profile-"), "volume_id").alias("profile_id"), "n_pos", "n_neg", F.col("threshold").alias("raw_threshold"))
