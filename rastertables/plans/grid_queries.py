"""Queries for value transforms, resampling and stencils."""
from pyspark.sql import functions as F

from ..functions.quantiles import group_quantiles
from ..operators import grid as G
from ..sources import lattice as L
from .registry import query

H, W, N = L.HEIGHT, L.WIDTH, L.DEPTH
PX = ["volume_id", "z", "y", "x"]


def r6(c, name):
    return F.round(c, 6).alias(name)


def s6(e, name):
    return f"round(CAST(({e}) AS DOUBLE), 6) + 0.0 AS {name}"


@query("p1_percentile_rescale", L.with_views("dense") + f"""
SELECT d.volume_id, d.z, d.y, d.x, {s6("CASE WHEN hi - lo < 1e-8 THEN 0 ELSE least(greatest((q - lo) / (hi - lo), 0), 1) END", "value")}
FROM dense d JOIN (SELECT volume_id, z, quantile_cont(q, 0.01) lo, quantile_cont(q, 0.995) hi FROM dense GROUP BY 1, 2) s USING (volume_id, z)""")
def p1(spark, sf):
    return G.normalize_planes(L.plane(spark, sf)).select(*PX, r6(F.col("value"), "value"))


@query("p2_minmax_rescale", L.with_views("dense") + f"""
SELECT volume_id, z, y, x, {s6("(p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w)", "value")}
FROM dense WINDOW w AS (PARTITION BY volume_id, z)""")
def p2(spark, sf):
    return G.rescale01(L.plane(spark, sf, "p")).select(*PX, r6(F.col("value"), "value"))


def channels(spark, sf):
    """The two recorded channels and their product as long rows (channel, value)."""
    d = L.dense(spark, sf)
    third = F.col("q") * F.col("p") / 1000
    return d.select(*PX, F.inline(F.array(*[F.struct(F.lit(i).alias("channel"), c.alias("value")) for i, c in enumerate((F.col("q"), F.col("p"), third))])))


@query("p3_luminance", L.with_views("dense") + f"SELECT volume_id, z, y, x, {s6('(q + p + q * p / 1000) / 3', 'value')} FROM dense")
def p3(spark, sf):
    return G.luminance(channels(spark, sf)).select(*PX, r6(F.col("value"), "value"))


@query("p4_colour_channel", L.with_views("dense") + f"""
SELECT volume_id, z, y, x, {s6('q', 'red')}, {s6('p', 'green')}, {s6('q * p / 1000', 'blue')} FROM dense""")
def p4(spark, sf):
    c = G.colour_pixels(channels(spark, sf))
    return c.select(*PX, *[r6(F.col("rgb")[i], n) for i, n in enumerate(("red", "green", "blue"))])


def rgb(spark, sf):
    d = L.dense(spark, sf)
    return d.select(*PX, (F.col("q") % 256).alias("r"), (F.floor(F.col("p") / 100) % 256).cast("double").alias("g"), ((F.col("q") * 3) % 256).alias("b"))


RGB_SQL = "rgb AS (SELECT volume_id, z, y, x, q % 256 AS r, floor(p / 100) % 256 AS g, (q * 3) % 256 AS b FROM dense)"


def stain_sql(expr):
    return L.with_views("dense", extra=RGB_SQL + f", ch AS (SELECT volume_id, z, y, x, {expr} AS v FROM rgb)") + f"""
SELECT c.volume_id, c.z, c.y, c.x, round(least(greatest((v - lo) / greatest(hi - lo, 1e-6), 0), 1), 9) AS value
FROM ch c JOIN (SELECT volume_id, z, quantile_cont(v, 0.01) lo, quantile_cont(v, 0.995) hi FROM ch GROUP BY 1, 2) s USING (volume_id, z)"""


STAIN_SQL = {
    "green": "1 - g / 255",
    "gray": "1 - (r + g + b) / 255 / 3",
    "od": "-(ln(greatest(r / 255, 1.0 / 255)) + ln(greatest(g / 255, 1.0 / 255)) + ln(greatest(b / 255, 1.0 / 255))) / 3",
}


def _stain(kind):
    @query(f"p5_stain_{kind}", stain_sql(STAIN_SQL[kind]))
    def run(spark, sf):
        return G.stain_channel(rgb(spark, sf), kind).select(*PX, F.round("value", 9).alias("value"))


for _kind in STAIN_SQL:
    _stain(_kind)


def _hema_sql():
    import numpy as np
    inv = np.linalg.inv(np.array(G.STAINS))[:, 0]
    return stain_sql("greatest(" + " + ".join(f"ln(greatest({c} / 255, 1e-6)) / ln(1e-6) * ({float(k)!r})" for c, k in zip("rgb", inv)) + ", 0)")


@query("p5_stain_hema", _hema_sql())
def p5_hema(spark, sf):
    return G.stain_channel(rgb(spark, sf), "hema").select(*PX, F.round("value", 9).alias("value"))


@query("p6_stain_mask", L.with_views("dense") + """
SELECT d.volume_id, d.z, y, x FROM dense d JOIN (SELECT volume_id, z, quantile_cont(p, 0.85) cut FROM dense GROUP BY 1, 2) s USING (volume_id, z) WHERE p > cut""")
def p6(spark, sf):
    return G.above_quantile(L.plane(spark, sf, "p")).select(*PX)


@query("quantiles_exact", L.with_views("lattice") + f"""
SELECT volume_id, {s6('quantile_cont(p, 0.1)', 'p10')}, {s6('quantile_cont(p, 0.5)', 'p50')}, {s6('quantile_cont(p, 0.975)', 'p975')} FROM lattice GROUP BY 1""")
def quantiles(spark, sf):
    q = group_quantiles(L.lattice(spark, sf), ["volume_id"], "p", {"p10": 0.1, "p50": 0.5, "p975": 0.975})
    return q.select("volume_id", *[r6(F.col(c), c) for c in ("p10", "p50", "p975")])


def resize_sql(n_in, n_out, src, out, val, part):
    """One axis of a linear resize with half-pixel centres."""
    s = f"greatest((o.o + 0.5) * {n_in} / {n_out} - 0.5, 0)"
    return f"""SELECT {part}, CAST(o.o AS INTEGER) AS {out}, a.{val} * (1 - ({s} - least(floor({s}), {n_in} - 1))) + b.{val} * ({s} - least(floor({s}), {n_in} - 1)) AS {val}
 FROM {{src}} a CROSS JOIN range({n_out}) o(o) JOIN {{src}} b ON {{same}} AND b.{src} = least(least(floor({s}), {n_in} - 1) + 1, {n_in} - 1)
 WHERE a.{src} = least(floor({s}), {n_in} - 1)"""


def upsample_sql(extra_first, hg, wg, ho, wo):
    """Two-axis resize of cells(volume_id, z, gy, gx, v)."""
    row = resize_sql(wg, wo, "gx", "x", "v", "a.volume_id, a.z, a.gy").format(src="cells", same="b.volume_id = a.volume_id AND b.z = a.z AND b.gy = a.gy")
    col = resize_sql(hg, ho, "gy", "y", "v", "a.volume_id, a.z, a.x").format(src="rows_", same="b.volume_id = a.volume_id AND b.z = a.z AND b.x = a.x")
    return f"{extra_first}, rows_ AS ({row}), up AS ({col})"


POOL = """cells AS (SELECT volume_id, z, y // 4 AS gy, x // 4 AS gx, avg(q) AS v FROM dense GROUP BY 1, 2, 3, 4)"""


@query("g1_bilinear_resize", L.with_views("dense", extra=upsample_sql(POOL, 10, 12, 25, 30)) + f"SELECT volume_id, z, y, x, {s6('v', 'value')} FROM up")
def g1(spark, sf):
    cells = G.block_mean(L.plane(spark, sf), N, H, W, 1, 4).withColumnsRenamed({"y": "gy", "x": "gx"})
    up = G.upsample(cells, (10, 12), (25, 30))
    return up.select(*PX, r6(F.col("value"), "value"))


REF = "CASE WHEN {i} < 0 THEN -{i} - 1 WHEN {i} >= {n} THEN 2 * {n} - 1 - {i} ELSE {i} END"


@query("g2_subpixel_shift", L.with_views("dense") + f"""
SELECT a.volume_id, a.z, a.y, a.x, {s6("0.25 * (0.7 * a.q + 0.3 * b.q) + 0.75 * (0.7 * c.q + 0.3 * d.q)", "value")}
FROM (SELECT volume_id, z, yy AS y, xx AS x, q, yy, xx FROM (SELECT volume_id, z, y AS yy, x AS xx FROM dense) t JOIN dense s USING (volume_id, z)
 WHERE s.y = {REF.format(i='(yy - 2)', n=40)} AND s.x = {REF.format(i='(xx + 1)', n=48)}) a
JOIN dense b ON b.volume_id = a.volume_id AND b.z = a.z AND b.y = {REF.format(i='(a.y - 2)', n=40)} AND b.x = {REF.format(i='(a.x + 2)', n=48)}
JOIN dense c ON c.volume_id = a.volume_id AND c.z = a.z AND c.y = {REF.format(i='(a.y - 1)', n=40)} AND c.x = {REF.format(i='(a.x + 1)', n=48)}
JOIN dense d ON d.volume_id = a.volume_id AND d.z = a.z AND d.y = {REF.format(i='(a.y - 1)', n=40)} AND d.x = {REF.format(i='(a.x + 2)', n=48)}""")
def g2(spark, sf):
    return G.shift_plane(L.plane(spark, sf), -1.25, 1.3, H, W).select(*PX, r6(F.col("value"), "value"))


def box_sql(cols, r, src, out):
    """Box mean with repeated edge samples as two joins on coordinate offsets."""
    a = ", ".join(f"avg(s.{c}) AS {c}" for c in cols)
    return f"""{out}_x AS (SELECT t.volume_id, t.z, t.y, t.x, {a} FROM (SELECT volume_id, z, y, x FROM {src}) t CROSS JOIN range({-r}, {r + 1}) o(o)
 JOIN {src} s ON s.volume_id = t.volume_id AND s.z = t.z AND s.y = t.y AND s.x = {REF.format(i='(t.x + o.o)', n=48)} GROUP BY 1, 2, 3, 4),
{out} AS (SELECT t.volume_id, t.z, t.y, t.x, {a} FROM (SELECT volume_id, z, y, x FROM {src}) t CROSS JOIN range({-r}, {r + 1}) o(o)
 JOIN {out}_x s ON s.volume_id = t.volume_id AND s.z = t.z AND s.x = t.x AND s.y = {REF.format(i='(t.y + o.o)', n=40)} GROUP BY 1, 2, 3, 4)"""


@query("g4_box_mean", L.with_views("dense", extra=box_sql(["q"], 2, "dense", "box")) + f"SELECT volume_id, z, y, x, {s6('q', 'value')} FROM box")
def g4(spark, sf):
    return G.box_mean(L.plane(spark, sf), 2, H, W).select(*PX, r6(F.col("value"), "value"))


@query("g5_guided_filter", L.with_views("dense", extra="src AS (SELECT volume_id, z, y, x, p / 100000 AS i, q / 100 AS p, p / 100000 * q / 100 AS ip, p / 100000 * p / 100000 AS ii FROM dense), "
       + box_sql(["i", "p", "ip", "ii"], 2, "src", "m") + ", ab AS (SELECT volume_id, z, y, x, (ip - i * p) / (ii - i * i + 0.01) AS a, p - (ip - i * p) / (ii - i * i + 0.01) * i AS b FROM m), "
       + box_sql(["a", "b"], 2, "ab", "mm")) + f"SELECT volume_id, z, y, x, {s6('mm.a * src.i + mm.b', 'value')} FROM mm JOIN src USING (volume_id, z, y, x)")
def g5(spark, sf):
    d = L.dense(spark, sf).select(*PX, (F.col("q") / 100).alias("value"), (F.col("p") / 100000).alias("guide"))
    return G.guided_filter(d, 2, 0.01, H, W).select(*PX, r6(F.col("value"), "value"))


def kernel_sql(sigma):
    k = G.gaussian_kernel(sigma)
    r = len(k) // 2
    return "(VALUES " + ", ".join(f"({i - r}, CAST({v!r} AS DOUBLE))" for i, v in enumerate(k)) + ") k(o, w)"


@query("g7_gaussian_blur", L.with_views("dense", extra=f"""gx AS (SELECT t.volume_id, t.z, t.y, t.x, sum(s.q * k.w) AS q FROM dense t CROSS JOIN {kernel_sql(1.0)}
 JOIN dense s ON s.volume_id = t.volume_id AND s.z = t.z AND s.y = t.y AND s.x = {REF.format(i='(t.x + k.o)', n=48)} GROUP BY 1, 2, 3, 4),
 gb AS (SELECT t.volume_id, t.z, t.y, t.x, sum(s.q * k.w) AS q FROM dense t CROSS JOIN {kernel_sql(1.5)}
 JOIN gx s ON s.volume_id = t.volume_id AND s.z = t.z AND s.x = t.x AND s.y = {REF.format(i='(t.y + k.o)', n=40)} GROUP BY 1, 2, 3, 4)""")
       + f"SELECT volume_id, z, y, x, {s6('q', 'value')} FROM gb")
def g7(spark, sf):
    return G.gaussian_blur(L.plane(spark, sf), (1.5, 1.0), H, W).select(*PX, r6(F.col("value"), "value"))


@query("g8_smooth_through_stack", L.with_views("dense") + f"""
SELECT t.volume_id, t.z, t.y, t.x, {s6('sum(s.q * k.w)', 'value')} FROM dense t CROSS JOIN {kernel_sql(1.0)}
JOIN dense s ON s.volume_id = t.volume_id AND s.y = t.y AND s.x = t.x
 AND s.z = CASE WHEN t.z + k.o < 0 THEN -(t.z + k.o) WHEN t.z + k.o > 6 THEN 12 - (t.z + k.o) ELSE t.z + k.o END GROUP BY 1, 2, 3, 4""")
def g8(spark, sf):
    return G.smooth_z(L.plane(spark, sf), 1.0, N).select(*PX, r6(F.col("value"), "value"))


@query("g9_block_reduce", L.with_views("dense") + """
SELECT volume_id, z // 2 AS z, y // 4 AS y, x // 4 AS x, avg(CASE WHEN q >= 30 THEN 1.0 ELSE 0.0 END) >= 0.25 AS inside
FROM dense WHERE z < 6 GROUP BY 1, 2, 3, 4""")
def g9(spark, sf):
    m = L.plane(spark, sf).withColumn("value", (F.col("value") >= 30).cast("double"))
    return G.block_mean(m, N, H, W, 2, 4).select(*PX, (F.col("value") >= 0.25).alias("inside"))


def _bins(b, n, k, a):
    return f"floor({b}.b * {n}.0 / {k}) <= d.{a} AND d.{a} < ceil(({b}.b + 1) * {n}.0 / {k})"


@query("g10_adaptive_pool", L.with_views("dense") + f"""
SELECT volume_id, z, CAST(u.b AS INTEGER) AS gy, CAST(v.b AS INTEGER) AS gx, {s6('avg(CASE WHEN q >= 30 THEN 1.0 ELSE 0.0 END)', 'share')}
FROM dense d JOIN range(7) u(b) ON {_bins('u', 40, 7, 'y')} JOIN range(9) v(b) ON {_bins('v', 48, 9, 'x')} GROUP BY 1, 2, 3, 4""")
def g10(spark, sf):
    m = L.plane(spark, sf).withColumn("value", (F.col("value") >= 30).cast("double"))
    return G.adaptive_pool(m, (H, W), (7, 9)).select("volume_id", "z", "gy", "gx", r6(F.col("value"), "share"))


@query("g11_class_shares", L.with_views("dense") + f"""
SELECT volume_id, z, CAST(u.b AS INTEGER) AS gy, CAST(v.b AS INTEGER) AS gx, CAST(c.c AS INTEGER) AS label,
 {s6('avg(CASE WHEN (CASE WHEN q >= 30 THEN 2 WHEN q > 0 THEN 1 ELSE 0 END) = c.c THEN 1.0 ELSE 0.0 END)', 'share')}
FROM dense d JOIN range(7) u(b) ON {_bins('u', 40, 7, 'y')} JOIN range(9) v(b) ON {_bins('v', 48, 9, 'x')} CROSS JOIN range(3) c(c) GROUP BY 1, 2, 3, 4, 5""")
def g11(spark, sf):
    m = L.plane(spark, sf).withColumn("label", F.when(F.col("value") >= 30, 2).when(F.col("value") > 0, 1).otherwise(0))
    return G.class_shares(m, (H, W), (7, 9), 3).select("volume_id", "z", "gy", "gx", "label", r6(F.col("share"), "share"))


@query("g12_nearest_label_resize", L.with_views("dense") + """
SELECT d.volume_id, d.z, CAST(a.o AS INTEGER) AS y, CAST(b.o AS INTEGER) AS x, CAST(CASE WHEN q >= 30 THEN 2 WHEN q > 0 THEN 1 ELSE 0 END AS INTEGER) AS label
FROM dense d JOIN range(27) a(o) ON d.y = CAST(floor((a.o + 0.5) * 40 / 27) AS INTEGER) JOIN range(61) b(o) ON d.x = CAST(floor((b.o + 0.5) * 48 / 61) AS INTEGER)""")
def g12(spark, sf):
    m = L.plane(spark, sf).select(*PX, F.when(F.col("value") >= 30, 2).when(F.col("value") > 0, 1).otherwise(0).alias("label"))
    return G.nearest_resize(m, (H, W), (27, 61))


@query("g13_strided", L.with_views("pred") + "SELECT volume_id, z, y // 3 AS y, x // 3 AS x FROM pred WHERE y % 3 = 0 AND x % 3 = 0")
def g13(spark, sf):
    return G.strided(L.predicted(spark, sf), 3)


@query("g18_edge_xor", L.with_views("dense", extra="m AS (SELECT volume_id, z, y, x, CAST(q >= 30 AS INTEGER) AS v FROM dense)") + """
SELECT a.volume_id, a.z, a.y, a.x FROM m a JOIN m u ON u.volume_id = a.volume_id AND u.z = a.z AND u.x = a.x AND u.y = (a.y + 39) % 40
JOIN m l ON l.volume_id = a.volume_id AND l.z = a.z AND l.y = a.y AND l.x = (a.x + 47) % 48 WHERE a.v <> u.v OR a.v <> l.v""")
def g18(spark, sf):
    m = L.plane(spark, sf).withColumn("value", (F.col("value") >= 30).cast("int"))
    return G.edge_xor(m, H, W).select(*PX)


def _stat_sql():
    """The same 14 statistics through lead windows and grouped averages, patches of 8 x 8."""
    mean = lambda k: f"""(SELECT avg(b.f0) FROM cells b WHERE b.volume_id = a.volume_id AND b.z = a.z AND abs(b.gy - a.gy) <= {k} AND abs(b.gx - a.gx) <= {k})"""
    names = [f"f{i}" for i in range(14)]
    return L.with_views("dense", extra=f"""
g0 AS (SELECT *, coalesce(lead(q) OVER (PARTITION BY volume_id, z, y ORDER BY x) - q, 0) AS gx_, coalesce(lead(q) OVER (PARTITION BY volume_id, z, x ORDER BY y) - q, 0) AS gy_,
 avg(q) OVER (PARTITION BY volume_id, z) AS lev FROM dense),
g AS (SELECT *, sqrt(gx_ * gx_ + gy_ * gy_) AS g FROM g0),
cells AS (SELECT volume_id, z, y // 8 AS gy, x // 8 AS gx, avg(q) f0, sqrt(greatest(avg(q * q) - avg(q) * avg(q), 0)) f1, max(q) f2, min(q) f3,
 avg(g) f4, sqrt(greatest(avg(g * g) - avg(g) * avg(g), 0)) f5, max(g) f6, min(g) f7, 0.5 AS f12, avg(CASE WHEN q > lev THEN 1.0 ELSE 0.0 END) f13 FROM g GROUP BY 1, 2, 3, 4),
c2 AS (SELECT a.*, {mean(1)} AS f8, {mean(3)} AS f10 FROM cells a),
c3 AS (SELECT *, f0 - f8 AS f9, f0 - f10 AS f11 FROM c2)""") + "SELECT volume_id, z, gy, gx, " + ", ".join(
        f"round(({n} - avg({n}) OVER w) / (stddev_samp({n}) OVER w + 1e-6), 5) + 0.0 AS {n}" for n in names) + " FROM c3 WINDOW w AS (PARTITION BY volume_id, z)"


@query("g20_patch_statistics", _stat_sql())
def g20(spark, sf):
    s = G.patch_statistics(L.plane(spark, sf), 8)
    return s.select("volume_id", "z", "gy", "gx", *[F.round(f"f{i}", 5).alias(f"f{i}") for i in range(14)])


@query("g20_patch_vectors")
def g20_vectors(spark, sf):
    return G.patch_vectors(L.plane(spark, sf), 8)


@query("g3_interleaved_patch_vectors")
def g3(spark, sf):
    return G.interleaved_vectors(L.plane(spark, sf), 2, 8, H, W)


@query("g6_context_features", L.with_views("patches") + f"""
SELECT a.volume_id, a.z, a.gy, a.gx, {s6('a.vec[1]', 'own')}, {s6('avg(b.vec[1])', 'near1')}, {s6('avg(b.vec[64])', 'near64')}, CAST(128 AS INTEGER) AS n
FROM patches a JOIN patches b ON a.volume_id = b.volume_id AND a.z = b.z AND abs(a.gy - b.gy) <= 2 AND abs(a.gx - b.gx) <= 2 GROUP BY 1, 2, 3, 4, a.vec[1]""")
def g6(spark, sf):
    v = G.context_mean(L.patch_vectors(spark, sf), 64, 5)
    return v.select("volume_id", "z", "gy", "gx", r6(F.col("vec")[0], "own"), r6(F.col("vec")[64], "near1"), r6(F.col("vec")[127], "near64"), F.size("vec").alias("n"))


@query("g21_l2_normalise", L.with_views("patches") + f"""
SELECT vec_id, {s6('2 * vec[1] / sqrt(list_dot_product(vec, vec)) / 2', 'first')}, CAST(1 AS DOUBLE) AS length FROM patches""")
def g21(spark, sf):
    from ..functions.vectors import l2_normalize, norm
    v = L.patch_vectors(spark, sf).withColumn("vec", l2_normalize(F.transform("vec", lambda e: e * 2)))
    return v.select("vec_id", r6(F.col("vec")[0], "first"), r6(norm(F.col("vec")), "length"))


@query("g22_z_context", L.with_views("patches") + f"""
SELECT a.volume_id, a.z, a.gy, a.gx, {s6('a.vec[1]', 'own')}, CAST(128 AS INTEGER) AS n,
 {s6('((b.vec[1] + c.vec[1]) / 2) / sqrt((list_dot_product(b.vec, b.vec) + list_dot_product(c.vec, c.vec) + 2 * list_dot_product(b.vec, c.vec)) / 4)', 'near')}
FROM patches a JOIN patches b ON b.volume_id = a.volume_id AND b.gy = a.gy AND b.gx = a.gx AND b.z = greatest(a.z - 2, 0)
JOIN patches c ON c.volume_id = a.volume_id AND c.gy = a.gy AND c.gx = a.gx AND c.z = least(a.z + 2, 4)""")
def g22(spark, sf):
    v = G.z_context(L.patch_vectors(spark, sf), 2, 5)
    return v.select("volume_id", "z", "gy", "gx", r6(F.col("vec")[0], "own"), F.size("vec").alias("n"), r6(F.col("vec")[64], "near"))


@query("g23_pixel_features")
def g23(spark, sf):
    return G.pixel_features(L.plane(spark, sf), H, W, (1.0, 2.0))
