"""Queries for settings, names, polygons, files and catalogue tables."""
from pyspark.sql import functions as F

from ..operators import polygons as G
from ..operators import settings as S
from ..operators import stats as T
from ..session import ensure_checkpoint_dir
from ..sources import catalog as K
from ..sources import files as X
from ..sources import lattice as L
from .grid_queries import PX, r6, s6
from .measure_queries import EV, evals
from .registry import query

SL = ["volume_id", "z"]


def orders(spark, sf):
    return L.table(spark, sf, "orders")


@query("p7_channel_spec", "SELECT o_orderkey AS id, 'f' || o_custkey || '.ims' AS path, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 7 AS INTEGER) ELSE 2 END AS channel FROM orders")
def p7(spark, sf):
    spec = F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(".ims"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(":"), (F.col("o_custkey") % 7).cast("string"))).otherwise(""))
    path, channel = S.split_channel(F.col("spec"), 2)
    return orders(spark, sf).withColumn("spec", spec).select(F.col("o_orderkey").alias("id"), path.alias("path"), channel.alias("channel"))


def volume_table(spark, sf):
    """Customers as volumes: nation modulo 4 channels, every fifth with a default, every third with a colour channel."""
    k = F.col("c_custkey")
    return L.table(spark, sf, "customer").select(k.alias("volume_id"), (F.col("c_nationkey") % 4 + 1).alias("n_channels"), F.when(k % 5 == 0, F.lit(1)).alias("default_channel"),
                                                 F.when(k % 3 == 0, F.col("c_nationkey") % 4 + 1).alias("rgb_channel"), (F.col("c_nationkey") + 1).alias("n_z"))


VT = "vt AS (SELECT c_custkey AS volume_id, c_nationkey % 4 + 1 AS n_channels, CASE WHEN c_custkey % 5 = 0 THEN 1 END AS dflt, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey % 4 + 1 END AS rgb, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 6 AS INTEGER) END AS req, c_nationkey + 1 AS n_z FROM customer)"
GIVEN = "coalesce(req, dflt, rgb, CASE WHEN n_channels = 1 THEN 0 END)"
PICK = f"(CASE WHEN {GIVEN} BETWEEN 0 AND n_channels + (rgb IS NOT NULL)::INTEGER - 1 THEN {GIVEN} END)"


@query("p8_channel_fallback", f"WITH {VT} SELECT volume_id, CAST({PICK} AS INTEGER) AS channel FROM vt")
def p8(spark, sf):
    return a29(spark, sf).select("volume_id", "channel")


@query("a29_batch_over_catalogue", f"WITH {VT} SELECT volume_id, CAST({PICK} AS INTEGER) AS channel, CASE WHEN {PICK} IS NULL AND req IS NOT NULL THEN 'skipped: no channel ' || req WHEN {PICK} IS NULL THEN 'skipped: no channel chosen' ELSE 'queued' END AS status FROM vt")
def a29(spark, sf):
    v = volume_table(spark, sf)
    return K.batch_plan(v, v.where("volume_id % 2 = 0").select("volume_id", (F.col("volume_id") % 6).cast("int").alias("channel")))


P9_TEXTS = {   # Setting -> its text for an order, as Spark column and as SQL
    "top_percent": "CASE WHEN o_orderkey % 4 = 0 THEN 'many' WHEN o_orderkey % 4 = 1 THEN 'NaN' ELSE CAST(o_custkey % 130 AS STRING) END",
    "threshold_position": "CASE WHEN o_orderkey % 5 = 0 THEN '-1' WHEN o_orderkey % 5 = 1 THEN '-0.5' ELSE '0.5' END",
    "vit_size": "CASE WHEN o_orderkey % 3 = 0 THEN '14.5' WHEN o_orderkey % 3 = 1 THEN '28.0' ELSE '7' END",
    "threshold_mode": "CASE WHEN o_orderkey % 7 = 0 THEN 'otsu' WHEN o_orderkey % 7 = 1 THEN 'auto' ELSE 'manual' END",
    "suggest_missed": "CASE WHEN o_orderkey % 6 = 0 THEN 'TRUE' WHEN o_orderkey % 6 = 1 THEN 'yes' ELSE '0' END",
    "clip_low": "CASE WHEN o_orderkey % 11 = 0 THEN '99.9' ELSE '2' END",
    "neg_weight": "CASE WHEN o_orderkey % 13 = 0 THEN '7' WHEN o_orderkey % 13 = 1 THEN '11' END",
}


@query("p9_settings_coercion", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN 10.0 ELSE o_custkey % 130 END::DOUBLE AS top_percent, CASE WHEN o_orderkey % 5 = 0 THEN -1.0 WHEN o_orderkey % 5 = 1 THEN -0.5 ELSE 0.5 END::DOUBLE AS position,
 CASE WHEN o_orderkey % 3 = 0 THEN 980 WHEN o_orderkey % 3 = 1 THEN 28 ELSE 7 END::INTEGER AS vit_size, CASE WHEN o_orderkey % 7 = 0 THEN 'clicks' WHEN o_orderkey % 7 = 1 THEN 'auto' ELSE 'manual' END AS mode,
 o_orderkey % 6 = 0 AS suggest_missed, CASE WHEN o_orderkey % 13 = 0 THEN 7 WHEN o_orderkey % 13 = 1 THEN 11 ELSE 0.8 END::DOUBLE AS neg_weight, 0.01::DOUBLE AS guided_eps, 2 AS shift_passes,
 ((o_orderkey % 4 < 2)::INTEGER + (o_orderkey % 4 >= 2 AND o_custkey % 130 NOT BETWEEN 1 AND 100)::INTEGER + (o_orderkey % 5 = 1)::INTEGER + (o_orderkey % 3 <> 1)::INTEGER
  + (o_orderkey % 7 = 1)::INTEGER + (o_orderkey % 6 = 1)::INTEGER + (o_orderkey % 11 = 0)::INTEGER + (o_orderkey % 13 = 1)::INTEGER)::INTEGER AS n_problems FROM orders""")
def p9(spark, sf):
    raw = F.create_map(F.lit("unknown"), F.lit("1"), *[x for name, text in P9_TEXTS.items() for x in (F.lit(name), F.expr(text))])
    s, problems = S.coerce_settings(F.col("raw"))
    return orders(spark, sf).withColumn("raw", raw).select(F.col("o_orderkey").alias("id"), s.alias("s"), F.size(problems).alias("n_problems")).select(
        "id", "s.top_percent", F.col("s.threshold_position").alias("position"), "s.vit_size", F.col("s.threshold_mode").alias("mode"), "s.suggest_missed", "s.neg_weight", "s.guided_eps", "s.shift_passes", "n_problems")


def diamonds(spark, sf):
    """A diamond outline around every order-heavy cell, corners normalised to the image."""
    c = L.lattice(spark, sf).where("q >= 80")
    pt = lambda dx, dy: F.struct(((F.col("x") + dx) / 48).alias("x"), ((F.col("y") + dy) / 40).alias("y"))
    return c.select(*SL, (F.col("y") * 48 + F.col("x")).alias("polygon_id"), (F.col("q") % 2).cast("int").alias("cls"), F.array(pt(-2.5, 0), pt(0, -2.5), pt(2.5, 0), pt(0, 2.5)).alias("corners"))


def pixel_polygons(spark, sf):
    half = F.when(F.col("q") % 3 == 0, 3.5).otherwise(2.5)
    pt = lambda sx, sy: F.struct((F.col("x") + sx * half).alias("x"), (F.col("y") + sy * half).alias("y"))
    return L.lattice(spark, sf).where("q >= 80").select(*SL, (F.col("y") * 48 + F.col("x")).alias("polygon_id"), F.array(pt(-1, 0), pt(0, -1), pt(1, 0), pt(0, 1)).alias("poly"))


@query("a18_polygon_labels_from_text", L.with_views("lattice") + f"""SELECT volume_id, z, count(*) AS n_polygons, {s6('sum((x - 2.5) / 48 + y / 40.0)', 'corner_sum')} FROM lattice WHERE q >= 80 AND q % 2 = 0 GROUP BY 1, 2""")
def a18(spark, sf):
    line = F.concat_ws(" ", F.col("cls").cast("string"), F.array_join(F.transform("corners", lambda c: F.concat_ws(" ", c["x"].cast("string"), c["y"].cast("string"))), " "))
    text = diamonds(spark, sf).groupBy(*SL).agg(F.concat_ws("\n", F.collect_list(line)).alias("text"))
    polys = text.select(*SL, F.explode(G.parse_polygons(F.col("text"))).alias("p"))
    return polys.groupBy(*SL).agg(F.count("*").alias("n_polygons"), r6(F.sum(F.col("p")[0]["x"] + F.col("p")[0]["y"]), "corner_sum"))


DIAMOND = """dm AS (SELECT volume_id, z, y AS cy, x AS cx, CASE WHEN q % 3 = 0 THEN 3.5 ELSE 2.5 END AS r FROM lattice WHERE q >= 80),
hit AS (SELECT d.volume_id, d.z, d.y, d.x, cy * 48 + cx AS polygon_id, r FROM dense d JOIN dm ON dm.volume_id = d.volume_id AND dm.z = d.z AND abs(d.y - cy) + abs(d.x - cx) < r)"""


@query("a19_rasterise_polygons", L.with_views("dense", extra=DIAMOND) + "SELECT volume_id, z, y, x, polygon_id FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, z, y, x ORDER BY r, polygon_id) AS k FROM hit) WHERE k = 1")
def a19(spark, sf):
    return G.rasterise(pixel_polygons(spark, sf), F.lit(L.HEIGHT), F.lit(L.WIDTH)).select(*PX, "polygon_id")


@query("p10_region_mask", L.with_views("dense", extra=DIAMOND) + "SELECT DISTINCT volume_id, z, y, x FROM hit")
def p10(spark, sf):
    return G.region_mask(pixel_polygons(spark, sf), F.lit(L.HEIGHT), F.lit(L.WIDTH), SL, "poly").select(*PX)


@query("j8_pixels_in_polygons", L.with_views("dense", extra=DIAMOND) + "SELECT volume_id, z, polygon_id, count(*) AS n_px FROM hit GROUP BY 1, 2, 3")
def j8(spark, sf):
    return G.polygon_rows(pixel_polygons(spark, sf), F.lit(L.HEIGHT), F.lit(L.WIDTH)).groupBy(*SL, "polygon_id").agg(F.count("*").alias("n_px"))


@query("p12_bounds_checks", f"WITH {VT} SELECT o_orderkey AS id, CAST((CASE WHEN o_orderkey % 5 >= n_channels THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 20 >= n_z THEN 1 ELSE 0 END) + (CASE WHEN n_z IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS n_errors FROM orders LEFT JOIN vt ON o_custkey = volume_id")
def p12(spark, sf):
    req = orders(spark, sf).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("volume_id"), (F.col("o_orderkey") % 5).alias("channel"), (F.col("o_orderkey") % 20).alias("z"))
    return S.bounds_errors(req, volume_table(spark, sf)).select("id", F.size("errors").alias("n_errors"))


@query("p13_non_finite_to_null", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN NULL ELSE s_acctbal END AS v FROM supplier")
def p13(spark, sf):
    k = F.col("s_suppkey") % 3
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("s_acctbal"))
    return T.nulls_for_non_finite(L.table(spark, sf, "supplier").select("s_suppkey", v.alias("v")))


@query("p14_slugs", r"""SELECT page_id, CASE WHEN s = '' THEN 'profile' ELSE s END AS slug, CASE WHEN t = '' THEN 'profile' ELSE t END AS text_slug FROM (
 SELECT page_id, substr(trim(regexp_replace(lower(url), '[^\p{L}\p{N}]', '-', 'g'), '-'), 1, 40) AS s, substr(trim(regexp_replace(lower(substr(text, 1, 60)), '[^\p{L}\p{N}]', '-', 'g'), '-'), 1, 40) AS t
 FROM pages JOIN documents ON doc_id = page_id)""")
def p14(spark, sf):
    texts = L.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.substring("text", 1, 60).alias("name"))   # Names in several alphabets
    return L.table(spark, sf, "pages").join(texts, "page_id").select("page_id", S.slug(F.col("url")).alias("slug"), S.slug(F.col("name")).alias("text_slug"))


@query("p15_item_seed", "SELECT o_orderkey AS id, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) AS seed FROM (SELECT o_orderkey, sha256('s' || o_custkey || '_' || o_orderkey || '_blur_2') AS h FROM orders)")
def p15(spark, sf):
    return orders(spark, sf).select(F.col("o_orderkey").alias("id"), S.item_seed(F.concat(F.lit("s"), "o_custkey"), F.col("o_orderkey").cast("string"), F.lit("blur"), F.lit("2")).alias("seed"))


@query("p16_model_input_size", "SELECT p_partkey AS id, CAST(greatest(14, round_even(h * (980.0::DOUBLE / greatest(h, w)) / 14, 0) * 14) AS INTEGER) AS in_h, CAST(greatest(14, round_even(w * (980.0::DOUBLE / greatest(h, w)) / 14, 0) * 14) AS INTEGER) AS in_w FROM (SELECT p_partkey, p_size * 60 AS h, (p_partkey % 50 + 1) * 60 AS w FROM part)")
def p16(spark, sf):
    h, w = S.model_input_size(F.col("p_size") * 60, ((F.col("p_partkey") % 50 + 1) * 60).cast("int"), 980, 14)
    return L.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), h.alias("in_h"), w.alias("in_w"))


@query("p17_downsample_factor", "SELECT p_partkey AS id, CAST(greatest(1, ceil(sqrt(p_size::DOUBLE * 3000 * (p_partkey % 50 + 1) * 60 / 2e8))) AS INTEGER) AS factor FROM part")
def p17(spark, sf):
    return L.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.downsample_factor(F.col("p_size"), F.lit(3000), (F.col("p_partkey") % 50 + 1) * 60).alias("factor"))


@query("p18_z_context_distance", "SELECT id, CASE WHEN n_z >= 2 * d + 1 THEN d ELSE 0 END AS d FROM (SELECT p_partkey AS id, p_size AS n_z, CAST(greatest(1, least(3, round_even(4.0::DOUBLE / (p_partkey % 9 * 0.5 + 0.5), 0))) AS INTEGER) AS d FROM part)")
def p18(spark, sf):
    return L.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.z_context_slices(F.col("p_partkey") % 9 * 0.5 + 0.5, F.col("p_size")).alias("d"))


@query("p19_normalise_annotations", """SELECT o_custkey AS id, CAST(count(*) FILTER (o_orderkey % 3 = 0) AS INTEGER) AS n_pos, CAST(count(*) FILTER (o_orderkey % 3 = 1) AS INTEGER) AS n_neg,
 CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN round_even(o_orderkey / 4.0, 0) ELSE 0 END) AS BIGINT) AS y_sum, 2 AS n_extra, CAST(count(*) FILTER (o_orderkey % 5 = 0) AS INTEGER) AS n_first, 0 AS n_second,
 substr('name of structure ' || repeat(o_custkey::VARCHAR, 20), 1, 60) AS name, 'rgba(120, 130, 1' AS color
FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 3 < 2 OR o_orderkey % 5 = 0) > 0""")
def p19(spark, sf):
    pt = F.array((F.col("o_orderkey") / 4), F.lit(1.0))
    pick = lambda m, k: F.collect_list(F.when(F.col("o_orderkey") % m == k, pt))
    saves = orders(spark, sf).groupBy(F.col("o_custkey").alias("id")).agg(pick(3, 0).alias("pos"), pick(3, 1).alias("neg"), pick(5, 0).alias("_first"))
    name = F.concat(F.lit("name of structure "), F.repeat(F.col("id").cast("string"), 20))
    extra = lambda pos: F.struct(name.alias("name"), F.lit("rgba(120, 130, 140, 1)").alias("color"), pos.alias("pos"))
    saves = saves.withColumn("extra", F.array(extra(F.col("_first")), extra(F.array().cast("array<array<double>>")))).drop("_first")
    n = S.normalise_annotations(saves)
    return n.select("id", F.size("pos").alias("n_pos"), F.size("neg").alias("n_neg"), F.aggregate("pos", F.lit(0).cast("long"), lambda a, p: a + p[0]).alias("y_sum"), F.size("extra").alias("n_extra"),
                    F.size(F.col("extra")[0]["pos"]).alias("n_first"), F.size(F.col("extra")[1]["pos"]).alias("n_second"), F.col("extra")[0]["name"].alias("name"), F.col("extra")[1]["color"].alias("color"))


@query("p20_annotation_keys", "SELECT o_orderkey AS id, CAST(o_custkey % 4 AS INTEGER) AS channel, CAST(o_orderkey % 100 AS INTEGER) AS z, CAST(o_custkey % 4 AS INTEGER) AS file_channel, CAST(o_orderkey % 100 AS INTEGER) AS file_z FROM orders")
def p20(spark, sf):
    c, z = (F.col("o_custkey") % 4).cast("string"), (F.col("o_orderkey") % 100).cast("string")
    k, f = S.annotation_key(F.concat(c, F.lit(":"), z)), S.label_file(F.concat(F.lit("c"), c, F.lit("_z"), z, F.lit(".png")))
    return orders(spark, sf).select(F.col("o_orderkey").alias("id"), k[0].alias("channel"), k[1].alias("z"), f[0].alias("file_channel"), f[1].alias("file_z"))


@query("p21_condition_label", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'no input' WHEN o_orderstatus = 'O' THEN 'labels from ' || o_orderpriority ELSE o_orderpriority || ' clicks, ' || CASE WHEN o_custkey % 2 = 0 THEN 'noisy' ELSE 'clean' END END AS condition FROM orders")
def p21(spark, sf):
    return orders(spark, sf).select(F.col("o_orderkey").alias("id"), T.condition_label(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey") % 2 == 0, ["F"], ["O"]).alias("condition"))


@query("p22_compatible_models", "SELECT p_partkey AS model_id, p_size > 25 AS compatible FROM part")
def p22(spark, sf):
    m = L.table(spark, sf, "part").select(F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("volume_id"), (F.col("p_size") > 25).alias("large"), F.lit(1).alias("layer"))
    s = m.select("volume_id").distinct().select("volume_id", F.lit(True).alias("large"), F.lit(1).alias("layer"))
    return S.compatibility(m, s, ["large", "layer"]).select("model_id", "compatible")


@query("p25_crop_to_region", L.with_views("pred", extra="v AS (SELECT * FROM lattice WHERE p >= 20000 AND y BETWEEN 5 AND 30 AND x BETWEEN 7 AND 40), b AS (SELECT volume_id, z, min(y) y0, min(x) x0 FROM v GROUP BY 1, 2)") + "SELECT volume_id, z, y - y0 AS y, x - x0 AS x FROM pred JOIN v USING (volume_id, z, y, x) JOIN b USING (volume_id, z)")
def p25(spark, sf):
    valid = L.lattice(spark, sf).where("p >= 20000 AND y BETWEEN 5 AND 30 AND x BETWEEN 7 AND 40")
    return S.crop_to_region(L.predicted(spark, sf), valid, SL).select(*PX)


# ---------- files ----------

@query("a2_array_files_to_pixels", L.with_views("dense") + "SELECT volume_id || '/' || z || '.npy' AS path, 0 AS channel, 0 AS z, y, x, CAST(q AS FLOAT) AS value FROM dense")
def a2(spark, sf):
    return X.decode_arrays(X.encode_arrays(L.plane(spark, sf), SL, L.HEIGHT, L.WIDTH))[0]


@query("a3_dispatch_by_suffix", "SELECT url AS path, CASE WHEN page_id % 3 = 0 THEN 'image' WHEN page_id % 3 = 1 THEN 'array' END AS kind, CASE WHEN page_id % 3 = 2 THEN 'unsupported file type xyz' END AS error FROM pages")
def a3(spark, sf):
    p = L.table(spark, sf, "pages")
    ext = F.element_at(F.array(F.lit(".PNG"), F.lit(".npy"), F.lit(".xyz")), (F.col("page_id") % 3 + 1).cast("int"))
    return X.by_suffix(p.select(F.concat("url", ext).alias("path"), "url")).select(F.col("url").alias("path"), "kind", "error")


@query("a4_axis_reorder", "SELECT l_orderkey AS id, CAST(CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber ELSE 0 END AS INTEGER) AS channel, CAST(CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_linenumber END AS INTEGER) AS z, CAST(l_suppkey % 8 AS INTEGER) AS y, CAST(l_partkey % 9 AS INTEGER) AS x, l_quantity AS value FROM lineitem WHERE l_orderkey % 2 = 0 OR l_partkey % 2 = 0")
def a4(spark, sf):
    n, y, x = F.col("l_linenumber"), (F.col("l_suppkey") % 8).cast("int"), (F.col("l_partkey") % 9).cast("int")
    even = F.col("l_orderkey") % 2 == 0
    coords = F.when(even, F.array(x, n, y)).otherwise(F.array((F.col("l_partkey") % 2).cast("int"), n, y, x))
    cells = L.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), coords.alias("coords"), F.when(even, "XSY").otherwise("TIYX").alias("axes"), F.col("l_quantity").alias("value"))
    return X.to_czyx(cells).select("id", "channel", "z", "y", "x", "value")


@query("a5_volumes_from_pixels", L.with_views("lattice") + "SELECT volume_id, 1 AS n_channels, CAST(max(z) + 1 AS INTEGER) AS n_z, CAST(max(y) + 1 AS INTEGER) AS height, CAST(max(x) + 1 AS INTEGER) AS width FROM lattice GROUP BY 1")
def a5(spark, sf):
    return K.volumes_from_pixels(L.lattice(spark, sf).withColumn("channel", F.lit(0))).drop("channel_names")


@query("a6_read_plane", L.with_views("dense") + "SELECT y, x, q AS value FROM dense WHERE volume_id = 'v0' AND z = 3")
def a6(spark, sf):
    px = L.plane(spark, sf).withColumn("channel", F.lit(0))
    vol = L.volumes(spark, sf).withColumn("n_channels", F.lit(1))
    return K.read_plane(px, vol, "v0", 0, 3).select("y", "x", "value")


@query("a7_side_view", L.with_views("dense") + "SELECT volume_id, z, x, q AS value FROM dense WHERE y = 17")
def a7(spark, sf):
    return K.side_view(L.plane(spark, sf), 17)


@query("a8_catalogue_listing", "SELECT c_custkey AS volume_id, count(o_orderkey) AS n_channels FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a8(spark, sf):
    v = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("volume_id"), F.col("c_acctbal").alias("created"))
    c = orders(spark, sf).select(F.col("o_custkey").alias("volume_id"), F.col("o_orderkey").alias("channel"), F.col("o_orderpriority").alias("name"))
    return K.listing(v, c).select("volume_id", F.coalesce(F.size("channel_names"), F.lit(0)).cast("long").alias("n_channels"))


@query("a9_register_new_paths", "SELECT DISTINCT url AS path FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def a9(spark, sf):
    p = L.table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return K.register_new(p.where("page_id % 4 = 0"), p).select("path")


@query("a10_guess_reference_channel", "SELECT p_brand AS volume_id, min(p_partkey) AS reference_channel FROM part WHERE regexp_matches(lower(p_name), 'small|bolt') GROUP BY 1")
def a10(spark, sf):
    names = F.regexp_replace(F.regexp_replace("p_name", "small", "Segmented"), "bolt", "MASK")
    return K.guess_reference(L.table(spark, sf, "part").select(F.col("p_brand").alias("volume_id"), F.col("p_partkey").alias("channel"), names.alias("name")))


@query("a11_metadata_overrides", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 AND s_acctbal BETWEEN 0 AND 5000 THEN s_acctbal ELSE 1.0 END AS vz FROM supplier")
def a11(spark, sf):
    s = L.table(spark, sf, "supplier")
    rows, _ = K.apply_overrides(s.select("s_suppkey", F.lit(1.0).alias("vz")), s.where("s_suppkey % 2 = 0").select("s_suppkey", F.col("s_acctbal").alias("vz")), "s_suppkey", {"vz": (0.0, 5000.0)})
    return rows


@query("a12_cascade_delete", "SELECT o_custkey AS volume_id, o_orderkey AS run_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def a12(spark, sf):
    gone = L.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("volume_id"))
    return K.cascade_delete(gone, {"runs": orders(spark, sf).select(F.col("o_custkey").alias("volume_id"), F.col("o_orderkey").alias("run_id"))}, "volume_id")["runs"]


@query("a13_labelled_slices", L.with_views("dense", extra="sh AS (SELECT volume_id, z FROM dense GROUP BY 1, 2 HAVING avg((q >= 50)::INTEGER) > 0.005), i AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY z) - 1 AS i, count(*) OVER (PARTITION BY volume_id) AS n FROM sh)") + "SELECT volume_id, z FROM i WHERE i IN (SELECT CAST(round_even(j * (n - 1) / (least(3, n) - 1.0), 0) AS INTEGER) FROM range(3) t(j))")
def a13(spark, sf):
    share = L.plane(spark, sf).groupBy(*SL).agg(F.avg((F.col("value") >= 50).cast("double")).alias("share"))
    return K.evenly_filled_slices(share, L.volumes(spark, sf), 3).select(*SL)


def _round_trip(spark, df, part, fmt="parquet"):
    """Written to the shared folder and read back. A partition's rows meet first, or every task would write a file of its own
    into every partition; Spark splits a partition of very many rows again."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    w = df.hint("rebalance", *part).write.partitionBy(*part) if part else df.write
    w.format(fmt).option("header", "true").save(path)
    return spark.read.schema(df.schema).format(fmt).option("header", "true").load(path)


@query("a14_mask_table_sink", L.with_views("pred") + "SELECT volume_id, count(*) AS n_px FROM pred GROUP BY 1")
def a14(spark, sf):
    from ..operators import runs as R
    m = _round_trip(spark, R.encode_runs(L.predicted(spark, sf)), ["volume_id"])
    return R.area(m, ["volume_id"])


@query("a16_result_sinks", L.with_views("lattice", extra=EV) + f"SELECT sample, method, {s6('avg(dice)', 'dice')} FROM ev GROUP BY 1, 2")
def a16(spark, sf):
    s = _round_trip(spark, evals(spark, sf), [], "csv")
    j = _round_trip(spark, s.groupBy("sample", "method").agg(r6(F.avg("dice"), "dice")), [], "json")
    return j


@query("a17_project_export", L.with_views("pred", "ref") + "SELECT 'pred' AS \"table\", count(*) AS n_rows FROM pred WHERE volume_id = 'v0' UNION ALL SELECT 'ref', count(*) FROM ref WHERE volume_id = 'v0'")
def a17(spark, sf):
    import uuid
    return K.export_volume({"pred": L.predicted(spark, sf), "ref": L.reference(spark, sf)}, "v0", f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4().hex}")


def cells(spark, sf):
    """Line items as overlapping cell masks of class 20 or 40."""
    return L.table(spark, sf, "lineitem").select(F.expr("concat('v', cast(l_orderkey div 2500 as string))").alias("image"), F.expr("cast(l_suppkey % 40 as int)").alias("y"), F.expr("cast(l_partkey % 48 as int)").alias("x"),
                                                 F.col("l_linenumber").alias("cell"), F.when(F.col("l_quantity") > 30, 40).when(F.col("l_quantity") > 10, 20).otherwise(0).alias("code"))


@query("a20_recode_classes", "SELECT 'v' || (l_orderkey // 2500) AS image, CASE WHEN l_quantity > 30 THEN 2 WHEN l_quantity > 10 THEN 1 ELSE 0 END AS class, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a20(spark, sf):
    cls = F.when(F.col("code") == 40, 2).when(F.col("code") == 20, 1).otherwise(0)
    return cells(spark, sf).withColumn("class", cls).groupBy("image", "class").agg(F.count("*").alias("n"))


@query("a21_collapse_cell_stack", "SELECT 'v' || (l_orderkey // 2500) AS image, CAST(l_suppkey % 40 AS INTEGER) AS y, CAST(l_partkey % 48 AS INTEGER) AS x, max(l_linenumber) AS instance, max(CASE WHEN l_quantity > 30 THEN 2 ELSE 1 END) AS class FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2, 3")
def a21(spark, sf):
    c = cells(spark, sf).where("code > 0").withColumn("class", F.when(F.col("code") == 40, 2).otherwise(1))
    return K.collapse_cells(c, ["image"])


@query("a22_parse_run_folders", "SELECT o_orderkey AS id, 'm' || (o_custkey % 5) AS method, 'points' AS prompt, CAST(o_custkey % 3 AS INTEGER) AS seed, CAST(o_orderkey % 4 AS INTEGER) AS draw FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def a22(spark, sf):
    name = F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string"), F.lit("_points_s"), (F.col("o_custkey") % 3).cast("string"), F.lit("_d"), (F.col("o_orderkey") % 4).cast("string"))
    known = L.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    o = orders(spark, sf).join(known, "o_custkey")
    return o.select(F.col("o_orderkey").alias("id"), *[c.alias(n) for n, c in X.parse_run_folder(name).items()])


def results(spark, sf):
    return orders(spark, sf).select(F.col("o_custkey").alias("image"), F.col("o_orderstatus").alias("method"), F.col("o_totalprice").alias("value"))


@query("a23_replace_method_rows", "SELECT o_custkey AS image, o_orderstatus AS method, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT c_custkey, 'F', c_acctbal FROM customer")
def a23(spark, sf):
    new = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("image"), F.lit("F").alias("method"), F.col("c_acctbal").alias("value"))
    return K.replace_method(results(spark, sf), new, "F", ["image"])[0]


@query("a23_missing_predictions", "SELECT DISTINCT o_custkey AS image FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def a23_missing(spark, sf):
    new = L.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("image"), F.lit("F").alias("method"), F.col("c_acctbal").alias("value"))
    return K.replace_method(results(spark, sf), new, "F", ["image"])[1]


@query("a24_relabel_consecutively", "SELECT o_orderkey AS id, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS INTEGER) AS label FROM orders")
def a24(spark, sf):
    r = orders(spark, sf).select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_custkey").alias("label"))
    return K.relabel(r, ["o_orderstatus"], "label").select("id", "label")


@query("a25_manifest_with_parameters", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type IN ('view', 'click')")
def a25(spark, sf):
    e = L.table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    return e.select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


@query("a26_resume_unfinished", "SELECT c_custkey AS image FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3)")
def a26(spark, sf):
    want = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("image"))
    return K.unfinished(want, results(spark, sf), ["image"], ["method"])


@query("a27_upsert_manifest", "SELECT o_custkey AS image, o_orderstatus AS method, o_totalprice AS value FROM orders WHERE NOT (o_custkey % 2 = 0 AND o_orderstatus = 'O') UNION ALL SELECT c_custkey, 'O', c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey % 2 = 0 AND o_orderstatus = 'O' AND o_custkey NOT IN (SELECT c_custkey FROM customer)")
def a27(spark, sf):
    new = L.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("image"), F.lit("O").alias("method"), F.col("c_acctbal").alias("value"))
    return K.upsert(results(spark, sf), new, ["image", "method"])


@query("x2_concatenate_with_replacement", "SELECT o_custkey AS image, o_orderstatus AS method, o_totalprice AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) UNION ALL SELECT c_custkey, 'N', c_acctbal FROM customer WHERE c_acctbal > 5000")
def x2(spark, sf):
    new = L.table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("image"), F.lit("N").alias("method"), F.col("c_acctbal").alias("value"))
    return K.upsert(results(spark, sf), new, ["image"])


@query("x3_ids_without_results", "SELECT c_custkey AS image FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def x3(spark, sf):
    return L.table(spark, sf, "customer").select(F.col("c_custkey").alias("image")).join(results(spark, sf).select("image"), "image", "left_anti")


@query("a30_fold_splits", "SELECT CAST(f.f AS INTEGER) AS held_out, count(*) FILTER (o_custkey % 5 = f.f) AS n_test, count(*) FILTER (o_custkey % 5 <> f.f) AS n_rest FROM orders CROSS JOIN range(5) f(f) GROUP BY 1")
def a30(spark, sf):
    c = orders(spark, sf).select(F.col("o_orderkey").alias("case"), (F.col("o_custkey") % 5).alias("fold"))
    s = K.fold_splits(c, "fold", 5)
    return s.groupBy("held_out").agg(F.sum((F.col("split") == "test").cast("long")).alias("n_test"), F.sum((F.col("split") != "test").cast("long")).alias("n_rest"))


@query("a31_selected_items", "SELECT o_orderkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def a31(spark, sf):
    sel = L.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, "dev").otherwise("test").alias("split"))
    return K.selected(orders(spark, sf), sel, ["o_custkey"]).select(F.col("o_orderkey").alias("id"), "split")


@query("a32_combine_result_tables", "SELECT setting, sample, count(*) AS n, count(extra) AS n_extra FROM (SELECT 'a' AS setting, 's' || o_custkey % 7 AS sample, NULL AS extra FROM orders UNION ALL SELECT 'b', 's' || c_custkey % 7, c_acctbal FROM customer) GROUP BY 1, 2")
def a32(spark, sf):
    image = lambda k, z: F.concat(F.lit("s"), (F.col(k) % 7).cast("string"), F.lit("_"), F.col(z).cast("string")).alias("image")
    a = orders(spark, sf).select(image("o_custkey", "o_orderkey"), F.col("o_totalprice").alias("value"))
    b = L.table(spark, sf, "customer").select(image("c_custkey", "c_custkey"), F.col("c_acctbal").alias("extra"))
    return K.combine_results([("a", a), ("b", b)]).groupBy("setting", "sample").agg(F.count("*").alias("n"), F.count("extra").alias("n_extra"))


@query("a28_batch_with_isolated_failures", L.with_views("lattice") + "SELECT volume_id, CASE WHEN CAST(substr(volume_id, 2) AS INTEGER) % 3 = 2 THEN 'failed: unreadable' ELSE 'ok' END AS status, CASE WHEN CAST(substr(volume_id, 2) AS INTEGER) % 3 <> 2 THEN n END AS n_px FROM (SELECT volume_id, count(*) FILTER (q >= 30) AS n FROM lattice GROUP BY 1)")
def a28(spark, sf):
    """Every third file holds bytes that are no array; its row says so and the others are measured."""
    files = X.encode_arrays(L.plane(spark, sf), SL, L.HEIGHT, L.WIDTH)
    vol = F.regexp_extract("path", r"^(v\d+)/", 1)
    broken = F.substring(vol, 2, 9).cast("int") % 3 == 2
    px, errors = X.decode_arrays(files.withColumn("content", F.when(broken, F.lit("no array").cast("binary")).otherwise(F.col("content"))))
    done = px.where("value >= 30").groupBy(vol.alias("volume_id")).agg(F.count("*").alias("n_px"))
    plan = L.volumes(spark, sf).select("volume_id", F.lit("queued").alias("status"))
    return K.batch_summary(plan, done, errors.select(vol.alias("volume_id"), F.lit("unreadable").alias("error")))
