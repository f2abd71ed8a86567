"""Queries for mask algebra, morphology, components and clean-up."""
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import runs as R
from ..sources import lattice as L
from .registry import query

PX = ["volume_id", "z", "y", "x"]
RUN = ["volume_id", "z", "y", "x0", "x1"]


def masks(spark, sf):
    return R.encode_runs(L.predicted(spark, sf)), R.encode_runs(L.reference(spark, sf))


def pixels(runs):
    return R.decode_runs(runs).select(*PX)


@query("a15_run_length_encode", L.with_views("pred") + """
SELECT volume_id, z, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY volume_id, z, y ORDER BY x) AS g FROM pred) GROUP BY volume_id, z, y, g""")
def a15(spark, sf):
    return R.encode_runs(L.predicted(spark, sf))


@query("a15_run_length_decode", L.with_views("pred") + "SELECT * FROM pred")
def a15_decode(spark, sf):
    return pixels(R.encode_runs(L.predicted(spark, sf)))


def _algebra(name, sql, fn):
    @query(name, L.with_views("pred", "ref") + sql)
    def run(spark, sf):
        return pixels(fn(*masks(spark, sf)))


_algebra("x1_mask_intersection", "SELECT * FROM pred INTERSECT SELECT * FROM ref", R.intersection)
_algebra("x1_mask_union", "SELECT * FROM pred UNION SELECT * FROM ref", R.union)
_algebra("x1_mask_difference", "SELECT * FROM pred EXCEPT SELECT * FROM ref", R.difference)
_algebra("x1_mask_symmetric_difference", "(SELECT * FROM pred EXCEPT SELECT * FROM ref) UNION (SELECT * FROM ref EXCEPT SELECT * FROM pred)", R.symmetric_difference)
_algebra("t22_agree_with_second_source", "SELECT * FROM pred INTERSECT SELECT * FROM ref", R.intersection)


def _offset_sql(src, cond):
    return f"""(SELECT DISTINCT d.volume_id, d.z, d.y, d.x FROM dense d JOIN {src} p ON p.volume_id = d.volume_id AND p.z = d.z AND {cond})"""


@query("g14_dilate_cross", L.with_views("dense", "pred") + "SELECT * FROM " + _offset_sql("pred", "abs(p.y - d.y) + abs(p.x - d.x) <= 2"))
def g14_dilate(spark, sf):
    return pixels(R.dilate(masks(spark, sf)[0], R.diamond(2), L.slices(spark, sf)))


# Holes and outside both erode, so the complement is taken on a frame two cells wider
FRAME = """cover AS (SELECT volume_id, z, y, x FROM dense WHERE q > 0 OR (x + y) % 3 > 0),
frame AS (SELECT s.volume_id, s.z, CAST(a.y AS INTEGER) y, CAST(b.x AS INTEGER) x FROM slices s CROSS JOIN range(-2, 42) a(y) CROSS JOIN range(-2, 50) b(x)),
back AS (SELECT * FROM frame EXCEPT SELECT * FROM cover)"""


def cover(spark, sf):
    """A well filled mask: recorded cells and two thirds of the rest."""
    d = L.dense(spark, sf).where((F.col("q") > 0) | ((F.col("x") + F.col("y")) % 3 > 0))
    return R.encode_runs(d.select(*PX))


@query("g14_erode_cross", L.with_views("dense", extra=FRAME) + """SELECT * FROM cover c WHERE NOT EXISTS
 (SELECT 1 FROM back b WHERE b.volume_id = c.volume_id AND b.z = c.z AND abs(b.y - c.y) + abs(b.x - c.x) <= 1)""")
def g14_erode(spark, sf):
    return pixels(R.erode(cover(spark, sf), R.diamond(1)))


def _smooth_sql():
    near = "(b.y - {a}.y) * (b.y - {a}.y) + (b.x - {a}.x) * (b.x - {a}.x) <= 1"
    ero = lambda src, back: f"(SELECT * FROM {src} c WHERE NOT EXISTS (SELECT 1 FROM {back} b WHERE b.volume_id = c.volume_id AND b.z = c.z AND {near.format(a='c')}))"
    dil = lambda src: f"(SELECT DISTINCT d.volume_id, d.z, d.y, d.x FROM dense d JOIN {src} b ON b.volume_id = d.volume_id AND b.z = d.z AND {near.format(a='d')})"
    return L.with_views("dense", extra=FRAME + f""", e1 AS {ero('cover', 'back')}, d1 AS {dil('e1')}, d2 AS {dil('d1')},
back2 AS (SELECT * FROM frame EXCEPT SELECT * FROM d2), e2 AS {ero('d2', 'back2')}""") + "SELECT * FROM e2"


@query("g15_open_close_disk", _smooth_sql())
def g15(spark, sf):
    return pixels(R.smooth(cover(spark, sf), 1, L.slices(spark, sf)))


@query("g16_boundary", L.with_views("dense", extra=FRAME) + """SELECT * FROM cover c WHERE EXISTS
 (SELECT 1 FROM back b WHERE b.volume_id = c.volume_id AND b.z = c.z AND abs(b.y - c.y) + abs(b.x - c.x) = 1)""")
def g16(spark, sf):
    return pixels(R.boundary(cover(spark, sf)))


@query("g17_bone_surface", L.with_views("dense", extra=FRAME) + """SELECT * FROM cover c WHERE EXISTS
 (SELECT 1 FROM back b WHERE b.volume_id = c.volume_id AND b.z = c.z AND b.y BETWEEN 0 AND 39 AND b.x BETWEEN 0 AND 47 AND greatest(abs(b.y - c.y), abs(b.x - c.x)) = 1)""")
def g17(spark, sf):
    return pixels(R.surface_boundary(cover(spark, sf), L.slices(spark, sf)))


def closure(src, conn, name="lab", solid=False):
    """Recursive closure: every pixel takes the lowest linear index it can reach."""
    near = {4: "abs(n.y - p.y) + abs(n.x - p.x) = 1 AND n.z = p.z", 8: "greatest(abs(n.y - p.y), abs(n.x - p.x)) = 1 AND n.z = p.z",
            6: "abs(n.z - p.z) + abs(n.y - p.y) + abs(n.x - p.x) = 1"}[conn]
    idx = "CAST((z * 40 + y) * 48 + x AS BIGINT)" if solid else "CAST(y * 48 + x AS BIGINT)"
    return f"""{name}_px AS (SELECT volume_id, z, y, x, {idx} AS i FROM {src}),
{name}_nb AS (SELECT p.volume_id, p.z, p.i AS a, n.i AS b FROM {name}_px p JOIN {name}_px n ON n.volume_id = p.volume_id AND {near}),
{name}_reach AS (SELECT volume_id, {'0 AS z' if solid else 'z'}, i AS a, i AS b FROM {name}_px UNION
 SELECT r.volume_id, {'0' if solid else 'r.z'}, r.a, n.b FROM {name}_reach r JOIN {name}_nb n ON n.volume_id = r.volume_id {'' if solid else 'AND n.z = r.z'} AND n.a = r.b),
{name}_root AS (SELECT volume_id, z, a AS i, min(b) AS comp FROM {name}_reach GROUP BY 1, 2, 3),
{name} AS (SELECT p.volume_id, p.z, p.y, p.x, r.comp FROM {name}_px p JOIN {name}_root r ON r.volume_id = p.volume_id AND r.i = p.i {'' if solid else 'AND r.z = p.z'})"""


def flood(src, name="outside"):
    """Background pixels that reach the image border through edge neighbours."""
    return f"""{name} AS (SELECT volume_id, z, y, x FROM {src} WHERE y IN (0, 39) OR x IN (0, 47) UNION
 SELECT n.volume_id, n.z, n.y, n.x FROM {name} p JOIN {src} n ON n.volume_id = p.volume_id AND n.z = p.z AND abs(n.y - p.y) + abs(n.x - p.x) = 1)"""


def _labels(name, conn):
    @query(name, L.with_views("pred", extra=closure("pred", conn), recursive=True) + """
SELECT volume_id, z, y, x, CAST(dense_rank() OVER (PARTITION BY volume_id, z ORDER BY comp) AS BIGINT) AS label FROM lab""")
    def run(spark, sf):
        ext = L.slices(spark, sf)
        lab = C.label_components(masks(spark, sf)[0], ext, conn)
        return R.decode_runs(C.number_components(lab, ext)).select(*PX, "label")


_labels("c1_label_4_connected", 4)
_labels("c1_label_8_connected", 8)


@query("c2_label_3d", L.with_views("lattice", extra="bright AS (SELECT volume_id, z, y, x FROM lattice WHERE q >= 50), " + closure("bright", 6, solid=True), recursive=True) + """
SELECT volume_id, z, y, x, CAST(dense_rank() OVER (PARTITION BY volume_id ORDER BY comp) AS BIGINT) AS label FROM lab""")
def c2(spark, sf):
    ext = L.volumes(spark, sf)
    lab = C.label_components(bright(spark, sf), ext, 6, ["volume_id"])
    return R.decode_runs(C.number_components(lab, ext, ["volume_id"])).select(*PX, "label")


def bright(spark, sf):
    return R.encode_runs(L.lattice(spark, sf).where("q >= 50").select(*PX))


@query("c3_remove_small", L.with_views("pred", extra=closure("pred", 8), recursive=True) + """
SELECT volume_id, z, y, x FROM (SELECT *, count(*) OVER (PARTITION BY volume_id, z, comp) AS n FROM lab) WHERE n >= 4""")
def c3(spark, sf):
    return pixels(C.remove_small(masks(spark, sf)[0], L.slices(spark, sf), 4))


BACK = """cover AS (SELECT volume_id, z, y, x FROM dense WHERE q > 0 OR (x + y) % 3 > 0),
bg AS (SELECT volume_id, z, y, x FROM dense EXCEPT SELECT * FROM cover)"""
HOLES = BACK + ", " + closure("bg", 8, "e") + ", " + flood("bg") + """,
filled AS (SELECT * FROM cover UNION (SELECT volume_id, z, y, x FROM (SELECT *, count(*) OVER (PARTITION BY volume_id, z, comp) AS n FROM e) WHERE n < 5 EXCEPT SELECT * FROM outside))"""


@query("c4_fill_small_holes", L.with_views("dense", extra=HOLES, recursive=True) + "SELECT volume_id, z, y, x FROM filled")
def c4(spark, sf):
    return pixels(C.fill_small_holes(cover(spark, sf), L.slices(spark, sf), 5))


ALL_HOLES = BACK + ", " + flood("bg") + ", filled AS (SELECT * FROM cover UNION (SELECT * FROM bg EXCEPT SELECT * FROM outside))"


@query("c5_fill_all_holes", L.with_views("dense", extra=ALL_HOLES, recursive=True) + "SELECT volume_id, z, y, x FROM filled")
def c5(spark, sf):
    return pixels(C.fill_holes(cover(spark, sf), L.slices(spark, sf)))


@query("c6_clean_up_chain")
def c6(spark, sf):
    return pixels(C.clean_up(cover(spark, sf), L.slices(spark, sf), (0.5, 0.5), 1, 2.0, 3.0))


INST = ("bg AS (SELECT volume_id, z, y, x FROM dense WHERE q < 30), " + flood("bg") + """,
filled AS (SELECT * FROM pred UNION (SELECT * FROM bg EXCEPT SELECT * FROM outside)), """ + closure("filled", 4, "g"))


@query("c7_instances", L.with_views("dense", "pred", extra=INST, recursive=True) + """
SELECT volume_id, z, y, x, CAST(dense_rank() OVER (PARTITION BY volume_id, z ORDER BY comp) AS BIGINT) AS label
FROM (SELECT *, count(*) OVER (PARTITION BY volume_id, z, comp) AS n FROM g) WHERE n >= 3""")
def c7(spark, sf):
    return R.decode_runs(C.instances(masks(spark, sf)[0], L.slices(spark, sf), 3)).select(*PX, "label")


@query("c9_largest_objects", L.with_views("pred", extra=closure("pred", 8), recursive=True) + """
SELECT volume_id, z, comp, n AS n_px, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, z ORDER BY n DESC, comp) AS k
 FROM (SELECT volume_id, z, comp, count(*) AS n FROM lab GROUP BY 1, 2, 3)) WHERE k <= 5""")
def c9(spark, sf):
    return C.largest(C.label_components(masks(spark, sf)[0], L.slices(spark, sf), 8), 5)
