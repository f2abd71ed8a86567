import numpy as np
import pytest
from conftest import extents, to_planes, to_rows

from rastertables.operators import components as C
from rastertables.operators import distance as D
from rastertables.operators import measure as M
from rastertables.operators import runs as R

SL = ["volume_id", "z"]


def flood(mask, steps):
    lab, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if lab[start]:
            continue
        n += 1
        stack = [start]
        lab[start] = n
        while stack:
            p = stack.pop()
            for s in steps:
                q = tuple(a + b for a, b in zip(p, s))
                if all(0 <= i < m for i, m in zip(q, mask.shape)) and mask[q] and not lab[q]:
                    lab[q] = n
                    stack.append(q)
    return lab


FOUR = [(0, 1), (0, -1), (1, 0), (-1, 0)]
EIGHT = FOUR + [(1, 1), (1, -1), (-1, 1), (-1, -1)]
SIX = [(0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)]


def spiral(n):
    a = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    a[0, 0] = True
    for _ in range(n * n):
        ny, nx, fy, fx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
        if not (0 <= ny < n and 0 <= nx < n) or (0 <= fy < n and 0 <= fx < n and a[fy, fx]):
            dy, dx = dx, -dy
            if a[y + dy, x + dx] if 0 <= y + dy < n and 0 <= x + dx < n else True:
                break
            continue
        y, x = ny, nx
        a[y, x] = True
    return a


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(1)
    return {("a", 0): rng.random((29, 31)) < 0.55, ("a", 1): rng.random((29, 31)) < 0.4, ("s", 0): spiral(29)[:, :29].repeat(1, 0)}


@pytest.mark.parametrize("conn,steps", [(4, FOUR), (8, EIGHT)])
@pytest.mark.parametrize("block", [8, 256])
def test_labels_match_flood_fill_across_blocks(spark, masks, conn, steps, block):
    runs, ext = R.encode_runs(to_rows(spark, masks, False)), extents(spark, masks)
    lab = C.number_components(C.label_components(runs, ext, conn, block=block), ext)
    got = to_planes(R.decode_runs(lab), {k: m.shape for k, m in masks.items()}, "label")
    for k, m in masks.items():
        assert (got[k] == flood(m, steps)).all(), k


def test_solid_labels_across_blocks(spark):
    rng = np.random.default_rng(2)
    vol = rng.random((6, 12, 14)) < 0.35
    planes = {("v", z): vol[z] for z in range(6)}
    runs = R.encode_runs(to_rows(spark, planes, False))
    ext = spark.createDataFrame([("v", 12, 14)], "volume_id string, height int, width int")
    lab = C.number_components(C.label_components(runs, ext, 6, ["volume_id"], block=5, depth=2), ext, ["volume_id"])
    got = to_planes(R.decode_runs(lab), {k: m.shape for k, m in planes.items()}, "label")
    want = flood(vol, SIX)
    assert all((got[("v", z)] == want[z]).all() for z in range(6))


def test_clean_up_rules(spark):
    m = np.zeros((60, 60), bool)
    m[5:35, 5:35] = True
    m[50:52, 50:52] = True
    m[10:13, 10:13] = False            # 9 px hole
    m[18:33, 18:33] = False            # 225 px hole
    planes = {("a", 0): m}
    runs, ext = R.encode_runs(to_rows(spark, planes, False)), extents(spark, planes)
    out = to_planes(R.decode_runs(C.fill_small_holes(runs, ext, 20)), {("a", 0): m.shape}, None)[("a", 0)]
    assert out[11, 11] and not out[25, 25] and not out[0, 0]
    small = to_planes(R.decode_runs(C.remove_small(runs, ext, 10)), {("a", 0): m.shape}, None)[("a", 0)]
    assert small[6, 6] and not small[50, 50]
    filled = to_planes(R.decode_runs(C.fill_holes(runs, ext)), {("a", 0): m.shape}, None)[("a", 0)]
    assert filled[25, 25] and filled.sum() == 904


def test_morphology_matches_brute_force(spark, masks):
    planes = {k: m for k, m in masks.items() if k[0] == "a"}
    runs, ext = R.encode_runs(to_rows(spark, planes, False)), extents(spark, planes)
    shapes = {k: m.shape for k, m in planes.items()}
    for shape, test in ((R.diamond(3), lambda dy, dx: abs(dy) + abs(dx) <= 3), (R.disk(2), lambda dy, dx: dy * dy + dx * dx <= 4)):
        offs = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if test(dy, dx)]
        move = lambda m, fill: np.stack([np.pad(m, 3, constant_values=fill)[3 + dy:3 + dy + m.shape[0], 3 + dx:3 + dx + m.shape[1]] for dy, dx in offs])
        got = to_planes(R.decode_runs(R.dilate(runs, shape, ext)), shapes, None)
        assert all((got[k].astype(bool) == move(m, False).any(0)).all() for k, m in planes.items())
        dense = {k: ~m | (np.indices(m.shape).sum(0) % 5 > 0) for k, m in planes.items()}
        druns = R.encode_runs(to_rows(spark, dense, False))
        for border, e in ((False, None), (True, ext)):
            got = to_planes(R.decode_runs(R.erode(druns, shape, SL, e)), shapes, None)
            assert all((got[k].astype(bool) == move(m, border).all(0)).all() for k, m in dense.items())


def test_distances_match_brute_force(spark, masks):
    t = {("a", 0): masks[("a", 0)] & (np.indices((29, 31)).sum(0) % 9 == 0), ("a", 1): np.zeros((29, 31), bool)}
    wide = np.zeros((7, 150), bool)
    wide[3, 140] = True
    t[("w", 0)] = wide
    ext = extents(spark, t)
    runs = R.encode_runs(to_rows(spark, t, False))
    got = to_planes(D.distance_transform(runs, ext, (2.0, 0.5)), {k: m.shape for k, m in t.items()}, "dist", np.inf)
    for k, m in t.items():
        yy, xx = np.nonzero(m)
        gy, gx = np.indices(m.shape)
        want = np.sqrt(((gy[..., None] - yy) * 2.0) ** 2 + ((gx[..., None] - xx) * 0.5) ** 2).min(-1) if len(yy) else np.full(m.shape, np.inf)
        assert np.allclose(got[k], want), k


def test_overlap_and_distance_edge_cases(spark):
    a = np.zeros((60, 60), bool)
    a[20:40, 20:40] = True
    shifted = np.roll(a, 3, 1)
    empty = np.zeros((60, 60), bool)
    pred = {("same", 0): a, ("shift", 0): a, ("none", 0): empty, ("half", 0): a}
    ref = {("same", 0): a, ("shift", 0): shifted, ("none", 0): empty, ("half", 0): empty}
    p, r, ext = R.encode_runs(to_rows(spark, pred, False)), R.encode_runs(to_rows(spark, ref, False)), extents(spark, pred)
    o = {x["volume_id"]: x for x in M.overlap_counts(p, r, ext).withColumns({"dice": M.dice(), "iou": M.iou(), "d0": M.dice(0.0)}).collect()}
    assert o["none"]["dice"] == o["none"]["iou"] == 1 and o["none"]["d0"] == 0 and o["same"]["dice"] == 1 and o["half"]["dice"] == 0
    h = {x["volume_id"]: x["hd95"] for x in D.hd95(p, r, ext).collect()}
    assert h["same"] == 0 and h["none"] is None and h["half"] is None and h["shift"] == pytest.approx(3)
    for tol, sp, check in ((5, 1.0, lambda v: v == 1), (1, 1.0, lambda v: v < 0.7), (5, 2.0, lambda v: v < 1)):
        n = {x["volume_id"]: x["nsd"] for x in D.surface_dice(p, r, ext, tol, (sp, sp)).collect()}
        assert check(n["shift"]) and n["none"] == 1 and n["half"] == 0 and n["same"] == 1


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.random((400, 2)) * 3, rng.random((30, 2)) * 500, [[900.0, 900.0], [900.0, 900.0]]])
    rows = [("a", float(y), float(x)) for y, x in pts] + [("one", 1.0, 2.0), ("line", 0.0, 0.0), ("line", 0.0, 10.0), ("line", 0.0, 30.0)]
    df = spark.createDataFrame(rows, "g string, y double, x double")
    got = D.nearest_neighbour(df, ["g"], ["y", "x"], 8.0, crowd=50).collect()
    by = {(r["g"], r["y"], r["x"]): r["nearest_neighbour_um"] for r in got}
    assert len(got) == len(rows) and by[("one", 1.0, 2.0)] is None
    assert [by[("line", 0.0, x)] for x in (0.0, 10.0, 30.0)] == [10, 10, 20]
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1)) + np.diag(np.full(len(pts), np.inf))
    for (y, x), want in zip(pts, d.min(1)):
        assert by[("a", y, x)] == pytest.approx(want)


def test_solid_objects(spark):
    stack = np.zeros((10, 40, 40), bool)
    stack[2:5, 5:15, 5:15] = True
    stack[9, 30:35, 30:35] = True
    planes = {("v", z): stack[z] for z in range(10)}
    ext = spark.createDataFrame([("v", 40, 40)], "volume_id string, height int, width int")
    lab = C.label_components(R.encode_runs(to_rows(spark, planes, False)), ext, 6, ["volume_id"])
    from pyspark.sql import functions as F
    rows = M.objects_3d(lab.withColumns({"z_min": F.lit(0), "z_max": F.lit(9)}), (2.0, 0.5, 0.5)).orderBy(F.desc("volume_um3")).collect()
    assert rows[0]["volume_um3"] == 300 * 2 * 0.25 and rows[0]["n_slices"] == 3 and not rows[0]["touches_stack_edge"]
    assert rows[1]["touches_stack_edge"] and rows[1]["z_first"] == 9


def test_object_shapes(spark):
    m = np.zeros((60, 60), bool)
    m[5:15, 5:25] = True                                    # rectangle: convex
    m[30:50, 30:50] = True
    m[35:50, 35:50] = False                                 # L shape
    planes = {("a", 0): m}
    lab = C.label_components(R.encode_runs(to_rows(spark, planes, False)), extents(spark, planes), 8)
    t = M.object_table(lab, None, (1.0, 1.0)).orderBy("comp").collect()
    assert t[0]["area_um2"] == 200 and t[0]["solidity"] == pytest.approx(1.0) and t[0]["perimeter_um"] == pytest.approx(2 * (9 + 19))
    assert t[0]["major_axis_um"] == pytest.approx(4 * np.sqrt((20 ** 2 - 1) / 12))
    assert t[1]["solidity"] < 0.75 and t[0]["nearest_neighbour_um"] == t[1]["nearest_neighbour_um"]


def test_surface_area_of_planes_and_boxes(spark):
    slab = np.zeros((6, 8, 8), bool)
    slab[2:4] = True
    cube = np.zeros((20, 20, 20), bool)
    cube[4:16, 4:16, 4:16] = True
    rows = [("slab", int(z), int(y), int(x)) for z, y, x in zip(*np.nonzero(slab))] + [("cube", int(z), int(y), int(x)) for z, y, x in zip(*np.nonzero(cube))]
    vox = spark.createDataFrame(rows, "volume_id string, z int, y int, x int")
    ext = spark.createDataFrame([("slab", 6, 8, 8), ("cube", 20, 20, 20)], "volume_id string, n_z int, height int, width int")
    m = {r["volume_id"]: r for r in M.solid_measures(vox, ext).collect()}
    # The cut faces are not surface: two planes over the padded 9 x 9 cells
    assert m["slab"]["bs_bv_per_mm"] == pytest.approx(1e3 * 2 * 81 / 128)
    assert 0.85 * 6 * 144 < m["cube"]["bs_bv_per_mm"] * 12 ** 3 / 1e3 < 6 * 144
    th = m["cube"]["tb_th_um"]
    assert m["cube"]["tb_sp_um"] == pytest.approx(1e3 / m["cube"]["tb_n_per_mm"] - th)


def test_greedy_matching_is_one_to_one(spark):
    pairs = spark.createDataFrame([("a", 0, 1, 1, 0.9), ("a", 0, 1, 2, 0.8), ("a", 0, 2, 1, 0.85), ("a", 0, 2, 3, 0.6), ("a", 0, 3, 2, 0.4)], "volume_id string, z int, p int, g int, iou double")
    got = {(r["p"], r["g"]) for r in M.greedy_pairs(pairs, 0.5).collect()}
    assert got == {(1, 1), (2, 3)}


def test_histology(spark):
    bone = np.zeros((100, 100), bool)
    bone[30:70, 30:70] = True
    cells = np.zeros((100, 100), bool)
    cells[40:50, 72:78] = True
    cells[5:10, 5:10] = True
    planes = {("a", 0): bone}
    ext = extents(spark, planes)
    enc = lambda m: R.encode_runs(to_rows(spark, {("a", 0): m}, False))
    s, t = M.histomorphometry(enc(bone), enc(cells), ext, (1.0, 1.0), 3.0)
    r = s.first()
    assert r["b_ar_t_ar_pct"] == pytest.approx(16) and r["n_oc"] == 1 and r["cells_total"] == 2 and r["b_pm_mm"] * 1000 == pytest.approx(156)
    half = np.zeros((100, 100), bool)
    half[:, :50] = True
    assert M.histomorphometry(enc(half), enc(cells), ext)[0].first()["b_pm_mm"] * 1000 == pytest.approx(100, abs=3)
