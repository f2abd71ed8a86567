import numpy as np
import pytest
from conftest import to_planes, to_rows
from pyspark.sql import functions as F

from rastertables.functions.quantiles import group_quantiles
from rastertables.operators import augment as A
from rastertables.operators import grid as G

H, W = 11, 13
SHAPES = {(v, z): (H, W) for v in ("a", "b") for z in (0, 1)}


def close(got, want):
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9), k


def box(a, r):
    p = np.pad(a, r, mode="symmetric")
    return np.mean([p[dy:dy + a.shape[0], dx:dx + a.shape[1]] for dy in range(2 * r + 1) for dx in range(2 * r + 1)], axis=0)


def test_quantiles_of_a_hot_group_match_numpy(spark):
    rng = np.random.default_rng(0)
    values = {"hot": np.round(rng.normal(0, 100, 5000), 1), "flat": np.full(50, 3.0), "wide": 10.0 ** rng.uniform(-20, 20, 300), "one": np.array([-2.5]), "signed": rng.normal(0, 1e-3, 41)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.01, "b": 0.5, "c": 0.995, "d": 1.0, "e": 0.0}
    for parts in (1, 7):
        got = {r["k"]: r for r in group_quantiles(df.repartition(parts), ["k"], "v", probs).collect()}
        for k, vs in values.items():
            for n, p in probs.items():
                assert got[k][n] == pytest.approx(np.quantile(vs, p), rel=1e-12), (k, n)
    low = {r["k"]: r["m"] for r in group_quantiles(df, ["k"], "v", {"m": 0.5}, "lower").collect()}
    for k, vs in values.items():
        assert low[k] == np.sort(vs)[(len(vs) - 1) // 2]


def test_normalise_flat_plane_is_zero(spark, rasters):
    planes = dict(rasters)
    planes[("a", 0)] = np.full((H, W), 7.0)
    got = to_planes(G.normalize_planes(to_rows(spark, planes)), SHAPES)
    assert (got[("a", 0)] == 0).all()
    a = planes[("b", 1)]
    lo, hi = np.percentile(a, [1, 99.5])
    assert np.allclose(got[("b", 1)], np.clip((a - lo) / (hi - lo), 0, 1))


def test_box_mean_and_guided_filter(spark, rasters):
    df = to_rows(spark, rasters)
    close(to_planes(G.box_mean(df, 2, H, W), SHAPES), {k: box(a, 2) for k, a in rasters.items()})
    guided = G.guided_filter(df.withColumn("guide", F.col("value") * F.col("value")), 1, 0.01, H, W)

    def want(p):
        i = p * p
        mi, mp = box(i, 1), box(p, 1)
        a = (box(i * p, 1) - mi * mp) / (box(i * i, 1) - mi * mi + 0.01)
        return box(a, 1) * i + box(mp - a * mi, 1)
    close(to_planes(guided, SHAPES), {k: want(a) for k, a in rasters.items()})


def test_guided_filter_moves_an_edge(spark):
    guide = np.zeros((20, 64))
    guide[:, 32:] = 1
    score = np.clip((np.arange(64) - 36) / 8.0, -1, 1) * np.ones((20, 1))
    df = to_rows(spark, {("a", 0): score}).join(to_rows(spark, {("a", 0): guide}).withColumnRenamed("value", "guide"), ["volume_id", "z", "y", "x"])
    out = to_planes(G.guided_filter(df, 8, 1e-3, 20, 64), {("a", 0): (20, 64)})[("a", 0)][10]
    assert abs(int(np.argmax(out > 0)) - 32) <= 1


def test_gaussian_with_kernel_longer_than_the_image(spark, rasters):
    k = np.array(G.gaussian_kernel(4.0))
    r = len(k) // 2
    def want(a):
        p = np.pad(a, ((0, 0), (r, r)), mode="symmetric")
        return np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, p)
    close(to_planes(G.smooth_axis(to_rows(spark, rasters), "x", W, 4.0, ["volume_id", "z", "y"]), SHAPES), {k_: want(a) for k_, a in rasters.items()})


def test_upsample_half_pixel_centres(spark, rasters):
    def want(a, h, w):
        def axis(n, m):
            s = np.maximum((np.arange(m) + 0.5) * n / m - 0.5, 0)
            i = np.minimum(np.floor(s).astype(int), n - 1)
            return i, np.minimum(i + 1, n - 1), s - i
        y0, y1, fy = axis(a.shape[0], h)
        x0, x1, fx = axis(a.shape[1], w)
        rows = a[:, x0] * (1 - fx) + a[:, x1] * fx
        return rows[y0] * (1 - fy)[:, None] + rows[y1] * fy[:, None]
    for h, w in ((29, 40), (5, 6)):
        cells = to_rows(spark, rasters).withColumnsRenamed({"y": "gy", "x": "gx"})
        got = to_planes(G.upsample(cells, (H, W), (h, w)), {k: (h, w) for k in SHAPES})
        close(got, {k: want(a, h, w) for k, a in rasters.items()})


def test_pixel_features_match_numpy(spark, rasters):
    f = G.pixel_features(to_rows(spark, rasters), H, W, (1.0,))
    a = rasters[("a", 1)]
    k = np.array(G.gaussian_kernel(1.0))
    r = len(k) // 2
    p = np.pad(a, r, mode="symmetric")
    g = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, p))
    gy, gx = np.gradient(g)
    gyy, gyx = np.gradient(gy)
    _, gxx = np.gradient(gx)
    eig = np.linalg.eigvalsh(np.stack([np.stack([gyy, gyx], -1), np.stack([gyx, gxx], -1)], -2))
    e = np.pad(g, 1, mode="edge")
    sx = (e[:, 2:] - e[:, :-2]) / 2
    sx = (sx[:-2] + 2 * sx[1:-1] + sx[2:]) / 4
    sy = (e[2:] - e[:-2]) / 2
    sy = (sy[:, :-2] + 2 * sy[:, 1:-1] + sy[:, 2:]) / 4
    want = {"level0": g, "edge0": np.sqrt((sx ** 2 + sy ** 2) / 2), "ridge0": eig[..., 1], "valley0": eig[..., 0]}
    for name, w in want.items():
        assert np.allclose(to_planes(f, SHAPES, name)[("a", 1)], w, atol=1e-9), name


def test_rotation_of_a_symmetric_image_and_reproducible_noise(spark):
    yy, xx = np.mgrid[:21, :21]
    a = np.exp(-((yy - 10) ** 2 + (xx - 10) ** 2) / 50.0)
    df = to_rows(spark, {("a", 0): a})
    out = to_planes(A.geometric(df, "rotate", 3, 21, 21), {("a", 0): (21, 21)})[("a", 0)]
    assert np.abs(out - a)[5:16, 5:16].max() < 0.02
    runs = [to_planes(A.photometric(df.repartition(n), "gauss_noise", 3, 21, 21, 4), {("a", 0): (21, 21)})[("a", 0)] for n in (1, 5)]
    assert (runs[0] == runs[1]).all()
    assert 0.09 < (runs[0] - a).std() < 0.15
    p = to_planes(A.photometric(to_rows(spark, {("a", 0): np.full((60, 60), 0.5)}), "poisson_noise", 3, 60, 60, 4), {("a", 0): (60, 60)})[("a", 0)] * 10
    assert abs(p.mean() - 5) < 0.2 and abs(p.var() - 5) < 0.6
