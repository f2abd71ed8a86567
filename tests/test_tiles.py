"""Stencils on tiles: equal to whole-image results wherever tile borders fall."""
import numpy as np
import pytest
from conftest import to_planes, to_rows
from pyspark.sql import functions as F

from rastertables.operators import grid as G
from rastertables.operators import tiles


def whole(a, r, fn, mode="symmetric"):
    return fn(np.pad(a, ((r[0], r[0]), (r[1], r[1])), mode=mode))


@pytest.mark.parametrize("shape, tile", [((23, 31), 5), ((23, 31), 8), ((4, 40), 16), ((1, 9), 4), ((16, 16), 8)])
def test_box_blur_shift_and_guided_filter_across_tile_borders(spark, shape, tile):
    rng = np.random.default_rng(shape[0] + tile)
    a, g = rng.random(shape), rng.random(shape)
    df = to_rows(spark, {("a", 0): a})
    both = df.join(to_rows(spark, {("a", 0): g}).withColumnRenamed("value", "guide"), ["volume_id", "z", "y", "x"])
    k = G.gaussian_kernel(1.3)
    r = len(k) // 2
    cases = [((2, 2), lambda p, _: {"value": tiles.box(p["value"], 2)}, lambda q: tiles.box(q, 2)),
             ((r, r), lambda p, _: {"value": tiles.convolve(tiles.convolve(p["value"], k, 0), k, 1)}, lambda q: tiles.convolve(tiles.convolve(q, k, 0), k, 1)),
             ((3, 3), lambda p, _: {"value": tiles.shifted(p["value"], 1.25, -2.5, 3)}, lambda q: tiles.shifted(q, 1.25, -2.5, 3))]
    for reach, step, fn in cases:
        got = to_planes(tiles.stencil(df, step, reach, shape, ["value"], ["value"], tile=tile), {("a", 0): shape})[("a", 0)]
        assert np.allclose(got, whole(a, reach, fn), atol=1e-12)
    step = lambda p, _: {"value": tiles.guided(p["guide"], p["value"], 2, 0.01)}
    got = to_planes(tiles.stencil(both, step, (4, 4), shape, ["guide", "value"], ["value"], tile=tile), {("a", 0): shape})[("a", 0)]
    # The definition: the second averaging repeats the edge of a and b, not of the input
    box = lambda v: whole(v, (2, 2), lambda q: tiles.box(q, 2))
    slope = (box(g * a) - box(g) * box(a)) / (box(g * g) - box(g) ** 2 + 0.01)
    assert np.allclose(got, box(slope) * g + box(box(a) - slope * box(g)), atol=1e-9)


def test_box_is_the_mean_of_the_square():
    a = np.random.default_rng(1).random((9, 12))
    assert np.allclose(tiles.box(a, 2), [[a[y:y + 5, x:x + 5].mean() for x in range(8)] for y in range(5)])
    a[3, 4] = np.nan
    assert np.allclose(tiles.box(a, 1), [[np.nanmean(a[y:y + 3, x:x + 3]) for x in range(10)] for y in range(7)])


def test_slices_of_different_size_nulls_and_other_columns(spark):
    rng = np.random.default_rng(2)
    planes = {("a", 0): rng.random((7, 9)), ("b", 3): rng.random((12, 5))}
    df = to_rows(spark, planes).withColumn("note", F.concat_ws("-", "y", "x"))
    df = df.withColumn("value", F.when((F.col("y") == 2) & (F.col("x") == 2), None).otherwise(F.col("value")))
    size = lambda k: F.when(F.col("volume_id") == "a", F.lit(planes[("a", 0)].shape[k])).otherwise(F.lit(planes[("b", 3)].shape[k]))
    out = G.box_mean(df, 1, size(0), size(1))
    assert out.where("note <> concat_ws('-', y, x)").count() == 0 and out.count() == sum(a.size for a in planes.values())
    got = to_planes(out, {k: a.shape for k, a in planes.items()})
    for k, a in planes.items():
        b = a.copy()
        b[2, 2] = np.nan
        p = np.pad(b, 1, mode="symmetric")
        assert np.allclose(got[k], [[np.nanmean(p[y:y + 3, x:x + 3]) for x in range(a.shape[1])] for y in range(a.shape[0])])
    assert G.box_mean(df.limit(0), 1, 3, 3).count() == 0


def test_pixel_features_are_one_sided_only_at_true_ends(spark, monkeypatch):
    a = np.random.default_rng(4).random((21, 26))
    df = to_rows(spark, {("a", 0): a})
    names = [f"{n}{k}" for k in (0, 1) for n in ("level", "edge", "ridge", "valley")]

    def planes(tile):
        monkeypatch.setattr(tiles.stencil, "__defaults__", tuple(tile if v == tiles.TILE else v for v in tiles.stencil.__defaults__))
        pdf = G.pixel_features(df, 21, 26, (0.7, 1.5)).toPandas()
        return {n: pdf.pivot(index="y", columns="x", values=n).to_numpy() for n in names}
    one, many = planes(tiles.TILE), planes(6)
    for n in names:
        assert np.allclose(one[n], many[n], atol=1e-10), n
    k = G.gaussian_kernel(0.7)
    r = len(k) // 2
    g = whole(a, (r, r), lambda q: tiles.convolve(tiles.convolve(q, k, 0), k, 1))
    gy, gx = np.gradient(g)
    h = np.array([[np.gradient(gy, axis=0), np.gradient(gy, axis=1)], [np.gradient(gy, axis=1), np.gradient(gx, axis=1)]])
    high = np.linalg.eigvalsh(np.moveaxis(h, (0, 1), (2, 3)))
    assert np.allclose(many["level0"], g) and np.allclose(many["ridge0"], high[..., 1]) and np.allclose(many["valley0"], high[..., 0])


def test_a_chain_costs_one_exchange(spark):
    df = spark.createDataFrame([("a", 0, 0, 0, 1.0, 2.0)], "volume_id string, z int, y int, x int, value double, guide double")
    plan = G.guided_filter(df, 3, 0.01, 500, 500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
