"""Scan conversion of polygons against the even-odd test of every pixel."""
import numpy as np
from pyspark.sql import functions as F

from rastertables.operators import polygons as P

H, W = 40, 60


def inside(corners, y, x):
    odd = False
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def shapes():
    rng = np.random.default_rng(2)
    out = [[tuple(p) for p in rng.uniform([-10, -10], [W + 10, H + 10], (n, 2))] for n in (3, 4, 5, 7, 12, 30)]   # Crossing outlines make holes
    out += [[tuple(p) for p in rng.integers(0, [W, H], (n, 2)).astype(float)] for n in (3, 5, 9)]   # Corners on pixel centres
    out += [[(5.0, 5.0), (20.0, 5.0), (20.0, 20.0), (5.0, 20.0)], [(3.0, 7.0), (9.0, 7.0), (6.0, 7.0)], [(1.0, 1.0), (2.0, 2.0)], [(0.2, 0.3), (0.4, 0.3), (0.3, 0.8)], [(-5.0, -5.0), (W + 5.0, -5.0), (W + 5.0, H + 5.0), (-5.0, H + 5.0)]]
    return out


def table(spark, polys):
    rows = [("a", 0, k, [{"x": float(x), "y": float(y)} for x, y in p], 9) for k, p in enumerate(polys)]
    return spark.createDataFrame(rows, "volume_id string, z int, polygon_id int, poly array<struct<x:double,y:double>>, x0 int")


def test_rows_instances_and_regions(spark):
    polys = shapes()
    t = table(spark, polys)
    got = {(r.polygon_id, r.y, r.x) for r in P.polygon_rows(t, F.lit(H), F.lit(W)).collect()}
    want = {(k, y, x) for k, p in enumerate(polys) if len(p) >= 3 for y in range(H) for x in range(W) if inside(p, y, x)}
    assert got == want
    area = lambda p: abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]))) / 2
    top = {}
    for k, y, x in want:
        if (y, x) not in top or (area(polys[k]), k) < (area(polys[top[y, x]]), top[y, x]):
            top[y, x] = k
    assert {(r.y, r.x): r.polygon_id for r in P.rasterise(t, F.lit(H), F.lit(W)).collect()} == top
    region = [(r.y, r.x) for r in P.region_mask(t.withColumnRenamed("poly", "roi"), F.lit(H), F.lit(W), ["volume_id", "z"]).collect()]
    assert len(region) == len(set(region)) and set(region) == set(top)
    assert P.polygon_rows(t.limit(0), F.lit(H), F.lit(W)).count() == 0


def test_runs_need_no_exchange_and_no_boxes(spark):
    wide = table(spark, [[(0.0, 0.0), (1e6, 0.0), (1e6, 3.0), (0.0, 3.0)]])
    runs = P.polygon_runs(wide, F.lit(10), F.lit(2_000_000))
    assert [(r.y, r.x0, r.x1) for r in runs.orderBy("y").collect()] == [(0, 0, 1000000), (1, 0, 1000000), (2, 0, 1000000)]
    assert "Exchange" not in runs._jdf.queryExecution().executedPlan().toString()
