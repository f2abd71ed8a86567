"""Distances to masks in linear time, against brute force."""
import time

import numpy as np
import pytest
from conftest import extents, to_planes, to_rows

from rastertables.operators import distance as D
from rastertables.operators import runs as R


def brute(mask, sy, sx):
    ty, tx = np.nonzero(mask)
    y, x = np.indices(mask.shape)
    return np.sqrt((((y[..., None] - ty) * sy) ** 2 + ((x[..., None] - tx) * sx) ** 2).min(-1))


@pytest.mark.parametrize("rows, cols, step", [(1, 5, 1.0), (7, 3, 2.0), (40, 11, 0.5), (60, 2, 3.0)])
def test_envelope_equals_all_pairs(rows, cols, step):
    rng = np.random.default_rng(rows)
    f = np.where(rng.random((rows, cols)) < 0.3, rng.integers(0, 400, (rows, cols)).astype(float), np.inf)
    f[:, 0] = np.inf
    if cols > 2:
        f[:, 2] = 9.0   # Ties everywhere
    d = (step * np.subtract.outer(np.arange(rows), np.arange(rows))) ** 2
    want = (f[None] + d[:, :, None]).min(1)
    assert np.allclose(D.column_distances(f, step), want)


def test_time_follows_the_number_of_cells():
    rng = np.random.default_rng(0)

    def cost(rows):
        f = np.where(rng.random((rows, 64)) < 0.05, 0.0, np.inf)
        f[0] = 0.0
        best = np.inf
        for _ in range(3):
            began = time.process_time()
            D.column_distances(f, 1.0)
            best = min(best, time.process_time() - began)
        return best / rows
    assert cost(3000) < 3 * cost(500)
    f = np.full((3000, 64), np.inf)   # One cell far away: every row asks over the whole height
    f[-1] = 0.0
    began = time.process_time()
    assert D.column_distances(f, 1.0)[0, 0] == 2999.0 ** 2 and time.process_time() - began < 2


@pytest.mark.parametrize("shape", [(7, 150), (200, 200)])
def test_distance_transform_over_several_strips(spark, shape):
    rng = np.random.default_rng(3)
    planes = {("a", 0): rng.random(shape) < 0.01, ("a", 1): np.zeros(shape, bool)}
    planes[("a", 0)][0, 0] = True
    mask = R.encode_runs(to_rows(spark, planes, value=False))
    got = to_planes(D.distance_transform(mask, extents(spark, planes), (2.0, 0.5)), {("a", 0): shape}, "dist", np.inf)
    assert np.allclose(got[("a", 0)], brute(planes[("a", 0)], 2.0, 0.5))
    assert D.distance_transform(mask.limit(0), extents(spark, planes)).count() == 0


def test_both_directions_of_hd95_and_surface_dice(spark):
    rng = np.random.default_rng(8)
    a = {("a", 0): rng.random((30, 70)) < 0.3, ("a", 1): rng.random((30, 70)) < 0.02, ("b", 0): np.zeros((30, 70), bool), ("b", 1): np.zeros((30, 70), bool)}
    b = {("a", 0): rng.random((30, 70)) < 0.3, ("a", 1): np.eye(30, 70, 5, bool), ("b", 0): np.eye(30, 70, 0, bool), ("b", 1): np.zeros((30, 70), bool)}
    runs = lambda m: R.encode_runs(to_rows(spark, m, value=False))
    ext = extents(spark, a)
    hd = {(r.volume_id, r.z): r.hd95 for r in D.hd95(runs(a), runs(b), ext, (0.5, 0.5)).collect()}
    nsd = {(r.volume_id, r.z): r.nsd for r in D.surface_dice(runs(a), runs(b), ext, 1.0, (0.5, 0.5)).collect()}

    def edge(m):
        p = np.pad(m, 1)
        return m & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])
    for k in a:
        ea, eb = edge(a[k]), edge(b[k])
        if not a[k].any() or not b[k].any():
            assert hd[k] is None and nsd[k] == (1.0 if not a[k].any() and not b[k].any() else 0.0)
            continue
        both = np.concatenate([brute(b[k], 0.5, 0.5)[ea], brute(a[k], 0.5, 0.5)[eb]])
        assert hd[k] == pytest.approx(np.percentile(both, 95))
        close = (brute(eb, 0.5, 0.5)[ea] <= 1).sum() + (brute(ea, 0.5, 0.5)[eb] <= 1).sum()
        assert nsd[k] == pytest.approx(close / (ea.sum() + eb.sum()))
