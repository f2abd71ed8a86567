"""Training of candidates: gradients, optimum, folds, and planted labels with a known best."""
import numpy as np
import pytest

from rastertables.operators import grid as G
from rastertables.operators import training as T

DIM, SIDE = 6, 8


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    x, t, w = rng.normal(size=(30, 5)), rng.random(30), rng.random(30)
    for net in (T.Net("linear", 1, 5), T.Net("two-layer", 1, 5, 4)):
        p = rng.normal(size=net.size)
        value, grad = net.sums(p, x, t, w)
        for k in range(net.size):
            e = np.zeros(net.size)
            e[k] = 1e-6
            assert (net.sums(p + e, x, t, w)[0] - net.sums(p - e, x, t, w)[0]) / 2e-6 == pytest.approx(grad[k], rel=1e-4, abs=1e-6)


def planted(spark, rule, slices=4, seed=1):
    """Random vectors on grids of SIDE x SIDE patches; rule makes the truth of a slice from its (SIDE, SIDE, DIM) array."""
    rng = np.random.default_rng(seed)
    rows = []
    for z in range(slices):
        v = rng.normal(size=(SIDE, SIDE, DIM))
        t = rule(v)
        rows += [("a", z, y, x, v[y, x].tolist(), float(t[y, x])) for y in range(SIDE) for x in range(SIDE)]
    return spark.createDataFrame(rows, "volume_id string, z int, gy int, gx int, vec array<double>, target double")


def truth_of(samples):
    return samples.where("target > 0.5").selectExpr("volume_id", "z", "gy AS y", "gx AS x")


def around(v):
    p = np.pad(v[..., 0], 2, constant_values=np.nan)
    return np.array([[np.nanmean(p[y:y + 5, x:x + 5]) for x in range(SIDE)] for y in range(SIDE)])


def test_linear_models_of_all_folds_reach_the_optimum(spark):
    s = planted(spark, lambda v: 1 / (1 + np.exp(-3 * v[..., 0] - 1)))
    got = T.train_folds(s, DIM, ("linear",), (1,), l2=1e-2)
    pdf = s.toPandas().sort_values(["z", "gy", "gx"])
    x, t, z = np.stack(pdf["vec"]), pdf["target"].to_numpy(), pdf["z"].to_numpy()
    for fold in (T.ALL, 0, 1, 2, 3):
        on = z != fold
        share = t[on].mean()
        w = np.where(t > 0.5, 0.5 / share, 0.5 / (1 - share))[on] / on.sum()
        p = np.zeros(DIM + 1)
        for _ in range(50):   # Newton's method
            a = np.c_[x[on], np.ones(on.sum())]
            q = 1 / (1 + np.exp(-a @ p))
            reg = 1e-2 * np.r_[np.ones(DIM), 0]
            p -= np.linalg.solve((a * (w * q * (1 - q))[:, None]).T @ a + np.diag(reg), a.T @ (w * (q - t[on])) + reg * p)
        assert np.allclose(got.params["linear, context 1", fold], p, atol=1e-4), fold


NOISE = np.random.default_rng(5)   # Noisy labels punish models that can learn them by heart


@pytest.mark.parametrize("rule, best", [(lambda v: (v[..., 0] + 0.7 * NOISE.normal(size=v.shape[:2]) > 0) * 1.0, "linear"), (lambda v: (around(v) > 0) * 1.0, "context 5"), (lambda v: (v[..., 0] * v[..., 1] > 0) * 1.0, "two-layer")])
def test_planted_labels_choose_their_candidate(spark, rule, best):
    s = planted(spark, rule, 5)
    trained = T.train_folds(s, DIM, contexts=(1, 5), hidden=12, rounds=60)
    scores, model = T.select_candidate(trained, truth_of(s), (SIDE, SIDE), (SIDE, SIDE))
    dice = {r.candidate: r.mean_dice for r in scores.collect()}
    first = max(dice, key=dice.get)
    assert len(dice) == 4 and best in first and dice[first] > 0.7
    m = model.first()
    assert m.candidate == first and m.dice_at_threshold >= m.dice_at_half - 1e-4 and 0.2 <= m.threshold <= 0.9
    p = {(r.z, r.gy, r.gx): r.value for r in T.predict(model, s, DIM).collect()}
    right = sum((p[r.z, r.gy, r.gx] > 0.5) == (r.target > 0.5) for r in s.collect())
    assert right / s.count() > 0.75


def test_single_slices_and_regions(spark):
    one = planted(spark, lambda v: (v[..., 0] > 0) * 1.0, 1)
    trained = T.train_folds(one, DIM, ("linear",), (1,))
    assert list(trained.params) == [("linear, context 1", T.ALL)]
    scores, model = T.select_candidate(trained, truth_of(one), (SIDE, SIDE), (SIDE, SIDE))
    assert scores.count() == 0 and model.first().threshold == 0.5
    two = planted(spark, lambda v: (v[..., 0] > 0) * 1.0, 2)
    half = G.F.col("x") < 4
    valid = two.selectExpr("volume_id", "z", "gy AS y", "gx AS x").where(half)
    trained = T.train_folds(two.where("gx < 4"), DIM, ("linear",), (1, 3), patches=two)
    scores, _ = T.select_candidate(trained, truth_of(two), (SIDE, SIDE), (SIDE, SIDE), valid)
    assert {r.candidate: r.n_slices for r in scores.collect()} == {"linear, context 1": 2, "linear, context 3": 2}
