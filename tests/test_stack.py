"""Whole-stack runs: threshold precedence, modes, guided edges, sinks, and threshold transfers by merge."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertables.operators import scoring as S
from rastertables.plans import stack as K

DIM, GRID, SIDE = 4, 5, 20


@pytest.fixture(scope="module")
def stack(spark):
    """Four volumes of three slices: points on the first slice, on the last, on none, and no examples at all."""
    rng = np.random.default_rng(0)
    patches, points, protos = [], [], []
    for k, v in enumerate(("early", "late", "none", "empty")):
        for z in range(3):
            vec = rng.normal(0, 0.3, (GRID, GRID, DIM)) + np.eye(DIM)[1]
            vec[1:3, 1:3] += 2 * np.eye(DIM)[0] - np.eye(DIM)[1]
            patches += [(v, z, y, x, vec[y, x].tolist()) for y in range(GRID) for x in range(GRID)]
            if (v, z) in (("early", 0), ("late", 2)):
                points += [(v, z, "pos", 0, 6.0, 6.0), (v, z, "neg", 1, 16.0, 16.0)]
        if v != "empty":
            protos += [(v, "pos", 0, np.eye(DIM)[0].tolist()), (v, "neg", 1, np.eye(DIM)[1].tolist())]
    return (spark.createDataFrame(patches, "volume_id string, z int, gy int, gx int, vec array<double>"), spark.createDataFrame(protos, "volume_id string, polarity string, ord int, vec array<double>"),
            spark.createDataFrame(points, "volume_id string, z int, polarity string, ord int, y double, x double"),
            spark.createDataFrame([(v, z, SIDE, SIDE) for v in ("early", "late", "none", "empty") for z in range(3)], "volume_id string, z int, height int, width int"))


def run(stack, **how):
    patches, protos, points, ext = stack
    return K.run_stack(patches, protos, points, ext, (GRID, GRID), (SIDE, SIDE), (2.0, 0.5, 0.5), **how)


def test_every_slice_of_every_volume_has_a_row_and_a_source(spark, stack, tmp_path):
    out = run(stack, guide=spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in ("early", "late", "none")])).alias("volume_id")).select("volume_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("z")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("x")).withColumn("value", (F.col("x") >= 10).cast("double")))
    source = {(r.volume_id, r.z): r.threshold_source for r in out["slices"].collect()}
    otsu = "otsu (no background clicks)"
    assert source == {("early", 0): "clicks", ("early", 1): "carried over", ("early", 2): "carried over", ("late", 0): "carried over", ("late", 1): "carried over", ("late", 2): "clicks",
                      **{("none", z): otsu for z in range(3)}, **{("empty", z): "no example" for z in range(3)}}
    n = {r.volume_id: r.n for r in out["masks"].groupBy("volume_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).collect()}
    assert set(n) == {"early", "late", "none"} and {r.volume_id: r.n_slices for r in out["summary"].collect()} == {v: 3 for v in ("early", "late", "none", "empty")}
    K.save_stack(out, str(tmp_path / "run"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/run/slices").count() == 12 and spark.read.json(f"{tmp_path}/run/summary").count() == 4
    assert spark.read.parquet(f"{tmp_path}/run/masks").agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == sum(n.values())


def test_modes_and_stored_thresholds(spark, stack):
    top = run(stack, mode="top_percent", top_percent=10.0)
    area = {(r.volume_id, r.z): r.area_fraction for r in top["slices"].collect()}
    assert all(0.08 <= a <= 0.15 for (v, _), a in area.items() if v != "empty") and area["empty", 0] == 0
    nothing = run(stack, mode="manual", manual=1.5)
    assert nothing["masks"].count() == 0 and nothing["slices"].where("threshold_source = 'manual' AND threshold = 1.5").count() == 9
    stored = run(stack, profile_thresholds=spark.createDataFrame([("none", 0.25), ("early", 9.0)], "volume_id string, threshold double"))
    assert {r.threshold_source for r in stored["slices"].where("volume_id = 'none'").collect()} == {"carried over"}
    assert {r.threshold_source for r in stored["slices"].where("volume_id = 'early'").collect()} == {"clicks", "carried over"}
    with pytest.raises(ValueError, match="Unknown threshold mode"):
        run(stack, mode="auto")


def test_thresholds_carry_along_the_order(spark):
    order = spark.createDataFrame([("a", z, s) for s, z in enumerate([3, 4, 2, 5, 1])] + [("b", 0, 0)], "volume_id string, z int, step int")
    here = spark.createDataFrame([("a", 4, 1.0), ("a", 5, 2.0)], "volume_id string, z int, threshold double")
    assert {(r.volume_id, r.z): r.threshold for r in S.carry_thresholds(here, order).collect()} == {("a", 3): 1.0, ("a", 4): 1.0, ("a", 2): 1.0, ("a", 5): 2.0, ("a", 1): 2.0, ("b", 0): None}


def test_transfers_by_merge_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(d, f"v{v}", z, float(rng.integers(0, 6)), bool(rng.random() < 0.4)) for d in ("p", "q") for v in range(2) for z in range(2) for _ in range(30)]
    thr = [(d, f"v{v}", z, t) for d in ("p", "q") for (v, z, t) in ((0, 0, 2.0), (0, 1, 2.5), (1, 0, 9.0), (1, 1, None))]
    got = K.threshold_transfers(spark.createDataFrame(rows, "dataset string, volume_id string, z int, value double, truth boolean"), spark.createDataFrame(thr, "dataset string, ref_volume string, ref_z int, threshold double"), "dataset").collect()
    want = {}
    for d, rv, rz, t in thr:
        for v in ("v0", "v1"):
            for z in (0, 1):
                px = [(x[3], x[4]) for x in rows if x[:3] == (d, v, z)]
                p, r, b = sum(t is not None and a >= t for a, _ in px), sum(m for _, m in px), sum(t is not None and a >= t and m for a, m in px)
                want[d, rv, rz, v, z] = (2 * b / (p + r) if p + r else 1.0, "same slice" if (rv, rz) == (v, z) else "same file" if rv == v else "other file")
    assert {(r.dataset, r.ref_volume, r.ref_z, r.volume_id, r.z): (pytest.approx(r.dice), r.transfer) for r in got} == want and len(got) == len(want)


def test_transfers_are_looked_up_in_blocks(spark, monkeypatch):
    """A pair was a row sorted into its target's values; now blocks of slices meet blocks of thresholds, here many."""
    rng = np.random.default_rng(4)
    odd = lambda v, share: None if rng.random() < share else v
    rows = [(d, f"v{v}", odd(z, 0.05), odd(float(rng.integers(-3, 4)) / 2, 0.1), None if (v, z) == (2, 0) else odd(bool(rng.random() < 0.3), 0.2))
            for d in ("p", "q", None) for v in range(4) for z in range(20) for _ in range(8)] + [("p", "v0", 0, float("nan"), True), ("p", "only", 0, 1.0, None)]
    thr = [(d, f"v{v}", z, odd(float(rng.integers(-4, 5)) / 2, 0.2)) for d in ("p", "r", None) for v in range(3) for z in (0, 1, 17, 18)] + [("p", "v0", 0, float("inf"))]
    values = spark.createDataFrame(rows, "dataset string, volume_id string, z int, value double, truth boolean")
    thresholds = spark.createDataFrame(thr, "dataset string, ref_volume string, ref_z int, threshold double")
    for name, n in (("TARGETS", 3), ("REFERENCES", 2)):
        monkeypatch.setattr(K, name, n)
    pairs = K.threshold_transfers(values, thresholds, "dataset")
    assert "Window" not in pairs._jdf.queryExecution().executedPlan().toString()
    slices = {}
    for d, v, z, value, truth in rows:
        slices.setdefault((d, v, z), []).append((value, truth))
    want = []
    for d, rv, rz, t in thr:
        for (e, v, z), px in slices.items():
            if d is None or d != e:
                continue
            over = [m for a, m in px if t is not None and a is not None and not a < t]
            truths = [m for _, m in px if m is not None]
            total = len(over) + sum(truths)
            want.append((rv, rz, v, z, None if not truths else round(2 * sum(m or False for m in over) / total, 9) if total else 1.0))
    got = [(r.ref_volume, r.ref_z, r.volume_id, r.z, None if r.dice is None else round(r.dice, 9)) for r in pairs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[4] is None for w in want)
    means = {(r.ref_volume, r.volume_id): r.dice for r in K.transfer_means(values, thresholds, "dataset").collect()}
    for pair in {(w[0], w[2]) for w in want}:
        d = [w[4] for w in want if (w[0], w[2]) == pair and w[4] is not None]
        assert means.pop(pair) == (pytest.approx(np.mean(d)) if d else None)
    assert not means
    assert K.transfer_means(values.limit(0), thresholds, "dataset").count() == 0 and K.threshold_transfers(values, thresholds.limit(0), "dataset").count() == 0
