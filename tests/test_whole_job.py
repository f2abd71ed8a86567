"""Cases in which a raster operator or query once did less than its whole job, against brute force."""
import numpy as np

from pyspark.sql import functions as F

from rastertables.operators import augment as A
from rastertables.operators import learning as ML
from rastertables.operators import scoring as S


def test_leave_one_out_takes_every_point(spark):
    """30 points, more than the 24 beyond which subsets once took over."""
    rng = np.random.default_rng(7)
    v, p = rng.normal(size=(40, 4)), rng.normal(size=(30, 4))
    patches = spark.createDataFrame([("a", 0, k // 8, k % 8, v[k].tolist()) for k in range(40)], "volume_id string, z int, gy int, gx int, vec array<double>")
    protos = spark.createDataFrame([("a", "pos" if k < 12 else "neg", k, p[k].tolist()) for k in range(30)], "volume_id string, polarity string, ord long, vec array<double>")
    thr = spark.createDataFrame([("a", 0.5)], "volume_id string, threshold double")
    got = {(r.gy, r.gx): r.value for r in S.uncertainty(patches, protos, ["volume_id"], thr, "leave_one_out").collect()}
    u = p / np.linalg.norm(p, axis=1)[:, None]
    score = lambda keep: v @ u[[k for k in keep if k < 12]].mean(0) - v @ u[[k for k in keep if k >= 12]].mean(0)
    full = score(range(30))
    on = lambda s: (s - full.min()) / (full.max() - full.min()) >= 0.5
    want = np.mean([on(score([k for k in range(30) if k != i])) != on(full) for i in range(30)], axis=0)
    assert want.max() > 0 and {k: round(x, 9) for k, x in got.items()} == {(k // 8, k % 8): round(float(want[k]), 9) for k in range(40)}


def test_suggestion_sees_the_last_row_and_column(spark):
    """Side 401: blocks of two cells once left out row and column 400."""
    u = spark.range(401 * 401).select(F.lit("a").alias("volume_id"), F.lit(0).alias("z"), F.floor(F.col("id") / 401).cast("int").alias("y"), (F.col("id") % 401).cast("int").alias("x"))
    u = u.withColumn("value", ((F.col("y") == 400) & (F.col("x") == 400)).cast("double"))
    none = spark.createDataFrame([], "volume_id string, z int, y int, x int")
    at = lambda **k: [(r.y, r.x) for r in S.suggest_point(u, none, 401, 401, **k).collect()]
    assert at() == [(400, 400)] and at(work_side=400) == [(400, 400)]


def test_folds_are_as_many_as_asked_for(spark):
    for slices in (4, 8):
        s = spark.createDataFrame([("ab"[k % 2], k // 2) for k in range(slices)], "volume_id string, z int")
        assert sorted(r.fold for r in ML.folds(s, None).collect()) == list(range(slices))
        assert sorted(r.fold for r in ML.folds(s, 3).collect()) == sorted(k % 3 for k in range(slices))


def test_poisson_beyond_mean_30_is_exact(spark):
    """Third central moment of a Poisson count is its mean; a rounded normal has none."""
    d = spark.range(100_000).select(A.poisson(F.lit(40.0), F.col("id")).alias("a"), A.poisson(F.lit(None).cast("double"), F.col("id")).alias("n")).toPandas()
    a = d["a"].to_numpy()
    assert d["n"].isna().all() and (a == a.round()).all()
    assert abs(a.mean() - 40) < 0.15 and abs(a.var() - 40) < 1.2 and abs(((a - a.mean()) ** 3).mean() - 40) < 15
