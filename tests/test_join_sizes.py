"""Rows whose size Spark guesses too low are joined by a shuffle, not sent whole to the driver."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertables import session
from rastertables.operators import augment as A
from rastertables.operators import distance as D
from rastertables.operators import runs as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_written_tables_are_not_broadcast(spark):
    """Few bytes of encoded columns, many rows."""
    rows = lambda n: spark.range(n).select(F.lit("a").alias("volume_id"), F.col("id").alias("x"))
    long, short = session.materialize(rows(session.BROADCAST_ROWS + 1)), session.materialize(rows(10))
    joined = lambda t: rows(1 << 21).withColumn("v", F.rand()).join(t, ["volume_id", "x"])
    assert "Broadcast" not in plan(joined(long)) and "BroadcastHashJoin" in plan(joined(short))
    assert long.count() == session.BROADCAST_ROWS + 1 and joined(long).count() == session.BROADCAST_ROWS + 1
    assert session.materialize(rows(0)).count() == 0


def test_rows_made_by_explode_are_not_broadcast(spark):
    runs = spark.createDataFrame([("a", 0, 0, 0, 1000)], "volume_id string, z int, y int, x0 int, x1 int")
    image = spark.range(1 << 21).select(F.lit("a").alias("volume_id"), F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), F.lit(1.0).alias("value"))
    assert "Broadcast" not in plan(image.join(R.decode_runs(runs), ["volume_id", "z", "y", "x"]))
    small = spark.createDataFrame([("a", 0, 0, 0, 1.0)], "volume_id string, z int, y int, x int, value double")
    for aug in ("rotate", "elastic"):
        assert "Broadcast" not in plan(A.geometric(small, aug, 1, 40, 48).select("y", "x", "value"))
    assert "Broadcast" not in plan(A.photometric(small, "lowres", 1, 40, 48).select("y", "x", "value"))


def test_cells_are_made_in_many_tasks(spark):
    """The slices are few small rows, which one task once expanded alone."""
    slices = spark.range(64).select(F.concat(F.lit("v"), "id").alias("volume_id"), F.lit(0).alias("z"))
    assert A._cells(slices, 4, 5, ["volume_id", "z"]).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert A._cells(slices, 4, 5, ["volume_id", "z"]).distinct().count() == 64 * 20


def test_nearest_points_of_a_full_grid(spark):
    """A crowd below the limit of a cell: the first grid is made finer until cells hold few points, and all still answer."""
    rng = np.random.default_rng(3)
    p = np.unique(rng.integers(0, 24, (300, 2)), axis=0) * 0.5
    df = spark.createDataFrame([("a", float(y), float(x)) for y, x in p], "volume_id string, cy double, cx double")
    got = {(r.cy, r.cx): r.nearest_neighbour_um for r in D.nearest_neighbour(df, ["volume_id"], ["cy", "cx"], 4.0).collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) + np.diag([np.inf] * len(p))
    assert got == pytest.approx({tuple(a): b for a, b in zip(p.tolist(), d.min(1).tolist())})


def test_poisson_inverts_the_distribution_function(spark):
    """Against the plain sum, without an expression of 120 steps for every row."""
    means = [None, 0.0, 0.5, 29.0, 31.0, 95.5]
    df = spark.createDataFrame([(i, means[i % 6]) for i in range(600)], "id long, lam double")
    n = F.greatest(F.ceil(F.col("lam") / 30), F.lit(1))
    u = F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda k: F.when(k == 1, A.uniform("id", F.lit("poisson"))).otherwise(A.uniform("id", F.lit("poisson"), k)))
    out = df.select("lam", u.alias("u"), A.poisson(F.col("lam"), "id").alias("k"))
    assert "ArrowEvalPython" in plan(out)
    for r in out.collect():
        if r.lam is None:
            assert r.k is None
            continue
        m = r.lam / len(r.u)
        cdf = np.cumsum(np.exp(-m) * np.concatenate([[1.0], np.cumprod(m / np.arange(1, 120))]))
        assert r.k == sum(int((v > cdf).sum()) for v in r.u)


def test_short_strips_are_solved_row_against_row(spark):
    rng = np.random.default_rng(11)
    for rows, share in ((1, 0.5), (40, 0.3), (90, 0.02), (7, 0.0)):
        f = np.where(rng.random((rows, 64)) < share, rng.integers(0, 50, (rows, 64)) * 0.25, np.inf)
        assert np.allclose(D.short_column_distances(f, 0.5), D.column_distances(f, 0.5))
    mask = spark.createDataFrame([("a", 0, 3, 5, 9), ("a", 0, 20, 70, 71)], "volume_id string, z int, y int, x0 int, x1 int")
    ext = spark.createDataFrame([("a", 0, 30, 90)], "volume_id string, z int, height int, width int")
    got = {(r.y, r.x): r.dist for r in D.distance_transform(mask, ext, (2.0, 0.5)).collect()}
    on = [(3, x) for x in range(5, 9)] + [(20, 70)]
    assert len(got) == 2700 and all(abs(d - min(np.hypot((y - v) * 2.0, (x - u) * 0.5) for v, u in on)) < 1e-9 for (y, x), d in got.items())


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """A fixed number of partitions would let each task hold a fixed share of however many rows there are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        monkeypatch.setattr(session, "ROWS_A_TASK", 50)
        slices = spark.range(40).select(F.concat(F.lit("v"), "id").alias("volume_id"), F.lit(0).alias("z"))
        cells = A._cells(slices, 10, 5, ["volume_id", "z"])
        assert cells.rdd.getNumPartitions() == 40 and cells.distinct().count() == 40 * 50
        assert A.smooth_field(slices, 8.0, 10, 10, 5, "field").count() == 40 * 100
        session.fit_shuffles(spark, 1)   # Never lowered
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 80
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
