"""The mask table sink, which once wrote a file per task and volume."""
from pyspark.sql import functions as F

from rastertables.plans.catalog_queries import _round_trip


def test_a_volume_is_written_by_few_tasks(spark):
    runs = spark.range(600, numPartitions=12).select(F.when(F.col("id") % 6 > 0, F.concat(F.lit("v"), (F.col("id") % 6).cast("string"))).alias("volume_id"), F.col("id").cast("int").alias("x0"))
    back = _round_trip(spark, runs, ["volume_id"])
    assert len(back.inputFiles()) == 6
    key = lambda r: (r.volume_id or "", r.x0)
    assert sorted(back.select("volume_id", "x0").collect(), key=key) == sorted(runs.collect(), key=key)
