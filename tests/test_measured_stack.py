"""Measured stacks read their masks from a written table."""
import numpy as np
from conftest import extents, to_rows
from pyspark.sql import functions as F

from rastertables.plans import stack as K


def test_measured_stacks_read_their_masks_from_a_table(spark):
    """The labels are encoded once, however many jobs measure them."""
    a = np.zeros((6, 8))
    a[1:4, 2:5], a[5, 7] = 1, 2
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = to_rows(spark, {("a", z): a for z in range(2)}).withColumn("label", F.col("value").cast("int")).drop("value")
    s = K.run_stack_multi(df.mapInArrow(count, df.schema), extents(spark, {("a", z): a for z in range(2)}), 2)["summary"]
    assert {r.structure: (r.volume_um3, r.n_objects_3d) for r in s.collect()} == {0: (20.0, 2), 1: (18.0, 1), 2: (2.0, 1)}
    assert read.value == 2 * 48
