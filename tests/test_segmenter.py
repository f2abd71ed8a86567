"""Steps of learning queries that once paid for every small tile or failed after a table was written."""
import numpy as np
import pandas as pd
import pytest
from conftest import to_rows

from rastertables.operators import learning as ML


def test_small_tiles_are_streamed_together(spark):
    """Every tile reaches the function once and whole, over batch borders too, without a group of Arrow data for each."""
    rng = np.random.default_rng(7)
    planes = {("a", z): rng.random((20, 30)) for z in range(3)}
    df = to_rows(spark, planes).unionByName(spark.createDataFrame([(None, 0, 1, 1, None)], "volume_id string, z int, y int, x int, value double"))

    def tile(pdf):
        return pd.DataFrame({"n": [len(pdf)], "volume_id": [pdf["volume_id"].iloc[0]], "z": [pdf["z"].iloc[0]], "y": [pdf["y"].min()], "s": [pdf["value"].sum()]})

    schema = "volume_id string, z int, y int, n long, s double"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = ML.external_segmenter(df, tile, schema, tile=8)
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3 * 3 * 4 + 1 and sum(r.n for r in got) == 3 * 600 + 1
    assert sum(r.s for r in got) == pytest.approx(sum(a.sum() for a in planes.values()))
    assert ML.external_segmenter(df, lambda pdf: tile(pdf).iloc[:0], schema, tile=8).count() == 0
