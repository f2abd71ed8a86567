"""Models reach the tasks in a session that has written tables."""
from pyspark.sql import functions as F

from rastertables import session
from rastertables.operators import learning as ML


def test_models_are_sent_to_tasks_after_a_table_was_written(spark):
    """An observation in the session once made every model with a training summary fail to reach the tasks."""
    rows = session.materialize(spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("f"), (F.col("id") % 7 > 3).alias("truth")))
    m = ML.fit_forest(rows, ["f"], 3)
    assert m.transform(rows).where((F.col("prediction") == 1) == F.col("truth")).count() == 40
