"""Session settings and lineage cuts."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SLICE = ["volume_id", "z"]
#: Rows of a written table up to which Spark may broadcast it by its file size.
BROADCAST_ROWS = 50_000
#: Rows of the largest table of a job that one shuffle partition is meant to hold.
ROWS_A_TASK = 400_000
#: Bytes up to which Spark merges the partitions of such a job.
MERGED = "4m"


def get_session(app: str = "rastertables", cpus: str | int = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the submitter's own session is used instead."""
    n = (os.cpu_count() or 8) if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; only a local master may fall back to a folder of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="rastertables-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, whose next equi-join shuffles both sides. For rows whose size Spark guesses far too low: rows made by explode
    count as the rows they come from, and encoded files as their bytes on disk, so the driver would be sent all of them."""
    return df.hint("merge")


def fit_shuffles(spark: SparkSession, rows: int) -> None:
    """Shuffle partitions for tables of so many rows. A fixed number lets the memory of a task grow with the data; the
    session's own number is only ever raised. Spark merges small partitions again, but not to 64 MB: cells are encoded in a
    few bytes, so that would be tens of millions in a task."""
    wanted = -(-rows // ROWS_A_TASK)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", MERGED)


def spread(df: DataFrame, keys: list[str], each: int = 1) -> DataFrame:
    """Few rows that are about to become many (each of them so many), dealt over all shuffle partitions: by their present
    size Spark would merge them into one task, which would then make all the rows."""
    spark = df.sparkSession
    fit_shuffles(spark, df.count() * each)
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table to the shared checkpoint folder and read it back: loops keep a short lineage, a lost executor
    costs a re-read instead of a recomputation, and later steps read only the columns they need. Unlike an RDD
    checkpoint, the rows are computed once. Tables beyond BROADCAST_ROWS are joined by a shuffle."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    # Counted from the file footers: a session with an observation can't be sent along with a model's training summary
    return table if table.count() <= BROADCAST_ROWS else by_shuffle(table)
