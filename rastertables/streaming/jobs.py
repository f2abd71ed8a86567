"""Structured Streaming jobs: annotation saves, arriving files, job status."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_saves(saves: DataFrame, keys: list[str]) -> DataFrame:
    """Last save per key by (ts, seq); an empty last save deletes the entry."""
    row = F.struct("ts", "seq", "payload", "empty")
    last = saves.groupBy(*keys).agg(F.max_by(row, F.struct("ts", "seq")).alias("s"))
    return last.select(*keys, "s.*")


def apply_saves(current: DataFrame, saves: DataFrame, keys: list[str]) -> DataFrame:
    """Table of live annotations after a batch of saves. Tombstones stay until compacted, so a late older save cannot
    bring a deleted entry back, and replaying a batch changes nothing."""
    cols = [*keys, "ts", "seq", "payload", "empty"]
    return latest_saves(current.select(*cols).unionByName(saves.select(*cols)), keys)


def stream_saves(saves: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Upserts of a save stream into versioned tables under path, one version per batch. The batch id names the version
    and a version is always built from the one before, so a replayed batch writes the same table."""
    def upsert(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        cols = [*keys, "ts", "seq", "payload", "empty"]
        b = batch.select(*cols)
        old = spark.read.schema(b.schema).parquet(f"{path}/v={batch_id - 1}") if batch_id > 0 else b.limit(0)
        apply_saves(old, b, keys).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return saves.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """Stream of (path, content) of the files put into a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)


def stream_files(files: DataFrame, decode: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, checkpoint: str):
    """Files as they arrive: pixel rows and a status row per file, one folder per batch so that a replay overwrites
    itself. A bad file becomes a failed status row."""
    def ingest(batch: DataFrame, batch_id: int):
        rows, errors = decode(batch)
        rows.write.mode("overwrite").parquet(f"{out}/pixels/batch={batch_id}")
        failed = errors.groupBy("path").agg(F.min("error").alias("error"))
        status = batch.select("path").join(failed, "path", "left").withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise(F.concat(F.lit("failed: "), "error")))
        status.select("path", "status").write.mode("overwrite").parquet(f"{out}/status/batch={batch_id}")

    return files.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(events: DataFrame, by: list[str]) -> DataFrame:
    """Latest status per job; works on a table and on a stream (complete mode)."""
    return events.groupBy(*by).agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def throughput(events: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Status changes per tumbling window; events later than the watermark are dropped."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", every), "status").agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("start"), "status", "n"))
