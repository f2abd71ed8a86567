"""Words, scratch tables and skew-safe lookups shared by the text operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: its rows are computed once and outlive the executor that made them."""
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_words(text: Column) -> Column:
    """Array of the maximal runs of characters other than space and \\t..\\r; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def group_least(df: DataFrame, keys: list[str], value: str, out: str, salts: int = 32) -> DataFrame:
    """df with the least `value` of each row's group, for groups of any size.

    A group is summarised per (group, salt of the row) before it meets, and its answer is handed back to each of its
    salts, so no task sees more than a salt of a hot group. Rows with a null key get their own value."""
    salt = F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")
    rows = df.withColumn("_salt", salt)
    parts = rows.groupBy(*keys, "_salt").agg(F.min(value).alias("_low"))
    least = parts.groupBy(*keys).agg(F.min("_low").alias(out), F.collect_list("_salt").alias("_salts"))
    back = least.select(*keys, out, F.explode("_salts").alias("_salt"))
    return rows.join(back, [*keys, "_salt"], "left").withColumn(out, F.coalesce(out, value)).drop("_salt")
