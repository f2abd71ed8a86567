"""Catalogue tables: listing, registering, updating, deleting, resuming and splitting."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinals import banded_ordinal

from ..operators.settings import channel_choice


def volumes_from_pixels(pixels: DataFrame) -> DataFrame:
    """One row per volume with its extent and default channel names."""
    v = pixels.groupBy("volume_id").agg(*[(F.max(c) + 1).alias(n) for c, n in (("channel", "n_channels"), ("z", "n_z"), ("y", "height"), ("x", "width"))])
    return v.withColumn("channel_names", F.transform(F.sequence(F.lit(0), F.col("n_channels") - 1), lambda c: F.concat(F.lit("Channel "), (c + 1).cast("string"))))


def read_plane(pixels: DataFrame, volumes: DataFrame, volume_id: str, channel: int, z: int) -> DataFrame:
    """Rows of one plane. Filters on the partition columns reach the scan; asking outside the stack raises."""
    v = volumes.where(F.col("volume_id") == volume_id).select("n_channels", "n_z").first()
    if v is None or not (0 <= channel < v["n_channels"] and 0 <= z < v["n_z"]):
        raise ValueError(f"Plane {channel}, {z} of {volume_id} is out of range")
    return pixels.where((F.col("volume_id") == volume_id) & (F.col("channel") == channel) & (F.col("z") == z))


def side_view(pixels: DataFrame, row: int) -> DataFrame:
    """One image row through all slices."""
    return pixels.where(F.col("y") == row).drop("y")


def listing(volumes: DataFrame, channels: DataFrame) -> DataFrame:
    names = channels.groupBy("volume_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "name"))), lambda s: s["name"]).alias("channel_names"))
    return volumes.join(names, "volume_id", "left").orderBy(F.desc("created"), "volume_id")


def register_new(existing: DataFrame, incoming: DataFrame, on: str = "path") -> DataFrame:
    """Incoming rows whose path is not known yet, each path once."""
    return incoming.dropDuplicates([on]).join(existing.select(on), on, "left_anti")


def guess_reference(channels: DataFrame) -> DataFrame:
    """First channel whose name speaks of a segmentation, mask, label or surface."""
    return channels.where(F.lower("name").rlike("segment|mask|label|surface")).groupBy("volume_id").agg(F.min("channel").alias("reference_channel"))


def apply_overrides(rows: DataFrame, overrides: DataFrame, on: str, limits: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """Rows with the overriding values put in, and the overrides that are out of range."""
    bad = None
    for c, (lo, hi) in limits.items():
        b = F.col(c).isNotNull() & ((F.col(c) < lo) | (F.col(c) > hi))
        bad = b if bad is None else bad | b
    good = overrides.where(~bad).select(on, *[F.col(c).alias(f"_{c}") for c in limits])
    out = rows.join(good, on, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in limits}).drop(*[f"_{c}" for c in limits])
    return out, overrides.where(bad)


def cascade_delete(ids: DataFrame, tables: dict[str, DataFrame], on: str) -> dict[str, DataFrame]:
    """Every table without the rows of the given ids."""
    return {name: t.join(ids.select(on), on, "left_anti") for name, t in tables.items()}


def evenly_filled_slices(shares: DataFrame, volumes: DataFrame, n: int, least: float = 0.005) -> DataFrame:
    """3n candidates spread over the stack, those with enough mask, then n of them evenly spaced. shares: volume_id, z,
    share of mask pixels."""
    from ..operators.select import evenly_spaced
    at = F.transform(F.sequence(F.lit(0), F.lit(3 * n - 1)), lambda i: F.bround(i * (F.col("n_z") - 1) / F.greatest(F.lit(3 * n - 1), F.lit(1))).cast("int"))
    cand = volumes.select("volume_id", F.explode(F.array_distinct(at)).alias("z"))
    return evenly_spaced(cand.join(shares.where(F.col("share") > least), ["volume_id", "z"]), n)


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Old rows without those the new ones replace, then the new ones."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_method(results: DataFrame, new: DataFrame, method: str, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Result table with one method's rows replaced, and the units the method gave no row for."""
    units = results.select(*on).distinct()
    return results.where(F.col("method") != method).unionByName(new), units.join(new.select(*on), on, "left_anti")


def unfinished(wanted: DataFrame, done: DataFrame, unit: list[str], part: list[str]) -> DataFrame:
    """Work left: a unit counts as done only when it has as many parts as the fullest unit."""
    have = done.groupBy(*unit).agg(F.countDistinct(*part).alias("_n"))
    full = have.agg(F.max("_n").alias("_full"))
    finished = have.join(full, F.col("_n") == F.col("_full"), "left_semi")
    return wanted.join(finished, unit, "left_anti")


def relabel(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Ids numbered 1.. without gaps, in their order. Only distinct ids are ranked, in bands of 4096 numbers (or of three
    letters), so a key may hold any number of them."""
    ids = rows.select(*keys, label).distinct()
    band = F.substring(label, 1, 3) if ids.schema[label].dataType.simpleString() == "string" else F.floor(F.col(label) / 4096)
    new = banded_ordinal(ids, keys, band, [label], "_new")
    return rows.join(new, [*keys, label]).withColumn(label, (F.col("_new") + 1).cast("int")).drop("_new")


def collapse_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping cell masks as one map: the last cell wins the instance, the highest class wins the class."""
    return cells.groupBy(*keys, "y", "x").agg(F.max("cell").alias("instance"), F.max("class").alias("class"))


def batch_plan(volumes: DataFrame, requests: DataFrame) -> DataFrame:
    """Channel of every volume of a batch; volumes without a usable channel are skipped with a reason."""
    j = volumes.join(requests.select("volume_id", F.col("channel").alias("requested")), "volume_id", "left")
    j = j.withColumn("channel", channel_choice(F.col("requested"), F.col("default_channel"), F.col("rgb_channel"), F.col("n_channels")))
    reason = F.when(F.col("requested").isNull(), "skipped: no channel chosen").otherwise(F.concat(F.lit("skipped: no channel "), F.col("requested")))
    return j.withColumn("status", F.when(F.col("channel").isNull(), reason).otherwise("queued")).select("volume_id", "channel", "status")


def batch_summary(plan: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per volume of the batch: its result, or why there is none. One bad file never hides the others."""
    f = failures.groupBy("volume_id").agg(F.min("error").alias("_e"))
    j = plan.join(results, "volume_id", "left").join(f, "volume_id", "left")
    status = F.when(F.col("_e").isNotNull(), F.concat(F.lit("failed: "), "_e")).when(F.col("status").startswith("skipped"), F.col("status")).otherwise("ok")
    return j.withColumn("status", status).drop("_e")


def fold_splits(cases: DataFrame, fold: str, n_folds: int, val_every: int = 5) -> DataFrame:
    """Train, validation and test membership per fold: a case is tested in its own fold; of the others every n-th (by
    hash) validates. n_folds is a fixed small number."""
    f = cases.withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    part = F.when(F.col(fold) == F.col("held_out"), "test").when(F.pmod(F.xxhash64("case"), F.lit(val_every)) == 0, "val").otherwise("train")
    return f.withColumn("split", part).select("held_out", "case", "split")


def selected(rows: DataFrame, selection: DataFrame, on: list[str], limit: int | None = None) -> DataFrame:
    """Rows named by a selection list with their split; limit keeps the first of each split, where a caller asks for it."""
    j = rows.join(selection, on)
    if limit is None:
        return j
    return j.withColumn("_k", F.row_number().over(Window.partitionBy("split").orderBy(*on))).where(F.col("_k") <= limit).drop("_k")


def combine_results(parts: list[tuple[str, DataFrame]], image: str = "image") -> DataFrame:
    """Result tables of several sources as one, columns that some lack filled with null, with source and sample."""
    out = None
    for name, df in parts:
        d = df.withColumn("setting", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out.withColumn("sample", F.split(image, "_")[0])


def export_volume(tables: dict[str, DataFrame], volume_id: str, path: str) -> DataFrame:
    """Everything of one volume written as one folder per table, and a manifest of row counts."""
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, t in tables.items():
        t.where(F.col("volume_id") == volume_id).write.mode("overwrite").parquet(f"{path}/{name}")
        m = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        manifest = m if manifest is None else manifest.unionByName(m)
    return manifest
