"""Masks as run-length rows (keys, y, x0, x1), x1 exclusive, and mask algebra on them.

All set and morphology operators share one sweep: intervals become +1 / -1 events, a running sum along one image row
counts how many intervals cover each place, and the stretches with enough cover are the result. Windows run over one
image row, and the data that moves is the runs, not the pixels."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import SLICE, by_shuffle
from .grid import as_col


def encode_runs(pixels: DataFrame, keys: list[str] = SLICE, label: str | None = None) -> DataFrame:
    """Run-length encoding of mask pixels; with a label column, runs end where the label changes."""
    group = [*keys, "y"] + ([label] if label else [])
    start = F.col("x") - F.row_number().over(Window.partitionBy(*group).orderBy("x"))
    return (pixels.withColumn("_s", start).groupBy(*group, "_s")
            .agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_s"))


def encode_runs_from_pieces(pieces: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Runs of the same component that touch in a row become one run again."""
    line = Window.partitionBy(*keys, "y", "comp").orderBy("x0")
    opens = F.when(F.lag("x1").over(line) == F.col("x0"), 0).otherwise(1)
    count = Window.partitionBy(*keys, "y", "comp").orderBy("x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (pieces.withColumn("_o", opens).withColumn("_g", F.sum("_o").over(count)).groupBy(*keys, "y", "comp", "_g")
            .agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g"))


def decode_runs(runs: DataFrame) -> DataFrame:
    return by_shuffle(runs.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))).drop("x0", "x1"))


def covered(intervals: DataFrame, at_least: int = 1, keys: list[str] = SLICE, weight: str | None = None, exactly: bool = False) -> DataFrame:
    """Stretches of a row covered by at least (or exactly) so many intervals, as runs."""
    w = F.col(weight) if weight else F.lit(1)
    events = intervals.select(*keys, "y", F.inline(F.array(F.struct(F.col("x0").alias("x"), w.alias("d")),
                                                           F.struct(F.col("x1").alias("x"), (-w).alias("d")))))
    events = events.groupBy(*keys, "y", "x").agg(F.sum("d").alias("d"))
    line = Window.partitionBy(*keys, "y").orderBy("x")
    cum = F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    events = events.withColumn("_in", (cum == at_least) if exactly else (cum >= at_least))
    turns = events.withColumn("_was", F.coalesce(F.lag("_in").over(line), F.lit(False))).where(F.col("_in") != F.col("_was"))
    return turns.withColumn("x1", F.lead("x").over(line)).where("_in").select(*keys, "y", F.col("x").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))


def union(a: DataFrame, b: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    return covered(_both(a, b, keys), 1, keys)


def intersection(a: DataFrame, b: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    return covered(_both(a, b, keys), 2, keys)


def difference(a: DataFrame, b: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    cols = [*keys, "y", "x0", "x1"]
    both = a.select(*cols, F.lit(1).alias("w")).unionByName(b.select(*cols, F.lit(-1).alias("w")))
    return covered(both, 1, keys, "w")


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    return covered(_both(a, b, keys), 1, keys, exactly=True)


def _both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    cols = [*keys, "y", "x0", "x1"]
    return a.select(*cols).unionByName(b.select(*cols))


def complement(runs: DataFrame, extents: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Background runs inside the image; extents has keys, height and width."""
    full = extents.select(*keys, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.lit(0).alias("x0"), F.col("width").alias("x1"))
    return difference(full, runs, keys)


def diamond(n: int) -> dict[int, int]:
    """Rows of the L1 ball of radius n (n rounds of the four-neighbour cross): row offset -> half width."""
    return {dy: n - abs(dy) for dy in range(-n, n + 1)}


def disk(r: int) -> dict[int, int]:
    return {dy: int(math.isqrt(r * r - dy * dy)) for dy in range(-r, r + 1)}


def square(n: int) -> dict[int, int]:
    return {dy: n for dy in range(-n, n + 1)}


def _offsets(shape: dict[int, int]):
    return F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(e).alias("e")) for dy, e in shape.items()]))


def dilate(runs: DataFrame, shape: dict[int, int], extents: DataFrame | None = None, keys: list[str] = SLICE) -> DataFrame:
    """Dilation by a symmetric shape given as row offset -> half width, clipped to the image when extents are given."""
    spread = runs.select(*keys, "y", "x0", "x1", _offsets(shape).alias("o")).select(
        *keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x0") - F.col("o.e")).alias("x0"), (F.col("x1") + F.col("o.e")).alias("x1"))
    if extents is not None:
        spread = clip(spread, extents, keys)
    return covered(spread, 1, keys)


def clip(runs: DataFrame, extents: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Runs cut at the image border; extents is one small row per slice."""
    e = extents.select(*keys, "height", "width")
    out = runs.join(e, keys).where((F.col("y") >= 0) & (F.col("y") < F.col("height")))
    return (out.withColumns({"x0": F.greatest(F.col("x0"), F.lit(0)), "x1": F.least(F.col("x1"), F.col("width"))})
            .where(F.col("x0") < F.col("x1")).select(*keys, "y", "x0", "x1"))


def erode(runs: DataFrame, shape: dict[int, int], keys: list[str] = SLICE, extents: DataFrame | None = None) -> DataFrame:
    """Erosion: a place survives when the shape around it is covered in every row. Outside counts as background, or as
    inside when extents are given (the border value 1 of bone surfaces)."""
    src = runs.select(*keys, "y", "x0", "x1")
    if extents is not None:
        pad = max(max(shape), max(shape.values()))
        e = extents.select(*keys, "height", "width")
        src = src.join(e, keys).withColumns({"x0": F.when(F.col("x0") == 0, F.lit(-pad)).otherwise(F.col("x0")),
                                             "x1": F.when(F.col("x1") == F.col("width"), F.col("width") + pad).otherwise(F.col("x1"))})
        src = src.select(*keys, "y", "x0", "x1")
        rows = F.concat(F.sequence(F.lit(-pad), F.lit(-1)), F.sequence(F.col("height"), F.col("height") + pad - 1))
        src = src.unionByName(e.select(*keys, F.explode(rows).alias("y"), F.lit(-pad).alias("x0"), (F.col("width") + pad).alias("x1")))
    shrunk = src.select(*keys, "y", "x0", "x1", _offsets(shape).alias("o")).select(
        *keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x0") + F.col("o.e")).alias("x0"), (F.col("x1") - F.col("o.e")).alias("x1"))
    out = covered(shrunk.where(F.col("x0") < F.col("x1")), len(shape), keys)
    return clip(out, extents, keys) if extents is not None else out


def smooth(runs: DataFrame, r: int, extents: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Opening, then closing, with a disk."""
    d = disk(r)
    opened = dilate(erode(runs, d, keys), d, extents, keys)
    # Closing erodes with outside as background, as the opening did
    return erode(dilate(opened, d, extents, keys), d, keys)


def boundary(runs: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Mask minus its erosion by the four-neighbour cross; the image border counts as boundary."""
    return difference(runs, erode(runs, diamond(1), keys), keys)


def surface_boundary(runs: DataFrame, extents: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Mask cells that touch background in the 3 x 3 square; the image border is not a surface."""
    return difference(runs, erode(runs, square(1), keys, extents), keys)


def area(runs: DataFrame, keys: list[str] = SLICE, out: str = "n_px") -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias(out))
