"""Exact distances: to masks (separable transform in linear time over column strips) and between points (grid levels)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import group_quantiles
from ..session import SLICE, by_shuffle, materialize
from . import runs as R

STRIP = 64
#: Rows of a strip up to which comparing all rows with each other costs less than the envelope.
SHORT = 512
#: Cells of the short strips that are solved at once.
CELLS = 1 << 19


def short_column_distances(f: np.ndarray, step: float) -> np.ndarray:
    """What column_distances gives, row against row: whole-array work for strips of few rows, where the envelope's many steps
    on a few cells cost more. f is one strip, or an array of strips of the same number of rows."""
    at = np.arange(f.shape[-2])
    out = np.full(f.shape, np.inf)
    for q in np.nonzero(np.isfinite(f).any(axis=(*range(f.ndim - 2), f.ndim - 1)))[0].tolist():
        np.minimum(out, f[..., q, None, :] + (step * step * (at - q) ** 2)[:, None], out=out)
    return out


def _whole_groups(batches, names: list[str]):
    """(table, number of its group for every row) of sorted batches, cut where the columns `names` change."""
    def changes(t):
        new = np.zeros(len(t), bool)
        for name in names:
            c = t.column(name).combine_chunks()
            a, b = c[1:], c[:-1]
            none = [x.is_null().to_numpy(zero_copy_only=False) for x in (a, b)]
            new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (none[0] != none[1])
        return new

    held: list[pa.Table] = []   # The last group's rows until it ends
    for b in batches:
        t = pa.Table.from_batches([b])
        if not len(t):
            continue
        ends = held and changes(pa.concat_tables([held[-1].slice(len(held[-1]) - 1), t.slice(0, 1)]))[1]
        new = changes(t)
        if not ends and not new.any():
            held.append(t)
            continue
        at = int(np.nonzero(new)[0][-1]) if new.any() else 0
        whole = pa.concat_tables([*held, t.slice(0, at)])
        held = [t.slice(at)]
        if len(whole):
            yield whole, np.cumsum(changes(whole))
    if held:
        whole = pa.concat_tables(held)
        yield whole, np.zeros(len(whole), np.int64)


def column_distances(f: np.ndarray, step: float) -> np.ndarray:
    """For every cell of a column the least f[y'] + (step (y - y'))^2 over its column, infinite where f has no finite cell.

    The lower envelope of parabolas (Felzenszwalb and Huttenlocher 2012) for all columns side by side: a parabola enters and
    leaves its column's stack once, so the time is proportional to the number of cells."""
    rows, cols = f.shape
    w = step * step
    stack, begins = np.zeros((rows, cols), np.int64), np.full((rows, cols), np.inf)
    top = np.full(cols, -1)
    lifted = f + w * np.arange(rows)[:, None] ** 2
    for q in np.nonzero(np.isfinite(f).any(axis=1))[0].tolist():
        c = np.nonzero(np.isfinite(f[q]))[0]
        while len(c):
            k = top[c]
            on = stack[k, c]   # Of an empty column this is the last row's place, and is not used
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = np.where(k < 0, -np.inf, (lifted[q, c] - lifted[on, c]) / (2 * w * (q - on)))
            lost = (k >= 0) & (cross <= np.where(k < 0, -np.inf, begins[k, c]))
            top[c[lost]] -= 1
            put, k = c[~lost], k[~lost] + 1
            stack[k, put], begins[k, put], top[put] = q, cross[~lost], k
            c = c[lost]
    first = np.zeros((rows, cols), np.int64)   # Which parabola of the stack is least from a row on
    level, col = np.nonzero(np.arange(rows)[:, None] <= top)
    start = np.maximum(np.ceil(begins[level, col]), 0)
    seen = start < rows
    np.maximum.at(first, (start[seen].astype(np.int64), col[seen]), level[seen])
    owner = np.take_along_axis(stack, np.maximum.accumulate(first, axis=0), axis=0)
    out = np.take_along_axis(f, owner, axis=0) + w * (np.arange(rows)[:, None] - owner) ** 2
    return np.where(top < 0, np.inf, out)



def distance_to_mask(queries: DataFrame, target: DataFrame, extents: DataFrame, spacing: tuple[float, float] = (1.0, 1.0),
                     keys: list[str] = SLICE) -> DataFrame:
    """Distance of every query pixel (given as runs) to the nearest target pixel of its slice: rows (keys, y, x, dist).
    Slices without target pixels give no rows.

    Along a row the nearest target pixel follows from the runs and the gaps between them. Runs and gaps are sent to
    strips of 64 columns; a strip holds one image height, so its size does not grow with the data, and its time is
    proportional to its cells. Sorted strips are streamed, and many small ones (single objects) solved side by side."""
    ext = extents.select(*keys, "height", "width").distinct()
    line = Window.partitionBy(*keys, "y").orderBy("x0")
    t = target.select(*keys, "y", "x0", "x1").join(ext, keys).withColumns({"_prev": F.lag("x1").over(line), "_next": F.lead("x0").over(line)})
    none = F.lit(None).cast("int")
    on = F.struct(F.col("x0").alias("a"), F.col("x1").alias("b"), none.alias("left"), none.alias("right"), F.lit(0).alias("kind"))
    before = F.struct(F.coalesce(F.col("_prev"), F.lit(0)).alias("a"), F.col("x0").alias("b"), (F.col("_prev") - 1).alias("left"),
                      F.col("x0").alias("right"), F.lit(1).alias("kind"))
    after = F.when(F.col("_next").isNull(), F.struct(F.col("x1").alias("a"), F.col("width").alias("b"), (F.col("x1") - 1).alias("left"),
                                                      none.alias("right"), F.lit(1).alias("kind")))
    segs = t.select(*keys, "y", "height", F.explode(F.filter(F.array(on, before, after), lambda s: s.isNotNull() & (s["a"] < s["b"]))).alias("s")).select(*keys, "y", "height", "s.*")
    q = queries.select(*keys, "y", "x0", "x1").join(ext.select(*keys, "height"), keys).select(
        *keys, "y", "height", F.col("x0").alias("a"), F.col("x1").alias("b"), none.alias("left"), none.alias("right"), F.lit(2).alias("kind"))
    parts = segs.unionByName(q)
    parts = parts.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("a") / STRIP), F.floor((F.col("b") - 1) / STRIP))))
    out_schema = T.StructType([parts.schema[k] for k in keys] + [T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("dist", T.DoubleType())])
    sy, sx = float(spacing[0]), float(spacing[1])

    def solve(table: pa.Table, group: np.ndarray) -> pa.Table:
        get = {c: table.column(c).to_numpy() for c in ("y", "a", "b", "left", "right", "kind")}
        base, rows = table.column("_strip").to_numpy() * STRIP, table.column("height").to_numpy()[0]

        def cells(which):
            """Row numbers of the table, once per cell of the strip that the row covers, and the cells' x."""
            at = np.nonzero(which)[0]
            a, b = np.maximum(get["a"][at], base[at]), np.minimum(get["b"][at], base[at] + STRIP)
            n = b - a
            return np.repeat(at, n), np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

        at, x = cells(get["kind"] < 2)
        gap = np.where(get["kind"][at] == 0, 0.0, np.fmin(x - get["left"][at], get["right"][at] - x))
        best = np.full((group[-1] + 1, rows, int(np.minimum(get["b"] - base, STRIP).max())), np.inf)
        best[group[at], get["y"][at], x - base[at]] = (gap * sx) ** 2
        at, x = cells(get["kind"] == 2)
        if len(at):
            best = short_column_distances(best, sy) if rows <= SHORT else np.stack([column_distances(f, sy) for f in best])
        y = get["y"][at]
        out = [table.column(k).take(pa.array(at)) for k in keys]
        out += [pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(np.sqrt(best[group[at], y, x - base[at]]), pa.float64())]
        return pa.Table.from_arrays(out, names=[*keys, "y", "x", "dist"])

    def run(batches):
        for table, group in _whole_groups(batches, [*keys, "_strip"]):
            rows = table.column("height").to_numpy()[np.nonzero(np.diff(group, prepend=-1))[0]]
            for h in np.unique(rows).tolist():   # Strips of one height are solved side by side
                alike, some = np.nonzero(rows == h)[0], max(1, CELLS // (h * STRIP))
                for k in range(0, len(alike), some):
                    part = alike[k:k + some]
                    mine = np.isin(group, part)
                    yield from solve(table.filter(pa.array(mine)), np.searchsorted(part, group[mine])).to_batches()

    # Empty strips of a slice whose target lies elsewhere still have gap segments, so only slices without target drop out
    strips = parts.repartition(*keys, "_strip").sortWithinPartitions(*keys, "_strip")
    return by_shuffle(strips.mapInArrow(run, out_schema).where(F.col("dist") < float("inf")))


def distance_transform(runs: DataFrame, extents: DataFrame, spacing=(1.0, 1.0), keys: list[str] = SLICE) -> DataFrame:
    """Distance of every pixel to the nearest mask pixel."""
    full = extents.select(*keys, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.lit(0).alias("x0"), F.col("width").alias("x1"))
    return distance_to_mask(full, runs, extents, spacing, keys)


def _side(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias(name))


def _both_ways(asked: tuple[DataFrame, DataFrame], targets: tuple[DataFrame, DataFrame], extents: DataFrame, spacing, keys: list[str]) -> DataFrame:
    """Distances from the first asked runs to the first target and from the second to the second, in one pass."""
    mark = lambda pair: pair[0].select(*keys, "y", "x0", "x1", F.lit(0).alias("_way")).unionByName(pair[1].select(*keys, "y", "x0", "x1", F.lit(1).alias("_way")))
    ways = extents.select(*keys, "height", "width").distinct().withColumn("_way", F.explode(F.array(F.lit(0), F.lit(1))))
    return distance_to_mask(mark(asked), mark(targets), ways, spacing, [*keys, "_way"])


def hd95(pred: DataFrame, ref: DataFrame, extents: DataFrame, spacing=(1.0, 1.0), keys: list[str] = SLICE) -> DataFrame:
    """95th percentile of the distances from each boundary to the other mask, both directions pooled. Null when a mask
    is empty."""
    d = materialize(_both_ways((R.boundary(pred, keys), R.boundary(ref, keys)), (ref, pred), extents, spacing, keys))
    q = group_quantiles(d, keys, "dist", {"hd95": 0.95})
    both = _side(pred, "_p", keys).join(_side(ref, "_r", keys), keys).select(*keys)
    return extents.select(*keys).distinct().join(both.join(q, keys), keys, "left")


def surface_dice(pred: DataFrame, ref: DataFrame, extents: DataFrame, tolerance: float, spacing=(1.0, 1.0), keys: list[str] = SLICE) -> DataFrame:
    """Share of both boundaries within the tolerance of the other boundary; 1 when both masks are empty, 0 when one is."""
    bp, br = materialize(R.boundary(pred, keys)), materialize(R.boundary(ref, keys))
    hits = _both_ways((bp, br), (br, bp), extents, spacing, keys).where(F.col("dist") <= tolerance).groupBy(*keys).agg(F.count("*").alias("_n"))
    out = (extents.select(*keys).distinct().join(_side(bp, "_p", keys), keys, "left").join(_side(br, "_r", keys), keys, "left")
           .join(hits, keys, "left"))
    value = (F.when(F.col("_p").isNull() & F.col("_r").isNull(), 1.0).when(F.col("_p").isNull() | F.col("_r").isNull(), 0.0)
             .otherwise(F.coalesce(F.col("_n"), F.lit(0)) / (F.col("_p") + F.col("_r"))))
    return out.select(*keys, value.alias("nsd"))


def nearest_neighbour(points: DataFrame, keys: list[str], coords: list[str], start: float = 8.0, crowd: int = 256, few: int = 4) -> DataFrame:
    """Distance of every point to its nearest other point of the group, null for a point on its own.

    Points at the same place answer each other at once. The rest are sought in the 3^d cells around them, on grids that
    double in size: a distance not above the cell size is final, so each level only carries the points still open.
    The first grid is made fine enough that no cell holds a crowd and cells hold few points on average, so no level pairs
    up a dense group and a point meets some dozens of others."""
    places = materialize(points.where(F.col(coords[0]).isNotNull()).groupBy(*keys, *coords).agg(F.count("*").alias("_n")))
    size = start
    cell = lambda g: [F.floor(F.col(c) / g).alias(f"_k{i}") for i, c in enumerate(coords)]
    while True:
        most, mean = places.groupBy(*keys, *cell(size)).count().agg(F.max("count"), F.avg("count")).first()
        if most is None or (most <= crowd and mean <= few) or size < 1e-9:
            break
        size /= 4 if most > crowd else 2
    found = places.where("_n > 1").select(*keys, *coords, F.lit(0.0).alias("nn"))
    alone = places.groupBy(*keys).agg(F.count("*").alias("_m"))
    open_ = places.where("_n = 1").join(alone.where("_m > 1").select(*keys), keys, "left_semi").drop("_n")
    spans = places.agg(*[(F.max(c) - F.min(c)).alias(c) for c in coords]).first()
    limit = max([float(spans[c] or 0.0) for c in coords] + [0.0])
    other = places.drop("_n")
    while True:
        open_ = materialize(open_)
        if open_.isEmpty():
            break
        near = open_
        for i, c in enumerate(coords):
            k = F.floor(F.col(c) / size)
            near = near.withColumn(f"_k{i}", F.explode(F.array(k - 1, k, k + 1)))
        names = [f"_k{i}" for i in range(len(coords))]
        b = other.select(*keys, *[F.col(c).alias(f"_b{c}") for c in coords], *cell(size))
        same = [F.col(c) == F.col(f"_b{c}") for c in coords]
        differ = ~same[0]
        for s in same[1:]:
            differ = differ | ~s
        d = F.sqrt(sum(((F.col(c) - F.col(f"_b{c}")) ** 2 for c in coords), F.lit(0.0)))
        best = by_shuffle(near).join(b, [*keys, *names]).where(differ).groupBy(*keys, *coords).agg(F.min(d).alias("nn"))
        last = size > limit
        done = materialize(best if last else best.where(F.col("nn") <= size))
        found = found.unionByName(done)
        if last:
            break
        open_ = open_.join(done, [*keys, *coords], "left_anti")
        size *= 2
    return points.join(by_shuffle(found.select(*keys, *coords, F.col("nn").alias("nearest_neighbour_um"))), [*keys, *coords], "left")
