"""Operators on dense pixel rows (keys, y, x, value): normalising, resampling, smoothing, pooling, patch features.

Stencils run on tiles with a halo (tiles.py): one exchange a chain, whatever the number of pixels of a slice. Statistics of
a slice are aggregates with map-side combine that are joined back; Spark broadcasts them only while they are below its size
threshold."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import group_quantiles
from ..functions.vectors import l2_normalize
from ..session import SLICE, by_shuffle, materialize
from . import tiles

# Stain matrix of haematoxylin, eosin and DAB (Ruifrok and Johnston 2001), rows are stains
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))


def as_col(n) -> Column:
    """An image size given as a number or as a column."""
    return n if isinstance(n, Column) else F.lit(n)


# ---------- value transforms ----------

def normalize_planes(df: DataFrame, low: float = 1.0, high: float = 99.5, keys: list[str] = SLICE, value: str = "value",
                     floor: float = 1e-8) -> DataFrame:
    """Clip to two percentiles of the plane and rescale to 0..1. A plane with no range becomes 0. Colour planes share
    one pair of percentiles when keys leaves the colour out."""
    q = group_quantiles(df, keys, value, {"_lo": low / 100, "_hi": high / 100})
    span = F.col("_hi") - F.col("_lo")
    scaled = F.least(F.greatest((F.col(value) - F.col("_lo")) / span, F.lit(0.0)), F.lit(1.0))
    return df.join(q, keys).withColumn(value, F.when(span < floor, 0.0).otherwise(scaled)).drop("_lo", "_hi")


def rescale01(df: DataFrame, keys: list[str] = SLICE, value: str = "value") -> DataFrame:
    r = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(r, keys).withColumn(value, F.when(span < 1e-12, 0.0).otherwise((F.col(value) - F.col("_lo")) / span)).drop("_lo", "_hi")


def luminance(df: DataFrame, keys: list[str] = SLICE, value: str = "value") -> DataFrame:
    """Mean over the colour channels."""
    return df.groupBy(*keys, "y", "x").agg(F.avg(value).alias(value))


def colour_pixels(df: DataFrame, channels: tuple[int, int, int] = (0, 1, 2), keys: list[str] = SLICE, value: str = "value") -> DataFrame:
    """Three channel rows of a pixel become one row with an (r, g, b) array."""
    pick = [F.max(F.when(F.col("channel") == c, F.col(value))) for c in channels]
    return df.where(F.col("channel").isin(*channels)).groupBy(*keys, "y", "x").agg(F.array(*pick).alias("rgb"))


def virtual_colour_channel(channels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Channel table with an extra colour row for volumes of three or four 8-bit channels."""
    rgb = (volumes.where(F.col("n_channels").between(3, 4) & (F.col("dtype") == "uint8"))
           .select("volume_id", F.col("n_channels").alias("channel"), F.lit("Colour").alias("name")))
    return channels.unionByName(rgb)


def stain_channel(df: DataFrame, kind: str, keys: list[str] = SLICE) -> DataFrame:
    """One channel in which stain is bright, from 8-bit (r, g, b) columns, clipped to the 1st and 99.5th percentiles."""
    r, g, b = (F.col(c) / 255.0 for c in "rgb")
    if kind == "green":
        v = 1 - g
    elif kind == "gray":
        v = 1 - (r + g + b) / 3
    elif kind == "od":
        v = -(sum((F.log(F.greatest(c, F.lit(1 / 255))) for c in (r, g, b)), F.lit(0.0))) / 3
    elif kind == "hema":
        inverse = np.linalg.inv(np.array(STAINS))
        low = math.log(1e-6)
        v = F.greatest(sum((F.log(F.greatest(c, F.lit(1e-6))) / low * float(inverse[i, 0]) for i, c in enumerate((r, g, b))), F.lit(0.0)), F.lit(0.0))
    else:
        raise ValueError(f"Unknown stain channel {kind}")
    out = df.select(*keys, "y", "x", v.alias("value"))
    return _clip_rescale(out, keys)


def _clip_rescale(df: DataFrame, keys: list[str]) -> DataFrame:
    q = group_quantiles(df, keys, "value", {"_lo": 0.01, "_hi": 0.995})
    scaled = (F.col("value") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6))
    return df.join(q, keys).withColumn("value", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def above_quantile(df: DataFrame, q: float = 0.85, keys: list[str] = SLICE, value: str = "value") -> DataFrame:
    """Cells strictly above a quantile of their slice (the stained cells)."""
    cut = group_quantiles(df, keys, value, {"_cut": q})
    return df.join(cut, keys).where(F.col(value) > F.col("_cut")).drop("_cut")


# ---------- stencils ----------

def _line(keys: list[str], axis: str, other: list[str]):
    return Window.partitionBy(*keys, *other).orderBy(axis)


def box_mean(df: DataFrame, r: int, height, width, cols: list[str] = ["value"], keys: list[str] = SLICE) -> DataFrame:
    """Mean over the (2r+1) square around every cell, with repeated edge samples, for several columns at once. Missing
    cells and nulls are left out of the means."""
    return tiles.stencil(df, lambda p, _: {c: tiles.box(p[c], r) for c in cols}, (r, r), (height, width), cols, cols, keys)


def gaussian_kernel(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return [float(v) for v in k / k.sum()]


def smooth_axis(df: DataFrame, axis: str, n, sigma: float, lines: list[str], value: str = "value", mode: str = "reflect") -> DataFrame:
    """Gaussian smoothing along one axis, the kernel cut at four standard deviations. lines tell the rows of a line; the
    last of them is the other axis of the tiles."""
    if sigma <= 0:
        return df
    kernel = gaussian_kernel(sigma)
    step = lambda p, _: {value: tiles.convolve(p[value], kernel, 0)}
    return tiles.stencil(df, step, (len(kernel) // 2, 0), (n, None), [value], [value], lines[:-1], (axis, lines[-1]), mode=mode)


def gaussian_blur(df: DataFrame, sigma: tuple[float, float], height, width, keys: list[str] = SLICE, value: str | list[str] = "value") -> DataFrame:
    kernels, values = [gaussian_kernel(s) if s > 0 else [1.0] for s in sigma], [value] if isinstance(value, str) else value
    step = lambda p, _: {v: tiles.convolve(tiles.convolve(p[v], kernels[0], 0), kernels[1], 1) for v in values}
    return tiles.stencil(df, step, (len(kernels[0]) // 2, len(kernels[1]) // 2), (height, width), values, values, keys)


def smooth_z(df: DataFrame, sigma: float, n_z, value: str = "value") -> DataFrame:
    """Gaussian smoothing through a stack, the ends mirrored."""
    return smooth_axis(df, "z", n_z, sigma, ["volume_id", "y", "x"], value, mode="mirror")


def shift_plane(df: DataFrame, dy: float, dx: float, height, width, keys: list[str] = SLICE, value: str = "value") -> DataFrame:
    """Image moved by (-dy, -dx): position (y, x) takes the bilinear sample at (y + dy, x + dx), edges reflected."""
    reach = math.ceil(max(abs(dy), abs(dx))) + 1
    return tiles.stencil(df, lambda p, _: {value: tiles.shifted(p[value], dy, dx, reach)}, (reach, reach), (height, width), [value], [value], keys)


# ---------- resampling ----------

def _resize_axis(df: DataFrame, axis: str, lines: list[str], n_in, n_out, values: list[str]) -> DataFrame:
    """Linear resize of one axis. Every sample meets its successor in a window over the line and writes the outputs
    that lie between the two, so the resized rows are made without a shuffle of their own."""
    n_in, n_out = as_col(n_in), as_col(n_out)
    w = Window.partitionBy(*lines).orderBy(axis)
    i = F.col(axis)
    df = df.withColumns({f"_next_{v}": F.coalesce(F.lead(v).over(w), F.col(v)) for v in values})
    lo = F.when(i == 0, F.lit(0)).otherwise(F.greatest(F.floor((i + 0.5) * n_out / n_in - 0.5).cast("int") - 1, F.lit(0)))
    hi = F.when(i == n_in - 1, n_out - 1).otherwise(F.least(F.ceil((i + 1.5) * n_out / n_in - 0.5).cast("int") + 1, n_out - 1))
    df = df.withColumn("_o", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))))
    src = F.greatest((F.col("_o") + 0.5) * n_in / n_out - 0.5, F.lit(0.0))
    df = df.withColumn("_s", src).where(F.least(F.floor("_s").cast("int"), n_in - 1) == i)
    f = F.col("_s") - i
    df = df.withColumns({v: F.col(v) * (1 - f) + F.col(f"_next_{v}") * f for v in values})
    return df.withColumn(axis, F.col("_o")).drop("_o", "_s", *[f"_next_{v}" for v in values])


def upsample(df: DataFrame, in_size: tuple[Column, Column], out_size: tuple[Column, Column], keys: list[str] = SLICE,
             axes: tuple[str, str] = ("gy", "gx"), values: list[str] = ["value"]) -> DataFrame:
    """Bilinear resize with half-pixel centres from (axes) to (y, x)."""
    df = _resize_axis(df, axes[1], [*keys, axes[0]], in_size[1], out_size[1], values)
    df = _resize_axis(df, axes[0], [*keys, axes[1]], in_size[0], out_size[0], values)
    return by_shuffle(df.withColumnsRenamed({axes[0]: "y", axes[1]: "x"}) if axes != ("y", "x") else df)


def nearest_resize(df: DataFrame, in_size: tuple[Column, Column], out_size: tuple[Column, Column]) -> DataFrame:
    """Nearest-neighbour resize of label rows: every source cell writes the output cells that read it."""
    for axis, n_in, n_out in (("y", in_size[0], out_size[0]), ("x", in_size[1], out_size[1])):
        i, n_in, n_out = F.col(axis), as_col(n_in), as_col(n_out)
        lo = F.greatest(F.floor(i * n_out / n_in - 0.5).cast("int") - 1, F.lit(0))
        hi = F.least(F.ceil((i + 1) * n_out / n_in - 0.5).cast("int") + 1, n_out - 1)
        places = F.filter(F.sequence(lo, hi), lambda o: F.floor((o + 0.5) * n_in / n_out).cast("int") == i)
        df = df.withColumn(axis, F.explode(F.when(lo <= hi, places).otherwise(F.array().cast("array<int>"))))
    return df


def block_mean(df: DataFrame, depth, height, width, fz: int = 1, f: int = 4, value: str = "value") -> DataFrame:
    """Mean of fz x f x f blocks; incomplete blocks at the far ends are left out."""
    depth, height, width = as_col(depth), as_col(height), as_col(width)
    whole = ((F.col("z") < F.floor(depth / fz) * fz) & (F.col("y") < F.floor(height / f) * f) & (F.col("x") < F.floor(width / f) * f))
    return (df.where(whole).groupBy("volume_id", F.floor(F.col("z") / fz).cast("int").alias("z"),
                                    F.floor(F.col("y") / f).cast("int").alias("y"), F.floor(F.col("x") / f).cast("int").alias("x"))
            .agg(F.avg(value).alias(value)))


def adaptive_pool(df: DataFrame, in_size: tuple[Column, Column], grid: tuple[int, int], keys: list[str] = SLICE, value: str = "value") -> DataFrame:
    """Mean over the bins of a coarser grid; neighbouring bins share a line when the sizes do not divide."""
    out = df
    for axis, g, n, k in (("y", "gy", in_size[0], grid[0]), ("x", "gx", in_size[1], grid[1])):
        i, n = F.col(axis), as_col(n)
        near = F.floor(i * k / n).cast("int")
        span = F.sequence(F.greatest(near - 1, F.lit(0)), F.least(near + 1, F.lit(k - 1)))
        out = out.withColumn(g, F.explode(F.filter(span, lambda b: (F.floor(b * n / k) <= i) & (i < F.ceil((b + 1) * n / k)))))
    return out.groupBy(*keys, "gy", "gx").agg(F.avg(value).alias(value))


def class_shares(df: DataFrame, in_size: tuple[Column, Column], grid: tuple[int, int], n_classes: int, keys: list[str] = SLICE) -> DataFrame:
    """Share of every patch covered by each class, one row per patch and class, zeros included."""
    shares = adaptive_pool_many(df, in_size, grid, {f"c{k}": F.when(F.col("label") == k, 1.0).otherwise(0.0) for k in range(n_classes)}, keys)
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"c{k}").alias("share")) for k in range(n_classes)])
    return shares.select(*keys, "gy", "gx", F.inline(pairs))


def adaptive_pool_many(df: DataFrame, in_size, grid, values: dict[str, Column], keys: list[str] = SLICE) -> DataFrame:
    packed = df.select(*keys, "y", "x", *[c.alias(n) for n, c in values.items()])
    for axis, g, n, k in (("y", "gy", in_size[0], grid[0]), ("x", "gx", in_size[1], grid[1])):
        i, n = F.col(axis), as_col(n)
        near = F.floor(i * k / n).cast("int")
        span = F.sequence(F.greatest(near - 1, F.lit(0)), F.least(near + 1, F.lit(k - 1)))
        packed = packed.withColumn(g, F.explode(F.filter(span, lambda b: (F.floor(b * n / k) <= i) & (i < F.ceil((b + 1) * n / k)))))
    return packed.groupBy(*keys, "gy", "gx").agg(*[F.avg(n).alias(n) for n in values])


def strided(df: DataFrame, f: int) -> DataFrame:
    """Every f-th row and column, coordinates divided by f."""
    return (df.where((F.col("y") % f == 0) & (F.col("x") % f == 0))
            .withColumns({"y": (F.col("y") / f).cast("int"), "x": (F.col("x") / f).cast("int")}))


def edge_xor(mask: DataFrame, height, width, keys: list[str] = SLICE) -> DataFrame:
    """Cells whose mask value differs from the cell above or to the left, the first line compared with the last.
    mask is dense with a 0/1 column 'value'."""
    out = mask
    for axis, n, other, name in (("y", height, ["x"], "_up"), ("x", width, ["y"], "_left")):
        w = _line(keys, axis, other)
        last = F.max(F.when(F.col(axis) == n - 1, F.col("value"))).over(Window.partitionBy(*keys, *other))
        out = out.withColumn(name, F.coalesce(F.lag("value").over(w), last))
    return out.where((F.col("value") != F.col("_up")) | (F.col("value") != F.col("_left"))).drop("_up", "_left")


# ---------- edge-preserving smoothing ----------

def guided_filter(df: DataFrame, r: int, eps: float, height, width, keys: list[str] = SLICE) -> DataFrame:
    """Guided filter (He, Sun and Tang 2013): 'value' is smoothed where 'guide' is flat and keeps the guide's edges. Both
    steps run on one tile that reaches over 2r cells."""
    step = lambda p, _: {"value": tiles.guided(p["guide"], p["value"], r, eps)}
    return tiles.stencil(df, step, (2 * r, 2 * r), (height, width), ["guide", "value"], ["value"], keys)


# ---------- patch vectors ----------

def context_mean(patches: DataFrame, dim: int, context: int = 5, passes: int = 1, keys: list[str] = SLICE, append: bool = True) -> DataFrame:
    """Mean vector of the square of patches around each patch, over the patches that exist, appended to its own."""
    k = context * passes
    k += 1 - k % 2
    r = k // 2
    # Components travel as columns: one window per axis averages all of them
    wide = patches.select("*", *[F.col("vec")[i].cast("double").alias(f"_c{i}") for i in range(dim)])
    for axis, other in (("gx", ["gy"]), ("gy", ["gx"])):
        w = Window.partitionBy(*keys, *other).orderBy(axis).rangeBetween(-r, r)
        wide = wide.select(*[c for c in wide.columns if not c.startswith("_c")], *[F.avg(f"_c{i}").over(w).alias(f"_c{i}") for i in range(dim)])
    mean = F.array(*[F.col(f"_c{i}") for i in range(dim)])
    own = F.transform("vec", lambda e: e.cast("double"))
    return wide.withColumn("vec", F.concat(own, mean) if append else mean).drop(*[f"_c{i}" for i in range(dim)])


def z_context(patches: DataFrame, d: int, n_z) -> DataFrame:
    """Vectors with the normalised mean of the vectors d slices below and above appended; the stack ends repeat."""
    if d <= 0:
        return patches
    cell = ["volume_id", "gy", "gx"]
    src = patches.select(*cell, F.col("z").alias("_z"), F.col("vec").alias("_vec"))
    below = src.withColumnsRenamed({"_z": "_zb", "_vec": "_below"})
    above = src.withColumnsRenamed({"_z": "_za", "_vec": "_above"})
    out = (patches.withColumns({"_zb": F.greatest(F.col("z") - d, F.lit(0)), "_za": F.least(F.col("z") + d, as_col(n_z) - 1)})
           .join(below, [*cell, "_zb"]).join(above, [*cell, "_za"]))
    near = l2_normalize(F.zip_with("_below", "_above", lambda a, b: (a.cast("double") + b.cast("double")) / 2))
    return out.withColumn("vec", F.concat(F.transform("vec", lambda e: e.cast("double")), near)).drop("_zb", "_za", "_below", "_above")


def _statistics(v: np.ndarray, there: np.ndarray, ends: tuple[bool, bool], patch: int) -> dict:
    """What patch_statistics needs of each patch. v: the tile and one cell more on each side; ends: whether the image ends
    with the tile, where no neighbour is left."""
    own = v[1:-1, 1:-1]
    slopes = []
    for axis, ahead in ((0, v[2:, 1:-1]), (1, v[1:-1, 2:])):
        d = np.nan_to_num(ahead - own)
        if ends[axis]:
            d[(slice(None),) * axis + (-1,)] = 0.0
        slopes.append(d)
    strength = np.where(there, np.sqrt(slopes[1] * slopes[1] + slopes[0] * slopes[0]), np.nan)
    own = np.where(there, own, np.nan)
    out = {}
    for j, a in ((0, own), (4, strength)):
        cells = tiles.by_patch(a, patch, np.nan)
        seen = ~np.isnan(cells)
        n = seen.sum(axis=1)
        total, squares = np.where(seen, cells, 0.0).sum(axis=1), np.where(seen, cells * cells, 0.0).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = total / n
            spread = np.sqrt(np.maximum(squares / n - mean * mean, 0.0))
        none = np.where(n > 0, 0.0, np.nan)
        out |= {f"f{j}": mean, f"f{j + 1}": spread, f"f{j + 2}": np.where(seen, cells, -np.inf).max(axis=1) + none, f"f{j + 3}": np.where(seen, cells, np.inf).min(axis=1) + none}
        if j == 0:
            out |= {"_n": n, "_sum": total, "_values": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(cells[seen], pa.float64()))}
    return out


_PATCH_FIELDS = [T.StructField(f"f{i}", T.DoubleType()) for i in range(8)] + [
    T.StructField("_n", T.LongType()), T.StructField("_sum", T.DoubleType()), T.StructField("_values", T.ArrayType(T.DoubleType())), T.StructField("_copy", T.IntegerType())]


def _standardised(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Columns f0..f13 of the patches that _statistics describes. Every pixel is read once, in its tile; only patches meet the
    level of their slice."""
    cells = materialize(cells)
    level = cells.groupBy(*keys).agg((F.sum("_sum") / F.sum("_n")).alias("_level"))
    above = F.size(F.filter("_values", lambda v: v > F.col("_level"))) / F.col("_n")
    cells = cells.join(level, keys).withColumns({"f12": F.lit(0.5), "f13": F.when(F.col("_n") > 0, above)}).drop("_n", "_sum", "_values", "_level")
    for name, diff, k in (("f8", "f9", 3), ("f10", "f11", 7)):
        for axis, other in (("gx", ["gy"]), ("gy", ["gx"])):
            w = Window.partitionBy(*keys, *other).orderBy(axis).rangeBetween(-(k // 2), k // 2)
            cells = cells.withColumn(name, F.avg("f0" if axis == "gx" else name).over(w))
        cells = cells.withColumn(diff, F.col("f0") - F.col(name))
    names = [f"f{i}" for i in range(14)]
    cells = materialize(cells)
    m = cells.groupBy(*keys).agg(*[F.avg(n).alias(f"_m{n}") for n in names], *[F.stddev_samp(n).alias(f"_s{n}") for n in names])
    scaled = [((F.col(n) - F.col(f"_m{n}")) / (F.coalesce(F.col(f"_s{n}"), F.lit(0.0)) + 1e-6)).alias(n) for n in names]
    return cells.join(m, keys).select(*keys, "gy", "gx", *scaled)


def patch_statistics(df: DataFrame, patch: int = 14, keys: list[str] = SLICE) -> DataFrame:
    """14 statistics per patch, standardised over the slice, as columns f0..f13: mean, spread, maximum and minimum of
    intensity and of gradient strength, the means at two larger scales with the differences to them, a constant and
    the share of pixels above the slice mean. A cell without a neighbour to the right or below has no gradient that way."""
    def step(p, inside, there):
        v = p["value"]
        return [_statistics(v, there, tuple(s.stop == n - 1 for s, n in zip(inside, v.shape)), patch) | {"_copy": np.zeros(len(tiles.by_patch(there, patch, False)), np.int32)}]

    cells = tiles.patches(df, step, (1, 1), (None, None), patch, ["value"], _PATCH_FIELDS, keys)
    return _standardised(cells.drop("_copy"), keys)


def projection(n_raw: int = 14, dim: int = 64, seed: int = 0) -> np.ndarray:
    """Fixed random matrix that lifts the patch statistics to vectors."""
    return np.random.default_rng(seed).standard_normal((n_raw, dim)) / math.sqrt(n_raw)


def _lifted(stats: DataFrame, dim: int) -> DataFrame:
    """Unit vectors of statistics f0..f13 by the fixed projection."""
    names = [f"f{i}" for i in range(14)]
    matrix = projection(14, dim)
    rest = [f for f in stats.schema.fields if f.name not in names]

    def lift(batches):
        for b in batches:
            f = np.stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1)
            v = f @ matrix
            v = v / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-12)[:, None]
            vec = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel(), pa.float64(), from_pandas=True), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in rest], vec], names=[*[f.name for f in rest], "vec"])

    return stats.mapInArrow(lift, T.StructType([*rest, T.StructField("vec", T.ArrayType(T.DoubleType()))]))


def patch_vectors(df: DataFrame, patch: int = 14, dim: int = 64, keys: list[str] = SLICE) -> DataFrame:
    """Unit vectors per patch from the patch statistics."""
    return _lifted(patch_statistics(df, patch, keys), dim)


def interleaved_vectors(df: DataFrame, passes: int, patch: int, height, width, dim: int = 64, keys: list[str] = SLICE) -> DataFrame:
    """Patch vectors of passes x passes shifted copies, interleaved into one finer grid. All copies come out of one tile:
    the shifts' reach, and one cell more for the gradients."""
    off = [((k + 0.5) / passes - 0.5) * patch for k in range(passes)]
    reach = max(math.ceil(abs(o)) for o in off) + 2

    def step(p, inside, there):
        v = p["value"]
        ends = tuple(s.stop == n - reach for s, n in zip(inside, v.shape))
        n = len(tiles.by_patch(there, patch, False))
        return [_statistics(tiles.shifted(v, dy, dx, reach - 1), there, ends, patch) | {"_copy": np.full(n, a * passes + b, np.int32)}
                for a, dy in enumerate(off) for b, dx in enumerate(off)]

    cells = tiles.patches(df, step, (reach, reach), (height, width), patch, ["value"], _PATCH_FIELDS, keys)
    v = _lifted(_standardised(cells, [*keys, "_copy"]), dim)
    return v.withColumns({"gy": F.col("gy") * passes + F.floor(F.col("_copy") / passes).cast("int"), "gx": F.col("gx") * passes + F.col("_copy") % passes}).drop("_copy")


def pixel_features(df: DataFrame, height, width, sigmas: tuple[float, ...] = (1.0, 2.0, 4.0), keys: list[str] = SLICE) -> DataFrame:
    """Intensity, edge strength and the two Hessian eigenvalues per pixel at several scales, one wide row per pixel. All
    scales come out of one tile: the blur's reach, and two cells more for the derivatives."""
    kernels = [gaussian_kernel(s) for s in sigmas]
    reach = max(len(k) // 2 for k in kernels) + 2
    names = [f"{n}{k}" for k in range(len(sigmas)) for n in ("level", "edge", "ridge", "valley")]

    def step(p, inside):
        out = {}
        core = [slice(reach - s.start, p["value"].shape[a] - reach - s.start) for a, s in enumerate(inside)]
        for k, kernel in enumerate(kernels):
            r = len(kernel) // 2
            g = tiles.convolve(tiles.convolve(p["value"], kernel, 0), kernel, 1)
            # Back to the part of the image that the tile holds: derivatives are one-sided at its true ends
            g = g[tuple(slice(max(s.start - r, 0), s.stop - r) for s in inside)]
            cut = [slice(c.start - max(r - s.start, 0), c.stop - max(r - s.start, 0)) for c, s in zip(core, inside)]
            made = _shape_features(g)
            out |= {f"{n}{k}": v[tuple(cut)] for n, v in made.items()}
        return out

    out = tiles.stencil(df.select(*keys, "y", "x", "value"), step, (reach, reach), (height, width), ["value"], names, keys)
    return out.select(*keys, "y", "x", *names)


def _slope(a: np.ndarray, axis: int) -> np.ndarray:
    """Central difference, one-sided at the ends."""
    return np.gradient(a, axis=axis) if a.shape[axis] > 1 else np.zeros_like(a)


def _three_taps(a: np.ndarray, axis: int, side: float, centre: float | None) -> np.ndarray:
    """Smoothing when a centre weight is given, a difference otherwise; the ends repeat."""
    a = np.moveaxis(a, axis, 0)
    before, after = np.concatenate([a[:1], a[:-1]]), np.concatenate([a[1:], a[-1:]])
    return np.moveaxis((after - before) * side if centre is None else (after + before) * side + a * centre, 0, axis)


def _shape_features(g: np.ndarray) -> dict[str, np.ndarray]:
    ex = _three_taps(_three_taps(g, 0, 0.25, 0.5), 1, 0.5, None)
    ey = _three_taps(_three_taps(g, 0, 0.5, None), 1, 0.25, 0.5)
    dy = _slope(g, 0)
    dyy, dxx, dxy = _slope(dy, 0), _slope(_slope(g, 1), 1), _slope(dy, 1)
    mid, gap = (dxx + dyy) / 2, np.sqrt(((dxx - dyy) / 2) ** 2 + dxy ** 2)
    return {"level": g, "edge": np.sqrt((ex ** 2 + ey ** 2) / 2), "ridge": mid + gap, "valley": mid - gap}
