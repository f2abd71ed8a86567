"""Neighbourhood operations on tiles of an image with a halo.

Pixel rows meet once, in tiles of bounded size that also hold the rows within reach of the tile; a whole chain of stencils
then runs on the tile's array. A chain costs one exchange, however many steps it has and however large the image is."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import SLICE

TILE = 256


def mirrored(p: np.ndarray, n: int, mode: str) -> np.ndarray:
    """Positions inside 0..n-1 that positions beyond both ends stand for: 'reflect' repeats the edge sample, 'mirror' does not."""
    if mode == "reflect":
        p = p % (2 * n)
        return np.where(p < n, p, 2 * n - 1 - p)
    if n == 1:
        return np.zeros_like(p)
    p = p % (2 * n - 2)
    return np.where(p < n, p, 2 * n - 2 - p)


def _targets(axis: str, reach: int, n: Column | None, tile: int) -> Column:
    """Numbers of the tiles that read the row."""
    i = F.col(axis)
    if reach == 0:
        return F.array(F.floor(i / tile).cast("int"))
    last = F.floor((n - 1) / tile).cast("int")
    return F.sequence(F.greatest(F.floor((i - reach) / tile).cast("int"), F.lit(0)), F.least(F.floor((i + reach) / tile).cast("int"), last))


def _dealt(df: DataFrame, reach: tuple[int, int], extent: tuple, axes: tuple[str, str], tile: int) -> DataFrame:
    """df once per tile that reads the row, with the tile's numbers and the image's size."""
    sizes = [e if isinstance(e, Column) else F.lit(e).cast("int") for e in extent]
    rows = df.withColumns({"_n0": sizes[0], "_n1": sizes[1]})
    for k in (0, 1):
        n = F.col(f"_n{k}")
        rows = rows.withColumn(f"_t{k}", F.explode(_targets(axes[k], reach[k], n, tile)) if reach[k] else F.floor(F.col(axes[k]) / tile).cast("int"))
    return rows


def _planes(table: pa.Table, reads: list[str], reach: tuple[int, int], axes: tuple[str, str], tile: int, mode: str) -> tuple:
    """Arrays of the tile with `reach` more cells on each side, where the image lies in them, the rows' positions, and the
    tile's start and end in the image."""
    at = [table.column(a).to_numpy() for a in axes]
    lo, hi, start, end, place = [], [], [], [], []
    for k in (0, 1):
        n = table.column(f"_n{k}")[0].as_py()
        n = int(at[k].max()) + 1 if n is None else n
        s = table.column(f"_t{k}")[0].as_py() * tile
        e = min(s + tile, n)
        start.append(s), end.append(e), lo.append(max(0, s - reach[k])), hi.append(min(n, e + reach[k]))
        place.append(mirrored(np.arange(s - reach[k], e + reach[k]), n, mode) - lo[k])
    inside = tuple(slice(reach[k] - min(reach[k], start[k]), hi[k] - start[k] + reach[k]) for k in (0, 1))
    planes = {}
    for c in reads:
        g = np.full((hi[0] - lo[0], hi[1] - lo[1]), np.nan)
        g[at[0] - lo[0], at[1] - lo[1]] = table.column(c).to_numpy().astype(float)
        planes[c] = g[np.ix_(*place)]
    return planes, inside, at, start, end


def stencil(df: DataFrame, step: Callable, reach: tuple[int, int], extent: tuple, reads: list[str], writes: list[str], keys: list[str] = SLICE,
            axes: tuple[str, str] = ("y", "x"), tile: int = TILE, mode: str = "reflect") -> DataFrame:
    """df with the columns `writes` that step makes of the columns `reads`; other columns stay as they are.

    step takes {name: array of the tile with `reach` more cells on each side} and where the image lies in those arrays (a
    pair of slices; cells outside repeat the image as `mode` says), and returns {name: array of the tile alone}. extent is
    the image's size along the axes, as numbers or columns; it may be None along an axis that is not reached over. Missing
    and null cells are NaN in the arrays, NaN results are null."""
    rows = _dealt(df, reach, extent, axes, tile)
    kept = [f for f in df.schema.fields if f.name not in writes]
    schema = T.StructType(kept + [T.StructField(w, T.DoubleType()) for w in writes])

    def run(table: pa.Table) -> pa.Table:
        planes, inside, at, start, end = _planes(table, reads, reach, axes, tile, mode)
        made = step(planes, inside)
        core = (at[0] >= start[0]) & (at[0] < end[0]) & (at[1] >= start[1]) & (at[1] < end[1])
        whole = core.all()
        out = table.select([f.name for f in kept])
        out = out if whole else out.filter(pa.array(core))
        y, x = (at[k] - start[k] if whole else at[k][core] - start[k] for k in (0, 1))
        for w in writes:
            out = out.append_column(w, pa.array(made[w][y, x], pa.float64(), from_pandas=True))
        return out

    return rows.groupBy(*keys, "_t0", "_t1").applyInArrow(run, schema)


def patches(df: DataFrame, step: Callable, reach: tuple[int, int], extent: tuple, patch: int, reads: list[str], writes: list[T.StructField], keys: list[str] = SLICE,
            axes: tuple[str, str] = ("y", "x"), tile: int = TILE, mode: str = "reflect") -> DataFrame:
    """Rows (keys, gy, gx, writes) per patch that holds a cell. A tile is a whole number of patches.

    step takes what it takes in stencil, and which cells of the tile are there; it returns one or more {name: values of the
    tile's patches in raster order (see by_patch)}, and a patch gets a row from each. An extent of None ends at the last cell
    that is there."""
    tile = max(1, tile // patch) * patch
    names = [*axes, *reads, "_n0", "_n1", "_t0", "_t1"]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("gy", T.IntegerType()), T.StructField("gx", T.IntegerType())] + writes)
    arrow = to_arrow_schema(schema)
    values = lambda v, name: v if isinstance(v, pa.Array) else pa.array(v, arrow.field(name).type, from_pandas=True)

    def run(table: pa.Table) -> pa.Table:
        first = [table.column(f"_t{k}")[0].as_py() * tile for k in (0, 1)]
        pos = [table.column(a).to_numpy() for a in axes]
        core = np.logical_and.reduce([(pos[k] >= first[k]) & (pos[k] < first[k] + tile) for k in (0, 1)])
        if not core.any():   # Only the neighbours of a tile beyond the image's end
            return arrow.empty_table()
        planes, inside, at, start, end = _planes(table.select(names), reads, reach, axes, tile, mode)
        there = np.zeros([end[k] - start[k] for k in (0, 1)], bool)
        there[at[0][core] - start[0], at[1][core] - start[1]] = True
        some = by_patch(there, patch, False).any(axis=1)
        i = np.nonzero(some)[0]
        across = -(-there.shape[1] // patch)
        gy, gx = i // across + start[0] // patch, i % across + start[1] // patch
        out = []
        for made in step(planes, inside, there):
            cols = [pa.array([table.column(k)[0].as_py()] * len(i), arrow.field(k).type) for k in keys] + [pa.array(gy, pa.int32()), pa.array(gx, pa.int32())]
            out.append(pa.Table.from_arrays(cols + [values(made[f.name], f.name).filter(pa.array(some)) for f in writes], schema=arrow))
        return pa.concat_tables(out)

    return _dealt(df.select(*keys, *axes, *reads), reach, extent, axes, tile).groupBy(*keys, "_t0", "_t1").applyInArrow(run, schema)


def by_patch(a: np.ndarray, patch: int, fill) -> np.ndarray:
    """Cells of every patch as one row, patches in raster order; patches over the end are filled up."""
    n, m = (-(-s // patch) for s in a.shape)
    whole = np.full((n * patch, m * patch), fill, a.dtype)
    whole[:a.shape[0], :a.shape[1]] = a
    return whole.reshape(n, patch, m, patch).swapaxes(1, 2).reshape(n * m, patch * patch)


# ---------- steps on arrays ----------

def _box_sum(a: np.ndarray, r: int) -> np.ndarray:
    for axis in (0, 1):
        c = np.cumsum(a, axis=axis)
        c = np.concatenate([np.zeros_like(np.take(c, [0], axis)), c], axis)
        n = a.shape[axis] - 2 * r
        c = np.moveaxis(c, axis, 0)
        a = np.moveaxis(c[2 * r + 1:2 * r + 1 + n] - c[:n], 0, axis)
    return a


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2r + 1 cells, over the cells that are there; r cells of each border go."""
    there = ~np.isnan(a)
    if there.all():
        return _box_sum(a, r) / (2 * r + 1) ** 2
    n = _box_sum(there.astype(float), r)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0.5, _box_sum(np.where(there, a, 0.0), r) / n, np.nan)


def convolve(a: np.ndarray, kernel: list[float], axis: int) -> np.ndarray:
    """Weighted sum along an axis; len(kernel) // 2 cells of both ends go."""
    a = np.moveaxis(a, axis, 0)
    n = len(a) - len(kernel) + 1
    out = np.zeros((n, *a.shape[1:]))
    for k, w in enumerate(kernel):
        out += w * a[k:k + n]
    return np.moveaxis(out, 0, axis)


def guided(guide: np.ndarray, value: np.ndarray, r: int, eps: float) -> np.ndarray:
    """Local linear fit of value on guide, averaged (He, Sun and Tang 2013); 2r cells of each border go."""
    mi, mp = box(guide, r), box(value, r)
    a = (box(guide * value, r) - mi * mp) / (box(guide * guide, r) - mi * mi + eps)
    core = tuple(slice(2 * r, n - 2 * r) for n in guide.shape)
    return box(a, r) * guide[core] + box(mp - a * mi, r)


def shifted(a: np.ndarray, dy: float, dx: float, reach: int) -> np.ndarray:
    """Bilinear sample at (y + dy, x + dx); reach cells of each border go."""
    for axis, d in ((0, dy), (1, dx)):
        whole = int(np.floor(d))
        f = d - whole
        a = np.moveaxis(a, axis, 0)
        n = len(a) - 2 * reach
        a = np.moveaxis(a[reach + whole:reach + whole + n] * (1 - f) + (a[reach + whole + 1:reach + whole + 1 + n] * f if f else 0.0), 0, axis)
    return a
