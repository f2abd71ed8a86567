"""Connected components of masks held as runs.

Runs are cut at block borders and labelled block by block (blocks have a fixed size, so no task grows with the data).
Only pieces that meet across a block border become edges of a graph, which is contracted with large and small stars
(Kiveris et al. 2014); every round is written to the checkpoint folder. A component is named by the linear index of
its first pixel in raster order, so the result does not depend on the partitioning."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordinals import banded_ordinal
from ..session import SLICE, materialize
from . import runs as R


def _block_labels(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, links: list[np.ndarray], reach: int) -> np.ndarray:
    """Lowest position of the connected group of every run; runs are sorted by (row, x0) and links are row offsets."""
    n = len(row)
    big = np.int64(x1.max() + 4)
    starts, ends = row * big + x0 + 1, row * big + x1 + 1
    src, dst = [], []
    for step in links:
        target = (row + step) * big
        lo = np.searchsorted(ends, target + x0 + 1 - reach, side="right")
        hi = np.searchsorted(starts, target + x1 + 1 + reach, side="left")
        count = np.maximum(hi - lo, 0)
        src.append(np.repeat(np.arange(n), count))
        dst.append(np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    a, b = np.concatenate(src), np.concatenate(dst)
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def label_components(runs: DataFrame, extents: DataFrame, connectivity: int = 8, keys: list[str] = SLICE,
                     block: int = 256, depth: int = 16) -> DataFrame:
    """Runs with a column comp. connectivity 4 and 8 label every slice, 6 labels whole volumes (keys without z).

    extents has keys, height and width (one row per slice, or per volume for connectivity 6)."""
    solid = connectivity == 6
    reach = 1 if connectivity == 8 else 0
    ext = extents.select(*keys, "height", "width").distinct()
    z = F.col("z").cast("long") if solid else F.lit(0).cast("long")
    cols = [*keys, "z", "y", "x0", "x1"] if solid else [*keys, "y", "x0", "x1"]
    pieces = runs.select(*cols).join(ext, keys)
    first, last = F.floor(F.col("x0") / block), F.floor((F.col("x1") - 1) / block)
    pieces = pieces.withColumn("_tx", F.explode(F.sequence(first, last)))
    pieces = pieces.withColumns({"x0": F.greatest(F.col("x0"), (F.col("_tx") * block)).cast("int"),
                                 "x1": F.least(F.col("x1"), ((F.col("_tx") + 1) * block)).cast("int"),
                                 "_ty": F.floor(F.col("y") / block), "_tz": F.floor(z / depth) if solid else F.lit(0).cast("long")})
    schema = T.StructType([f for f in pieces.schema.fields] + [T.StructField("comp", T.LongType())])

    def label(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        h, w = (np.int64(table.column(c)[0].as_py()) for c in ("height", "width"))
        zz = table.column("z").to_numpy().astype(np.int64) if solid else np.zeros(len(y), np.int64)
        order = np.lexsort((x0, y, zz))
        y, x0, x1, zz = y[order], x0[order], x1[order], zz[order]
        lines = np.int64(block + 2)
        row = (zz - zz.min()) * lines + y - y.min()
        root = _block_labels(row, x0 - x0.min(), x1 - x0.min(), [np.int64(1), lines] if solid else [np.int64(1)], reach)
        comp = np.empty(len(y), np.int64)
        comp[order] = ((zz * h + y) * w + x0)[root]
        return table.append_column("comp", pa.array(comp, pa.int64()))

    group = [*keys, "_tz", "_ty", "_tx"]
    pieces = materialize(pieces.groupBy(*group).applyInArrow(label, schema))
    blocks = pieces.agg(F.max(F.greatest("_tx", "_ty", "_tz")) > 0).first()[0]
    roots = contract(_border_edges(pieces, keys, block, depth, solid, reach), keys) if blocks else None
    if not blocks:
        return pieces.select(*cols, "comp")
    if roots is not None:
        pieces = (pieces.join(roots, [*keys, "comp"], "left")
                  .withColumn("comp", F.coalesce(F.col("root"), F.col("comp"))).drop("root"))
    # Pieces that were cut at a block border are joined up again
    merged = R.encode_runs_from_pieces(pieces, [*keys, "z"] if solid else keys)
    return merged


def _border_edges(pieces: DataFrame, keys: list[str], block: int, depth: int, solid: bool, reach: int) -> DataFrame:
    """Pairs of component names that touch across a block border. Every join has the image row among its keys, so a
    match only looks at runs of one row (of a bounded stretch of it)."""
    z = ["z"] if solid else []
    p = pieces.select(*keys, *z, "y", "x0", "x1", "comp", "_tx")
    right = p.where(F.col("x1") == (F.col("_tx") + 1) * block)
    left = p.where(F.col("x0") == F.col("_tx") * block).select(*keys, *z, F.col("y").alias("_y"), F.col("_tx"), F.col("comp").alias("b"))
    sideways = (right.select(*keys, *z, F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)).alias("_y"), (F.col("_tx") + 1).alias("_tx"), F.col("comp").alias("a"))
                .join(left, [*keys, *z, "_y", "_tx"]).select(*keys, "a", "b"))
    overlap = (F.col("x0") < F.col("_x1") + reach) & (F.col("_x0") < F.col("x1") + reach)
    low = p.where(F.col("y") % block == block - 1)
    high = p.where(F.col("y") % block == 0).select(*keys, *z, (F.col("y") - 1).alias("y"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"),
                                                   F.col("comp").alias("b"), "_tx")
    down = low.join(high, [*keys, *z, "y", "_tx"]).where(overlap).select(*keys, F.col("comp").alias("a"), "b")
    out = sideways.unionByName(down)
    if solid:
        here = p.where(F.col("z") % depth == depth - 1)
        above = p.where(F.col("z") % depth == 0).select(*keys, (F.col("z") - 1).alias("z"), "y", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"),
                                                         F.col("comp").alias("b"), "_tx")
        out = out.unionByName(here.join(above, [*keys, "z", "y", "_tx"]).where(overlap).select(*keys, F.col("comp").alias("a"), "b"))
    return out.where("a <> b")


def contract(edges: DataFrame, keys: list[str]) -> DataFrame | None:
    """Root (lowest name) of every vertex of the edge list, by alternating large-star and small-star rounds.
    Returns None when there are no edges."""
    def state(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def tidy(df):
        return df.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    e = materialize(tidy(edges))
    seen = state(e)
    if seen[0] == 0:
        return None
    while True:
        both = e.select(*keys, "a", "b").unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        large = tidy(large)
        lowest = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(lowest, [*keys, "a"])
        small = small.select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(*keys, "a", F.col("m").alias("b")))
        e = materialize(tidy(small))
        now = state(e)
        if now == seen:
            return e.select(*keys, F.col("a").alias("comp"), F.col("b").alias("root"))
        seen = now


def component_sizes(labelled: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    return labelled.groupBy(*keys, "comp").agg(F.sum(F.col("x1") - F.col("x0")).cast("long").alias("n_px"))


def number_components(labelled: DataFrame, extents: DataFrame, keys: list[str] = SLICE, solid: bool = False) -> DataFrame:
    """Runs with label 1..n in raster order of the first pixel, per slice (or per volume)."""
    ext = extents.select(*keys, "width").distinct()
    names = labelled.select(*keys, "comp").distinct().join(ext, keys)
    numbered = banded_ordinal(names, keys, F.floor(F.col("comp") / F.col("width")), ["comp"], "label")
    return labelled.join(numbered.select(*keys, "comp", (F.col("label") + 1).alias("label")), [*keys, "comp"])


def remove_small(runs: DataFrame, extents: DataFrame, min_px: int, keys: list[str] = SLICE, connectivity: int = 8) -> DataFrame:
    """Components of at least min_px pixels."""
    lab = label_components(runs, extents, connectivity, keys)
    keep = component_sizes(lab, keys).where(F.col("n_px") >= min_px).select(*keys, "comp")
    return lab.join(keep, [*keys, "comp"], "left_semi").drop("comp")


def _border_comps(lab: DataFrame, extents: DataFrame, keys: list[str]) -> DataFrame:
    e = extents.select(*keys, "height", "width").distinct()
    edge = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("width"))
    return lab.join(e, keys).where(edge).select(*keys, "comp").distinct()


def fill_small_holes(runs: DataFrame, extents: DataFrame, hole_px: int, keys: list[str] = SLICE) -> DataFrame:
    """Mask with background objects below hole_px pixels (diagonals connect) added, except pixels whose edge-connected
    background region reaches the image border."""
    back = R.complement(runs, extents, keys)
    eight = label_components(back, extents, 8, keys)
    small = component_sizes(eight, keys).where(F.col("n_px") < hole_px).select(*keys, "comp")
    candidates = eight.join(small, [*keys, "comp"], "left_semi").drop("comp")
    four = label_components(back, extents, 4, keys)
    outside = four.join(_border_comps(four, extents, keys), [*keys, "comp"], "left_semi").drop("comp")
    return R.union(runs, R.difference(candidates, outside, keys), keys)


def fill_holes(runs: DataFrame, extents: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Mask with every background region that does not reach the border filled."""
    back = label_components(R.complement(runs, extents, keys), extents, 4, keys)
    holes = back.join(_border_comps(back, extents, keys), [*keys, "comp"], "left_anti").drop("comp")
    return R.union(runs, holes, keys)


def clean_up(runs: DataFrame, extents: DataFrame, pixel_um: tuple[float, float] = (1.0, 1.0), smooth_px: int = 0,
             fill_holes_um2: float = 0.0, min_object_um2: float = 0.0, keys: list[str] = SLICE) -> DataFrame:
    """Smoothing, hole filling and removal of small objects; sizes in square micrometres."""
    px = pixel_um[0] * pixel_um[1]
    if smooth_px > 0:
        runs = R.smooth(runs, smooth_px, extents, keys)
    if fill_holes_um2 > 0:
        runs = fill_small_holes(runs, extents, max(1, int(fill_holes_um2 / px)), keys)
    if min_object_um2 > 0:
        runs = remove_small(runs, extents, max(1, int(min_object_um2 / px)), keys)
    return runs


def instances(runs: DataFrame, extents: DataFrame, min_px: int = 0, keys: list[str] = SLICE) -> DataFrame:
    """Filled objects (edge-connected) of at least min_px pixels, numbered again from 1."""
    lab = label_components(fill_holes(runs, extents, keys), extents, 4, keys)
    if min_px:
        keep = component_sizes(lab, keys).where(F.col("n_px") >= min_px).select(*keys, "comp")
        lab = lab.join(keep, [*keys, "comp"], "left_semi")
    return number_components(lab, extents, keys)


def largest(labelled: DataFrame, k: int, keys: list[str] = SLICE) -> DataFrame:
    """The k largest objects per slice with their rank. Ranks are cut in every task before the shuffle."""
    from pyspark.sql import Window
    sizes = component_sizes(labelled, keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("n_px"), "comp")
    return sizes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
