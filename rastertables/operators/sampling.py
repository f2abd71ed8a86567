"""Simulated points, prompts and crops. Draws are hashes of the seed and the pixel, so they do not depend on the
partitioning; distributions match the originals, single draws do not."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinals import uniform
from ..functions.quantiles import group_quantiles
from ..session import SLICE, materialize
from . import components as C
from . import distance as D
from . import runs as R
from .scoring import inside_boxes


def pick(region: DataFrame, n: Column | int, seed: int, tag: str, keys: list[str] = SLICE, by: list[str] | None = None) -> DataFrame:
    """n random pixels per slice from pixel rows; a region with fewer pixels is used again from the start. Only the best
    n hashes of a slice leave each task."""
    by = by or keys
    most = n if isinstance(n, int) else None
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.lit(tag), *keys, "y", "x"), "y", "x")
    r = region.withColumn("_k", F.row_number().over(w))
    r = r.where(F.col("_k") <= most) if most is not None else r.where(F.col("_k") <= n)
    r = materialize(r)   # At most n rows per slice
    have = r.groupBy(*by).agg(F.count("*").alias("_h"))
    want = F.lit(most) if most is not None else n
    # Slot k is served by pixel ((k - 1) mod h) + 1: each pixel is repeated as often as needed
    return (r.join(have, by).withColumn("ord", F.explode(F.sequence(F.col("_k"), F.greatest(want, F.col("_k")), F.col("_h").cast("int"))))
            .where(F.col("ord") <= want).select(*keys, "ord", "y", "x"))


def _or_else(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """First region, or the second on slices where the first is empty."""
    have = first.select(*keys).distinct()
    return first.unionByName(second.join(have, keys, "left_anti"))


def simulated_points(mask: DataFrame, extents: DataFrame, n_pos: int, n_neg: int, seed: int = 0, noisy: bool = False, margin: int = 10, keys: list[str] = SLICE) -> DataFrame:
    """Points inside and outside a mask (runs), away from its boundary when clean; noisy points lie anywhere and a tenth
    of each kind lands on the wrong side."""
    m = 0 if noisy else margin
    mask = materialize(mask)
    cols = [*keys, "y", "x0", "x1"]
    outside = R.complement(mask, extents, keys).select(*cols)
    inner = R.erode(mask, R.diamond(m), keys).select(*cols) if m else mask.select(*cols)
    outer = R.complement(R.dilate(mask, R.diamond(m), extents, keys), extents, keys).select(*cols) if m else outside
    inner, outer = materialize(_or_else(inner, mask.select(*cols), keys)), materialize(_or_else(outer, outside, keys))
    px = lambda r: R.decode_runs(r).select(*keys, "y", "x")
    wrong = lambda n: max(1, round(0.1 * n)) if noisy and n >= 5 else 0
    parts = [(pick(px(inner), n_pos, seed, "pos", keys).where(F.col("ord") > wrong(n_pos)), "pos"), (pick(px(outer), n_neg, seed, "neg", keys).where(F.col("ord") > wrong(n_neg)), "neg")]
    if wrong(n_pos):
        parts.append((pick(px(outside), wrong(n_pos), seed, "wrong-pos", keys), "pos"))
    if wrong(n_neg):
        parts.append((pick(px(mask.select(*cols)), wrong(n_neg), seed, "wrong-neg", keys), "neg"))
    out = None
    for p, polarity in parts:
        p = p.withColumn("polarity", F.lit(polarity))
        out = p if out is None else out.unionByName(p)
    return out


def points_over_objects(instances: DataFrame, image: DataFrame, extents: DataFrame, n_pos: int, n_neg: int, seed: int = 0, inner_margin: int = 5, outer_margin: int = 10,
                        quantile: float = 0.85, keys: list[str] = SLICE) -> DataFrame:
    """Positive points spread over the objects (one per object while they last, then anywhere inside); half of the
    negatives on stained look-alikes. instances: runs with comp."""
    mask = materialize(R.encode_runs(R.decode_runs(instances).select(*keys, "y", "x"), keys))
    inner = R.decode_runs(_or_else(R.erode(mask, R.diamond(inner_margin), keys), mask.select(*keys, "y", "x0", "x1"), keys))
    inner = materialize(inner.join(R.decode_runs(instances).select(*keys, "y", "x", "comp"), [*keys, "y", "x"]))
    draw = F.xxhash64(F.lit(seed), *keys, "y", "x")
    first = inner.withColumn("_d", draw).groupBy(*keys, "comp").agg(F.min_by(F.struct("y", "x"), F.struct("_d", "y", "x")).alias("p"))
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "comp"), "comp")
    one = first.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= n_pos).select(*keys, "ord", "p.y", "p.x")
    served = one.groupBy(*keys).agg(F.count("*").alias("_s"))
    more = pick(inner.select(*keys, "y", "x"), n_pos, seed + 1, "fill", keys).join(served, keys).where(F.col("ord") <= n_pos - F.col("_s"))
    pos = one.unionByName(more.select(*keys, (F.col("ord") + F.col("_s")).alias("ord"), "y", "x")).withColumn("polarity", F.lit("pos"))
    cut = group_quantiles(image, keys, "value", {"_cut": quantile})
    far = R.decode_runs(R.complement(R.dilate(mask, R.diamond(outer_margin), extents, keys), extents, keys))
    far = materialize(far.join(image.select(*keys, "y", "x", "value"), [*keys, "y", "x"]).join(cut, keys))
    hard = far.where(F.col("value") > F.col("_cut")).select(*keys, "y", "x")
    plain = _or_else(far.where(F.col("value") <= F.col("_cut")).select(*keys, "y", "x"), far.select(*keys, "y", "x"), keys)
    n_hard = n_neg // 2
    h = pick(hard, n_hard, seed, "hard", keys)
    has = h.select(*keys).distinct().withColumn("_h", F.lit(n_hard))
    e = pick(plain, n_neg, seed, "easy", keys).join(has, keys, "left").where(F.col("ord") <= n_neg - F.coalesce("_h", F.lit(0)))
    neg = h.unionByName(e.select(*keys, (F.col("ord") + F.coalesce("_h", F.lit(0))).cast("int").alias("ord"), "y", "x")).withColumn("polarity", F.lit("neg"))
    return pos.unionByName(neg)


def centroid_points(labelled: DataFrame, n: int, seed: int = 0, keys: list[str] = SLICE) -> DataFrame:
    """Points at the centroids of n random objects per slice."""
    k = (F.col("x1") - F.col("x0")).cast("double")
    c = labelled.groupBy(*keys, "comp").agg((F.sum(k * F.col("y")) / F.sum(k)).alias("y"), (F.sum(k * (F.col("x0") + F.col("x1") - 1) / 2) / F.sum(k)).alias("x"))
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "comp"), "comp")
    return c.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= n)


def interior(labelled: DataFrame, extents: DataFrame, share: float = 0.1, keys: list[str] = SLICE) -> DataFrame:
    """The most interior pixels of every object: distance to the object's outside at least the value at the top share of
    the sorted distances, and at least 1. Every object is measured against its own complement."""
    by = [*keys, "comp"]
    # Each object in a frame of its own: the box around it and one cell more, which is where the nearest outside lies
    box = labelled.groupBy(*by).agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x0").alias("_x0"), F.max("x1").alias("_x1"))
    moved = materialize(labelled.join(box, by).select(*by, (F.col("y") - F.col("_y0") + 1).alias("y"), (F.col("x0") - F.col("_x0") + 1).alias("x0"), (F.col("x1") - F.col("_x0") + 1).alias("x1")))
    # Only the cells around an object can be nearest to it, so its dilation ring stands for the whole complement
    ring = R.difference(R.dilate(moved, R.square(1), None, by), moved, by)
    ext = box.select(*by, (F.col("_y1") - F.col("_y0") + 3).alias("height"), (F.col("_x1") - F.col("_x0") + 2).alias("width"))
    d = D.distance_to_mask(moved, ring, ext, (1.0, 1.0), by).join(box.select(*by, "_y0", "_x0"), by)
    d = materialize(d.withColumns({"y": F.col("y") + F.col("_y0") - 1, "x": F.col("x") + F.col("_x0") - 1}).drop("_y0", "_x0"))
    n = d.groupBy(*by).agg(F.count("*").alias("_n"))
    # vals[int(share * n)] of the falling order is rank n - 1 - int(share * n) of the rising one
    ranked = d.groupBy(*by, "dist").agg(F.count("*").alias("_c")).join(n, by)
    w = Window.partitionBy(*by).orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = ranked.withColumn("_cum", F.sum("_c").over(w)).where(F.col("_cum") > F.floor(F.col("_n") * share)).groupBy(*by).agg(F.greatest(F.max("dist"), F.lit(1.0)).alias("_cut"))
    return d.join(at, by).where(F.col("dist") >= F.col("_cut")).drop("_cut")


def prompts(labelled: DataFrame, extents: DataFrame, k: int = 5, n_background: int = 10, seed: int = 0, box_noise: float = 0.1, margin: int = 10, keys: list[str] = SLICE) -> DataFrame:
    """Prompt rows (kind, ord, y0, x0, y1, x1): an interior point and a widened box for each of the k largest objects,
    background points away from objects, and background points outside the boxes."""
    top = C.largest(labelled, k, keys).select(*keys, "comp", "rank")
    objs = materialize(labelled.join(top, [*keys, "comp"]))
    inside = interior(objs, extents, keys=keys).join(top, [*keys, "comp"]).withColumn("_d", F.xxhash64(F.lit(seed), *keys, "y", "x"))
    centre = inside.groupBy(*keys, "rank").agg(F.min_by(F.struct("y", "x"), F.struct("_d", "y", "x")).alias("p"))
    point = centre.select(*keys, F.lit("point").alias("kind"), F.col("rank").alias("ord"), *[F.col(f"p.{c}").cast("double").alias(f"{c}0") for c in "yx"], *[F.col(f"p.{c}").cast("double").alias(f"{c}1") for c in "yx"])
    b = objs.groupBy(*keys, "rank").agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x0").alias("_x0"), (F.max("x1") - 1).alias("_x1")).join(extents.select(*keys, "height", "width").distinct(), keys)
    r = lambda tag: uniform(F.lit(seed), *keys, "rank", F.lit(tag))
    ty, tx = (F.col("_y1") - F.col("_y0")) * box_noise, (F.col("_x1") - F.col("_x0")) * box_noise
    box = b.select(*keys, F.lit("box").alias("kind"), F.col("rank").alias("ord"), F.greatest(F.lit(0.0), F.col("_y0") - ty * r("y0")).alias("y0"), F.greatest(F.lit(0.0), F.col("_x0") - tx * r("x0")).alias("x0"),
                   F.least(F.col("height").cast("double"), F.col("_y1") + ty * r("y1")).alias("y1"), F.least(F.col("width").cast("double"), F.col("_x1") + tx * r("x1")).alias("x1"))
    mask = R.encode_runs(R.decode_runs(labelled).select(*keys, "y", "x"), keys)
    back = R.complement(mask, extents, keys)
    far = R.decode_runs(_or_else(R.complement(R.dilate(mask, R.diamond(margin), extents, keys), extents, keys), back, keys))
    as_rows = lambda p, kind: p.select(*keys, F.lit(kind).alias("kind"), "ord", F.col("y").cast("double").alias("y0"), F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y1"), F.col("x").cast("double").alias("x1"))
    background = as_rows(pick(far.select(*keys, "y", "x"), n_background, seed, "background", keys), "background")
    full = extents.select(*keys, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.lit(0).alias("x0"), F.col("width").alias("x1"))
    box = materialize(box)
    whole = box.select(*keys, F.floor("y0").cast("int").alias("y0"), F.floor("x0").cast("int").alias("x0"), F.ceil("y1").cast("int").alias("y1"), F.ceil("x1").cast("int").alias("x1"))
    pixels = R.decode_runs(full).select(*keys, "y", "x")
    free = pixels.join(inside_boxes(pixels, whole, keys), [*keys, "y", "x"], "left_anti")
    return point.unionByName(box).unionByName(background).unionByName(as_rows(pick(free, n_background, seed, "free", keys), "box_background"))


def stratified_items(items: DataFrame, batch: str, per_split: int, seed: int = 0, candidates: int | None = None) -> DataFrame:
    """Even wells to development, odd ones to test: in a random order per batch and split (its first `candidates` only, if
    given), the first per_split items holding an object. items: batch, well, name, has_object."""
    s = items.withColumn("split", F.when(F.col("well") % 2 == 0, "dev").otherwise("test"))
    h = F.xxhash64(F.lit(seed), batch, "name")
    c = s.withColumn("_k", F.row_number().over(Window.partitionBy(batch, "split").orderBy(h, "name")))
    c = c if candidates is None else c.where(F.col("_k") <= candidates)
    k = c.where("has_object").withColumn("_j", F.row_number().over(Window.partitionBy(batch, "split").orderBy("_k")))
    return k.where(F.col("_j") <= per_split).drop("_k", "_j")


def crop_windows(edges: DataFrame, extents: DataFrame, k: int, size: int, seed: int = 0, keys: list[str] = SLICE) -> DataFrame:
    """k square crop windows per slice, every other one centred on a boundary pixel where there is any."""
    e = extents.select(*keys, "height", "width").distinct().withColumn("_s", F.least(F.lit(size), "height", "width")).withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    at = pick(edges, (k + 1) // 2, seed, "crop", keys).select(*keys, ((F.col("ord") - 1) * 2).cast("int").alias("crop"), F.col("y").alias("_cy"), F.col("x").alias("_cx"))
    j = e.join(at, [*keys, "crop"], "left")
    u = lambda t, n: F.floor(uniform(F.lit(seed), *keys, "crop", F.lit(t)) * (n - F.col("_s") + 1)).cast("int")
    near = lambda c, n: F.least(F.greatest(F.col(c) - F.floor(F.col("_s") / 2).cast("int"), F.lit(0)), n - F.col("_s"))
    return j.select(*keys, "crop", F.coalesce(near("_cy", F.col("height")), u("r", F.col("height"))).alias("r0"), F.coalesce(near("_cx", F.col("width")), u("c", F.col("width"))).alias("c0"), F.col("_s").alias("size"))


def crop_pixels(pixels: DataFrame, windows: DataFrame, keys: list[str] = SLICE, bucket: int = 64) -> DataFrame:
    """Pixels of every crop in crop coordinates. Windows are spread over coarse tiles, so the join is an equi-join."""
    w = (windows.withColumn("_ty", F.explode(F.sequence(F.floor(F.col("r0") / bucket), F.floor((F.col("r0") + F.col("size") - 1) / bucket))))
         .withColumn("_tx", F.explode(F.sequence(F.floor(F.col("c0") / bucket), F.floor((F.col("c0") + F.col("size") - 1) / bucket)))))
    p = pixels.withColumns({"_ty": F.floor(F.col("y") / bucket), "_tx": F.floor(F.col("x") / bucket)})
    j = p.join(w, [*keys, "_ty", "_tx"]).where(F.col("y").between(F.col("r0"), F.col("r0") + F.col("size") - 1) & F.col("x").between(F.col("c0"), F.col("c0") + F.col("size") - 1))
    return j.withColumns({"y": F.col("y") - F.col("r0"), "x": F.col("x") - F.col("c0")}).drop("_ty", "_tx", "r0", "c0")


def jitter_crops(crops: DataFrame, seed: int = 0, keys: list[str] = SLICE) -> DataFrame:
    """Random quarter turns, flips, gain, offset and gamma, the same for all pixels of a crop."""
    u = lambda t: uniform(F.lit(seed), *keys, "crop", F.lit(t))
    turn, flip, last = F.floor(u("turn") * 4).cast("int"), u("flip") < 0.5, F.col("size") - 1
    y, x = F.col("y"), F.col("x")
    ty = F.when(turn == 0, y).when(turn == 1, last - x).when(turn == 2, last - y).otherwise(x)
    tx = F.when(turn == 0, x).when(turn == 1, y).when(turn == 2, last - x).otherwise(last - y)
    value = F.pow(F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0)), 0.7 + 0.7 * u("gamma")) * (0.8 + 0.4 * u("gain")) + (0.2 * u("offset") - 0.1)
    return crops.withColumns({"_y": ty, "_x": F.when(flip, last - tx).otherwise(tx), "value": F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))}).drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})
