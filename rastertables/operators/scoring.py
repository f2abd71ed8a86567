"""Similarity scores against clicked examples, thresholds, and region proposals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinals import uniform
from ..functions.quantiles import group_quantiles
from ..functions.vectors import dot, l2_normalize, mean_vector
from ..session import SLICE, materialize
from . import components as C
from . import grid as G
from . import runs as R


# ---------- prototypes and scores ----------

def points_to_cells(points: DataFrame, height, width, hg, wg) -> DataFrame:
    """Patch under each point: truncated share of the image side, clipped to the grid."""
    cell = lambda v, n, g: F.least(F.greatest((v / n * g).cast("int"), F.lit(0)), G.as_col(g) - 1)
    return points.withColumns({"gy": cell(F.col("y"), height, hg), "gx": cell(F.col("x"), width, wg)})


def prototypes(patches: DataFrame, points: DataFrame, height, width, hg, wg, keys: list[str] = SLICE) -> DataFrame:
    """Patch vectors under the points."""
    cells = points_to_cells(points, height, width, hg, wg)
    return cells.join(patches.select(*keys, "gy", "gx", "vec"), [*keys, "gy", "gx"])


def mean_prototypes(protos: DataFrame, on: list[str]) -> DataFrame:
    """One row per profile with the mean of the normalised positive and negative prototypes. The mean of the cosines
    of a patch to all prototypes equals its dot product with this mean, so scoring costs one product per patch however
    many points were clicked."""
    unit = protos.withColumn("vec", l2_normalize(F.col("vec")))
    m = mean_vector(unit, [*on, "polarity"])
    return m.groupBy(*on).agg(F.max(F.when(F.col("polarity") == "pos", F.col("vec"))).alias("pos"),
                              F.max(F.when(F.col("polarity") == "neg", F.col("vec"))).alias("neg"),
                              F.max(F.when(F.col("polarity") == "pos", F.col("n"))).alias("n_pos"),
                              F.max(F.when(F.col("polarity") == "neg", F.col("n"))).alias("n_neg"))


def score_patches(patches: DataFrame, means: DataFrame, on: list[str], neg_weight: float = 1.0) -> DataFrame:
    """Mean cosine to the positives minus neg_weight times the mean cosine to the negatives. Profiles without a
    positive give no rows; without negatives the second term drops out."""
    joined = patches.join(means.where(F.col("pos").isNotNull()), on)
    against = F.when(F.col("neg").isNull(), 0.0).otherwise(dot(F.col("vec"), F.col("neg")))
    return joined.withColumn("value", dot(F.col("vec"), F.col("pos")) - neg_weight * against).drop("vec", "pos", "neg", "n_pos", "n_neg")


def standardise_robust(scores: DataFrame, keys: list[str] = SLICE, value: str = "value") -> DataFrame:
    """(score - median) / (1.4826 MAD + 1e-6) per slice with lower medians."""
    scores = materialize(scores)   # Read five times below; one number per patch
    med = group_quantiles(scores, keys, value, {"_med": 0.5}, method="lower")
    off = scores.join(med, keys).withColumn("_off", F.abs(F.col(value) - F.col("_med")))
    mad = group_quantiles(off, keys, "_off", {"_mad": 0.5}, method="lower")
    return off.join(mad, keys).withColumn(value, (F.col(value) - F.col("_med")) / (F.col("_mad") * 1.4826 + 1e-6)).drop("_med", "_mad", "_off")


def sample_points(raster: DataFrame, points: DataFrame, height, width, keys: list[str] = SLICE) -> DataFrame:
    """Raster value at the rounded, clipped position of every point (half goes to even)."""
    at = lambda v, n: F.least(F.greatest(F.bround(v).cast("int"), F.lit(0)), G.as_col(n) - 1)
    p = points.withColumns({"_py": at(F.col("y"), height), "_px": at(F.col("x"), width)})
    r = raster.select(*keys, F.col("y").alias("_py"), F.col("x").alias("_px"), "value")
    return p.join(r, [*keys, "_py", "_px"]).drop("_py", "_px")


# ---------- thresholds ----------

def calibrate_threshold(samples: DataFrame, keys: list[str], position: float = -1.0) -> DataFrame:
    """Threshold between the scores at positive and at negative points. Each side uses its extreme, or the 10th / 90th
    percentile once it has more than five points. position -1 picks 0.7, or 0.9 when both sides have more than five.
    Null when a side is empty."""
    samples = materialize(samples)   # One row per point, made from the whole score map and read six times below
    pos, neg = samples.where("polarity = 'pos'"), samples.where("polarity = 'neg'")
    p = pos.groupBy(*keys).agg(F.count("value").alias("n_pos"), F.min("value").alias("_pmin"))
    n = neg.groupBy(*keys).agg(F.count("value").alias("n_neg"), F.max("value").alias("_nmax"))
    pq = group_quantiles(pos, keys, "value", {"_pq": 0.1})
    nq = group_quantiles(neg, keys, "value", {"_nq": 0.9})
    t = p.join(pq, keys).join(n.join(nq, keys), keys, "full").fillna(0, ["n_pos", "n_neg"])
    lo = F.when(F.col("n_pos") > 5, F.col("_pq")).otherwise(F.col("_pmin"))
    hi = F.when(F.col("n_neg") > 5, F.col("_nq")).otherwise(F.col("_nmax"))
    return t.select(*keys, "n_pos", "n_neg", (hi + auto_position(position) * (lo - hi)).alias("threshold"))


def auto_position(position: float) -> Column:
    if position >= 0:
        return F.lit(float(position))
    return F.when((F.col("n_pos") > 5) & (F.col("n_neg") > 5), 0.9).otherwise(0.7)


def otsu(df: DataFrame, keys: list[str] = SLICE, value: str = "value", bins: int = 256) -> DataFrame:
    """Threshold with the largest between-class variance of a 256-bin histogram (the bin centre; the first wins).
    Only bin totals are accumulated per slice."""
    r = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    hist = (df.join(r, keys).where(F.col("_hi") > F.col("_lo")).withColumn("_b", b)
            .groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")))
    hist = hist.withColumn("_c", F.col("_lo") + (F.col("_b") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins)
    up = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    mass = F.col("_n") * F.col("_c")
    v = hist.withColumns({"_w1": F.sum("_n").over(up), "_w2": F.sum("_n").over(down), "_s1": F.sum(mass).over(up), "_s2": F.sum(mass).over(down)})
    gap = F.col("_s1") / F.col("_w1") - F.col("_s2") / F.col("_w2")
    v = v.where(F.col("_w2").isNotNull()).withColumn("_var", F.col("_w1").cast("double") * F.col("_w2") * gap * gap)
    return v.groupBy(*keys).agg(F.max_by("_c", F.struct(F.round("_var", 4), -F.col("_b"))).alias("threshold"))


def threshold_heat(heat: DataFrame, mode: str, top_percent: float = 20.0, manual: float = 0.5, keys: list[str] = SLICE) -> DataFrame:
    """Threshold per slice of a map in 0..1: the top share, a given value, or Otsu (1 for a flat map)."""
    if mode == "top_percent":
        return group_quantiles(heat, keys, "value", {"threshold": (100 - top_percent) / 100})
    if mode == "manual":
        return heat.select(*keys).distinct().withColumn("threshold", F.lit(float(manual)))
    if mode == "clicks":
        return heat.select(*keys).distinct().join(otsu(heat, keys), keys, "left").fillna(1.0, ["threshold"])
    raise ValueError(f"Unknown threshold mode {mode}")


def apply_threshold(raster: DataFrame, thresholds: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Pixels at or above the threshold of their slice."""
    return raster.join(thresholds.select(*on, "threshold"), on).where(F.col(value) >= F.col("threshold")).drop("threshold")


def score_map(patches: DataFrame, means: DataFrame, on: list[str], in_size, out_size, neg_weight: float = 1.0, robust: bool = True,
              guide: DataFrame | None = None, guided_eps: float = 1e-3, radius: int = 1, keys: list[str] = SLICE) -> DataFrame:
    """Full resolution score rows: patch scores, standardised per slice, resized, snapped to the guide's edges."""
    s = score_patches(patches.select(*keys, "gy", "gx", "vec"), means, on, neg_weight)
    if robust:
        s = standardise_robust(s, keys)
    up = G.upsample(s.select(*keys, "gy", "gx", "value"), in_size, out_size, keys)
    if guide is None:
        return up
    both = up.join(guide.select(*keys, "y", "x", F.col("value").alias("guide")), [*keys, "y", "x"])
    return G.guided_filter(both, radius, guided_eps, out_size[0], out_size[1], keys).drop("guide")


def carry_thresholds(here: DataFrame, order: DataFrame, by: list[str] = ["volume_id"]) -> DataFrame:
    """by, z, threshold: what each slice gets from others. order: by, z, step (the processing order); here: by, z, threshold of
    slices with points. The last threshold met on the way carries on; slices before the first one take that one. Groups
    without any give null. A window holds the slices of one stack, not their pixels."""
    rows = order.select(*by, "z", "step").join(here.select(*by, "z", "threshold"), [*by, "z"], "left")
    w = Window.partitionBy(*by).orderBy("step")
    met = F.last("threshold", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("threshold", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(*by, "z", F.coalesce(met, first).alias("threshold"))


def choose_thresholds(raw: DataFrame, calibrated: DataFrame, carried: DataFrame | None, keys: list[str] = SLICE, mode: str = "clicks", top_percent: float = 10.0, manual: float = 0.5) -> DataFrame:
    """Threshold per slice with its source. Mode "clicks": points on the slice, else a carried-over value (a row per slice, or
    per group of slices), else Otsu on the map. Modes "top_percent" and "manual" look at the map on its 0..1 scale alone.
    Also the threshold on that scale."""
    span = raw.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    if mode != "clicks":
        flat = F.col("hi") - F.col("lo") < 1e-12
        if mode == "manual":
            t = span.withColumn("_t", F.lit(float(manual))).withColumn("_q", F.col("lo") + F.col("_t") * width)
        elif mode == "top_percent":   # The quantile of the rescaled map is the rescaled quantile
            t = span.join(group_quantiles(raw, keys, "value", {"_q": (100 - top_percent) / 100}), keys)
            t = t.withColumn("_t", F.when(flat, 0.0).otherwise((F.col("_q") - F.col("lo")) / width))
        else:
            raise ValueError(f"Unknown threshold mode {mode}")
        return t.select(*keys, F.col("_q").alias("threshold"), F.col("_t").alias("heat_threshold"), F.lit(mode).alias("threshold_source"), "lo", "hi")
    t = span.join(calibrated.select(*keys, F.col("threshold").alias("_here")), keys, "left")
    if carried is not None:
        on = [k for k in keys if k in carried.columns]
        t = t.join(carried.select(*on, F.col("threshold").alias("_carried")), on, "left")
    else:
        t = t.withColumn("_carried", F.lit(None).cast("double"))
    t = t.join(otsu(raw, keys).withColumnRenamed("threshold", "_otsu"), keys, "left")
    t = t.withColumn("_otsu", F.coalesce("_otsu", F.col("lo") + width))
    raw_thr = F.coalesce("_here", "_carried", "_otsu")
    source = F.when(F.col("_here").isNotNull(), "clicks").when(F.col("_carried").isNotNull(), "carried over").otherwise("otsu (no background clicks)")
    return t.select(*keys, raw_thr.alias("threshold"), ((raw_thr - F.col("lo")) / width).alias("heat_threshold"),
                    source.alias("threshold_source"), "lo", "hi")


# ---------- several structures ----------

def multi_prototypes(protos: DataFrame, on: list[str]) -> DataFrame:
    """Prototype rows per structure: its own points are positive; background points and the points of every other
    structure are negative. Every point is read once per structure of its profile, and structures are few by nature."""
    structures = protos.where("polarity = 'pos'").select(*on, F.col("structure").alias("_target")).distinct()
    rows = protos.join(structures, on)
    own = (F.col("polarity") == "pos") & (F.col("structure") == F.col("_target"))
    return (rows.withColumn("polarity", F.when(own, "pos").otherwise("neg")).drop("structure").withColumnRenamed("_target", "structure"))


def most_similar_passing(sims: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Rows (keys, y, x, structure, ordinal, score, threshold, sim) -> label = ordinal + 1 of the most similar
    structure that clears its threshold, 0 when none does; ties go to the lowest ordinal."""
    passing = F.when(F.col("score") >= F.col("threshold"), F.struct("sim", (-F.col("ordinal")).alias("o")))
    return sims.groupBy(*keys, "y", "x").agg(F.coalesce(1 - F.max(passing)["o"], F.lit(0)).cast("int").alias("label"))


def clean_labels(labels: DataFrame, extents: DataFrame, n: int, pixel_um=(1.0, 1.0), smooth_px: int = 0, fill_holes_um2: float = 0.0,
                 min_object_um2: float = 0.0, keys: list[str] = SLICE) -> DataFrame:
    """Every structure cleaned up on its own in one pass (structure is part of the key), the lowest structure wins."""
    by = [*keys, "label"]
    runs = R.encode_runs(labels.where("label > 0"), by)
    ext = extents.select(*keys, "height", "width", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("label"))
    cleaned = C.clean_up(runs, ext, pixel_um, smooth_px, fill_holes_um2, min_object_um2, by)
    return R.decode_runs(cleaned).groupBy(*keys, "y", "x").agg(F.min("label").alias("label"))


# ---------- uncertainty and suggestions ----------

def uncertainty(patches: DataFrame, protos: DataFrame, on: list[str], thresholds: DataFrame, mode: str, neg_weight: float = 1.0, n_draws: int = 16, seed: int = 0,
                keys: list[str] = SLICE) -> DataFrame:
    """Share of redraws of the points in which a patch changes sides. mode "leave_one_out": each point is left out in
    turn, however many there are: the mean without point i is (n * mean - v_i) / (n - 1), so redraws are vectors, not
    recomputations. mode "subsets": n_draws 80 % subsets picked by hash rank. Scores keep the scale of the full result.
    thresholds: on + threshold (0..1)."""
    if mode not in ("leave_one_out", "subsets"):
        raise ValueError(f"unknown mode {mode!r}")
    unit = protos.withColumn("vec", l2_normalize(F.col("vec")))
    means = mean_prototypes(protos, on)
    unit = unit.join(means.select(*on, "pos", "neg", F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.coalesce("n_neg", F.lit(0)).alias("n_neg")), on)
    positive = F.col("polarity") == "pos"
    n = F.when(positive, F.col("n_pos")).otherwise(F.col("n_neg"))
    full = F.when(positive, F.col("pos")).otherwise(F.col("neg"))
    without = F.when(n > 1, F.zip_with(full, "vec", lambda m, v: (m * n - v) / (n - 1)))
    if mode == "leave_one_out":
        draws = (unit.where(~(positive & (F.col("n_pos") == 1)))
                 .select(*on, F.concat_ws(":", "polarity", F.col("ord").cast("string")).alias("draw"),
                         F.when(positive, without).otherwise(F.col("pos")).alias("pos"), F.when(positive, F.col("neg")).otherwise(without).alias("neg")))
    else:
        many = unit.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
        rank = F.row_number().over(Window.partitionBy(*on, "_d", "polarity").orderBy(F.xxhash64(F.lit(seed), "_d", "ord", "polarity"), "ord"))
        kept = many.withColumn("_r", rank).where(F.col("_r") <= F.greatest(F.floor(n * 0.8), F.when(positive, 1).otherwise(0)))
        subsets = mean_vector(kept.select(*on, "_d", "polarity", "vec"), [*on, "_d", "polarity"])
        draws = subsets.groupBy(*on, F.col("_d").cast("string").alias("draw")).agg(
            F.max(F.when(positive, F.col("vec"))).alias("pos"), F.max(F.when(~positive, F.col("vec"))).alias("neg"))
    draws = draws.select(*on, "draw", F.col("pos").alias("_dp"), F.col("neg").alias("_dn"))
    base = patches.select(*keys, "gy", "gx", "vec").join(means, on)
    score = lambda p, q: dot(F.col("vec"), F.col(p)) - neg_weight * F.when(F.col(q).isNull(), 0.0).otherwise(dot(F.col("vec"), F.col(q)))
    base = base.withColumn("_full", score("pos", "neg"))
    span = base.groupBy(*keys).agg(F.min("_full").alias("_lo"), F.max("_full").alias("_hi"))
    base = base.join(span, keys).join(thresholds.select(*on, "threshold"), on)
    scaled = lambda c: F.least(F.greatest((c - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))
    base = base.withColumn("_on", scaled(F.col("_full")) >= F.col("threshold"))
    redrawn = base.join(draws, on, "left").withColumn("_flip", (scaled(score("_dp", "_dn")) >= F.col("threshold")) != F.col("_on"))
    return redrawn.groupBy(*keys, "gy", "gx").agg(F.avg(F.when(F.col("_dp").isNull(), 0.0).otherwise(F.col("_flip").cast("double"))).alias("value"))


def probability_uncertainty(p: Column) -> Column:
    return F.least(F.greatest(1 - 4 * F.abs(p - 0.5), F.lit(0.0)), F.lit(1.0))


def suggest_point(u: DataFrame, points: DataFrame, height: int, width: int, work_side: int | None = None, away: float = 0.05, keys: list[str] = SLICE) -> DataFrame:
    """Most uncertain place of every slice away from its points; none when nothing is uncertain. Cells are looked at one by
    one; with work_side, as means of blocks (the last ones may be smaller) of which a side holds at most so many."""
    f = max(1, -(-max(height, width) // work_side)) if work_side else 1
    sh, sw = -(-height // f), -(-width // f)
    small = u if f == 1 else (
        u.groupBy(*keys, F.floor(F.col("y") / f).cast("int").alias("y"), F.floor(F.col("x") / f).cast("int").alias("x")).agg(F.avg("value").alias("value")))
    small = small.select(*keys, "y", "x", "value")
    sigma = max(1.0, min(sh, sw) / 100)
    blurred = G.gaussian_blur(small, (sigma, sigma), sh, sw, keys)
    r = away * max(sh, sw)
    blocked = exclude_near(blurred, points.select(*keys, (F.col("y") / f).alias("py"), (F.col("x") / f).alias("px")), r, keys)
    best = blocked.groupBy(*keys).agg(F.max(F.struct("value", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("b"))
    at = lambda c, n: F.least((-F.col(c) * f + f // 2).cast("int"), F.lit(n - 1))
    return best.where(F.col("b.value") > 1e-6).select(*keys, at("b.ny", height).alias("y"), at("b.nx", width).alias("x"), F.col("b.value").alias("value"))


def exclude_near(cells: DataFrame, points: DataFrame, r: float, keys: list[str] = SLICE) -> DataFrame:
    """Cells that are not within r of any point. Both sides meet in grid cells of side r, so the join is an equi-join."""
    g = max(float(r), 1.0)
    p = points.withColumns({"_ky": F.floor(F.col("py") / g), "_kx": F.floor(F.col("px") / g)}).select(*keys, "py", "px", "_ky", "_kx").distinct()
    around = (p.withColumn("_ky", F.explode(F.array(F.col("_ky") - 1, F.col("_ky"), F.col("_ky") + 1)))
              .withColumn("_kx", F.explode(F.array(F.col("_kx") - 1, F.col("_kx"), F.col("_kx") + 1))))
    around = around.withColumnsRenamed({k: f"_p{k}" for k in keys})
    c = cells.withColumns({"_cy": F.floor(F.col("y") / g), "_cx": F.floor(F.col("x") / g)})
    same = [F.col(k) == F.col(f"_p{k}") for k in keys] + [F.col("_cy") == F.col("_ky"), F.col("_cx") == F.col("_kx")]
    cond = (F.col("y") - F.col("py")) ** 2 + (F.col("x") - F.col("px")) ** 2 < r * r
    for s in same:
        cond = cond & s
    return c.join(around, cond, "left_anti").drop("_cy", "_cx")


def missed_regions(raw: DataFrame, mask: DataFrame, thresholds: DataFrame, points: DataFrame, extents: DataFrame, height: int, width: int,
                   top: int = 5, min_share: float = 2e-4, keys: list[str] = SLICE) -> DataFrame:
    """Regions above a looser threshold that do not touch the mask and hold no point, the strongest first. The looser
    threshold is half way from the threshold down to the median score at the background points (of the map if none)."""
    neg = sample_points(raw, points.where("polarity = 'neg'"), height, width, keys)
    at_neg = group_quantiles(neg, keys, "value", {"_typical": 0.5})
    overall = group_quantiles(raw, keys, "value", {"_median": 0.5})
    t = overall.join(at_neg, keys, "left").join(thresholds.select(*keys, "threshold"), keys)
    loose = t.select(*keys, (F.col("threshold") - 0.5 * (F.col("threshold") - F.coalesce("_typical", "_median"))).alias("loose"))
    above = raw.join(loose, keys).where(F.col("value") >= F.col("loose"))
    region = R.difference(R.encode_runs(above.select(*keys, "y", "x"), keys), R.dilate(mask, R.diamond(2), extents, keys), keys)
    lab = R.decode_runs(C.label_components(region, extents, 4, keys))
    scored = lab.join(above, [*keys, "y", "x"])
    stats = scored.groupBy(*keys, "comp").agg(
        F.count("*").alias("area_px"), F.sum(F.col("value") - F.col("loose")).alias("strength"),
        F.max(F.struct("value", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("peak"))
    seed = sample_points(lab.withColumnRenamed("comp", "value"), points, height, width, keys).select(*keys, F.col("value").alias("comp")).distinct()
    stats = stats.join(seed, [*keys, "comp"], "left_anti").where(F.col("area_px") >= min_share * height * width)
    w = Window.partitionBy(*keys).orderBy(F.desc("strength"), "comp")
    return (stats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select(*keys, "rank", "comp", "area_px", (F.col("strength") / F.col("area_px")).alias("score"), (-F.col("peak.ny")).alias("y"), (-F.col("peak.nx")).alias("x")))


def region_at(lab: DataFrame, points: DataFrame, height: int, width: int, keys: list[str] = SLICE) -> DataFrame:
    """Pixels of the labelled region under each point."""
    hit = sample_points(lab.withColumnRenamed("comp", "value"), points, height, width, keys).select(*keys, F.col("value").alias("comp")).distinct()
    return lab.join(hit, [*keys, "comp"], "left_semi")


def box_positives(cells: DataFrame, boxes: DataFrame, height, width, hg: int, wg: int, share: float = 0.3, most: int = 15, keys: list[str] = SLICE) -> DataFrame:
    """Per box, the 30 % of its cells (at least 1, at most 15) least like the background. cells: keys, gy, gx, value
    (similarity to the background); boxes: keys, box, y0, x0, y1, x1 in pixels. A box covers the cells from the one its
    first corner lies in up to, but without, the one its far end reaches, one cell at least. Boxes are turned into the
    grid cells they cover, so the join is an equi-join."""
    def span(lo, hi, n, g):
        a = F.greatest(F.floor(F.col(lo) / n * g).cast("int"), F.lit(0))
        z = F.least(F.greatest(a + 1, F.ceil(F.col(hi) / n * g).cast("int")), F.lit(g))   # Exclusive
        return F.when(a < z, F.sequence(a, z - 1))
    covered = boxes.withColumn("gy", F.explode(span("y0", "y1", height, hg))).withColumn("gx", F.explode(span("x0", "x1", width, wg)))
    counts = covered.groupBy(*keys, "box").agg(F.count("*").alias("_n"))
    take = F.least(F.greatest(F.floor(F.col("_n") * share), F.lit(1)), F.lit(most))
    w = Window.partitionBy(*keys, "box").orderBy("value", "gy", "gx")
    ranked = covered.select(*keys, "box", "gy", "gx").join(cells, [*keys, "gy", "gx"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.join(counts, [*keys, "box"]).where(F.col("rank") <= take).drop("_n")


def inside_boxes(pixels: DataFrame, boxes: DataFrame, keys: list[str] = SLICE, bucket: int = 64) -> DataFrame:
    """Pixels inside at least one box. Boxes are spread over coarse tiles, so pixels meet only the boxes of their tile."""
    b = (boxes.select(*keys, "y0", "x0", "y1", "x1")
         .withColumn("_ty", F.explode(F.sequence(F.floor(F.col("y0") / bucket), F.floor(F.col("y1") / bucket))))
         .withColumn("_tx", F.explode(F.sequence(F.floor(F.col("x0") / bucket), F.floor(F.col("x1") / bucket)))))
    b = b.withColumnsRenamed({k: f"_b{k}" for k in keys})
    cond = (F.floor(F.col("y") / bucket) == F.col("_ty")) & (F.floor(F.col("x") / bucket) == F.col("_tx")) & F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_b{k}"))
    return pixels.join(b, cond, "left_semi")


# ---------- profiles ----------

def profile_kind(profiles: DataFrame, structures: DataFrame) -> DataFrame:
    """Kind of each profile: learned when it holds a model, structures when it names several, prototypes otherwise."""
    n = structures.groupBy("profile_id").agg(F.countDistinct("structure").alias("n_structures"))
    kind = F.when(F.col("model_id").isNotNull(), "learned").when(F.col("n_structures") > 1, "structures").otherwise("prototypes")
    return profiles.join(n, "profile_id", "left").withColumn("kind", kind)


def resolve_profile(profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Profile of each distinct requested name or id prefix: exactly one match resolves, anything else reports why."""
    # Every beginning of an id is a row, so both ways of asking are equi-joins
    starts = F.transform(F.sequence(F.lit(0), F.length("profile_id")), lambda n: F.substring(F.col("profile_id"), F.lit(1), n))
    asked = profiles.select("profile_id", F.explode(F.array_distinct(F.concat(starts, F.array(F.coalesce("name", F.lit("")))))).alias("spec"))
    m = wanted.select("spec").distinct().join(asked, "spec", "left")
    g = m.groupBy("spec").agg(F.count("profile_id").alias("n"), F.min("profile_id").alias("profile_id"))
    return g.select("spec", F.when(F.col("n") == 1, F.col("profile_id")).alias("profile_id"),
                    F.when(F.col("n") == 0, "no profile matches").when(F.col("n") > 1, "several profiles match").alias("problem"))


def refine_profile(stored: DataFrame, clicked: DataFrame, on: list[str], thresholds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored prototypes joined by the clicked ones; a profile that got points loses its stored threshold."""
    cols = [*on, "polarity", "ord", "vec"]
    both = stored.select(*cols).unionByName(clicked.select(*cols))
    touched = clicked.select(*on).distinct().withColumn("_new", F.lit(True))
    t = thresholds.join(touched, on, "left").withColumn("threshold", F.when(F.col("_new").isNull(), F.col("threshold"))).drop("_new")
    return both, t


def subset_rank(*identity) -> Column:
    return uniform(*identity)
