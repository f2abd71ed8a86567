"""Scalar rules on names, settings, sizes and annotations. All of it is column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The settings with their types and defaults
SETTINGS = {
    "backbone": ("string", "dinov2_s14"), "vit_size": ("int", 980), "layer_from_end": ("int", 1), "neg_weight": ("double", 0.8), "threshold_mode": ("string", "clicks"),
    "top_percent": ("double", 10.0), "manual_threshold": ("double", 0.5), "min_object_um2": ("double", 0.0), "fill_holes_um2": ("double", 0.0), "smooth_px": ("int", 0),
    "score_norm": ("string", "robust"), "threshold_position": ("double", -1.0), "edge_refine": ("string", "guided"), "guided_eps": ("double", 0.01), "shift_passes": ("int", 2),
    "refiner": ("string", ""), "suggest_missed": ("boolean", False), "sam_refine": ("string", "off"), "sam_model": ("string", "sam"), "clip_low": ("double", 1.0), "clip_high": ("double", 99.5)}
# Words a setting may be, lowest and highest numbers (None: no bound)
WORDS = {"threshold_mode": ("clicks", "top_percent", "manual"), "score_norm": ("robust", "none"), "edge_refine": ("guided", "none"), "sam_refine": ("off", "agree", "replace"), "sam_model": ("sam", "microsam")}
RANGES = {"vit_size": (14, 4200), "layer_from_end": (1, 40), "neg_weight": (0, 10), "top_percent": (0, 100), "manual_threshold": (0, None), "min_object_um2": (0, None), "fill_holes_um2": (0, None),
          "smooth_px": (0, None), "guided_eps": (0, None), "shift_passes": (1, 4), "clip_low": (0, 100), "clip_high": (0, 100)}
ABOVE_ZERO = ("top_percent", "guided_eps")


def split_channel(spec: Column, default: int | None = None) -> tuple[Column, Column]:
    """Path and channel of 'file:3'; without a number the default channel."""
    n = F.regexp_extract(spec, r"^(.*):(\d+)$", 2)
    path = F.when(n != "", F.regexp_extract(spec, r"^(.*):(\d+)$", 1)).otherwise(spec)
    return path, F.coalesce(F.when(n != "", n.cast("int")), F.lit(default).cast("int"))


def channel_choice(requested: Column, default: Column, colour: Column, n_channels: Column) -> Column:
    """The first that is given of requested, default and colour channel, else the only one; null if the volume lacks it."""
    chosen = F.coalesce(requested, default, colour, F.when(n_channels == 1, F.lit(0)))
    return F.when((chosen >= 0) & (chosen < n_channels + colour.isNotNull().cast("int")), chosen)


def _typed(text: Column, name: str, kind: str) -> tuple[Column, Column]:
    """A setting's text in its type (null if it has none) and what is wrong with it."""
    if kind == "string":
        return text, F.lit(None).cast("string")
    if kind == "boolean":
        word = F.lower(text)
        value = F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)
        return value, F.when(text.isNotNull() & value.isNull(), F.lit(f"{name} must be true or false"))
    number = text.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    if kind == "double":
        return F.when(finite, number), F.when(text.isNotNull() & ~F.coalesce(finite, F.lit(False)), F.lit(f"{name} must be a finite number"))
    whole = finite & (number == F.floor(number)) & (F.abs(number) < 2 ** 31)
    return F.when(whole, number.cast("int")), F.when(text.isNotNull() & ~F.coalesce(whole, F.lit(False)), F.lit(f"{name} must be a whole number"))


def coerce_settings(raw: Column) -> tuple[Column, Column]:
    """Typed struct and list of violations from map<string, string>. Unknown keys are ignored, missing ones default, and so do
    values of a wrong type, which are reported; the mode 'otsu' of old settings means 'clicks'. A null map is all defaults."""
    values, problems = {}, []
    for name, (kind, default) in SETTINGS.items():
        text = F.try_element_at(raw, F.lit(name))
        if name == "threshold_mode":
            text = F.when(text == "otsu", F.lit("clicks")).otherwise(text)
        value, problem = _typed(text, name, kind)
        values[name] = F.coalesce(value, F.lit(default).cast(kind))
        problems.append(problem)
    for name, words in WORDS.items():
        problems.append(F.when(~values[name].isin(*words), F.concat(F.lit(f"unknown {name} "), values[name])))
    for name, (low, high) in RANGES.items():
        v = values[name]
        bad = (F.lit(False) if low is None else v <= low if name in ABOVE_ZERO else v < low) | (F.lit(False) if high is None else v > high)
        problems.append(F.when(bad, F.lit(f"{name} is out of range")))
    position = values["threshold_position"]
    problems.append(F.when((position != -1) & ~position.between(0, 1), F.lit("threshold_position must be -1 or between 0 and 1")))
    problems.append(F.when(values["clip_low"] >= values["clip_high"], F.lit("clip_low must be below clip_high")))
    return F.struct(*[c.alias(n) for n, c in values.items()]), F.filter(F.array(*problems), lambda p: p.isNotNull())


def slug(name: Column, most: int = 40) -> Column:
    """Lower-case id: letters and digits of any alphabet stay, every other character becomes a dash, dashes at the ends go."""
    s = F.substring(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "-"), F.lit("-")), 1, most)
    return F.when(s == "", "profile").otherwise(s)


def item_seed(*parts: Column) -> Column:
    """First four bytes of the SHA-256 of the parts joined by '_', read as a little-endian number."""
    h = F.sha2(F.concat_ws("_", *parts), 256)
    return F.conv(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")


def model_input_size(h: Column, w: Column, size: int, patch: int) -> tuple[Column, Column]:
    """Input size that keeps the aspect ratio in whole patches (half goes to even)."""
    scale = F.lit(float(size)) / F.greatest(h, w)
    side = lambda v: F.greatest(F.lit(patch), (F.bround(v * scale / patch) * patch).cast("int"))
    return side(h), side(w)


def downsample_factor(n_z: Column, h: Column, w: Column, budget: float = 2e8) -> Column:
    """In-plane factor that brings a stack under the voxel budget."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n_z.cast("double") * h * w / budget)).cast("int"))


def z_context_slices(z_um: Column, n_z: Column, distance_um: float = 4.0) -> Column:
    d = F.when(z_um > 0, F.greatest(F.lit(1), F.least(F.lit(3), F.bround(distance_um / z_um).cast("int")))).otherwise(1)
    return F.when(n_z >= 2 * d + 1, d).otherwise(0)


def bounds_errors(requests: DataFrame, volumes: DataFrame) -> DataFrame:
    """Requests with a list of what is out of range; unknown volumes are reported as well."""
    j = requests.join(volumes.select("volume_id", "n_channels", "n_z"), "volume_id", "left")
    checks = F.array(F.when(F.col("n_z").isNull(), "unknown volume"), F.when((F.col("channel") < 0) | (F.col("channel") >= F.col("n_channels")), "channel out of range"),
                     F.when((F.col("z") < 0) | (F.col("z") >= F.col("n_z")), "slice out of range"))
    return j.withColumn("errors", F.filter(checks, lambda c: c.isNotNull())).drop("n_channels", "n_z")


def normalise_annotations(saves: DataFrame) -> DataFrame:
    """Saved points as whole numbers. A save without any point is dropped; one that has points keeps all its extra structures,
    those without points too. Names are cut to 60 characters, colours to 16; null names and colours are empty.

    saves: key, pos, neg (array<array<double>>), extra (array<struct<name, color, pos>>)."""
    whole = lambda c: F.transform(c, lambda p: F.transform(p, lambda v: F.bround(v).cast("int")))
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    extra = F.transform("extra", lambda e: F.struct(text(e["name"], 60).alias("name"), text(e["color"], 16).alias("color"), F.coalesce(whole(e["pos"]), F.array().cast("array<array<int>>")).alias("pos")))
    out = saves.withColumns({"pos": whole(F.col("pos")), "neg": whole(F.col("neg")), "extra": extra})
    return out.where((F.size("pos") > 0) | (F.size("neg") > 0) | F.exists("extra", lambda e: F.size(e["pos"]) > 0))


def annotation_key(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, ":")
    return parts[0].cast("int"), parts[1].cast("int")


def label_file(name: Column) -> tuple[Column, Column]:
    """Channel and slice of a label file name such as c2_z10."""
    pat = r"c(\d+)_z(\d+)"
    return tuple(F.when(F.regexp_extract(name, pat, k) != "", F.regexp_extract(name, pat, k).cast("int")) for k in (1, 2))


def compatibility(models: DataFrame, settings: DataFrame, on: list[str]) -> DataFrame:
    """Models whose feature settings equal those of a volume, and the others with the reason."""
    s = settings.select("volume_id", *[F.col(c).alias(f"_{c}") for c in on])
    j = models.join(s, "volume_id")
    wrong = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in on]), lambda c: c.isNotNull())
    return j.withColumn("mismatch", wrong).withColumn("compatible", F.size("mismatch") == 0).drop(*[f"_{c}" for c in on])


def crop_to_region(mask: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """Mask pixels inside the valid region, moved so that the region's bounding box starts at the origin."""
    box = valid.groupBy(*keys).agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"))
    return (mask.join(valid.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi").join(box, keys)
            .withColumns({"y": F.col("y") - F.col("_y0"), "x": F.col("x") - F.col("_x0")}).drop("_y0", "_x0"))
