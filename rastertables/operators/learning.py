"""Classifiers on patch vectors and pixels, with cross-validation, on Spark ML."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ordinals import banded_ordinal, uniform
from ..session import SLICE, materialize

THRESHOLDS = [round(0.2 + 0.05 * i, 2) for i in range(15)]   # 0.2 .. 0.9


def soft_rows(samples: DataFrame) -> DataFrame:
    """A patch with soft target t as two rows of weight t and 1 - t, times its class weight: classes split at one half
    count equally. The class share is one aggregate."""
    share = samples.agg(F.least(F.greatest(F.avg("target"), F.lit(1e-3)), F.lit(1 - 1e-3)).alias("s")).first()["s"]
    w = F.when(F.col("target") > 0.5, 0.5 / share).otherwise(0.5 / (1 - share))
    rows = F.array(F.struct(F.lit(1.0).alias("label"), (F.col("target") * w).alias("weight")), F.struct(F.lit(0.0).alias("label"), ((1 - F.col("target")) * w).alias("weight")))
    out = samples.select("*", F.inline(rows)).where("weight > 0")
    return out.withColumn("features", array_to_vector(F.transform("vec", lambda e: e.cast("double"))))


def fit_linear(samples: DataFrame, l2: float = 1e-3):
    """Logistic regression on soft targets, balanced by weight."""
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=l2, maxIter=60).fit(soft_rows(samples))


def fit_mlp(samples: DataFrame, dim: int, seed: int = 0, hidden: int = 64):
    """Two-layer network. The estimator takes no weights, so the rarer class is repeated until both count alike."""
    rows = samples.withColumn("label", (F.col("target") > 0.5).cast("double"))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = max(n.values())
    times = F.lit(1)
    for label, k in n.items():
        whole, rest = divmod(most, k)
        times = F.when(F.col("label") == label, F.lit(whole) + (uniform(F.lit(seed), *SLICE, "gy", "gx") < rest / k).cast("int")).otherwise(times)
    rows = rows.withColumn("_t", F.explode(F.sequence(F.lit(1), times))).withColumn("features", array_to_vector(F.transform("vec", lambda e: e.cast("double"))))
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[dim, hidden, 2], maxIter=40, seed=seed).fit(rows)


def fit_multi(shares: DataFrame, n_classes: int, l2: float = 1e-3):
    """Multinomial regression on class shares (rows patch, label, share), classes weighted by inverse frequency."""
    f = {r["label"]: max(r["s"], 1e-3) for r in shares.groupBy("label").agg(F.avg("share").alias("s")).collect()}
    total = sum(1 / v for v in f.values())
    w = F.lit(0.0)
    for k, v in f.items():
        w = F.when(F.col("label") == k, (1 / v) / total * n_classes).otherwise(w)
    rows = shares.where("share > 0").withColumns({"weight": F.col("share") * w, "label": F.col("label").cast("double"), "features": array_to_vector(F.transform("vec", lambda e: e.cast("double")))})
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=l2, maxIter=60).fit(rows)


def probability(model, patches: DataFrame) -> DataFrame:
    """Patches with the probability of the object as value."""
    v = patches.withColumn("features", array_to_vector(F.transform("vec", lambda e: e.cast("double"))))
    return model.transform(v).withColumn("value", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def class_probabilities(model, patches: DataFrame) -> DataFrame:
    v = patches.withColumn("features", array_to_vector(F.transform("vec", lambda e: e.cast("double"))))
    return model.transform(v).withColumn("probs", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def most_probable(df: DataFrame, columns: list[str]) -> DataFrame:
    """Label of the largest column, the lowest label on ties."""
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("p"), F.lit(-i).alias("k")) for i, c in enumerate(columns)]))
    return df.withColumn("label", (-best["k"]).cast("int")).drop(*columns)


def folds(slices: DataFrame, n_folds: int | None) -> DataFrame:
    """So many interleaved folds; None: every slice is a fold of its own. Slices are numbered inside their volume; only
    the totals per volume are accumulated over the whole table."""
    ids = slices.select(*SLICE).distinct().withColumn("_all", F.lit(0))
    i = banded_ordinal(ids, ["_all"], F.col("volume_id"), ["z"], "_i")
    fold = F.col("_i") if n_folds is None else F.col("_i") % n_folds
    return i.select(*SLICE, fold.cast("int").alias("fold"))


def mean_dice(held: DataFrame, cut: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Dice per held-out slice of value >= cut against truth."""
    on, ref = F.col("value") >= cut, F.col("truth")
    n = lambda c: F.sum(c.cast("long"))
    return held.groupBy(*(by or []), *SLICE).agg(F.when(n(on) + n(ref) == 0, 1.0).otherwise(2 * n(on & ref) / (n(on) + n(ref))).alias("dice"))


def calibrate(held: DataFrame) -> DataFrame:
    """Probability threshold with the best mean Dice over held-out slices (four digits); ties go to the one nearest 0.5.
    Rows are counted once per threshold bucket, not once per threshold."""
    cuts = F.array(*[F.lit(t) for t in THRESHOLDS])
    bucket = F.size(F.filter(cuts, lambda t: F.col("value") >= t))
    c = held.groupBy(*SLICE, bucket.alias("_b")).agg(F.count("*").alias("n"), F.sum(F.col("truth").cast("long")).alias("t"))
    per = c.select(*SLICE, "n", "t", "_b", F.explode(cuts).alias("threshold")).withColumn("_on", F.element_at(cuts, F.greatest(F.col("_b"), F.lit(1))) >= F.col("threshold"))
    on = F.col("_on") & (F.col("_b") > 0)
    s = per.groupBy(*SLICE, "threshold").agg(F.sum(F.when(on, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(on, F.col("t")).otherwise(0)).alias("b"), F.sum("t").alias("r"))
    d = s.withColumn("dice", F.when(F.col("p") + F.col("r") == 0, 1.0).otherwise(2 * F.col("b") / (F.col("p") + F.col("r"))))
    m = d.groupBy("threshold").agg(F.avg("dice").alias("dice"))
    return m.agg(F.max_by(F.struct("threshold", "dice"), F.struct(F.bround("dice", 4), -F.round(F.abs(F.col("threshold") - 0.5), 6), -F.col("threshold"))).alias("b")).select("b.*")


def cross_validate(samples: DataFrame, candidates: dict[str, callable], n_folds: int | None) -> DataFrame:
    """Held-out predictions of every candidate: (candidate, slice, patch, value, truth). The loop is over the folds
    (see folds) and candidates; every fit and prediction is a Spark job over all patches."""
    f = materialize(samples.join(folds(samples, n_folds), SLICE))
    out = None
    for fold in [r["fold"] for r in f.select("fold").distinct().orderBy("fold").collect()]:
        train, test = f.where(F.col("fold") != fold), f.where(F.col("fold") == fold)
        for name, fit in candidates.items():
            p = probability(fit(train), test).select(F.lit(name).alias("candidate"), *SLICE, "gy", "gx", "value", (F.col("target") > 0.5).alias("truth"))
            out = p if out is None else out.unionByName(p)
    return materialize(out)


def select_model(held: DataFrame) -> DataFrame:
    """Mean held-out Dice per candidate, the best first."""
    return mean_dice(held, 0.5, ["candidate"]).groupBy("candidate").agg(F.avg("dice").alias("mean_dice"), F.count("*").alias("n_slices")).orderBy(F.desc("mean_dice"), "candidate")


def inside_region(samples: DataFrame, region_share: DataFrame, keys: list[str] = SLICE) -> DataFrame:
    """Patches at least half inside the region their label speaks for."""
    return samples.join(region_share.where("value >= 0.5").select(*keys, "gy", "gx"), [*keys, "gy", "gx"], "left_semi")


def balanced_subsample(rows: DataFrame, per_class: int, seed: int = 0, keys: list[str] = SLICE) -> DataFrame:
    """The same number of random pixels of each class per slice."""
    w = Window.partitionBy(*keys, "truth").orderBy(F.xxhash64(F.lit(seed), *keys, "y", "x"), "y", "x")
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_class).drop("_k")


def disk_pixels(points: DataFrame, height: int, width: int, r: int = 3, keys: list[str] = SLICE) -> DataFrame:
    """Pixels within r of each point, with the point's polarity as truth."""
    from .runs import disk
    o = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, e in disk(r).items() for dx in range(-e, e + 1)])
    p = points.withColumn("_o", F.explode(o)).select(*keys, (F.bround("y").cast("int") + F.col("_o.dy")).alias("y"), (F.bround("x").cast("int") + F.col("_o.dx")).alias("x"), (F.col("polarity") == "pos").alias("truth"))
    return p.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).groupBy(*keys, "y", "x").agg(F.max("truth").alias("truth"))


def fit_forest(rows: DataFrame, features: list[str], trees: int = 100, seed: int = 0) -> PipelineModel:
    """Random forest on pixel features, both classes weighted alike."""
    n = {r["truth"]: r["n"] for r in rows.groupBy("truth").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    w = F.when(F.col("truth"), total / (2 * n.get(True, 1))).otherwise(total / (2 * n.get(False, 1)))
    r = rows.withColumns({"label": F.col("truth").cast("double"), "weight": w})
    stages = [VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, seed=seed)]
    from pyspark.ml import Pipeline
    return Pipeline(stages=stages).fit(r)


def save_model(model, path: str):
    model.write().overwrite().save(path)


def external_segmenter(pixels: DataFrame, fn, schema: str, keys: list[str] = SLICE, tile: int = 512) -> DataFrame:
    """Extension point: a user function from the pixel frame of one tile to rows of the given schema. Tiles have a fixed
    size, so a plane of any size is cut up before it reaches the function. Sorted tiles are streamed in batches, which costs
    less than an exchange of Arrow data for each of many small tiles; a tile that spans batches is held until it ends."""
    own = pixels.columns
    by = [*keys, "_ty", "_tx"]
    t = pixels.withColumns({"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile)})

    def run(batches):
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows])
            ends = _last_rows(rows.select(by))
            held = rows.slice(ends[-1])   # The last tile may go on
            yield from made(rows, ends)
        if held is not None and len(held):
            yield from made(held, np.array([0, len(held)]))

    def made(rows, ends):
        plain = rows.select(own)
        whole = plain.slice(0, int(ends[-1]))
        # Nulls turn a pandas column into floats, for the tile that has them alone
        frame = whole.to_pandas() if all(c.null_count == 0 for c in whole.columns) else None
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            pdf = frame.iloc[a:b].reset_index(drop=True) if frame is not None else plain.slice(a, b - a).to_pandas()
            found = fn(pdf)
            if len(found):
                out.append(found)
        if out:
            yield pd.concat(out, ignore_index=True)

    def frames(batches):
        for found in run(batches):
            yield pa.RecordBatch.from_pandas(found[arrow.names], schema=arrow, preserve_index=False)

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return t.repartition(*by).sortWithinPartitions(*by).mapInArrow(frames, schema)


def _last_rows(by: pa.Table) -> np.ndarray:
    """0 and the places in sorted rows where a new group begins; the last group is left out."""
    new = np.zeros(len(by) - 1, bool)
    for c in by.columns:
        codes = c.combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        i = codes.indices.to_numpy(zero_copy_only=False)
        new |= i[1:] != i[:-1]
    return np.concatenate([[0], np.nonzero(new)[0] + 1])
