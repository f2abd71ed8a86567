"""Whole-stack runs composed from the operators: no loop over slices, every slice is scored in the same job."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import components as C
from ..operators import measure as M
from ..operators import runs as R
from ..operators import scoring as S
from ..operators import select as P
from ..session import SLICE, materialize

#: Slices and distinct values of a block of targets and thresholds of a block of references, about which one call scores.
TARGETS, TARGET_ROWS, REFERENCES = 256, 1 << 20, 4096


def run_stack(patches: DataFrame, prototypes: DataFrame, points: DataFrame, extents: DataFrame, in_size, out_size, voxel_um=(1.0, 1.0, 1.0), neg_weight: float = 0.8,
              min_object_um2: float = 0.0, fill_holes_um2: float = 0.0, image: DataFrame | None = None, reference: DataFrame | None = None, roi: DataFrame | None = None,
              start: DataFrame | None = None, mode: str = "clicks", top_percent: float = 10.0, manual: float = 0.5, position: float = -1.0, robust: bool = True, smooth_px: int = 0,
              guide: DataFrame | None = None, guided_eps: float = 0.01, profile_thresholds: DataFrame | None = None) -> dict[str, DataFrame]:
    """Masks, slice rows, solid objects and stack summaries of every volume. extents: one row per processed slice.

    In mode "clicks" a slice takes the threshold of its own points, else the one carried along the processing order (start:
    volume_id, ref_z; plain order without), else the volume's stored one (profile_thresholds: volume_id, threshold), else Otsu.
    guide: an image whose edges the score map follows, at the radius of one patch. Volumes without a positive example have
    no scores; their slices come out empty, with the source "no example"."""
    means = S.mean_prototypes(prototypes, ["volume_id"])
    radius = max(1, round(max(out_size[0] / in_size[0], out_size[1] / in_size[1])))
    raw = materialize(S.score_map(patches, means, ["volume_id"], in_size, out_size, neg_weight, robust, guide, guided_eps, radius))
    return segment_stack(raw, points, extents, out_size, voxel_um, min_object_um2, fill_holes_um2, image, reference, roi, start, mode, top_percent, manual, position, smooth_px, profile_thresholds)


def segment_stack(raw: DataFrame, points: DataFrame, extents: DataFrame, out_size, voxel_um=(1.0, 1.0, 1.0), min_object_um2: float = 0.0, fill_holes_um2: float = 0.0, image: DataFrame | None = None,
                  reference: DataFrame | None = None, roi: DataFrame | None = None, start: DataFrame | None = None, mode: str = "clicks", top_percent: float = 10.0, manual: float = 0.5,
                  position: float = -1.0, smooth_px: int = 0, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """run_stack from score maps (keys, y, x, value), which may be the probabilities of a learned model with its stored
    threshold."""
    here = materialize(S.calibrate_threshold(S.sample_points(raw, points, *out_size), SLICE, position).where("threshold IS NOT NULL"))
    slices = extents.select(*SLICE).distinct()
    order = P.outward_order(slices, start if start is not None else slices.select("volume_id", F.lit(None).cast("int").alias("ref_z")).limit(0))
    carried = S.carry_thresholds(here, order)
    if stored is not None:
        carried = carried.join(stored.select("volume_id", F.col("threshold").alias("_stored")), "volume_id", "left").select(*SLICE, F.coalesce("threshold", "_stored").alias("threshold"))
    thr = materialize(S.choose_thresholds(raw, here, carried, SLICE, mode, top_percent, manual))
    masks = C.clean_up(R.encode_runs(S.apply_threshold(raw, thr, SLICE).select(*SLICE, "y", "x")), extents, voxel_um[1:], smooth_px, fill_holes_um2, min_object_um2)
    if roi is not None:
        masks = R.intersection(masks, roi)
    masks = materialize(masks)
    every = slices.join(thr, SLICE, "left").withColumn("threshold_source", F.coalesce("threshold_source", F.lit("no example")))
    return {"masks": masks, **measure_stack(masks, extents, voxel_um, image, reference, roi, every)}


def save_stack(result: dict[str, DataFrame], path: str) -> None:
    """Write what a stack run returns below path: masks as runs (Parquet), slices and objects_3d as CSV with a header,
    summary as JSON lines. Spark writes every table in parts."""
    for name, df in result.items():
        if name == "masks":
            df.write.parquet(f"{path}/masks")
        elif name == "summary":
            df.write.json(f"{path}/summary", ignoreNullFields=False)
        else:
            df.write.option("header", True).csv(f"{path}/{name}")


def measure_stack(masks: DataFrame, extents: DataFrame, voxel_um=(1.0, 1.0, 1.0), image: DataFrame | None = None, reference: DataFrame | None = None,
                  roi: DataFrame | None = None, thresholds: DataFrame | None = None, by: list[str] = ["volume_id"]) -> dict[str, DataFrame]:
    """Slice rows, solid objects and stack summary of masks; by may hold the structure besides the volume. Several jobs read
    the masks, so they should be a written table."""
    sl = [*by, "z"]
    slices = M.summarize_slices(masks, extents, image, voxel_um[1:], roi, sl)
    if thresholds is not None:
        slices = slices.join(thresholds.select(*sl, F.col("heat_threshold").alias("threshold"), *[c for c in ("threshold_source",) if c in thresholds.columns]), sl, "left")
    if reference is not None:
        reference = materialize(reference)
        slices = slices.join(M.compare(masks, reference, extents, voxel_um[1:], roi, sl).select(*sl, "dice", "iou", "hd95_um"), sl, "left")
    slices = materialize(slices.withColumn("z_um", F.col("z") * voxel_um[0]))
    step = M.slice_step(slices, by)
    ends = slices.groupBy(*by).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    # Solid objects connect processed slices, so slices are counted, not their numbers
    spaced = masks.join(step, by).join(ends, by).withColumn("z", ((F.col("z") - F.col("z_min")) / F.col("step")).cast("int"))
    solid = C.label_components(spaced.select(*sl, "y", "x0", "x1"), extents.select(*by, "height", "width").distinct(), 6, by)
    solid = solid.join(ends.join(step, by).select(*by, F.lit(0).alias("z_min"), ((F.col("z_max") - F.col("z_min")) / F.col("step")).cast("int").alias("z_max")), by)
    objects = materialize(M.objects_3d(solid, voxel_um, by))
    summary = M.summarize_stacks(slices.join(step, by), F.col("step") * voxel_um[0], by).join(M.roll_up_objects(objects, by), by, "left").fillna(0, ["n_objects_3d", "n_objects_3d_inside"])
    if reference is not None:
        summary = summary.join(slices.groupBy(*by).agg(F.avg("dice").alias("mean_dice_vs_reference")), by, "left")
    return {"slices": slices, "objects_3d": objects, "summary": summary}


def run_stack_multi(labels: DataFrame, extents: DataFrame, n: int, voxel_um=(1.0, 1.0, 1.0), image: DataFrame | None = None) -> dict[str, DataFrame]:
    """Measurements per structure of label maps (keys, y, x, label): the structure is one more key, all structures run
    in the same jobs. Structure 0 is the union of all."""
    by = ["volume_id", "structure"]
    both = labels.where("label > 0").withColumn("structure", F.explode(F.array(F.lit(0), F.col("label")))).drop("label")
    masks = materialize(R.encode_runs(both, [*by, "z"]))
    each = lambda d: d.withColumn("structure", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return measure_stack(masks, each(extents), voxel_um, each(image) if image is not None else None, by=by)


def study(volumes: DataFrame, runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Volumes with their group and the metrics of their latest finished run, null where there is none."""
    from ..operators.select import newest
    last = newest(runs.where("status = 'done'"), ["volume_id"], 1).select("volume_id", *metrics)
    return volumes.join(last, "volume_id", "left")


def _meet(values: DataFrame, thresholds: DataFrame, dataset: str, make: Callable, out: list[T.StructField]) -> DataFrame:
    """make(targets, references, scores) for every block of target slices and block of thresholds of a data set; scores has
    a Dice per target slice and threshold. A pair costs a look-up in its block; what is shuffled are the blocks.

    Targets are counted per distinct value, so a look-up among a slice's rising values tells what lies at or above a threshold.
    A null threshold selects nothing."""
    c = materialize(values.where(F.col(dataset).isNotNull()).groupBy(dataset, *SLICE, F.col("value").cast("double").alias("value"))
                    .agg(F.count("*").alias("n"), F.sum(F.col("truth").cast("long")).alias("t")))
    refs = materialize(thresholds.where(F.col(dataset).isNotNull()).select(dataset, "ref_volume", "ref_z", F.col("threshold").cast("double").alias("threshold")))
    held = c.groupBy(dataset, *SLICE).agg(F.count("*").alias("_n")).groupBy(dataset).agg(F.count("*").alias("_s"), F.sum("_n").alias("_n"))
    n_t = held.agg(F.max(F.greatest(F.ceil(F.col("_s") / TARGETS), F.ceil(F.col("_n") / TARGET_ROWS)))).first()[0] or 1
    n_r = refs.groupBy(dataset).count().agg(F.max(F.ceil(F.col("count") / REFERENCES))).first()[0] or 1
    part = lambda volume, z, n: F.pmod(F.xxhash64(volume, F.floor(F.col(z) / 16)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.withColumn("_t", part("volume_id", "z", n_t)).withColumn("_r", all_of(n_r))
    refs = refs.withColumn("_r", part("ref_volume", "ref_z", n_r)).withColumn("_t", all_of(n_t))
    schema = T.StructType([c.schema[dataset], *out])
    empty = c.sparkSession.createDataFrame([], schema).toArrow()

    def solve(table: pa.Table, thr: pa.Table) -> pa.Table:
        if not (table.num_rows and thr.num_rows):
            return empty
        (z, _), (volume, n_volumes) = _codes(table, "z"), _codes(table, "volume_id")
        _, first, at = np.unique(z * n_volumes + volume, return_index=True, return_inverse=True)
        number = lambda t, name, zero: (pc.fill_null(t.column(name), zero).to_numpy(), pc.is_valid(t.column(name)).to_numpy())
        (value, known), (t, counted), n = number(table, "value", 0.0), number(table, "t", 0), table.column("n").to_numpy()
        n_ref, scored = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
        np.add.at(n_ref, at, t)
        scored[at[counted]] = True
        order = np.lexsort((value, at))
        order = order[known[order]]   # A null value is at or above nothing
        ends = np.searchsorted(at[order], np.arange(len(first) + 1))
        cut, given = number(thr, "threshold", 0.0)
        cuts, of = np.unique(cut, return_inverse=True)

        def scores():
            for i in range(len(first)):
                rows = order[ends[i]:ends[i + 1]]
                from_here = lambda a: np.append(np.cumsum(a[rows][::-1])[::-1], 0)
                place = np.searchsorted(value[rows], cuts)
                total = from_here(n)[place] + n_ref[i]
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = np.where(total == 0, 1.0, 2 * from_here(t)[place] / total)
                yield np.where(given, d[of], 1.0 if n_ref[i] == 0 else 0.0)

        made = make(table.take(pa.array(first)), thr, scores(), scored)
        return pa.Table.from_arrays([pa.repeat(table.column(dataset)[0], len(made[0])), *made], names=schema.names)

    by = [dataset, "_t", "_r"]
    return c.groupBy(*by).cogroup(refs.groupBy(*by)).applyInArrow(solve, schema)


def _codes(table: pa.Table, name: str) -> tuple[np.ndarray, int]:
    """Numbers from 0 that stand for the values of a column, null among them, and how many there are."""
    d = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy().astype(np.int64), len(d.dictionary)


def threshold_transfers(values: DataFrame, thresholds: DataFrame, dataset: str) -> DataFrame:
    """Every reference slice's threshold applied to every target slice of the data set, scored and classed as same
    slice, same file or other file: one row per pair. values: dataset, volume_id, z, value, truth; thresholds: dataset,
    ref_volume, ref_z, threshold."""
    def pairs(targets: pa.Table, refs: pa.Table, scores: Iterator[np.ndarray], scored: np.ndarray) -> list[pa.Array]:
        s, r = np.divmod(np.arange(targets.num_rows * refs.num_rows), refs.num_rows)
        taken = [t.column(c).combine_chunks().take(pa.array(at)) for t, at, names in ((refs, r, ("ref_volume", "ref_z")), (targets, s, SLICE)) for c in names]
        return [*taken, pa.array(np.concatenate(list(scores)), pa.float64(), mask=~scored[s])]

    out = [thresholds.schema["ref_volume"], thresholds.schema["ref_z"], *[values.schema[k] for k in SLICE], T.StructField("dice", T.DoubleType())]
    s = _meet(values, thresholds, dataset, pairs, out)
    kind = F.when((F.col("ref_volume") == F.col("volume_id")) & (F.col("ref_z") == F.col("z")), "same slice").when(F.col("ref_volume") == F.col("volume_id"), "same file").otherwise("other file")
    return s.withColumn("transfer", kind)


def transfer_means(values: DataFrame, thresholds: DataFrame, dataset: str) -> DataFrame:
    """Mean Dice of the transfers from every reference volume to every target volume of the data set: one row per pair of
    volumes, whose pairs of slices are summed up where they are scored."""
    def sums(targets: pa.Table, refs: pa.Table, scores: Iterator[np.ndarray], scored: np.ndarray) -> list[pa.Array]:
        (volume, n), (ref, m) = _codes(targets, "volume_id"), _codes(refs, "ref_volume")
        total, count, each = np.zeros((n, m)), np.zeros((n, m), np.int64), np.bincount(ref, minlength=m)
        for v, d, ok in zip(volume, scores, scored):
            if ok:
                total[v] += np.bincount(ref, d, m)
                count[v] += each
        name = lambda t, c, code, at: t.column(c).combine_chunks().take(pa.array(np.unique(code, return_index=True)[1][at]))
        t, r = np.divmod(np.arange(n * m), m)
        return [name(refs, "ref_volume", ref, r), name(targets, "volume_id", volume, t), pa.array(total.ravel()), pa.array(count.ravel())]

    out = [thresholds.schema["ref_volume"], values.schema["volume_id"], T.StructField("_s", T.DoubleType()), T.StructField("_n", T.LongType())]
    s = _meet(values, thresholds, dataset, sums, out).groupBy(dataset, "ref_volume", "volume_id").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return s.select(dataset, "ref_volume", "volume_id", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias("dice"))
