"""All registered queries in one place."""
from . import catalog_queries, grid_queries, mask_queries, measure_queries, model_queries, score_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    """Percentile rescale, top-percent threshold and Dice against the second mask, per slice."""
    from pyspark.sql import functions as F

    from ..operators import grid, measure, runs, scoring
    from ..session import SLICE
    from ..sources import lattice
    planes = grid.normalize_planes(lattice.plane(spark, sf_dir))
    cut = scoring.threshold_heat(planes, "top_percent", 20.0)
    pred = runs.encode_runs(scoring.apply_threshold(planes, cut, SLICE).select(*SLICE, "y", "x"))
    ref = runs.encode_runs(lattice.reference(spark, sf_dir))
    o = measure.overlap_counts(pred, ref, lattice.slices(spark, sf_dir))
    return o.select(*SLICE, "n_pred", "n_ref", F.round(measure.dice(), 6).alias("dice"))
