"""Time the headline queries: python bench.py (BENCH_SF_DIR, BENCH_CPUS). Prints one JSON line."""
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from rastertables.plans import catalogue  # noqa: E402
from rastertables.session import get_session  # noqa: E402

HEADLINE = ["p1_percentile_rescale", "p2_minmax_rescale", "quantiles_exact", "g1_bilinear_resize", "g4_box_mean", "g5_guided_filter", "g7_gaussian_blur", "g10_adaptive_pool", "g20_patch_statistics",
            "t2_similarity_score", "t3_robust_standardise", "t8_otsu", "t9_score_and_threshold", "a15_run_length_encode", "x1_mask_intersection", "g14_dilate_cross", "c1_label_8_connected", "c2_label_3d",
            "m1_dice_iou", "m3_hd95", "m10_slice_summary", "m14_objects_3d", "m24_seed_then_sample_means", "q1_rank_statistic", "q5_icc", "q9_nested_leave_one_out", "w7_prune_old_runs", "z1_last_save_wins"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    catalogue.QUERIES["w10_sorted_output"](spark, sf_dir).write.format("noop").mode("overwrite").save()   # Warm-up
    times = {}
    for name in HEADLINE:
        t = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
