"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed; results are written to the
``noop`` sink, so every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from labelgrid.plans.catalogue import QUERIES  # noqa: E402
from labelgrid.session import local_session  # noqa: E402

HEADLINE = [
    "pixel_metrics_by_class", "soft_metrics_by_class", "folder_report", "threshold_sweep", "confusion_matrix", "class_summary", "weighted_metrics",
    "annotator_pairs", "consensus_layers", "ensemble_mean", "ensemble_median", "box_iou_pairs", "match_boxes", "ocr_score", "chars_in_region", "dilate", "border",
    "gaussian_smooth", "nearest_distance", "drd", "stitch_tiles", "score_images", "sample_by_performance", "class_crops", "rolling_metrics", "ctc_decode", "wer", "stream_best_so_far",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cores=cpus, partitions=2 * cpus, app="labelgrid-bench")
    times = {}
    for name in names:
        took = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
