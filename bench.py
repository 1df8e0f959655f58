"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from arborscan.queries import QUERIES
from arborscan.session import local_session

HEADLINE = [
    # catalogue and zones
    "scene_quality_filter", "band_manifest", "scene_upsert", "scene_pairs", "zone_change_status", "zone_newest",
    "zone_area_chart", "detection_area_filter",
    # spatial
    "dwithin_join", "knn_mask_flag", "knn_topk", "iou_pair_join", "overlay_intersection", "connected_components",
    "region_union", "zone_assign_max_overlap", "greedy_match", "replay_results",
    # raster
    "ndvi", "band_statistics", "sigma_clip_scale", "histogram_match", "erode3_close5", "close5_dilate3", "mosaic",
    "polygonize", "otsu_threshold", "score_chips",
    # evaluation
    "dice_chip", "dice_at_iou_thresholds", "bce_dice_score", "stratified_split",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, "bench", **{"spark.driver.memory": "16g"})
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the executor threads before timing
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
