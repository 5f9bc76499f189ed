"""Headline queries, timed. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "tile_heat_cache_state", "access_metrics", "lonlat_to_tile_key", "quadkeys", "tile_paths", "affected_tiles", "tiles_by_coverage",
    "points_in_coverage", "tile_count_plan", "uncached_tiles", "import_merge", "cleanup", "availability_ranges", "rescale_fill",
    "grid_rekey", "route_by_srs", "request_combine", "mosaic", "overview_pyramid", "border_exchange", "dem_sample", "mesh_sample",
    "raster_warp", "tileset_resample", "coverage_mask", "stacked_merge", "feature_json_tiles", "feature_coverage_filter",
    "tile_statistics", "feature_info", "feature_info_json_merge", "tile_url_parse", "query_string_normalise", "fetch_schedule",
    "request_stream_classify", "windowed_metrics",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tilespark.plans import load
    from tilespark.plans.inputs import Inputs
    from tilespark.session import tune

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = tune(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    plans, inputs = load(), Inputs(spark, sf_dir)

    def run(name: str) -> float:
        started = time.perf_counter()
        plans[name].run(inputs).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run(HEADLINE[0])  # start-up costs belong to no query
    times = {name: run(name) for name in HEADLINE}
    spark.stop()
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir,
    }))


if __name__ == "__main__":
    main()
