"""Times the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lumenquarry.plans import scene_queries  # noqa: F401  (adds its queries)
from lumenquarry.plans import table_queries as T

NAMES = ["voxel_downsample", "gap_islands", "extent_quantiles", "histogram_peaks", "imu_window", "interval_join", "nearest_asof", "pair_theta_join", "greedy_keyframes", "tall_column_filter", "conformal_quantile", "axis_score", "ray_first_hit", "interval_measurement", "share_of_best", "corner_snap", "boundary_walls", "polygon_raster", "label_fill", "merged_peaks", "measurement_intervals"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    T.QUERIES[NAMES[0]](spark, d).write.format("noop").mode("overwrite").save()
    for name in NAMES:
        began = time.time()
        T.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": d.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
