"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from barloom.plans import registry

HEADLINE = [
    "b1_bars", "v6_sigma_session", "c3_c5_student_flow", "x1_x7_subbar_features", "x11_x16_geometry", "x18_feature_table", "f1_student_t_fit", "f2_f3_f5_pit",
    "d6_thresholds", "d10_d12_cells", "d10_d16_d20_cells", "d13_d16_pooled", "m5_m9_baselines", "m14_m16_m18_metrics", "m10_m13_boosted", "q1_symbol_inventory",
]
#: Runs of a query, of which the median counts; no further run begins once a query has taken so many seconds.
RUNS, ENOUGH = 3, 20.0


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["b1_bars"](spark, d).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) < RUNS and sum(runs) < ENOUGH:
            t = time.time()
            registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[name] = round(median(runs), 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline queries, total of medians", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
