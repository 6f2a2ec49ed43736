"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from loomlens.plans.catalogue import QUERIES
from loomlens.session import DEFAULTS

HEADLINE = (
    "churn_hotspots", "fan_out", "fan_in", "zone_violations", "percentile_floors", "dup_lines", "dup_windows", "dup_line_union", "link_edges", "coverage_labels", "coverage_by_joins", "scc_by_joins", "reach_of_imports", "churn_trend_types", "churn_trend_counts",
    "maintainability", "crap", "risk_profile", "health_score", "target_category", "target_order", "unused_keys", "suppressed_findings", "changed_scope",
    "new_only_attribution", "baseline_exclusion", "first_candidate", "flag_lines", "extracted_functions",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    out = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        out[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
