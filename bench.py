"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from catalog import run_query
from panelsift.session import build_session

HEADLINE = (
    "flag_breakdown",
    "j1_user_completion_profile_device",
    "j4_merge_studies_into_completions",
    "a1_study_groups",
    "a2_respondent_summary",
    "a8_breakdown",
    "a11_feature_breakdown_table",
    "a12_quantiles_by_group",
    "a13_distribution",
    "a18_exposure_and_gender",
    "w2_task_counts",
    "w3_days_active",
    "w7_average_rank",
    "f2_temporal_features",
    "f5_speed_by_group",
    "f10_one_hot_batch",
    "f14_bins",
    "f18_device_categories",
    "x1_clustered_ols",
    "x2_clustered_logit",
    "x6_chi_square",
    "x8_mann_whitney",
    "x10_vif",
    "m1_scale_standard",
    "m4_linear_baseline",
    "m14_impute_by_cluster",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the session up
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        run_query(name, spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
