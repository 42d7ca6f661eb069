"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from folio_spark.session import build_session, use_local_folder
from folio_spark.workloads import QUERIES

HEADLINE = [
    "counts_by_org", "b1_cards", "b2_fallback_anchors", "c3_stop_rule", "c6_seq", "c6_seq_by_org", "a5_frontier",
    "c7_candidates", "c8_classify", "c9_routing", "c11_merge", "b12_b13_columns", "b18_detail_rows", "c16_normalise",
    "c20_upsert", "c21_failrecon", "c25_unique", "c28_counters", "e3_progress", "e5_download_log", "a11_a12_chunks", "metadata_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "folio_spark-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start-up is not part of a query
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
