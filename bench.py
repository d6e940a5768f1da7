"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The warehouse and the graphs are loaded first; their times are part of the headline, as materialising them is
work of its own. Each query runs to completion twice into a discarding sink; the second, warm time counts. Stored
tables lie under ``$BENCH_SHARED_DIR`` (default: spark-warehouse beside this file) and are deleted at the end.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from cubegraph.plans.registered import all_queries
from cubegraph.plans.registered.base import close_all, context

HEADLINE = [
    "flagship_correlation",
    "paged_retrieval",
    "by_borough",
    "by_neighbourhood_bimester",
    "top10_neighbourhoods",
    "export_mart",
    "daily_climate_rollup",
    "fact_load_counts",
    "loss_audit",
    "filtered_kpis",
    "borough_map",
    "centroids",
    "proximity_pairs",
    "knn_pairs",
    "triple_counts_by_predicate",
    "graph_neighbour_consumption",
    "graph_climate_join",
    "graph_by_level",
    "graph_non_domestic_share",
    "degree_top15",
    "integrity_checks",
    "atypicality",
    "lof_1d",
    "pr_curve",
    "latency_summary",
    "search_insensitive",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR", str(Path(__file__).resolve().parent / "spark-warehouse")))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = context(spark, sf_dir)
    loads = {}
    for name in ("star", "mart", "edges", "nearest", "graph", "reduced"):
        start = time.perf_counter()
        getattr(tables, name)
        loads[f"load_{name}"] = round(time.perf_counter() - start, 3)
    registered, times = all_queries(), {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    close_all(spark)
    print(
        json.dumps(
            {
                "metric": "headline_loads_and_queries_total",
                "value": round(sum(times.values()) + sum(loads.values()), 3),
                "unit": "sec",
                "queries": {**times, **loads},
                "queries_only": round(sum(times.values()), 3),
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
