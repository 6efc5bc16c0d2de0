"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lagweave.checks.queries import QUERIES

HEADLINE = [
    "panel_wide_shipments", "time_index", "lag_grouped", "structural_mean_nonlinear2", "fit_metrics", "boost_chain_shrunk",
    "causality_graph_linear", "causality_graph_five", "causality_graph_grouped", "incremental_merged", "tree_round",
    "causality_graph_tree", "var_summary", "var_forecast", "var_graph", "var_edges_running_min", "granger_pairs",
    "granger_pairs_grouped",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["causality_graph_linear"](spark, sf_dir).collect()  # start the JVM's and the Python workers' code paths
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
