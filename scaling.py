"""Scaling runs on generated panels: seconds of the shared-moment path, and of one ML chain per test where asked.

    python scaling.py [ml]
"""

from __future__ import annotations

import sys
import time

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.checks.queries import QUERIES  # noqa: F401  (imports the whole package once)
from lagweave.operators import graph, panel as pn, var
from lagweave.operators.tree import all_orders


def long_panel(spark: SparkSession, rows: int, k: int) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("idx"), *[F.randn(i).alias(f"x{i}") for i in range(k)])


def skewed_panels(spark: SparkSession, rows: int, panels: int, k: int) -> DataFrame:
    """Panel 0 holds a third of all rows, the others share the rest."""
    hot, each = rows // 3, (rows - rows // 3) // panels
    keyed = F.when(F.col("id") < hot, 0).otherwise(1 + F.floor((F.col("id") - hot) / each)).cast("long")
    idx = F.when(F.col("id") < hot, F.col("id")).otherwise((F.col("id") - hot) % each)
    return spark.range(hot + each * panels).select(keyed.alias("k"), idx.cast("long").alias("idx"), *[F.randn(i).alias(f"x{i}") for i in range(k)])


def ml_chains(df: DataFrame, names: list[str], maxlag: int, v: float) -> list[float]:
    """The usual way: one chain of ML fits per test, on a cached lagged panel."""
    lagged, out = pn.lag_panel(df, names, maxlag).cache(), []
    lagged.count()
    for order in all_orders(names):
        rows, label = lagged, order[0]
        for j, name in enumerate(order):
            ready = VectorAssembler(inputCols=pn.lag_names(name, maxlag), outputCol=f"f{j}").transform(rows)
            model = LinearRegression(featuresCol=f"f{j}", labelCol=label, predictionCol=f"p{j}", maxIter=1000).fit(ready)
            rows = model.transform(ready).withColumn(f"r{j}", F.col(label) - (1.0 if j == 0 else v) * F.col(f"p{j}"))
            label = f"r{j}"
        out.append(model.summary.meanSquaredError)
    lagged.unpersist()
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master("local[8]").appName("scaling").config("spark.sql.shuffle.partitions", "32")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        size = run()
        print(f"{name}: {time.perf_counter() - start:.1f} s ({size} rows out)", flush=True)

    def tests(df, k, keys=()):
        return lambda: graph.chain_tests(df, [f"x{i}" for i in range(k)], 2, v=0.1, keys=keys).count()

    timed("warm up", tests(long_panel(spark, 1000, 3), 3))
    for rows in (10**5, 10**6, 10**7):
        timed(f"linear graph, one panel, n={rows}, k=4", tests(long_panel(spark, rows, 4), 4))
    for k in (6, 8):
        timed(f"linear graph, one panel, n=100000, k={k}", tests(long_panel(spark, 10**5, k), k))
    timed("linear graph, 3M rows, 2000 panels, one with a third of the rows", tests(skewed_panels(spark, 3 * 10**6, 2000, 4), 4, ["k"]))
    names = [f"x{i}" for i in range(4)]
    timed("VAR graph, lags 1..4, n=10^6, k=4", lambda: var.var_graph(long_panel(spark, 10**6, 4), names, 4, alpha=2.0).count())
    timed("index of 10^7 unordered rows", lambda: pn.with_index(long_panel(spark, 10**7, 1).select((F.hash("x0").cast("long") * 2**20 + F.col("idx")).alias("t")), "t").selectExpr("max(idx)").first()[0])
    timed("tree graph, n=10^6, k=3, depth 3", lambda: graph.causality_graph(long_panel(spark, 10**6, 3), names[:3], 2, alpha=2.0, learner="tree", depth=3).count())
    if "ml" in sys.argv[1:]:
        timed("one ML chain per test, n=100000, k=4", lambda: len(ml_chains(long_panel(spark, 10**5, 4), names, 2, 0.1)))
    spark.stop()


if __name__ == "__main__":
    main()
