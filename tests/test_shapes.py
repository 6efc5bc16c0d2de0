"""Panels outside the usual shape: slices, gaps, nulls, null keys, off-grid rows, ties, and labels of any scale."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import graph, staging, tree
from lagweave.operators import panel as pn
from lagweave.operators.moments import moments


def walk(spark, n=400, k=2, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, k)).cumsum(axis=0)
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "idx long, " + ", ".join(f"x{j} double" for j in range(k)))


def test_slice_has_no_invented_lags(spark):
    rows = walk(spark)
    for chunk in (7, 100, 65536):
        part = pn.slice_panel(rows, 33, 250)
        m = moments(part, ["x0", "x1"], 3, chunk_rows=chunk).collect()[0]
        lagged = pn.lag_panel(part, ["x0", "x1"], 3, chunk_rows=chunk).toPandas()
        assert (m["n"], m["n_rows"], len(lagged), lagged.idx.min()) == (215, 218, 215, 36)
        z = lagged[[pn.lag_name(v, i) for v in ("x0", "x1") for i in range(4)]].to_numpy()
        assert np.allclose(m["means"], z.mean(0)) and np.allclose(np.reshape(m["g"], (8, 8)), (z - z.mean(0)).T @ (z - z.mean(0)))
        filled = moments(part, ["x0", "x1"], 3, fill=0, chunk_rows=chunk).collect()[0]
        assert filled["n"] == 218


@pytest.mark.parametrize("gap", [[150], [199], [200], [198, 199, 200], [*range(100, 200)]])
def test_gaps_raise(spark, gap):
    rows = walk(spark).where(~F.col("idx").isin(gap))
    with pytest.raises(Exception, match="not consecutive"):
        moments(rows, ["x0"], 2, chunk_rows=100).collect()
    for panel in (rows, pn.beginning_at(rows, 0)):
        with pytest.raises(Exception, match="not consecutive"):
            pn.lag_panel(panel, ["x0"], 2, chunk_rows=100).collect()


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_nulls_raise_with_panel_and_column(spark, bad):
    rows = walk(spark, 50).withColumn("x1", F.when(F.col("idx") != 20, F.col("x1")).otherwise(F.lit(bad).cast("double"))).withColumn("k", F.lit("p"))
    with pytest.raises(Exception, match=r"x1.*'k': 'p'"):
        moments(rows, ["x0", "x1"], 2, ["k"]).collect()


def test_off_grid_and_missing_times_raise(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("2024-01-01 01:37:00", 2.0), ("2024-01-01 03:00:00", 3.0)], "t string, v double")
    rows = rows.withColumn("t", F.col("t").cast("timestamp"))
    with pytest.raises(Exception, match="off the grid"):
        pn.densify(rows, "t", "1 hour").collect()
    assert pn.densify(rows.where("v <> 2"), "t", "1 hour").count() == 4
    with pytest.raises(Exception, match="has no t"):
        pn.densify(rows.where("v <> 2").unionByName(rows.limit(1).withColumn("t", F.lit(None).cast("timestamp"))), "t", "1 hour").collect()


def test_null_key_is_a_panel(spark):
    a = walk(spark, 90).withColumn("k", F.lit(1))
    both = a.unionByName(walk(spark, 60, seed=1).withColumn("k", F.lit(None).cast("int")))
    assert {(r["k"], r["n"]) for r in moments(both, ["x0", "x1"], 2, ["k"], chunk_rows=16).collect()} == {(1, 88), (None, 58)}
    assert {r["k"] for r in graph.chain_tests(both, ["x0", "x1"], 2, keys=["k"]).collect()} == {1, None}
    timed = both.withColumn("t", F.timestamp_seconds(F.col("idx") * 3600)).drop("idx")
    assert pn.densify(timed, "t", "1 hour", ["k"]).groupBy("k").count().count() == 2
    got = pn.with_index(timed, "t", ["k"]).groupBy("k").agg(F.max("idx").alias("m")).collect()
    assert {(r["k"], r["m"]) for r in got} == {(1, 89), (None, 59)}
    assert pn.last_rows(both, 2, ["k"]).count() == 4


def test_ties_need_an_order(spark):
    rows = spark.range(1000).selectExpr("id", "id div 10 as t")
    want = {(i, i) for i in range(1000)}
    for parts in (2, 5):
        got = pn.with_index(rows.repartition(parts), "t", ties=["id"], buckets=7).select("id", "idx").collect()
        assert {tuple(r) for r in got} == want
    with pytest.raises(Exception, match="equal t"):
        pn.with_index(rows, "t", buckets=7).collect()


def test_tree_does_not_depend_on_scale_or_partitions(spark):
    rng = np.random.default_rng(3)
    x, noise = rng.uniform(0, 5, 3000), rng.normal(size=3000)
    values = [(i, float(x[i]), float(np.sin(x[i - 1]) + 0.1 * noise[i])) for i in range(3000)]
    base = spark.createDataFrame(values, "idx long, x double, y double")
    found = []
    for scale in (1.0, 1e-6, 1e6):
        rows, fit, shares = tree.tree_round(base.withColumn("y", F.col("y") * scale), "y", "x", 2, depth=3)
        r2 = fit.collect()[0]["r2"]
        found.append((round(r2, 6), [(r["lag"], round(r["importance"], 6)) for r in shares.orderBy("lag").collect()],
                      np.round(rows.orderBy("idx").toPandas().prediction.to_numpy() / scale, 6).tolist()))
    assert found[0][0] > 0.8 and found[0] == found[1] == found[2]
    cuts = [tree.split_points(base.repartition(p), ["x", "y"], 32).collect()[0]["thresholds"] for p in (2, 5, 9)]
    assert cuts[0] == cuts[1] == cuts[2] and all(20 < len(c) < 32 for c in cuts[0])
    level = spark.createDataFrame([(i, 7.0, float(i % 3)) for i in range(60)], "idx long, c double, v double")
    assert tree.split_points(level, ["c", "v"], 32).collect()[0]["thresholds"] == [[], [0.5, 1.5]]


def test_eight_old_variables_and_a_new_one(spark):
    rows = walk(spark, 200, 9)
    names = [f"x{j}" for j in range(9)]
    table = moments(rows, names, 1)
    tests = graph.incremental_effect(table, names[:8], "x8", 0.1)
    assert tests.where("effect = 'x8' and cause <> 'x8'").count() == 40320


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda key, default: None)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())
