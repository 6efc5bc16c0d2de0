import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagweave.operators import panel as pn
from lagweave.sources import io


def long_rows(spark):
    at = [dt.datetime(2024, 3, 10, h, 15) for h in (0, 0, 1, 5)]
    return spark.createDataFrame(
        [("a", at[0], "x", 1.0), ("a", at[1], "y", 2.0), ("a", at[2], "x", 3.0), ("a", at[3], "y", 4.0), ("b", at[2], "x", 5.0)],
        "k string, ts timestamp_ntz, v string, amount double")


def wide(spark):
    return pn.long_panel(long_rows(spark), "ts", "1 hour", F.col("v"), ["x", "y"], F.col("amount"), ["k"])


def test_densify_fills_each_panel_to_its_own_ends(spark):
    got = pn.densify(wide(spark), "t", "1 hour", ["k"], chunk_rows=2).orderBy("k", "idx").toPandas()
    assert got.groupby("k").size().to_dict() == {"a": 6, "b": 1}
    a = got[got.k == "a"]
    assert a.idx.tolist() == [0, 1, 2, 3, 4, 5]
    assert a.x.tolist() == [1, 3, 0, 0, 0, 0] and a.y.tolist() == [2, 0, 0, 0, 0, 4]


def test_zone_less_times_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 2 o'clock does not exist on 2024-03-10 there
    try:
        rows = pn.densify(wide(spark), "t", "1 hour", ["k"]).where("k = 'a'")
        got = [r[0] for r in rows.orderBy("idx").select(F.col("t").cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [f"2024-03-10 0{h}:00:00" for h in range(6)]


@pytest.mark.parametrize("step, sizes", [("30 minutes", 11), ("1 day", 1), ("2 hours", 3)])
def test_steps(spark, step, sizes):
    rows = long_rows(spark).where("k = 'a'")
    got = pn.densify(pn.long_panel(rows, "ts", step, F.col("v"), ["x", "y"]), "t", step)
    assert got.count() == sizes
    assert got.agg(F.sum(F.col("x") + F.col("y"))).first()[0] == 4


def test_index_counts_across_buckets_and_panels(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * F.col("id") + 7).alias("at")).orderBy(F.rand(1))
    got = pn.with_index(rows, "at", ["k"], buckets=13).toPandas().sort_values(["k", "at"])
    for _, g in got.groupby("k"):
        assert g.idx.tolist() == list(range(len(g)))


def test_index_spreads_one_panel_over_many_tasks(spark):
    rows = pn.with_index(spark.range(20000).withColumnRenamed("id", "at"), "at", buckets=8)
    spread = rows.withColumn("b", F.floor(F.col("idx") / 2500)).groupBy("b").count().collect()
    assert len(spread) == 8 and sum(r["count"] for r in spread) == 20000


@pytest.mark.parametrize("fill", [None, 0.0])
def test_chunked_lags_equal_unchunked(spark, fill):
    rows = spark.range(200).select(F.col("id").alias("idx"), (F.col("id") * 7 % 11).cast("double").alias("x"))
    one = pn.lag_panel(rows, ["x"], 5, fill=fill).orderBy("idx").toPandas()
    many = pn.lag_panel(rows, ["x"], 5, fill=fill, chunk_rows=7).orderBy("idx").toPandas()
    pd.testing.assert_frame_equal(one, many)
    x = rows.orderBy("idx").toPandas().x
    expected = x.shift(5, fill_value=0.0) if fill == 0.0 else x.shift(5).iloc[5:]
    assert one.x__lag5.tolist() == expected.tolist()


def test_nulls_of_the_data_stay_visible(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(8)], "idx long, x double")
    got = pn.lag_panel(rows, ["x"], 1).orderBy("idx").toPandas()
    assert len(got) == 7 and got.x__lag1.isna().tolist() == [False, False, False, True, False, False, False]


def test_lag_wider_than_chunk_is_refused(spark):
    with pytest.raises(ValueError):
        pn.lag_panel(spark.range(5).selectExpr("id as idx", "id as x"), ["x"], 4, chunk_rows=3)


def test_last_rows_and_slices(spark):
    rows = spark.range(20).selectExpr("id % 2 as k", "id div 2 as idx", "id as x")
    assert sorted(map(tuple, pn.last_rows(rows, 2, ["k"]).select("k", "idx").collect())) == [(0, 8), (0, 9), (1, 8), (1, 9)]
    assert pn.slice_panel(rows, 3, 4).count() == 4


def test_running_min_keeps_strict_new_minima(spark):
    ps = [0.5, 0.6, 0.5, 0.2, 1.0]
    edges = spark.createDataFrame([("e", "c", i + 1, p) for i, p in enumerate(ps)], "effect string, cause string, lag int, p_value double")
    assert [r.lag for r in pn.running_min(edges).orderBy("lag").collect()] == [1, 4]


def test_csv_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.5, 2.25), (1, -3.0, 1e-7)], "idx long, x double, y double")
    rows.write.csv(str(tmp_path / "h"), header=True)
    assert io.read_panel(spark, str(tmp_path / "h"), "idx").where("x = 1.5").count() == 1
    assert io.read_panel(spark, str(tmp_path / "h"), names=["a", "b", "c"], skip_rows=1).columns == ["a", "b", "c"]
    with pytest.raises(ValueError):
        io.read_panel(spark, str(tmp_path / "h"), "missing")
    io.write_matrix(rows, str(tmp_path / "m"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "m")).collect()) == ["0.000000,1.500000,2.250000", "1.000000,-3.000000,0.000000"]
    edges = spark.createDataFrame([("b", "a", 0.5, ["b", "a"]), ("a", "b", 0.1, ["a", "b"])], "effect string, cause string, p double, ord array<string>")
    io.write_edges(edges, str(tmp_path / "e"), header=False, sort_by=["p"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "e")).collect()][0].startswith("a,b,0.1")


def test_last_rows_are_cut_before_the_shuffle(spark):
    rows = spark.range(0, 4000, 1, 4).selectExpr("if(id % 3 = 0, null, id % 3) as k", "id div 3 as idx", "id * 0.5 as x")
    rows = rows.where("not (k is null and idx = 1331)")
    last = pn.last_rows(rows, 3, ["k"])
    got = sorted(((r.k, r.idx) for r in last.collect()), key=str)
    assert got == sorted([(None, 1332), (None, 1333), (1, 1330), (1, 1331), (1, 1332), (2, 1330), (2, 1331), (2, 1332)], key=str)
    plan = last._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "WindowGroupLimit" in plan and "Join" not in plan and plan.count("Exchange hash") == 1
    assert sorted(r.idx for r in pn.last_rows(rows, 2).select("idx").collect()) == [1332, 1332, 1332, 1333]
