import numpy as np
import pandas as pd
import pytest
from fixtures import chain_mse, known_graph, lags, ols
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lagweave.functions import metrics
from lagweave.operators import boost, graph, panel as pn
from lagweave.operators.moments import moments
from lagweave.plans import orders

NAMES = ["s1", "s2", "s3", "s4"]
few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def linear(spark):
    return spark.createDataFrame(known_graph("linear")).repartition(5).cache()


def edges_of(df):
    return {(r.cause, r.effect) for r in df.select("cause", "effect").distinct().collect()}


def test_chains_equal_plain_least_squares(linear):
    pdf = known_graph("linear")
    for fill in (None, 0.0):
        for r in boost.boost_chains(moments(linear, NAMES, 2, fill=fill, chunk_rows=100), NAMES, 0.1).collect():
            got = [x.mse for x in r.rounds]
            np.testing.assert_allclose(got, chain_mse(pdf, r.order, 2, 0.1, fill), rtol=1e-9)


def test_chain_equals_ml_regressions(spark, linear):
    order, label = ["s3", "s4", "s1"], "s3"
    rows = pn.lag_panel(linear, NAMES, 3)
    got = boost.boost_chains(moments(linear, NAMES, 3), NAMES, 0.1, orders=[order]).first().rounds
    for j, name in enumerate(order):
        ready = VectorAssembler(inputCols=pn.lag_names(name, 3), outputCol=f"f{j}").transform(rows)
        model = LinearRegression(featuresCol=f"f{j}", labelCol=label, predictionCol=f"p{j}", maxIter=1000).fit(ready)
        assert got[j].mse == pytest.approx(model.summary.meanSquaredError, rel=1e-9)
        rows = model.transform(ready).withColumn(f"r{j}", F.col(label) - (1.0 if j == 0 else 0.1) * F.col(f"p{j}"))
        label = f"r{j}"


def test_shared_prefixes_equal_single_orders(linear):
    table = moments(linear, NAMES, 2)
    shared = {tuple(r.order): [x.mse for x in r.rounds] for r in boost.boost_chains(table, NAMES, 0.1).collect()}
    picked = [["s1", "s4", "s2", "s3"], ["s4", "s3", "s2", "s1"]]
    for r in boost.boost_chains(table, NAMES, 0.1, orders=picked).collect():
        assert shared[tuple(r.order)] == pytest.approx([x.mse for x in r.rounds])
    assert len(shared) == 24


def test_test_ids_follow_the_plan(spark, linear):
    plan = {r.test_id: tuple(r.order) for r in orders.test_plan(spark, NAMES, 2).collect()}
    got = {r.test_id: tuple(r.order) for r in boost.boost_chains(moments(linear, NAMES, 2), NAMES).collect()}
    assert got == plan


def test_true_edges_are_found(spark, linear):
    found = edges_of(graph.causality_graph(linear, NAMES, 2, alpha=1e-3, v=0.1))
    assert {("s1", "s3"), ("s2", "s3"), ("s3", "s4")} <= found


def test_moments_do_not_depend_on_chunks_or_row_order(linear):
    one = moments(linear, NAMES, 3, lags=[1, 3]).orderBy("p").collect()
    many = moments(linear.orderBy(F.rand(3)), NAMES, 3, lags=[1, 3], chunk_rows=16).orderBy("p").collect()
    for a, b in zip(one, many):
        assert (a.n, a.n_rows) == (b.n, b.n_rows) == (1500 - a.p, 1500)
        np.testing.assert_allclose(a.means, b.means, atol=1e-12)
        np.testing.assert_allclose(a.g, b.g, rtol=1e-9, atol=1e-8)


def test_far_from_zero_levels_keep_their_digits(spark):
    """Values around 1e8 with unit spread: centred chunks lose nothing."""
    pdf = known_graph("linear", 600)
    moved = pdf.assign(**{c: pdf[c] + 1e8 for c in NAMES})
    got = boost.boost_chains(moments(spark.createDataFrame(moved), NAMES, 2, chunk_rows=64), NAMES, orders=[NAMES]).first()
    np.testing.assert_allclose([r.mse for r in got.rounds], chain_mse(pdf, NAMES, 2, 1.0), rtol=1e-6)


@few
@given(scale=st.floats(0.01, 1000), shift=st.floats(-100, 100), seed=st.integers(0, 99))
def test_affine_rescaling_leaves_p_unchanged(spark, scale, shift, seed):
    pdf = known_graph("nonlinear", 300, seed)
    moved = pdf.assign(s2=pdf.s2 * scale + shift)
    a, b = (graph.chain_tests(spark.createDataFrame(d), NAMES[:3], 2, v=0.1).orderBy("test_id").toPandas() for d in (pdf, moved))
    np.testing.assert_allclose(a.p_value, b.p_value, rtol=1e-5, atol=1e-12)


@few
@given(seed=st.integers(0, 99), p=st.integers(1, 4))
def test_unshrunk_mse_never_rises(spark, seed, p):
    table = moments(spark.createDataFrame(known_graph("nonlinear2", 300, seed)), NAMES, p)
    for r in boost.boost_chains(table, NAMES, 1.0).collect():
        mse = [x.mse for x in r.rounds]
        assert all(b <= a * (1 + 1e-12) for a, b in zip(mse, mse[1:]))


def test_constant_and_duplicate_variables(spark):
    pdf = known_graph("linear", 400).assign(s4=3.0)
    pdf["s2"] = pdf.s1
    tests = graph.chain_tests(spark.createDataFrame(pdf), NAMES, 2, v=1.0).toPandas()
    assert tests[(tests.cause == "s4") & (tests.effect != "s4")].p_value.between(0.999, 1).all()
    constant = tests[tests.effect == "s4"]
    assert (constant.mse_all == 0).all() and constant.f_score.isna().all()


def test_gaps_are_reported(spark):
    pdf = known_graph("linear", 50).drop(index=20)
    with pytest.raises(Exception, match="not consecutive"):
        moments(spark.createDataFrame(pdf), NAMES, 2).collect()


def test_panels_are_independent(spark):
    parts = [known_graph("linear", 200 + 30 * i, i).assign(k=i) for i in range(3)]
    both = graph.chain_tests(spark.createDataFrame(pd.concat(parts)), NAMES, 2, v=0.1, keys=["k"]).toPandas()
    for i, part in enumerate(parts):
        alone = graph.chain_tests(spark.createDataFrame(part.drop(columns="k")), NAMES, 2, v=0.1).toPandas().sort_values("test_id")
        mine = both[both.k == i].sort_values("test_id")
        np.testing.assert_allclose(mine.p_value, alone.p_value, rtol=1e-9)
        assert (mine.n == len(part)).all()


def test_row_level_rounds_and_predictions(linear):
    pdf = known_graph("linear")
    lagged = pn.lag_panel(linear, NAMES, 2)
    first = boost.boost_round(lagged, "s3", "s3", 2)
    rows = boost.boost_round(first, "residual", "s1", 2, v=0.1, pred="pred2", out="res2")
    fit = metrics.fit_metrics(rows, "residual", "pred2").first()
    mse = chain_mse(pdf, ["s3", "s1"], 2, 0.1)
    assert fit.mse == pytest.approx(mse[1])
    assert fit.r2 == pytest.approx(fit.explained_variance)
    chains = boost.boost_chains(moments(linear, NAMES, 2), NAMES, 0.1, orders=[["s3", "s1"]])
    preds = boost.chain_predictions(lagged, chains, ["s3", "s1"], 2)
    both = rows.join(preds.select("idx", "predicted_1", "predicted_2"), "idx").toPandas()
    np.testing.assert_allclose(both.pred2, both.predicted_2, atol=1e-9)


def test_joint_ols(linear):
    pdf = known_graph("linear")
    x = np.hstack([lags(pdf[c].to_numpy(), 2) for c in NAMES])
    beta, pred = ols(x, pdf.s3.to_numpy()[2:])
    got = boost.joint_ols(moments(linear, NAMES, 2), "s3", NAMES).first()
    np.testing.assert_allclose([got.intercept, *got.coef], beta, atol=1e-9)
    assert got.mse == pytest.approx(np.mean((pdf.s3.to_numpy()[2:] - pred) ** 2))


def test_incremental_effect_is_the_full_run_on_those_orders(linear):
    table = moments(linear, NAMES, 2)
    got = graph.incremental_effect(table, NAMES[:3], "s4", 0.1).toPandas().sort_values("test_id")
    full = graph.chain_tests(linear, NAMES, 2, v=0.1).toPandas().sort_values("test_id")
    np.testing.assert_allclose(got.p_value, full[full.effect == "s4"].p_value, rtol=1e-9)


def test_incremental_cause_conditioned_is_the_longer_chain(linear):
    """Fitting the new variable on what the old chain left is one more round."""
    table = moments(linear, NAMES, 2)
    state = graph.causality_state(table, NAMES[:3], 0.1)
    got = graph.incremental_cause(state, table, "s4", 4, mode="condition").collect()
    pdf = known_graph("linear")
    for r in got:
        assert r.mse_all == pytest.approx(chain_mse(pdf, r.order, 2, 0.1)[-1])


def test_state_survives_a_table(spark, linear, tmp_path):
    old = moments(linear, NAMES[:3], 2)
    graph.causality_state(old, NAMES[:3], 0.1).write.parquet(str(tmp_path / "state"))
    table = moments(linear, NAMES, 2)
    stored = graph.incremental_cause(spark.read.parquet(str(tmp_path / "state")), table, "s4", 5).toPandas().sort_values("test_id")
    direct = graph.incremental_cause(graph.causality_state(table, NAMES[:3], 0.1), table, "s4", 5).toPandas().sort_values("test_id")
    np.testing.assert_allclose(stored.p_value, direct.p_value, rtol=1e-9)


def test_incremental_graph_sources_and_filters(linear):
    out = graph.incremental_graph(linear, NAMES[:3], "s4", 2, alpha=1e-3).toPandas()
    assert {"effect", "existing"} <= set(out.source)
    assert (out.p_value < 1e-3).all()
    assert (out[out.source == "effect"].effect == "s4").all() and (out[out.source == "cause"].cause == "s4").all()
    kept = set(out[out.source == "existing"].test_id)
    assert set(out[out.source == "cause"].test_id) <= kept
    everything = graph.incremental_graph(linear, NAMES[:3], "s4", 2, alpha=1.1, all_tests=True).toPandas()
    assert everything.groupby("source").size().to_dict() == {"effect": 6, "cause": 6, "existing": 6}


def test_edge_operations(spark):
    edges = spark.createDataFrame(
        [("e", "c", 1, 0.5), ("e", "c", 2, 0.1), ("e", "c", 3, 0.1), ("e", "e", 1, 0.2)], "effect string, cause string, lag int, p_value double")
    assert [tuple(r) for r in graph.edge_list(edges).select("effect", "cause", "lag", "p_value").collect()] == [("e", "c", 2, 0.1)]
    assert graph.edge_list(edges, keep_self=True).count() == 2
    assert graph.significant(edges, 0.1).count() == 0  # strictly below
    ranked = graph.rank_edges(edges.withColumnRenamed("p_value", "strength"), 2).collect()
    assert [r.lag for r in ranked] == [2, 3]
