import numpy as np
import pandas as pd
import pytest
from fixtures import known_graph
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from lagweave.operators import graph, panel as pn, tree

NAMES = ["s1", "s2", "s3"]


def rounded_panel(name, rows=600, seed=42):
    """Few distinct values, so that every one of them is a candidate split."""
    pdf = known_graph(name, rows, seed)
    return pdf.assign(**{c: pdf[c].clip(-3, 3).round() for c in ("s1", "s2", "s3", "s4")})


def ml_tree(rows, label, names, depth, pred, min_leaf=10):
    ready = VectorAssembler(inputCols=names, outputCol=f"f_{pred}").transform(rows)
    model = DecisionTreeRegressor(featuresCol=f"f_{pred}", labelCol=label, predictionCol=pred, maxDepth=depth,
                                  minInstancesPerNode=min_leaf, seed=0).fit(ready)
    return model.transform(ready), model


def test_chain_equals_ml_trees(spark):
    panel = spark.createDataFrame(rounded_panel("linear"))
    order = ["s3", "s2", "s1"]
    got = tree.tree_chains(panel, NAMES, 2, v=0.1, orders=[order], depth=3).first().rounds
    rows, label = pn.lag_panel(panel, NAMES, 2), "s3"
    for j, name in enumerate(order):
        rows, _ = ml_tree(rows, label, pn.lag_names(name, 2), 3, f"p{j}")
        err = F.col(label) - F.col(f"p{j}")
        assert got[j].mse == pytest.approx(rows.agg(F.avg(err * err)).first()[0], rel=1e-9)
        rows = rows.withColumn(f"r{j}", F.col(label) - (1.0 if j == 0 else 0.1) * F.col(f"p{j}"))
        label = f"r{j}"


def test_importances_equal_ml(spark):
    panel = spark.createDataFrame(rounded_panel("nonlinear"))
    _, fit, shares = tree.tree_round(panel, "s3", "s1", 3, depth=4)
    rows, model = ml_tree(pn.lag_panel(panel, ["s1", "s3"], 3), "s3", pn.lag_names("s1", 3), 4, "p")
    got = {r.lag: r.importance for r in shares.collect()}
    np.testing.assert_allclose([got.get(i, 0.0) for i in (1, 2, 3)], model.featureImportances.toArray(), rtol=1e-6, atol=1e-9)


def test_tree_learner_sees_the_even_effect_linear_learners_miss(spark):
    panel = spark.createDataFrame(known_graph("nonlinear", 1500))
    names = ["s1", "s3"]
    linear = graph.causality_graph(panel, names, 2, alpha=1e-3, v=1.0).where("cause = 's1'").count()
    trees = graph.causality_graph(panel, names, 2, alpha=1e-3, v=1.0, learner="tree", depth=3).where("cause = 's1'").count()
    assert (linear, trees) == (0, 1)


def test_panels_and_shared_prefixes(spark):
    parts = [rounded_panel("nonlinear2", 300, i).assign(k=i) for i in range(2)]
    both = tree.tree_chain_tests(spark.createDataFrame(pd.concat(parts)), NAMES, 2, keys=["k"], depth=2).toPandas()
    assert len(both) == 12
    alone = tree.tree_chain_tests(spark.createDataFrame(parts[1]), NAMES, 2, depth=2, orders=[["s2", "s3", "s1"]]).first()
    mine = both[(both.k == 1) & both.order.map(lambda o: list(o) == ["s2", "s3", "s1"])].iloc[0]
    assert (mine.mse_prev, mine.mse_all) == (pytest.approx(alone.mse_prev), pytest.approx(alone.mse_all))


def test_continuous_values_use_a_bounded_histogram(spark):
    panel = spark.createDataFrame(known_graph("linear", 800))
    cuts = tree.split_points(pn.lag_panel(panel, ["s1"], 1), ["s1__lag1"], 16).first().thresholds[0]
    assert len(cuts) == 15 and cuts == sorted(cuts)
    _, fit, _ = tree.tree_round(panel, "s3", "s1", 1, depth=3, max_bins=16)
    exact, _ = ml_tree(pn.lag_panel(panel, ["s1", "s3"], 1), "s3", ["s1__lag1"], 3, "p")
    reference = exact.agg(F.avg((F.col("s3") - F.col("p")) ** 2)).first()[0]
    assert fit.first().mse == pytest.approx(reference, rel=0.1)


def test_incremental_tree_modes(spark):
    panel = spark.createDataFrame(rounded_panel("linear", 400))
    out = graph.incremental_graph(panel, ["s1", "s3"], "s4", 2, alpha=1.1, learner="tree", depth=2).toPandas()
    assert out.groupby("source").size().to_dict() == {"effect": 2, "cause": 2, "existing": 2}
    chain = tree.tree_chains(panel, ["s1", "s3", "s4"], 2, orders=[["s3", "s1", "s4"]], depth=2).first().rounds
    longer = graph.incremental_graph(panel, ["s1", "s3"], "s4", 2, alpha=1.1, learner="tree", depth=2, mode="condition").toPandas()
    row = longer[(longer.source == "cause") & (longer.effect == "s3")].iloc[0]
    assert row.mse_all == pytest.approx(chain[2].mse)


def test_autoregressive_tree(spark):
    panel = spark.createDataFrame(rounded_panel("linear", 300))
    _, fit, _ = tree.ar_tree(panel, "s1", 3, depth=3)
    rows, _ = ml_tree(pn.lag_panel(panel, ["s1"], 3), "s1", pn.lag_names("s1", 3), 3, "p", min_leaf=1)
    assert fit.first().mse == pytest.approx(rows.agg(F.avg((F.col("s1") - F.col("p")) ** 2)).first()[0])


def test_increment_from_stored_trees_equals_one_session(spark, tmp_path):
    parts = [rounded_panel("linear", 300, i).assign(k=None if i else 1) for i in range(2)]
    panel = spark.createDataFrame(pd.concat(parts).astype({"k": "object"}), "idx long, s1 double, s2 double, s3 double, s4 double, k long" if "t" not in parts[0] else None)
    old, path = ["s1", "s3"], str(tmp_path / "state")
    tree.tree_chains(panel, old, 2, keys=["k"], depth=3, state_path=path)
    for mode in ("replace", "condition"):
        def edges(**how):
            return graph.incremental_graph(panel, old, "s4", 2, alpha=1.1, keys=["k"], learner="tree", depth=3, mode=mode, **how)

        a, b = (x.toPandas().astype({"order": str}).sort_values(["k", "source", "test_id"]).reset_index(drop=True) for x in (edges(), edges(state_path=path)))
        pd.testing.assert_frame_equal(a, b)
        assert len(a) == 2 * 6
    with pytest.raises(ValueError, match="made for"):
        graph.incremental_graph(panel, ["s3", "s1"], "s4", 2, keys=["k"], learner="tree", depth=3, state_path=path)


def test_deep_trees_equal_ml(spark):
    panel = spark.createDataFrame(rounded_panel("nonlinear", 2000))
    _, fit, _ = tree.tree_round(panel, "s3", "s1", 2, depth=7)
    exact, _ = ml_tree(pn.lag_panel(panel, ["s1", "s3"], 2), "s3", pn.lag_names("s1", 2), 7, "p")
    assert fit.first().mse == pytest.approx(exact.agg(F.avg((F.col("s3") - F.col("p")) ** 2)).first()[0], rel=1e-9)
