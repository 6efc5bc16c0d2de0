"""Increments from stored moments and chains, and the stored edge table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import graph
from lagweave.operators.moments import bordered_moments, moments
from lagweave.sources import io

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def panels(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key, size in (("x", 90), (None, 60), ("y", 41)):
        x = rng.normal(size=(size, 4)) + [0, 50, 0, 0]
        x[1:, 2] += 0.8 * x[:-1, 0]
        x[2:, 3] += 0.7 * x[:-2, 2]
        rows += [(key, i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "k string, idx long, a double, b double, c double, d double").repartition(3)


@pytest.mark.parametrize("fill", [None, 0.0])
@pytest.mark.parametrize("new", [["d"], ["c", "d"]])
def test_border_equals_one_pass(panels, fill, new):
    old = NAMES[:-len(new)]
    how = {"keys": ["k"], "fill": fill, "lags": [1, 2], "chunk_rows": 16}
    got = bordered_moments(moments(panels, old, 2, **how), panels, old, new, 2, **how).collect()
    want = {(r.k, r.p): r for r in moments(panels, NAMES, 2, **how).collect()}
    assert len(got) == len(want) == 6
    for r in got:
        w = want[r.k, r.p]
        assert (r.n, r.n_rows, r.cols) == (w.n, w.n_rows, w.cols)
        np.testing.assert_allclose(r.means, w.means, rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose(r.g, w.g, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("change", ["rows", "values", "panel", "lags"])
def test_border_of_other_rows_raises(panels, change):
    then = {"rows": panels.where("idx < 40"), "values": panels.withColumn("a", F.col("a") + 1), "panel": panels.where("k = 'x'"), "lags": panels}[change]
    stored = moments(then, NAMES[:3], 2, ["k"], lags=[1] if change == "lags" else [2])
    with pytest.raises(Exception, match="other rows, lags or variables"):
        bordered_moments(stored, panels, NAMES[:3], ["d"], 2, ["k"]).collect()


def test_graph_from_state_equals_one_session(panels, spark, tmp_path):
    named = panels.where("k is not null")
    path, how = str(tmp_path / "state"), {"alpha": 0.2, "v": 0.5, "keys": ["k"]}
    graph.keep_state(named, path, NAMES[:3], 2, 0.5, ["k"])
    for mode in ("replace", "condition"):
        frames = [graph.incremental_graph(named, NAMES[:3], "d", 2, mode=mode, **how, **more).toPandas() for more in ({}, {"state_path": path})]
        one, two = (f.assign(order=f["order"].map(",".join)).sort_values(["k", "source", "test_id"]).reset_index(drop=True) for f in frames)
        assert len(one) and one[["k", "source", "test_id", "order"]].equals(two[["k", "source", "test_id", "order"]])
        np.testing.assert_allclose(one[["f_score", "p_value"]], two[["f_score", "p_value"]], rtol=1e-6, atol=1e-9)
    with pytest.raises(ValueError, match="v=0.5"):
        graph.incremental_graph(named, NAMES[:3], "d", 2, v=0.1, keys=["k"], state_path=path)


def test_stored_edges_replace_their_own_part(spark, tmp_path):
    path, ddl = str(tmp_path / "edges"), "cause string, p double, source string"
    first = [("a", 0.1, "effect"), ("b", 0.2, "cause"), ("c", 0.3, "existing"), ("n", 0.4, None)]
    io.store_edges(spark.createDataFrame(first, ddl), path)
    io.store_edges(spark.createDataFrame([("z", 0.5, "cause"), ("y", 0.6, "cause")], ddl), path)
    io.store_edges(spark.createDataFrame([], ddl), path)
    got = {tuple(r) for r in spark.read.schema(ddl).parquet(path).collect()}
    assert got == {first[0], first[2], first[3], ("z", 0.5, "cause"), ("y", 0.6, "cause")}
