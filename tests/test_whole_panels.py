"""Gaps that end where a chunk begins: seen only by counting the whole panel's rows."""

import pytest
from pyspark.sql import functions as F
from test_shapes import walk

from lagweave.operators import graph, tree
from lagweave.operators import panel as pn

CHUNK = 100
GAPS = {"ends with a chunk": [198, 199], "up to a chunk's first row": [198, 199, 200], "whole chunk": [*range(100, 200)], "within a chunk": [150]}


@pytest.mark.parametrize("gap", GAPS.values(), ids=GAPS)
@pytest.mark.parametrize("fill", [None, 0.0])
def test_gaps_raise_wherever_they_end(spark, gap, fill):
    rows = walk(spark).withColumn("k", F.when(F.col("idx") < 0, 1))
    whole = rows.unionByName(rows.withColumn("k", F.lit(2)))
    holed = whole.where(~(F.col("idx").isin(gap) & F.col("k").isNull()))
    for keys, panel in ((["k"], holed), ([], holed.where("k is null").drop("k")), (["k"], pn.beginning_at(holed, 0))):
        with pytest.raises(Exception, match="not consecutive"):
            pn.lag_panel(panel, ["x0"], 2, keys, fill, chunk_rows=CHUNK).collect()
    part = holed.where("k = 2 or idx > 250")
    assert pn.lag_panel(part, ["x0"], 2, ["k"], fill, chunk_rows=CHUNK).count() == 400 + 149 - (4 if fill is None else 0)


def test_trees_raise_on_gaps_at_the_end_of_a_chunk(spark):
    size = pn.CHUNK_ROWS
    rows = spark.range(size - 200, size + 200).selectExpr("id as idx", "sin(id) as x0", "cos(id) as x1").where(f"idx < {size - 5} or idx >= {size}")
    with pytest.raises(Exception, match="not consecutive"):
        tree.tree_round(rows, "x0", "x1", 2, depth=2)[1].collect()
    with pytest.raises(Exception, match="not consecutive"):
        graph.causality_graph(rows, ["x0", "x1"], 2, learner="tree", depth=2).collect()


def test_slices_tell_where_panels_begin(spark):
    rows = pn.beginning_at(walk(spark), 0)
    part = pn.slice_panel(rows, 200).select("idx", "x0")
    assert pn.first_position(part) == 200
    assert pn.lag_panel(part, ["x0"], 2, chunk_rows=CHUNK).count() == part.count() - 2
    with pytest.raises(Exception, match="not consecutive"):
        pn.lag_panel(rows.where("idx >= 200"), ["x0"], 2, chunk_rows=CHUNK).collect()
