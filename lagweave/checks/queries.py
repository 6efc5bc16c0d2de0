"""One query per operator, on panels derived from the supplied tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist, metrics
from ..operators import boost, granger, graph, tree, var
from ..operators import panel as pn
from ..operators.moments import moments
from ..operators.staging import scratch_path
from ..plans import orders
from ..sources import io

EVENTS = ["click", "error", "purchase", "signup", "view"]
SHIPMENTS = {"af": "AF", "ao": "AO", "nf": "NF", "no": "NO", "rf": "RF", "ro": "RO"}
PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}
TWO, THREE, FOUR = ["click", "view"], ["click", "view", "error"], ["click", "view", "error", "purchase"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r6(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
                       for f in df.schema.fields])


def joined_order(df: DataFrame) -> DataFrame:
    return df.withColumn("order", F.array_join("order", ","))


def clock(c: str = "t") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hourly_events(spark, sf, keys=(), value=None, names=EVENTS) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("grp", F.pmod("user_id", F.lit(8)))
    amount = None if value is None else F.col(value)
    return pn.long_panel(ev, "ts", "1 hour", F.col("event_type"), names, amount, keys)


def event_counts(spark, sf, names=EVENTS, keys=()) -> DataFrame:
    """Hourly counts of some event types. Asking for the needed ones only lets ``densify`` read the table once."""
    return pn.densify(hourly_events(spark, sf, keys, names=names), "t", "1 hour", keys)


def event_values(spark, sf, names=EVENTS) -> DataFrame:
    return pn.densify(hourly_events(spark, sf, value="value", names=names), "t", "1 hour")


def daily_shipments(spark, sf, keys=(), names=tuple(SHIPMENTS)) -> DataFrame:
    li = table(spark, sf, "lineitem")
    sums = pn.long_panel(li, "l_shipdate", "1 day", F.concat("l_returnflag", "l_linestatus"),
                         {n: SHIPMENTS[n] for n in names}, F.col("l_quantity"), keys)
    return pn.densify(sums, "t", "1 day", keys)


def daily_orders(spark, sf) -> DataFrame:
    od = table(spark, sf, "orders")
    return pn.long_panel(od, "o_orderdate", "1 day", F.col("o_orderpriority"), PRIORITIES)


def scaled_values(spark, sf) -> DataFrame:
    """Event values brought to the range of the known-graph models."""
    ev = event_values(spark, sf, FOUR)
    return ev.select("idx", *[((F.col(v) - 150) / 100).alias(s) for s, v in zip(("s1", "s2", "s3", "s4"), FOUR)])


# --- sources and panels -----------------------------------------------------


@query
def csv_header_roundtrip(spark, sf):
    path = scratch_path(spark, "csv_header")
    event_counts(spark, sf).select("idx", *EVENTS).write.csv(path, header=True)
    return io.read_panel(spark, path, "idx").select(F.col("idx").cast("long").alias("idx"), *EVENTS)


@query
def csv_headerless_named(spark, sf):
    path = scratch_path(spark, "csv_named")
    event_counts(spark, sf, TWO).select("idx", *TWO).write.csv(path, header=True)
    return io.read_panel(spark, path, "idx", ["idx", "x1", "x2"], skip_rows=1)


@query
def matrix_roundtrip(spark, sf):
    path = scratch_path(spark, "matrix")
    io.write_matrix(event_values(spark, sf, TWO).select("idx", *TWO), path)
    return rounded(io.read_panel(spark, path, names=["idx", "x1", "x2"]), 4)


@query
def edges_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "edges")
    edges = graph.causality_graph(event_counts(spark, sf), EVENTS, 2, alpha=0.9, v=1.0)
    io.write_edges(edges.select("effect", "cause", "p_value", "order"), path)
    return rounded(io.read_panel(spark, path, schema="effect string, cause string, p_value double, `order` string"))


@query
def panel_wide_events(spark, sf):
    return event_counts(spark, sf).select("idx", clock(), *EVENTS)


@query
def panel_wide_shipments(spark, sf):
    return daily_shipments(spark, sf).select("idx", clock(), *SHIPMENTS)


@query
def panel_assembled(spark, sf):
    hours = hourly_events(spark, sf)
    series = {v: hours.where(F.col(v) > 0).select("t", F.col(v).alias("value")) for v in THREE}
    return pn.assemble_panel(series, "t").select(clock(), *THREE)


@query
def panel_shape_grouped(spark, sf):
    shape = pn.panel_shape(daily_shipments(spark, sf, ["l_linenumber"]), ["l_linenumber"])
    return shape.select("l_linenumber", "n", F.col("k").cast("long").alias("k"))


@query
def time_index(spark, sf):
    return pn.with_index(daily_orders(spark, sf), "t").select("idx", clock(), *PRIORITIES)


@query
def time_index_grouped(spark, sf):
    sparse = hourly_events(spark, sf, ["grp"])
    return pn.with_index(sparse, "t", ["grp"]).select("grp", "idx", clock(), "click")


@query
def calendar_month_end(spark, sf):
    days = pn.with_calendar(pn.with_index(daily_orders(spark, sf), "t"), "1979-01-01", "M")
    return days.select("idx", F.date_format("date", "yyyy-MM-dd").alias("date"), "urgent")


@query
def calendar_daily(spark, sf):
    days = pn.with_calendar(pn.with_index(daily_orders(spark, sf), "t"), "1900-01-01", "D")
    return days.select("idx", F.date_format("date", "yyyy-MM-dd").alias("date"), "urgent")


@query
def lag_zero_fill(spark, sf):
    return pn.lag_panel(event_counts(spark, sf, TWO).select("idx", *TWO), TWO, 2, fill=0.0)


@query
def lag_drop(spark, sf):
    return pn.lag_panel(event_counts(spark, sf, TWO).select("idx", *TWO), TWO, 3)


@query
def lag_features(spark, sf):
    lagged = pn.lag_panel(event_counts(spark, sf, TWO).select("idx", *TWO), TWO, 2)
    out = lagged.select("idx", pn.feature_array("view", 2).alias("features"))
    return out.select("idx", F.element_at("features", 1).alias("f1"), F.element_at("features", 2).alias("f2"))


@query
def lag_grouped(spark, sf):
    days = daily_shipments(spark, sf, ["l_linenumber"], ["af", "no"]).select("l_linenumber", "idx", "af", "no")
    return pn.lag_panel(days, ["af", "no"], 2, ["l_linenumber"])


@query
def lag_chunked(spark, sf):
    days = daily_shipments(spark, sf, names=["af", "no"]).select("idx", "af", "no")
    return pn.lag_panel(days, ["af", "no"], 3, chunk_rows=100)


@query
def slice_prefix(spark, sf):
    return pn.slice_panel(daily_shipments(spark, sf), hi=499).select("idx", *SHIPMENTS)


@query
def slice_last_p(spark, sf):
    return pn.last_rows(daily_shipments(spark, sf), 5).select("idx", *SHIPMENTS)


@query
def slice_range(spark, sf):
    return pn.slice_panel(daily_shipments(spark, sf), 499, 548).select("idx", *SHIPMENTS)


def _middle(spark, sf) -> DataFrame:
    """Positions 300 to 599 of the hourly counts: a panel that does not begin at 0."""
    return pn.slice_panel(event_counts(spark, sf), 300, 599)


@query
def lag_of_slice(spark, sf):
    return pn.lag_panel(_middle(spark, sf).select("idx", *EVENTS), EVENTS, 2, chunk_rows=64)


@query
def moments_of_slice(spark, sf):
    return _cells(moments(_middle(spark, sf), TWO, 2))


@query
def chain_tests_of_slice(spark, sf):
    tests = graph.chain_tests(_middle(spark, sf), THREE, 2, v=0.1)
    return rounded(joined_order(tests.select(*_TEST_COLS)))


@query
def time_index_ties(spark, sf):
    events = table(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("t"), "event_id", "event_type")
    return pn.with_index(events, "t", ["event_type"], ties=["event_id"]).select("event_type", "event_id", "idx")


@query
def preview_rows(spark, sf):
    return daily_shipments(spark, sf).orderBy("idx").limit(10).select("idx", *SHIPMENTS)


def _structural(model: str) -> Query:
    return lambda spark, sf: rounded(pn.structural_mean(scaled_values(spark, sf), model))


QUERIES["structural_mean_linear"] = _structural("linear")
QUERIES["structural_mean_nonlinear"] = _structural("nonlinear")
QUERIES["structural_mean_nonlinear2"] = _structural("nonlinear2")


# --- single fits ------------------------------------------------------------


def _click_round(spark, sf) -> DataFrame:
    lagged = pn.lag_panel(event_counts(spark, sf, TWO).select("idx", *TWO), TWO, 2)
    return boost.boost_round(lagged, "click", "click", 2)


@query
def ols_fit_lag2(spark, sf):
    lagged = pn.lag_panel(event_counts(spark, sf, TWO).select("idx", *TWO), TWO, 2)
    fit = boost.ols_fit(lagged, "click", pn.lag_names("view", 2))
    return rounded(fit.select("n", "intercept", F.col("coef")[0].alias("b1"), F.col("coef")[1].alias("b2"), "mse", "r2"))


@query
def ols_residual_lag2(spark, sf):
    return rounded(_click_round(spark, sf).select("idx", "predicted", "residual"))


@query
def shrunk_residual(spark, sf):
    lagged = pn.lag_panel(event_counts(spark, sf, TWO).select("idx", *TWO), TWO, 2)
    fit = boost.boost_round(lagged, "click", "view", 2, v=0.1)
    return rounded(fit.select("idx", metrics.residual("click", "predicted", 0.1).alias("by_rule"), "residual"))


@query
def fit_metrics(spark, sf):
    return rounded(metrics.fit_metrics(_click_round(spark, sf), "click", "predicted"))


@query
def cumulative_prediction(spark, sf):
    panel = event_counts(spark, sf, THREE).select("idx", *THREE)
    chains = boost.boost_chains(moments(panel, THREE, 2), THREE, 0.1, orders=[["click", "view", "error"]])
    rows = boost.chain_predictions(pn.lag_panel(panel, THREE, 2), chains, ["click", "view", "error"], 2)
    preds = ["predicted_1", "predicted_2", "predicted_3"]
    return rounded(metrics.cumulative_prediction(rows, preds).select("idx", *preds, "pred_y", "last_step"))


@query
def joint_ols(spark, sf):
    fit = boost.joint_ols(moments(event_counts(spark, sf, TWO), TWO, 1), "click", TWO)
    return rounded(fit.select("n", "intercept", F.col("coef")[0].alias("b_click"), F.col("coef")[1].alias("b_view"), "mse", "r2"))


@query
def moment_matrix(spark, sf):
    return _cells(moments(event_counts(spark, sf, TWO), TWO, 2))


def _cells(table: DataFrame) -> DataFrame:
    """A moment table, one row per cell of the matrix."""
    cells = table.select("n", "n_rows", "cols", "means", F.posexplode("g").alias("at", "g"))
    q = F.size("cols")
    row, col = F.floor(F.col("at") / q).cast("int"), F.pmod(F.col("at"), q)
    return rounded(cells.select("n", "n_rows", F.get("cols", row).alias("row"), F.get("cols", col).alias("col"),
                                F.get("means", row).alias("row_mean"), "g"))


# --- boosting chains and graphs ---------------------------------------------


def _rounds(spark, sf, v: float) -> DataFrame:
    chains = boost.boost_chains(moments(event_counts(spark, sf), EVENTS, 2), EVENTS, v)
    rows = joined_order(boost.chain_rounds(chains))
    return rounded(rows.select("test_id", "order", "round", "x_name", "mse", "r2", "intercept",
                               F.col("coef")[0].alias("b1"), F.col("coef")[1].alias("b2")))


@query
def boost_chain_linear(spark, sf):
    return _rounds(spark, sf, 1.0)


@query
def boost_chain_shrunk(spark, sf):
    return _rounds(spark, sf, 0.1)


def _tests(spark, sf, names=EVENTS, **how) -> DataFrame:
    return graph.chain_tests(event_counts(spark, sf, names), names, 2, **how)


_TEST_COLS = ["test_id", "effect", "cause", "order", "n", "mse_prev", "mse_all", "f_score", "p_value"]


@query
def chain_f_test(spark, sf):
    return rounded(joined_order(_tests(spark, sf, v=0.1).select(*_TEST_COLS)))


@query
def chain_f_test_zero_fill(spark, sf):
    return rounded(joined_order(_tests(spark, sf, v=0.1, fill=0.0).select(*_TEST_COLS)))


@query
def chain_f_test_fitted_n(spark, sf):
    picked = [["click", "view", "error"], ["view", "error", "click"]]
    return rounded(joined_order(_tests(spark, sf, THREE, v=1.0, n="fitted", orders=picked).select(*_TEST_COLS)))


@query
def mse_log_ratio(spark, sf):
    return rounded(_tests(spark, sf, v=1.0).select("test_id", metrics.log_mse_ratio().alias("log_ratio")))


@query
def pseudo_f_ratio(spark, sf):
    return rounded(_tests(spark, sf, v=1.0).select(
        "test_id", metrics.pseudo_f().alias("ratio"), metrics.log_pseudo_f().alias("log_ratio")))


@query
def r2_change(spark, sf):
    return rounded(_tests(spark, sf, v=1.0).select("test_id", metrics.r2_change().alias("change")))


@query
def test_plan(spark, sf):
    names = pn.discover_variables(table(spark, sf, "events"), "event_type")
    return joined_order(orders.test_plan(spark, names, 2)).select("test_id", "effect", "cause", "order", "maxlag")


@query
def variable_pairs(spark, sf):
    events = table(spark, sf, "events")
    counts = events.groupBy(F.col("event_type").alias("cause")).agg(F.count(F.lit(1)).alias("events"))
    return orders.variable_pairs(spark, pn.discover_variables(events, "event_type")).join(counts, "cause").select("effect", "cause", "events")


@query
def causality_graph_linear(spark, sf):
    edges = graph.causality_graph(event_counts(spark, sf), EVENTS, 2, alpha=0.5, v=0.1)
    return rounded(joined_order(edges.select(*_TEST_COLS)))


@query
def causality_graph_five(spark, sf):
    names = pn.discover_variables(table(spark, sf, "events"), "event_type")
    edges = graph.causality_graph(event_counts(spark, sf, names), names, 2, alpha=0.05, v=0.1)
    return rounded(joined_order(edges.select(*_TEST_COLS)))


@query
def causality_graph_grouped(spark, sf):
    days = daily_shipments(spark, sf, ["l_linenumber"], ["af", "no", "ro"])
    edges = graph.causality_graph(days, ["af", "no", "ro"], 2, alpha=0.2, v=0.1, keys=["l_linenumber"])
    return rounded(joined_order(edges.select("l_linenumber", *_TEST_COLS)), 4)


@query
def causality_graph_null_key(spark, sf):
    """Panels by a key that is null for a fifth of the users."""
    ev = table(spark, sf, "events").withColumn("grp", F.expr("nullif(user_id % 5, 0)"))
    wide = pn.long_panel(ev, "ts", "1 hour", F.col("event_type"), THREE, keys=["grp"])
    edges = graph.causality_graph(pn.densify(wide, "t", "1 hour", ["grp"]), THREE, 2, alpha=0.5, v=0.1, keys=["grp"])
    return rounded(joined_order(edges.select(F.col("grp").cast("string").alias("grp"), *_TEST_COLS)))


def _incremental(spark, sf, **how) -> DataFrame:
    return graph.incremental_graph(event_counts(spark, sf, THREE), TWO, "error", 2, alpha=0.7, v=0.1, **how)


def _edge_view(df: DataFrame) -> DataFrame:
    return rounded(joined_order(df.select("source", *_TEST_COLS)))


@query
def incremental_effect(spark, sf):
    table = moments(event_counts(spark, sf, THREE), THREE, 2)
    return rounded(joined_order(graph.incremental_effect(table, TWO, "error", 0.1).select(*_TEST_COLS)))


@query
def incremental_cause(spark, sf):
    table = moments(event_counts(spark, sf, THREE), THREE, 2)
    state = graph.causality_state(table, TWO, 0.1)
    return rounded(joined_order(graph.incremental_cause(state, table, "error", 4).select(*_TEST_COLS)))


@query
def incremental_cause_conditioned(spark, sf):
    table = moments(event_counts(spark, sf, THREE), THREE, 2)
    state = graph.causality_state(table, TWO, 0.1)
    return rounded(joined_order(graph.incremental_cause(state, table, "error", 3, mode="condition").select(*_TEST_COLS)))


@query
def incremental_merged(spark, sf):
    return _edge_view(_incremental(spark, sf))


def all_chain_tests(spark, sf) -> DataFrame:
    """Every test of the five event types, significant or not: the flagship query."""
    tests = graph.chain_tests(event_counts(spark, sf), EVENTS, 2, v=0.1)
    return rounded(joined_order(tests.select(*_TEST_COLS)))


# --- trees ------------------------------------------------------------------


@query
def tree_stump_round(spark, sf):
    rows, _, _ = tree.tree_round(event_counts(spark, sf, ["click"]), "click", "click", 2, depth=1)
    return rounded(rows.select("idx", "prediction", "residual"))


@query
def tree_round(spark, sf):
    rows, _, _ = tree.tree_round(event_counts(spark, sf, TWO), "click", "view", 2, depth=3)
    return rounded(rows.select("idx", "prediction", "residual"))


@query
def tree_round_grouped(spark, sf):
    rows, _, _ = tree.tree_round(event_counts(spark, sf, TWO, ["grp"]), "click", "view", 2, depth=2, keys=["grp"])
    return rounded(rows.select("grp", "idx", "prediction"))


@query
def tree_importances(spark, sf):
    _, _, shares = tree.tree_round(event_counts(spark, sf, ["click"]), "click", "click", 2, depth=3)
    return rounded(shares.select(F.col("lag").cast("long").alias("lag"), "importance"))


@query
def ar_tree(spark, sf):
    _, fit, _ = tree.ar_tree(event_counts(spark, sf, ["click"]), "click", 3, depth=4)
    return rounded(fit.select("n", "mse", "r2"))


@query
def tree_round_values(spark, sf):
    """A tree on continuous values: hundreds of distinct ones, so thresholds come from the grid."""
    rows, _, _ = tree.tree_round(event_values(spark, sf, TWO), "click", "view", 2, depth=3)
    return rounded(rows.select("idx", "prediction", "residual"))


@query
def tree_importances_values(spark, sf):
    _, _, shares = tree.tree_round(event_values(spark, sf, TWO), "click", "view", 2, depth=3)
    return rounded(shares.select(F.col("lag").cast("long").alias("lag"), "importance"))


@query
def causality_graph_tree(spark, sf):
    edges = graph.causality_graph(event_counts(spark, sf, THREE), THREE, 2, alpha=0.5, v=0.1, learner="tree", depth=2)
    return rounded(joined_order(edges.select(*_TEST_COLS)))


@query
def incremental_from_state(spark, sf):
    path, panel = scratch_path(spark, "chains"), event_counts(spark, sf, THREE)
    graph.keep_state(panel, path, TWO, 2, 0.1)
    return _edge_view(_incremental(spark, sf, state_path=path))


@query
def incremental_stored(spark, sf):
    """The merged increment kept by source, its new causes written anew, and all of it read back."""
    path, merged = scratch_path(spark, "edges"), _incremental(spark, sf)
    io.store_edges(merged, path)
    io.store_edges(merged.where("source = 'cause'"), path)
    return _edge_view(spark.read.schema(merged.schema).parquet(path))


@query
def incremental_tree(spark, sf):
    return _edge_view(_incremental(spark, sf, learner="tree", depth=2))


@query
def causality_graph_tree_five(spark, sf):
    """All five event types at the depth and leaf size of production."""
    edges = graph.causality_graph(event_counts(spark, sf), EVENTS, 2, alpha=0.5, v=0.1, learner="tree", depth=6)
    return rounded(joined_order(edges.select(*_TEST_COLS)))


@query
def ar_tree_five(spark, sf):
    """Autoregressive trees of all event types at depth 5."""
    panel = event_counts(spark, sf)
    fits = [tree.ar_tree(panel, v, 3, depth=5)[1].select(F.lit(v).alias("variable"), "n", "mse", "r2") for v in EVENTS]
    return rounded(reduce(DataFrame.unionByName, fits))


@query
def incremental_tree_from_state(spark, sf):
    """The trees of two variables are written; the third is added to what is read back."""
    panel, path = event_counts(spark, sf, THREE), scratch_path(spark, "tree-state")
    tree.tree_chains(panel.select("idx", *TWO), TWO, 2, 0.1, depth=2, state_path=path)
    return _edge_view(_incremental(spark, sf, learner="tree", depth=2, state_path=path))


# --- vector autoregressions -------------------------------------------------


def _var1(spark, sf) -> DataFrame:
    return var.var_fit(event_counts(spark, sf, TWO), TWO, 1)


@query
def var_dims(spark, sf):
    dims = var.var_dims(var.var_fit(event_counts(spark, sf), EVENTS, [1, 5]))
    return dims.select(*[F.col(c).cast("long").alias(c) for c in dims.columns])


@query
def var_fit(spark, sf):
    cells = _var1(spark, sf).select("nobs", F.posexplode("params").alias("at", "value"))
    return rounded(cells.select("nobs", F.col("at").cast("long").alias("at"), "value"))


@query
def var_summary(spark, sf):
    rows = var.var_summary(_var1(spark, sf), TWO)
    return rounded(rows.select("equation", "term", F.col("lag").cast("long").alias("lag"), "coef", "std_err", "t_stat", "p_value"))


@query
def var_residual_correlation(spark, sf):
    return rounded(var.residual_correlation(_var1(spark, sf), TWO).select("row", "col", "correlation"))


def _forecast(spark, sf, steps: int, alpha=None) -> DataFrame:
    panel = event_counts(spark, sf, TWO)
    fc = var.var_forecast(var.var_fit(panel, TWO, 1), panel, TWO, steps, alpha=alpha, p=1)
    return fc.withColumn("step", F.col("step").cast("long"))


@query
def var_forecast(spark, sf):
    return rounded(_forecast(spark, sf, 50).select("step", "variable", "mean"))


@query
def forecast_bands(spark, sf):
    return rounded(_forecast(spark, sf, 100, 0.05).select("step", "variable", "mean", "lower", "upper"))


def _versus(spark, sf, offset: int) -> DataFrame:
    panel = event_counts(spark, sf, TWO)
    past = pn.slice_panel(panel, hi=499)
    fc = var.var_forecast(var.var_fit(past, TWO, 1), pn.slice_panel(panel, 499, 499), TWO, 50)
    table = var.forecast_vs_actual(fc, panel, "click", 500, offset=offset)
    return rounded(table.select(F.col("step").cast("long").alias("step"), "true_value", "predicted_value"))


@query
def forecast_vs_actual(spark, sf):
    return _versus(spark, sf, 0)


@query
def forecast_vs_actual_shifted(spark, sf):
    return _versus(spark, sf, -1)


def _causality(spark, sf, kind: str) -> DataFrame:
    fit = var.var_fit(event_counts(spark, sf, TWO), TWO, 2)
    out = var.var_causality(fit, TWO, "click", "view", kind)
    return out


@query
def var_wald_f(spark, sf):
    return rounded(_causality(spark, sf, "f").select("statistic", "df1", "df2", "p_value"))


@query
def var_wald_chi2(spark, sf):
    return rounded(_causality(spark, sf, "wald").select("statistic", "df1", "p_value"))


@query
def var_critical_values(spark, sf):
    both = [_causality(spark, sf, k).select("kind", "signif", "critical_value") for k in ("f", "wald")]
    return rounded(both[0].unionByName(both[1]))


@query
def var_joint_causality(spark, sf):
    fit = var.var_fit(event_counts(spark, sf, THREE), THREE, 2)
    return rounded(var.var_causality(fit, THREE, 0).select("statistic", "df1", "df2", "p_value"))


@query
def granger_pairs(spark, sf):
    tests = granger.granger_pairs(event_counts(spark, sf), EVENTS, 4)
    return rounded(tests.select("effect", "cause", F.col("lag").cast("long").alias("lag"), "f_score", "p_value"))


@query
def granger_best_lag(spark, sf):
    edges = granger.granger_graph(event_counts(spark, sf), EVENTS, 4, alpha=0.3)
    return rounded(edges.select("effect", "cause", F.col("lag").cast("long").alias("lag"), "p_value"))


@query
def granger_graph_default(spark, sf):
    edges = granger.granger_graph(event_counts(spark, sf), EVENTS, 4)
    return rounded(edges.select("effect", "cause", F.col("lag").cast("long").alias("lag"), "p_value"))


@query
def var_graph_default(spark, sf):
    edges = var.var_graph(event_counts(spark, sf, FOUR), FOUR)
    return rounded(edges.select("effect", "cause", F.col("lag").cast("long").alias("lag"), "p_value"))


@query
def granger_pairs_grouped(spark, sf):
    days = daily_shipments(spark, sf, ["l_linenumber"], ["af", "no", "ro"])
    tests = granger.granger_pairs(days, ["af", "no", "ro"], [2], ["l_linenumber"])
    return rounded(tests.select("l_linenumber", "effect", "cause", "f_score", "p_value"), 5)


@query
def var_pair_tests(spark, sf):
    fit = var.var_fit(event_counts(spark, sf, FOUR), FOUR, [1, 2, 3])
    tests = var.var_pair_tests(fit, FOUR)
    return rounded(tests.select("effect", "cause", F.col("lag").cast("long").alias("lag"), "statistic", "p_value"))


@query
def var_graph(spark, sf):
    edges = var.var_graph(event_counts(spark, sf, FOUR), FOUR, 3, alpha=0.5)
    return rounded(edges.select("effect", "cause", F.col("lag").cast("long").alias("lag"), "p_value"))


def _var_edges(spark, sf) -> DataFrame:
    edges = var.var_edges(event_counts(spark, sf, FOUR), FOUR, 3, alpha=0.9)
    return edges.withColumn("time_lag", F.col("time_lag").cast("long"))


@query
def var_edges_running_min(spark, sf):
    return rounded(_var_edges(spark, sf))


@query
def var_edges_top20(spark, sf):
    return rounded(graph.rank_edges(_var_edges(spark, sf), 20))


@query
def var_edges_csv(spark, sf):
    path = scratch_path(spark, "var_edges")
    io.write_edges(_var_edges(spark, sf), path, header=False, sort_by=["strength"])
    schema = "effect string, cause string, time_lag long, strength double, method string"
    return rounded(spark.read.schema(schema).csv(path))


# --- distributions ----------------------------------------------------------


def _hourly_scores(spark, sf) -> DataFrame:
    """A score per hour of the panel, to evaluate the tails on."""
    return event_counts(spark, sf, ["click"]).select("idx", (F.col("click") / 2 + F.col("idx") / 300).alias("x"))


@query
def f_survival_table(spark, sf):
    rows = _hourly_scores(spark, sf)
    return rounded(rows.select("idx", *[dist.f_sf("x", d1, 100).alias(f"p{d1}") for d1 in (2, 4, 3)],
                               dist.f_sf_even("x", 3, 100).alias("p6")))


@query
def chi2_survival_table(spark, sf):
    rows = _hourly_scores(spark, sf)
    return rounded(rows.select("idx", *[dist.chi2_sf("x", df).alias(f"p{df}") for df in (2, 4)],
                               dist.chi2_sf_even("x", 3).alias("p6")))


@query
def quantile_table(spark, sf):
    rows = _hourly_scores(spark, sf).select("idx", ((F.col("idx") + 1) / 2000 + 0.5).alias("level"))
    return rounded(rows.select("idx", dist.f_ppf("level", 2, 100).alias("f"), dist.chi2_ppf("level", 2).alias("chi2")), 5)
