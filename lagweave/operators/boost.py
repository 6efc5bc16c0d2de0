"""Residual-boosting chains with the linear learner, and the F test on their last two rounds.

A label is a coefficient vector over the moment columns, so a round is one small
solve on the moment matrix and no row of data is read again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import f_sf
from ..plans.orders import check_variables, explode_orders, grow_orders, text_array
from .moments import _matrix
from .panel import attach_by_panel, lag_names, shuffle_partitions

_ROUND = pa.struct([
    ("round", pa.int32()), ("x_name", pa.string()), ("mse", pa.float64()), ("r2", pa.float64()),
    ("intercept", pa.float64()), ("coef", pa.list_(pa.float64())),
])
_ROUND_DDL = "struct<round:int,x_name:string,mse:double,r2:double,intercept:double,coef:array<double>>"


#: Steps of an order that one work item walks by itself: 7! = 5040 tests at most.
IN_TASK = 7


def solve_normal(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least-squares coefficients from centred moments; minimum norm when lags are collinear."""
    if not (np.isfinite(a).all() and np.isfinite(y).all()):
        return np.full(y.shape, np.nan)
    scale = np.sqrt(np.diag(a))
    scale = np.where(scale > 0, scale, 1.0)
    scaled = (y.T / scale).T
    return (np.linalg.lstsq(a / np.outer(scale, scale), scaled, rcond=1e-11)[0].T / scale).T


def _round(m: dict, name: str, label: np.ndarray, offset: float, number: int, v: float):
    """Fit ``label`` on the lags of ``name``: the round's record, next label and offset."""
    x = [m["cols"].index(c) for c in lag_names(name, m["p"])]
    g, n = m["g"], m["n"]
    b = solve_normal(g[np.ix_(x, x)], g[x] @ label)
    fit, nxt = label.copy(), label.copy()
    fit[x] -= b
    mse, var = max(fit @ g @ fit / n, 0.0), label @ g @ label / n
    intercept = label @ m["means"] + offset - b @ m["means"][x]
    shrink = 1.0 if number == 1 else v
    nxt[x] -= shrink * b
    r2 = 1 - mse / var if var > 0 else None
    record = {"round": number, "x_name": name, "mse": mse, "r2": r2, "intercept": intercept, "coef": b.tolist()}
    return record, nxt, offset - shrink * intercept


def _walk(m: dict, todo: Sequence[str], left: Sequence[str], v: float, state=None):
    """Run the fixed variables ``todo``, then every order of ``left``; shared prefixes are fitted once."""
    if state is None:
        label = np.zeros(len(m["cols"]))
        label[m["cols"].index(todo[0])] = 1.0
        state = ([], [], None, label, 0.0)
    order, rounds, _, label, offset = state
    choices = todo[:1] or left
    if not choices:
        yield state
        return
    for name in choices:
        record, nxt, shifted = _round(m, name, label, offset, len(order) + 1, v)
        grown = ([*order, name], [*rounds, record], label, nxt, shifted)
        yield from _walk(m, todo[1:], left if todo else [c for c in left if c != name], v, grown)


def _moment_rows(batch: pa.RecordBatch):
    """Moment records of a batch, with the other columns of each row."""
    table = pa.Table.from_batches([batch])
    if not len(table):
        return
    means, g = _matrix(table, "means"), _matrix(table, "g")
    q = means.shape[1]
    for i, row in enumerate(table.drop_columns(["means", "g"]).to_pylist()):
        yield row, {"p": row["p"], "n": max(row["n"], 1), "cols": row["cols"], "means": means[i], "g": g[i].reshape(q, q)}


def in_batches(records, schema: pa.Schema, size: int = 2048):
    """Arrow batches of a stream of records."""
    while part := list(islice(records, size)):
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def boost_chains(moment_table: DataFrame, variables: Sequence[str], v: float = 1.0, keys: Sequence[str] = (),
                 orders: Sequence[Sequence[str]] | None = None, prefix: Sequence[str] = (), state: bool = False) -> DataFrame:
    """One row per panel and test: test_id, effect, cause, order, p, n, n_rows, rounds, cols, label, residual.

    Without ``orders`` every order of ``variables`` is tested (after ``prefix``
    if given). With ``state``, ``label`` and ``residual`` are the last round's
    label and what is left of it, as coefficients over ``cols``: what the
    incremental mode needs; else the three are null.
    """
    keys, names = list(keys), list(variables)
    base = moment_table.where("n > 0")
    if orders is None:
        check_variables([*prefix, *names])
        # Explicit steps give the cluster work items, k(k-1) per panel at least; each grows the last steps inside its task.
        rows = grow_orders(base, names, min(len(names), max(2, len(names) - IN_TASK)))
        if prefix:
            rows = rows.withColumn("order", F.expr(f"concat({text_array(prefix)}, `order`)"))
    else:
        rows = explode_orders(base, orders)
    # Few tests per panel: let the size of the moment rows decide the tasks. Many: one panel alone must fill the cluster.
    tests = math.factorial(len(names)) if orders is None else len(orders)
    by = [*keys, "p", "test_id"]
    rows = rows.repartition(shuffle_partitions(rows), *by) if tests > 1000 else rows.repartition(*by)
    complete = orders is None

    out_schema = pa.schema([
        *[pa.field(k, _arrow_type(moment_table, k)) for k in keys],
        ("test_id", pa.int64()), ("effect", pa.string()), ("cause", pa.string()), ("order", pa.list_(pa.string())),
        ("p", pa.int32()), ("n", pa.int64()), ("n_rows", pa.int64()), ("rounds", pa.list_(_ROUND)),
        ("cols", pa.list_(pa.string())), ("label", pa.list_(pa.float64())), ("residual", pa.list_(pa.float64())),
    ])
    ddl = "".join(f"`{k}` {moment_table.schema[k].dataType.simpleString()}, " for k in keys) + (
        "test_id long, effect string, cause string, order array<string>, p int, n long, n_rows long, "
        f"rounds array<{_ROUND_DDL}>, cols array<string>, label array<double>, residual array<double>"
    )

    def found(batches):
        for batch in batches:
            for row, m in _moment_rows(batch):
                left = [c for c in names if c not in row["order"]] if complete else []
                fixed = {k: row[k] for k in keys} | {c: row[c] for c in ("p", "n", "n_rows")}
                for i, (order, rounds, label, residual, _) in enumerate(_walk(m, row["order"], left, v)):
                    test = {"test_id": row["test_id"] + i, "effect": order[0], "cause": order[-1], "order": order, "rounds": rounds}
                    yield fixed | test | ({"cols": row["cols"], "label": label, "residual": residual} if state else {})

    def run(batches):
        return in_batches(found(batches), out_schema)

    return rows.mapInArrow(run, ddl)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def chain_rounds(chains: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rounds in long form: test_id, effect, cause, round, x_name, mse, r2, intercept, coef."""
    return chains.select(*keys, "test_id", "effect", "cause", "order", F.explode("rounds").alias("r")).select(
        *keys, "test_id", "effect", "cause", "order", "r.*"
    )


def chain_f_test(chains: DataFrame, k: int, keys: Sequence[str] = (), n: str = "all") -> DataFrame:
    """F test of the last round against the one before.

    ``k`` is the number of variables of the panel; ``n='all'`` counts every
    panel row, ``n='fitted'`` only the rows of the fit.
    """
    if n not in ("all", "fitted"):
        raise ValueError("n must be 'all' or 'fitted'")
    rounds = chains.selectExpr(
        *[f"`{c}`" for c in keys], "test_id", "effect", "cause", "`order`", "p as maxlag", f"{'n_rows' if n == 'all' else 'n'} as n",
        *[f"element_at(rounds, {at}).{c} as {c}_{name}" for c in ("mse", "r2") for at, name in ((-2, "prev"), (-1, "all"))],
    )
    return with_f_test(rounds, k)


def with_f_test(tests: DataFrame, k: int) -> DataFrame:
    """Add f_score and p_value from mse_prev, mse_all, n and maxlag.

    F is the relative drop of the MSE per degree of freedom; infinite when the last fit is exact.
    """
    d2 = f"cast(n - {k} * maxlag as double)"
    score = (f"case when mse_all > 0 then (mse_prev - mse_all) / mse_all * ({d2} / maxlag) "
             "when mse_prev > 0 then double('Infinity') end as f_score")
    return tests.selectExpr("*", score).withColumn("p_value", f_sf("f_score", "maxlag", F.expr(d2)))


def ols_fit(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """OLS of any column on any few columns, per panel: n, intercept, coef, mse, r2.

    One aggregation of covariances on the JVM; only one row per panel meets the solver.
    """
    keys, feats = list(keys), list(features)
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i:]]
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(F.avg(label), *[F.avg(c) for c in feats]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("sxx"),
        F.array(*[F.covar_pop(c, label) for c in feats]).alias("sxy"), F.var_pop(label).alias("syy"),
    )
    fields = [*[pa.field(k, _arrow_type(df, k)) for k in keys], ("n", pa.int64()), ("intercept", pa.float64()),
              ("coef", pa.list_(pa.float64())), ("mse", pa.float64()), ("r2", pa.float64())]
    schema, upper = pa.schema(fields), np.triu_indices(len(feats))

    def solve(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                a = np.zeros((len(feats), len(feats)))
                a[upper] = row["sxx"]
                a = np.triu(a) + np.triu(a, 1).T
                sxy, mean = np.array(row["sxy"]), np.array(row["means"])
                b = solve_normal(a, sxy)
                mse = row["syy"] - 2 * b @ sxy + b @ a @ b
                found.append({k: row[k] for k in keys} | {
                    "n": row["n"], "intercept": mean[0] - b @ mean[1:], "coef": b.tolist(), "mse": mse,
                    "r2": 1 - mse / row["syy"] if row["syy"] else None,
                })
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    key_ddl = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return stats.where("n > 0").mapInArrow(solve, f"{key_ddl}n long, intercept double, coef array<double>, mse double, r2 double")


def linear_prediction(intercept: Column, coef: Column, features: Sequence[str]) -> Column:
    out = intercept
    for i, c in enumerate(features):
        out = out + coef[i] * F.col(c)
    return out


def boost_round(lagged: DataFrame, label: str, variable: str, maxlag: int, v: float = 1.0, keys: Sequence[str] = (),
                idx: str = "idx", pred: str = "predicted", out: str = "residual") -> DataFrame:
    """One round on the rows of a lagged panel: adds the prediction, ``label - v * prediction`` and ``mse``."""
    feats = lag_names(variable, maxlag)
    fit = ols_fit(lagged, label, feats, keys).select(*keys, F.col("intercept").alias("_a"), F.col("coef").alias("_b"), "mse")
    rows = attach_by_panel(lagged, fit, keys)
    rows = rows.withColumn(pred, linear_prediction(F.col("_a"), F.col("_b"), feats))
    return rows.withColumn(out, F.col(label) - v * F.col(pred)).drop("_a", "_b")


def chain_predictions(lagged: DataFrame, chains: DataFrame, order: Sequence[str], maxlag: int, keys: Sequence[str] = (),
                      idx: str = "idx") -> DataFrame:
    """Predictions ``predicted_1..`` of one order's rounds on the panel rows: one projection, no refit."""
    fit = chains.where(F.col("order") == F.array(*[F.lit(c) for c in order])).select(*keys, F.col("rounds").alias("_rounds"))
    rows = attach_by_panel(lagged, fit, keys)
    preds = [
        linear_prediction(F.col("_rounds")[j]["intercept"], F.col("_rounds")[j]["coef"], lag_names(name, maxlag))
        .alias(f"predicted_{j + 1}")
        for j, name in enumerate(order)
    ]
    return rows.select(*lagged.columns, *preds)


def joint_ols(moment_table: DataFrame, label: str, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """OLS of ``label`` on all lags of all ``variables`` at once: n, intercept, coef, mse, r2."""
    keys, names = list(keys), list(variables)
    schema = pa.schema([*[pa.field(k, _arrow_type(moment_table, k)) for k in keys], ("p", pa.int32()), ("n", pa.int64()),
                        ("terms", pa.list_(pa.string())), ("intercept", pa.float64()), ("coef", pa.list_(pa.float64())),
                        ("mse", pa.float64()), ("r2", pa.float64())])

    def solve(batches):
        for batch in batches:
            found = []
            for row, m in _moment_rows(batch):
                terms = [c for name in names for c in lag_names(name, m["p"])]
                x, y, g = [m["cols"].index(c) for c in terms], m["cols"].index(label), m["g"]
                b = solve_normal(g[np.ix_(x, x)], g[x, y])
                mse = (g[y, y] - 2 * b @ g[x, y] + b @ g[np.ix_(x, x)] @ b) / m["n"]
                found.append({k: row[k] for k in keys} | {
                    "p": m["p"], "n": row["n"], "terms": terms, "intercept": m["means"][y] - b @ m["means"][x],
                    "coef": b.tolist(), "mse": mse, "r2": 1 - mse * m["n"] / g[y, y] if g[y, y] > 0 else None,
                })
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    key_ddl = "".join(f"`{k}` {moment_table.schema[k].dataType.simpleString()}, " for k in keys)
    return moment_table.where("n > 0").mapInArrow(
        solve, f"{key_ddl}p int, n long, terms array<string>, intercept double, coef array<double>, mse double, r2 double"
    )
