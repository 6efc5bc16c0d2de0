"""Vector autoregressions on moment tables: fit, summary, forecast, and causality tests.

The data is read once for all lag orders; each fit, test or forecast is a small
solve on one row of the moment table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_ppf, chi2_sf, f_ppf, f_sf, normal_quantile, t_sf2
from ..plans.orders import explode_pairs
from .boost import _arrow_type, _moment_rows, in_batches
from .graph import edge_list, significant
from .moments import moments
from .panel import last_rows, running_min


def term_names(variables: Sequence[str], p: int) -> list[str]:
    """Regressors of every equation: intercept, then all variables at lag 1, at lag 2, …"""
    return ["const", *[f"{v}.L{lag}" for lag in range(1, p + 1) for v in variables]]


_FIT = [("p", pa.int32()), ("variables", pa.list_(pa.string())), ("nobs", pa.int64()), ("df_model", pa.int64()),
        ("df_resid", pa.int64()), ("params", pa.list_(pa.float64())), ("sigma_u", pa.list_(pa.float64())),
        ("ztz_inv", pa.list_(pa.float64()))]
_FIT_DDL = ("p int, variables array<string>, nobs long, df_model long, df_resid long, params array<double>, "
            "sigma_u array<double>, ztz_inv array<double>")


def _fit_one(m: dict, names: Sequence[str]) -> dict:
    k, p, n, g, mean = len(names), m["p"], m["n"], m["g"], m["means"]
    y = [m["cols"].index(v) for v in names]
    x = [i + lag for lag in range(1, p + 1) for i in y]
    scale = np.sqrt(np.diag(g)[x])
    scale = np.outer(*[np.where(scale > 0, scale, 1.0)] * 2)
    inv = np.linalg.pinv(g[np.ix_(x, x)] / scale, rcond=1e-13, hermitian=True) / scale
    slopes = inv @ g[np.ix_(x, y)]
    resid = g[np.ix_(y, y)] - g[np.ix_(y, x)] @ slopes
    params = np.vstack([mean[y] - mean[x] @ slopes, slopes])
    cross = -inv @ mean[x]
    ztz_inv = np.block([[np.array([[1 / n - mean[x] @ cross]]), cross[None, :]], [cross[:, None], inv]])
    df_resid = n - (1 + k * p)
    return {"p": p, "variables": list(names), "nobs": n, "df_model": 1 + k * p, "df_resid": df_resid,
            "params": params.ravel(), "sigma_u": (resid / df_resid).ravel(), "ztz_inv": ztz_inv.ravel()}


def var_fit_moments(moment_table: DataFrame, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One VAR(p) per panel and lag order of the moment table.

    ``params`` is (1 + k·p) x k with one column per equation, ``sigma_u`` the
    residual covariance over df_resid, ``ztz_inv`` the inverse regressor moment;
    all row-major. Orders without residual degrees of freedom are left out.
    """
    keys, names = list(keys), list(variables)
    schema = pa.schema([*[pa.field(c, _arrow_type(moment_table, c)) for c in keys], *_FIT])

    def run(batches):
        for batch in batches:
            fits = [{c: row[c] for c in keys} | _fit_one(m, names) for row, m in _moment_rows(batch)]
            yield pa.RecordBatch.from_pylist(fits, schema=schema)

    key_ddl = "".join(f"`{c}` {moment_table.schema[c].dataType.simpleString()}, " for c in keys)
    enough = F.col("n") > 1 + len(names) * F.col("p")
    return moment_table.where(enough).mapInArrow(run, key_ddl + _FIT_DDL)


def var_fit(panel: DataFrame, variables: Sequence[str], p: int | Sequence[int], keys: Sequence[str] = (),
            idx: str = "idx") -> DataFrame:
    """Fit VAR(p), or one VAR per order in a list, in one pass over the panel."""
    orders = [p] if isinstance(p, int) else list(p)
    table = moments(panel, variables, max(orders), keys, lags=orders, idx=idx)
    return var_fit_moments(table, variables, keys)


def var_dims(fit: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return fit.select(*keys, "p", F.size("variables").alias("k"), "nobs", "df_model", "df_resid")


def var_summary(fit: DataFrame, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per equation and term: coefficient, standard error, t and p (Student t on df_resid)."""
    k = len(variables)
    names = F.array(*[F.lit(v) for v in variables])
    rows = fit.select("*", F.posexplode("params").alias("_at", "coef"))
    term, eq = F.floor(F.col("_at") / k).cast("int"), F.pmod(F.col("_at"), F.lit(k)).cast("int")
    width = F.col("df_model").cast("int")
    var = F.get("ztz_inv", term * width + term) * F.get("sigma_u", eq * k + eq)
    lag = F.when(term == 0, F.lit(0)).otherwise(F.floor((term - 1) / k).cast("int") + 1)
    named = F.when(term == 0, F.lit("const")).otherwise(
        F.concat(F.get(names, F.pmod(term - 1, F.lit(k)).cast("int")), F.lit(".L"), lag.cast("string")))
    out = rows.select(*keys, "p", F.get(names, eq).alias("equation"), named.alias("term"), lag.alias("lag"), "coef",
                      F.sqrt(var).alias("std_err"), "df_resid")
    out = out.withColumn("t_stat", F.try_divide("coef", "std_err"))
    return out.withColumn("p_value", t_sf2("t_stat", F.col("df_resid"))).drop("df_resid")


def residual_correlation(fit: DataFrame, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of the residuals of each pair of equations."""
    k = len(variables)
    names = F.array(*[F.lit(v) for v in variables])
    rows = fit.select("*", F.posexplode("sigma_u").alias("_at", "cov"))
    i, j = F.floor(F.col("_at") / k).cast("int"), F.pmod(F.col("_at"), F.lit(k)).cast("int")
    scale = F.sqrt(F.get("sigma_u", i * k + i) * F.get("sigma_u", j * k + j))
    return rows.select(*keys, "p", F.get(names, i).alias("row"), F.get(names, j).alias("col"),
                       F.try_divide("cov", scale).alias("correlation"))


def _forecast_one(row: dict, steps: int, z: float | None):
    k, p = len(row["variables"]), row["p"]
    params = np.array(row["params"]).reshape(1 + k * p, k)
    lags = [params[1 + i * k : 1 + (i + 1) * k].T for i in range(p)]
    past = np.array(row["last"], float).reshape(-1, k)
    sigma, spread = np.array(row["sigma_u"]).reshape(k, k), np.zeros((k, k))
    weights = []
    for step in range(1, steps + 1):
        mean = params[0] + sum(a @ past[-1 - i] for i, a in enumerate(lags))
        past = np.vstack([past, mean])[-max(p, 1):]
        # moving-average weight of the shock step-1 periods ago
        weights.append(np.eye(k) if step == 1 else sum(a @ weights[-1 - i] for i, a in enumerate(lags[: len(weights)])))
        weights = weights[-p:]
        spread = spread + weights[-1] @ sigma @ weights[-1].T
        half = None if z is None else z * np.sqrt(np.diag(spread))
        for j, name in enumerate(row["variables"]):
            yield {"step": step, "variable": name, "mean": mean[j],
                   "lower": None if half is None else mean[j] - half[j], "upper": None if half is None else mean[j] + half[j]}


def var_forecast(fit: DataFrame, recent: DataFrame, variables: Sequence[str], steps: int, keys: Sequence[str] = (),
                 alpha: float | None = None, idx: str = "idx", p: int | None = None) -> DataFrame:
    """Iterate the fitted VAR ``steps`` ahead from each panel's last rows: step, variable, mean, lower, upper.

    ``recent`` holds at least the last p rows of each panel (see ``last_rows``), and is gathered by panel; with ``p``, the largest
    order fitted, it may be the whole panel, of which only the last p rows are.
    With ``alpha`` the bands hold 1 - alpha of the forecast distribution.
    """
    keys, names = list(keys), list(variables)
    recent = recent if p is None else last_rows(recent, p, keys, idx)
    tail = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        F.col(idx).alias("at"), F.array(*[F.col(v).cast("double") for v in names]).alias("x")))).alias("_tail"))
    tail = tail.select(*keys, F.transform("_tail", lambda r: r["x"]).alias("last"))
    z = None if alpha is None else normal_quantile(1 - alpha / 2)
    # a constant key lets a single unkeyed panel join by equality too
    orders = fit.select(*keys, "p", "variables", "params", "sigma_u").withColumn("_one", F.lit(1))
    rows = orders.join(tail.withColumn("_one", F.lit(1)), [*keys, "_one"]).drop("_one")
    schema = pa.schema([*[pa.field(c, _arrow_type(fit, c)) for c in keys], ("p", pa.int32()), ("step", pa.int32()),
                        ("variable", pa.string()), ("mean", pa.float64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def run(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        records = ({c: row[c] for c in (*keys, "p")} | f for row in rows for f in _forecast_one(row, steps, z))
        return in_batches(records, schema)

    key_ddl = "".join(f"`{c}` {fit.schema[c].dataType.simpleString()}, " for c in keys)
    return rows.mapInArrow(run, f"{key_ddl}p int, step int, variable string, mean double, lower double, upper double")


def forecast_vs_actual(forecast: DataFrame, panel: DataFrame, variable: str, origin: int, keys: Sequence[str] = (),
                       offset: int = 0, idx: str = "idx") -> DataFrame:
    """Forecast next to the observed value: step, true_value, predicted_value.

    ``origin`` is the position of the first forecast step; ``offset=-1`` compares
    each step with the row before it.
    """
    fc = forecast.where(F.col("variable") == variable).select(
        *keys, "step", (F.col("step") + F.lit(origin - 1 + offset)).cast("long").alias("_at"), F.col("mean").alias("predicted_value"))
    actual = panel.select(*keys, F.col(idx).alias("_at"), F.col(variable).alias("true_value"))
    return actual.join(fc, [*keys, "_at"]).select(*keys, "step", "true_value", "predicted_value")


def _named(which, names: Sequence[str]) -> list[str]:
    which = [which] if isinstance(which, (str, int)) else list(which)
    if not all(isinstance(c, (str, int)) for c in which):
        raise TypeError("variables must be given as names or positions")
    chosen = [names[c] if isinstance(c, int) else c for c in which]
    for c in chosen:
        if c not in names:
            raise ValueError(f"{c!r} is not a variable of the model")
    return chosen


def _wald(row: dict, caused: Sequence[str], causing: Sequence[str]) -> float:
    """λ of "no lag of ``causing`` enters the equations of ``caused``"."""
    names, p = row["variables"], row["p"]
    k = len(names)
    e = [names.index(c) for c in caused]
    c = [1 + lag * k + names.index(v) for lag in range(p) for v in causing]
    b = np.array(row["params"]).reshape(-1, k)[np.ix_(c, e)]
    v = np.array(row["ztz_inv"]).reshape(1 + k * p, -1)[np.ix_(c, c)]
    s = np.array(row["sigma_u"]).reshape(k, k)[np.ix_(e, e)]
    if not (np.isfinite(v).all() and np.isfinite(b).all() and np.isfinite(s).all()):
        return float("nan")
    # The selected covariance is v ⊗ s, so λ = tr(s⁻¹ bᵀ v⁻¹ b).
    return float(np.trace(np.linalg.pinv(s, hermitian=True) @ b.T @ np.linalg.pinv(v, hermitian=True) @ b))


def _statistics(rows: DataFrame, keys: Sequence[str], extra: Sequence[str], pick) -> DataFrame:
    keep = [*keys, *extra, "p", "nobs", "df_resid"]
    schema = pa.schema([*[pa.field(c, _arrow_type(rows, c)) for c in keep], ("lam", pa.float64())])

    def run(batches):
        for batch in batches:
            found = [{c: row[c] for c in keep} | {"lam": _wald(row, *pick(row))} for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, ddl + ", lam double")


def _check_kind(kind: str, signif: float) -> str:
    if kind.lower() not in ("f", "wald"):
        raise ValueError(f"choose 'f' or 'wald' as kind of test, not {kind!r}")
    if signif <= 0 or signif >= 1:
        raise ValueError(f"a significance level lies strictly within 0..1: {signif}")
    return kind.lower()


def _distribution(stats: DataFrame, restrictions, k: int, kind: str, signif: float | None = None) -> DataFrame:
    q = F.lit(restrictions) * F.col("p")
    out = stats.withColumn("df1", q.cast("long"))
    if kind == "f":
        out = out.withColumn("df2", (F.col("df_resid") * k).cast("long")).withColumn("statistic", F.col("lam") / F.col("df1"))
        out = out.withColumn("p_value", f_sf("statistic", "df1", "df2"))
        return out if signif is None else out.withColumn("critical_value", f_ppf(1 - signif, "df1", "df2"))
    out = out.withColumn("df2", F.lit(None).cast("long")).withColumn("statistic", F.col("lam"))
    out = out.withColumn("p_value", chi2_sf("statistic", "df1"))
    return out if signif is None else out.withColumn("critical_value", chi2_ppf(1 - signif, "df1"))


def var_causality(fit: DataFrame, variables: Sequence[str], caused, causing=None, kind: str = "f", signif: float = 0.05,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Test that ``causing`` does not help predict ``caused``, for sets of variables (names or positions).

    Without ``causing`` all other variables are taken. Returns the statistic,
    degrees of freedom, p and the critical value at ``signif``.
    """
    kind, names = _check_kind(kind, signif), list(variables)
    effects = _named(caused, names)
    causes = [c for c in names if c not in effects] if causing is None else _named(causing, names)
    stats = _statistics(fit, list(keys), [], lambda row: (effects, causes))
    out = _distribution(stats, len(effects) * len(causes), len(names), kind, signif)
    listed = [F.array(*[F.lit(c) for c in cs]) for cs in (effects, causes)]
    return out.select(*keys, "p", listed[0].alias("caused"), listed[1].alias("causing"), F.lit(kind).alias("kind"),
                      "statistic", "df1", "df2", "p_value", "critical_value", F.lit(signif).alias("signif"))


def var_pair_tests(fit: DataFrame, variables: Sequence[str], kind: str = "f", keys: Sequence[str] = (),
                   keep_self: bool = True) -> DataFrame:
    """The causality test for every ordered pair and every fitted order: effect, cause, lag, statistic, p_value."""
    kind = _check_kind(kind, 0.5)
    rows = explode_pairs(fit, variables, keep_self)
    stats = _statistics(rows, list(keys), ["effect", "cause"], lambda row: ([row["effect"]], [row["cause"]]))
    out = _distribution(stats, 1, len(variables), kind)
    return out.select(*keys, "effect", "cause", F.col("p").alias("lag"), "statistic", "df1", "df2", "p_value")


def _lag_tests(panel, variables, lags, keys, kind, idx):
    orders = list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)
    return var_pair_tests(var_fit(panel, variables, orders, keys, idx), variables, kind, keys)


def var_graph(panel: DataFrame, variables: Sequence[str], maxlag: int | Sequence[int] = 4, alpha: float = 0.001,
              keys: Sequence[str] = (), kind: str = "f", keep_self: bool = True, idx: str = "idx") -> DataFrame:
    """VAR causality graph over lag orders 1..maxlag: one edge per pair with its best lag and p."""
    tests = _lag_tests(panel, variables, maxlag, keys, kind, idx)
    return edge_list(significant(tests, alpha), keys, keep_self)


def var_edges(panel: DataFrame, variables: Sequence[str], maxlag: int | Sequence[int], alpha: float = 0.05,
              keys: Sequence[str] = (), keep_self: bool = False, idx: str = "idx") -> DataFrame:
    """VAR edge list: a row each time a pair's p falls to a new minimum while the lag order grows.

    Columns effect, cause, time_lag, strength, method; sorted with ``rank_edges``.
    """
    tests = significant(_lag_tests(panel, variables, maxlag, keys, "f", idx), alpha)
    rows = running_min(tests if keep_self else tests.where("effect != cause"), keys)
    return rows.select(*keys, "effect", "cause", F.col("lag").alias("time_lag"), F.col("p_value").alias("strength"),
                       F.lit("GC").alias("method"))
