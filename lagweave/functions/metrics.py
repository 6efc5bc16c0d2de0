"""Fit metrics and the comparison scores of a boosting chain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def residual(label, pred, v: float = 1.0) -> Column:
    """``label - v * pred`` on the same row."""
    return F.col(label) - v * F.col(pred)


def fit_metrics(df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, MSE, R² and explained variance of a prediction, per panel."""
    err = F.col(label) - F.col(pred)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        (1 - F.avg(err * err) / F.var_pop(label)).alias("r2"),
        (1 - F.var_pop(err) / F.var_pop(label)).alias("explained_variance"),
    )


def cumulative_prediction(df: DataFrame, preds: Sequence[str]) -> DataFrame:
    """Add ``pred_y`` (sum of the unshrunk predictions) and ``last_step`` (all but the last)."""
    total = reduce(add, [F.col(p) for p in preds])
    return df.withColumn("pred_y", total).withColumn(
        "last_step", F.col("pred_y") - F.col(preds[-1])
    )


def _log_positive(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def log_mse_ratio(mse_prev="mse_prev", mse_all="mse_all") -> Column:
    return _log_positive(F.col(mse_prev) / F.col(mse_all))


def pseudo_f(d_extra: float = 1, n_eff: float = 996, mse_prev="mse_prev", mse_all="mse_all") -> Column:
    """Relative drop of the MSE with fixed degrees of freedom."""
    prev, last = F.col(mse_prev), F.col(mse_all)
    return ((prev - last) / F.lit(float(d_extra))) / (last / F.lit(float(n_eff)))


def log_pseudo_f(d_extra: float = 1, n_eff: float = 996, **cols) -> Column:
    return _log_positive(pseudo_f(d_extra, n_eff, **cols))


def r2_change(r2_prev="r2_prev", r2_all="r2_all") -> Column:
    return F.abs(F.col(r2_all) - F.col(r2_prev)) / F.col(r2_prev)
