"""Pairwise lag regressions: does the past of one variable improve on the effect's own past?"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import f_sf
from ..plans.orders import text_array
from .boost import _arrow_type, _moment_rows, solve_normal
from .graph import edge_list, significant
from .moments import moments
from .panel import lag_names


def _rss(m: dict, y: str, regressors: Sequence[str]) -> float:
    i, x, g = m["cols"].index(y), [m["cols"].index(c) for c in regressors], m["g"]
    b = solve_normal(g[np.ix_(x, x)], g[x, i])
    return float(g[i, i] - 2 * b @ g[x, i] + b @ g[np.ix_(x, x)] @ b)


def granger_pairs(panel: DataFrame, variables: Sequence[str], maxlag: int | Sequence[int], keys: Sequence[str] = (),
                  idx: str = "idx") -> DataFrame:
    """F test of every ordered pair at every lag order: effect, cause, lag, rss_restricted, rss_full, f_score, p_value."""
    orders = list(range(1, maxlag + 1)) if isinstance(maxlag, int) else sorted(maxlag)
    keys = list(keys)
    table = moments(panel, variables, orders[-1], keys, lags=orders, idx=idx)
    names = list(variables)
    # One copy of a panel's moments for each effect, dealt out by it; the effect's own fit serves all its causes.
    rows = table.where("n > 2 * p + 1").selectExpr("*", f"explode({text_array(names)}) as effect", "cast(null as string) as cause")
    rows = rows.repartition(*keys, "p", "effect")
    fixed = [*keys, "effect", "cause", "p", "n"]
    schema = pa.schema([*[pa.field(c, _arrow_type(rows, c)) for c in fixed], ("rss_restricted", pa.float64()),
                        ("rss_full", pa.float64())])

    def run(batches):
        for batch in batches:
            for row, m in _moment_rows(batch):
                own = lag_names(row["effect"], m["p"])
                restricted = _rss(m, row["effect"], own)
                found = [{c: row[c] for c in fixed} | {"cause": cause, "rss_restricted": restricted, "rss_full": _rss(m, row["effect"], own + lag_names(cause, m["p"]))}
                         for cause in names if cause != row["effect"]]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in fixed)
    fits = rows.mapInArrow(run, ddl + ", rss_restricted double, rss_full double")
    d2 = F.col("n") - 2 * F.col("p") - 1
    gain = (F.col("rss_restricted") - F.col("rss_full")) / F.col("p")
    score = F.when(F.col("rss_full") > 0, gain / (F.col("rss_full") / d2)).when(F.col("rss_restricted") > 0, F.lit(float("inf")))
    out = fits.withColumn("f_score", score).withColumn("df2", d2)
    return out.withColumn("p_value", f_sf("f_score", "p", "df2")).select(
        *keys, "effect", "cause", F.col("p").alias("lag"), "rss_restricted", "rss_full", "f_score", "df2", "p_value")


def granger_graph(panel: DataFrame, variables: Sequence[str], maxlag: int | Sequence[int], alpha: float = 1e-10,
                  keys: Sequence[str] = (), idx: str = "idx") -> DataFrame:
    """Significant pairs with the lag of the smallest p."""
    return edge_list(significant(granger_pairs(panel, variables, maxlag, keys, idx), alpha), keys)
