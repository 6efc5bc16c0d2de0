"""Causality graphs from boosting chains: full, incremental, and edge-list operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.orders import text_array
from .boost import _arrow_type, _moment_rows, _round, boost_chains, chain_f_test, with_f_test
from .moments import bordered_moments, moments
from .staging import cut

_EDGE = ("test_id", "effect", "cause", "order", "maxlag", "n", "mse_prev", "mse_all", "f_score", "p_value")


def significant(tests: DataFrame, alpha: float) -> DataFrame:
    """Tests with p strictly below alpha."""
    return tests.where(F.col("p_value") < alpha)


def best_lag(edges: DataFrame, keys: Sequence[str] = (), lag: str = "lag", p: str = "p_value") -> DataFrame:
    """One edge per pair: the smallest p and its lag (the smaller lag on a tie)."""
    return edges.groupBy(*keys, "effect", "cause").agg(
        F.min_by(lag, F.struct(p, lag)).alias(lag), F.min(p).alias(p)
    )


def edge_list(edges: DataFrame, keys: Sequence[str] = (), keep_self: bool = False, **cols) -> DataFrame:
    """Strict directed graph: one row per (cause, effect), self edges optional."""
    kept = edges if keep_self else edges.where("cause != effect")
    return best_lag(kept, keys, **cols)


def rank_edges(edges: DataFrame, n: int | None = None, strength: str = "strength") -> DataFrame:
    """Edges by ascending strength (p); the first n with a stable tie-break."""
    ties = [c for c in ("effect", "cause", "lag") if c in edges.columns]
    ranked = edges.orderBy(strength, *ties)
    return ranked if n is None else ranked.limit(n)


def chain_tests(panel: DataFrame, variables: Sequence[str], maxlag: int, v: float = 1.0, keys: Sequence[str] = (),
                fill: float | None = None, orders: Sequence[Sequence[str]] | None = None, n: str = "all",
                idx: str = "idx") -> DataFrame:
    """All linear chain tests of a panel, significant or not."""
    table = moments(panel, variables, maxlag, keys, fill, idx=idx)
    chains = boost_chains(table, variables, v, keys, orders)
    return chain_f_test(chains, len(variables), keys, n)


def causality_graph(panel: DataFrame, variables: Sequence[str], maxlag: int, alpha: float = 0.05, learner: str = "linear",
                    v: float = 0.1, keys: Sequence[str] = (), fill: float | None = None,
                    orders: Sequence[Sequence[str]] | None = None, n: str = "all", idx: str = "idx", **tree) -> DataFrame:
    """Significant tests over every order of the variables: one row per test, as edges."""
    if learner == "linear":
        tests = chain_tests(panel, variables, maxlag, v, keys, fill, orders, n, idx)
    elif learner == "tree":
        from .tree import tree_chain_tests

        tests = tree_chain_tests(panel, variables, maxlag, v=v, keys=keys, fill=fill, orders=orders, n=n, idx=idx, **tree)
    else:
        raise ValueError(f"learner must be 'linear' or 'tree', not {learner!r}")
    return significant(tests, alpha).select(*keys, *_EDGE)


def incremental_effect(moment_table: DataFrame, old: Sequence[str], new_var: str, v: float = 0.1, keys: Sequence[str] = (),
                       n: str = "all", k: int | None = None) -> DataFrame:
    """Tests with the new variable as effect: it is put in front of every old order."""
    chains = boost_chains(moment_table, old, v, keys, prefix=[new_var])
    return chain_f_test(chains, k or len(old) + 1, keys, n)


def incremental_cause(state: DataFrame, moment_table: DataFrame, new_var: str, k: int, keys: Sequence[str] = (),
                      mode: str = "replace", n: str = "all") -> DataFrame:
    """Tests with the new variable as cause of each stored test's effect.

    ``state`` holds chains over the old variables (possibly read back from a
    table); ``moment_table`` covers old and new variables. ``mode='replace'``
    fits the new lags on the label of the old last round and compares with its
    MSE; ``mode='condition'`` fits them on what the old last round left.
    """
    if mode not in ("replace", "condition"):
        raise ValueError("mode must be 'replace' or 'condition'")
    keys = list(keys)
    stored = state.select(
        *keys, "p", "test_id", "effect", "order", F.col("cols").alias("old_cols"),
        F.col("label" if mode == "replace" else "residual").alias("label"),
        F.element_at("rounds", -1)["mse"].alias("mse_prev"),
    )
    rows = stored.join(moment_table, [*keys, "p"])
    schema = pa.schema([*[pa.field(c, _arrow_type(state, c)) for c in keys], ("p", pa.int32()), ("test_id", pa.int64()),
                        ("effect", pa.string()), ("order", pa.list_(pa.string())), ("n", pa.int64()), ("n_rows", pa.int64()),
                        ("mse_prev", pa.float64()), ("mse_all", pa.float64())])

    def fit(batches):
        for batch in batches:
            found = []
            for row, m in _moment_rows(batch):
                label = np.zeros(len(m["cols"]))
                label[[m["cols"].index(c) for c in row["old_cols"]]] = row["label"]
                prev = row["mse_prev"] if mode == "replace" else label @ m["g"] @ label / m["n"]
                record, _, _ = _round(m, new_var, label, 0.0, 2, 1.0)
                found.append({c: row[c] for c in (*keys, "p", "test_id", "effect", "order", "n", "n_rows")}
                             | {"mse_prev": prev, "mse_all": record["mse"]})
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    key_ddl = "".join(f"`{c}` {state.schema[c].dataType.simpleString()}, " for c in keys)
    fits = rows.mapInArrow(fit, f"{key_ddl}p int, test_id long, effect string, order array<string>, n long, n_rows long, "
                                "mse_prev double, mse_all double")
    return cause_tests(fits, new_var, k, keys, n)


def cause_tests(fits: DataFrame, new_var: str, k: int, keys: Sequence[str], n: str) -> DataFrame:
    """F test of new-as-cause fits; the new variable closes the order."""
    added = text_array([new_var])
    tests = fits.selectExpr(
        *[f"`{c}`" for c in keys], "test_id", "effect", f"{added}[0] as cause", f"concat(`order`, {added}) as `order`",
        "p as maxlag", f"{'n_rows' if n == 'all' else 'n'} as n", "mse_prev", "mse_all")
    return with_f_test(tests, k)


def merge_edges(effect: DataFrame, cause: DataFrame, existing: DataFrame) -> DataFrame:
    """New-as-effect, new-as-cause and existing edges in one table, told apart by ``source``."""
    parts = [df.withColumn("source", F.lit(s)) for df, s in ((effect, "effect"), (cause, "cause"), (existing, "existing"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def causality_state(moment_table: DataFrame, old: Sequence[str], v: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """Chains of the old variables, materialised: what a later increment needs. May also be written as a table."""
    return cut(boost_chains(moment_table, old, v, keys, state=True))


def keep_state(panel: DataFrame, path: str, old: Sequence[str], maxlag: int, v: float = 0.1, keys: Sequence[str] = (),
               fill: float | None = None, idx: str = "idx") -> None:
    """Write what increments of a linear graph start from: the old variables' moments and chains, in two folders under ``path``."""
    where = f"{path}/moments"
    moments(panel, old, maxlag, keys, fill, idx=idx).write.parquet(where)
    table = panel.sparkSession.read.parquet(where)
    boost_chains(table, old, v, keys, state=True).withColumn("_v", F.lit(float(v))).write.parquet(f"{path}/chains")


def kept_state(spark: SparkSession, path: str, v: float) -> tuple[DataFrame, DataFrame]:
    """Moments and chains that `keep_state` wrote; raises where they were fitted with another ``v``."""
    chains = spark.read.parquet(f"{path}/chains")
    other = chains.where(F.col("_v") != float(v)).select("_v").limit(1).collect()
    if other:
        raise ValueError(f"the stored chains were fitted with v={other[0]._v}, not {v}")
    return spark.read.parquet(f"{path}/moments"), chains.drop("_v")


def incremental_graph(panel: DataFrame, old: Sequence[str], new_var: str, maxlag: int, alpha: float = 0.05, v: float = 0.1,
                      keys: Sequence[str] = (), fill: float | None = None, mode: str = "replace", all_tests: bool = False,
                      k_override: int | None = None, n: str = "all", learner: str = "linear", idx: str = "idx",
                      state_path: str | None = None, **tree) -> DataFrame:
    """Graph of the old variables plus the edges a new variable adds.

    New-as-cause is tested on the old tests that were significant (``all_tests``
    lifts that). In the cause pass the count of variables is one above the
    panel's in ``mode='replace'``; ``k_override`` sets it. ``state_path`` names the folder in which `keep_state`, or ``tree_chains`` for the
    tree learner, kept the old variables' fits: they are read instead of fitted again, and only products with the new variable are summed.
    """
    k = len(old) + 1
    k_cause = k_override or (k + 1 if mode == "replace" else k)
    if learner == "tree":
        from .tree import incremental_tree_from_state, incremental_tree_tests

        how = {"v": v, "keys": keys, "fill": fill, "mode": mode, "all_tests": all_tests, "n": n, "idx": idx, **tree}
        existing, effect, cause = incremental_tree_from_state(panel, state_path, old, new_var, maxlag, alpha, k_cause, **how) if state_path else \
            incremental_tree_tests(panel, old, new_var, maxlag, alpha, k_cause, **how)
    else:
        if state_path:
            stored, state = kept_state(panel.sparkSession, state_path, v)
            table = cut(bordered_moments(stored, panel, old, [new_var], maxlag, keys, fill, idx=idx))
        else:
            table = cut(moments(panel, [*old, new_var], maxlag, keys, fill, idx=idx))
            state = causality_state(table, old, v, keys)
        tests = chain_f_test(state, k, keys, n)
        existing = significant(tests, alpha)
        kept = state if all_tests else state.join(existing.select(*keys, "test_id"), [*keys, "test_id"], "left_semi")
        effect = incremental_effect(table, old, new_var, v, keys, n, k)
        cause = incremental_cause(kept, table, new_var, k_cause, keys, mode, n)
    cols = [*keys, *_EDGE]
    return merge_edges(significant(effect, alpha).select(*cols), significant(cause, alpha).select(*cols), existing.select(*cols))
