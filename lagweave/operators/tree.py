"""Regression-tree learner for boosting chains, grown level by level for all trees at once.

The rows are the panel's rows times the trees of the current round, with the
lags as bin numbers. A level is one aggregation of per-bin counts and sums, a
running sum over the bins of each node and feature, and a join of the chosen
splits back to the rows. Orders that share a prefix share its trees. The splits
are saved per level and the rows once per round, so plans stay short.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.orders import check_variables, text_array
from . import forest
from .boost import chain_f_test
from .graph import cause_tests, significant
from .panel import SALTS, attach_by_panel, lag_name, lag_names, lag_panel, null_safe_join
from .staging import cut, saved

# About 6 MB of split rows; beyond it the join is a salted shuffle.
BROADCAST_SPLITS = 100_000


def _cols(keys: Sequence[str]) -> list[str]:
    return [f"`{k}`" for k in keys]


def _ints(values: Sequence[int]) -> str:
    return f"array({', '.join(str(int(v)) for v in values)})"


#: Cells of the fixed grid between a column's least and greatest value in which values are counted.
GRID = 4096


def split_points(lagged: DataFrame, columns: Sequence[str], max_bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Candidate thresholds per panel and column, at most ``max_bins`` - 1 of each.

    Values are counted in the cells of a fixed grid. With at most ``max_bins`` cells in use, thresholds are the midpoints between
    neighbouring cells' values: for values that lie in cells of their own, all midpoints. Beyond that, those midpoints are kept at which
    the running count passes a multiple of its ``max_bins``-th part. Counts, minima and maxima do not depend on the order of rows.
    """
    k, b = _cols(keys), int(max_bins)
    ends = lagged.groupBy(*keys).agg(*[F.expr(f"array({', '.join(f'{f}(cast(`{c}` as double))' for c in columns)}) as {to}") for f, to in (("min", "_lo"), ("max", "_hi"))])
    rows = attach_by_panel(lagged.select(*keys, *columns), ends, keys)
    values = rows.selectExpr(*k, "_lo", "_hi", f"posexplode(array({', '.join(f'cast(`{c}` as double)' for c in columns)})) as (_c, _x)").where("_x is not null")
    cell = f"coalesce(least({GRID - 1}, cast(floor((_x - _lo[_c]) / nullif(_hi[_c] - _lo[_c], 0D) * {GRID}) as int)), 0)"
    cells = values.selectExpr(*k, "_c", "_x", f"{cell} as _cell").groupBy(*keys, "_c", "_cell").agg(F.expr("count(1) as n"), F.expr("min(_x) as lo"), F.expr("max(_x) as hi"))
    by = "partition by " + ", ".join([*k, "_c"])
    seen = cells.selectExpr(*k, "_c", "n", "hi", f"lead(lo) over ({by} order by _cell) as next", f"count(1) over ({by}) as used",
                            f"sum(n) over ({by} order by _cell) as upto", f"sum(n) over ({by}) as total")
    passed = f"floor(upto * {b} / total) > floor((upto - n) * {b} / total)"
    found = seen.groupBy(*keys, "_c").agg(F.expr(f"sort_array(collect_list(case when next is not null and (used <= {b} or {passed}) then (hi + next) / 2 end)) as cuts"))
    each = found.groupBy(*keys).agg(F.expr("map_from_entries(collect_list(struct(_c, cuts))) as m"))
    none = "cast(array() as array<double>)"
    return each.selectExpr(*k, f"transform(sequence(0, {len(columns) - 1}), i -> coalesce(m[i], {none})) as thresholds")


def _bin_name(variable: int, lag: int) -> str:
    return f"_b{variable}_{lag}"


def _case(of: str, results: Sequence[str]) -> str:
    """``results[of]`` as a plain CASE, which stays in generated code."""
    return f"case {of} " + " ".join(f"when {i} then {r}" for i, r in enumerate(results)) + " end"


def binned_rows(lagged: DataFrame, variables: Sequence[str], maxlag: int, max_bins: int, keys: Sequence[str] = (),
                idx: str = "idx", also: Sequence[str] = ()) -> DataFrame:
    """Rows of a lagged panel: the bin of each lag (``_b<variable>_<lag>``) and the values of the variables (and of ``also``)."""
    names = [(i, lag, lag_name(v, lag)) for i, v in enumerate(variables) for lag in range(1, maxlag + 1)]
    cuts = saved(split_points(lagged, [c for _, _, c in names], max_bins, keys), "thresholds")
    rows = attach_by_panel(lagged, cuts, keys)
    bins = [f"size(filter(thresholds[{at}], t -> t < `{c}`)) as {_bin_name(i, lag)}" for at, (i, lag, c) in enumerate(names)]
    values = [f"cast(`{v}` as double) as `{v}`" for v in dict.fromkeys([*variables, *also])]
    return rows.selectExpr(*_cols(keys), f"`{idx}`", *bins, *values)


def start_round(rows: DataFrame, variables: Sequence[int], maxlag: int, labels: Sequence[str] | None = None,
                parents: Sequence[int] = (), shrink: float = 1.0) -> DataFrame:
    """One row per tree: its label, its features ``_f1``.., the root node and no prediction.

    In the first round the labels are the columns ``labels``; later a tree takes
    what its parent tree of the round before left.
    """
    kept = [f"`{c}`" for c in rows.columns if c not in ("tree", "label", "pred")]
    if labels is not None:
        grown = rows.selectExpr(*kept, f"posexplode(array({', '.join(labels)})) as (tree, label)")
    else:
        children = [[t for t, p in enumerate(parents) if p == i] for i in range(max(parents) + 1)]
        listed = "array(" + ", ".join(f"cast({_ints(c)} as array<int>)" for c in children) + ")"
        grown = rows.selectExpr(*kept, f"explode(get({listed}, tree)) as tree", f"label - {float(shrink)}D * pred as label")
    which, found = f"{_ints(variables)}[tree]", sorted(set(variables))
    feats = [
        f"case {which} " + " ".join(f"when {v} then {_bin_name(v, lag)}" for v in found) + f" end as _f{lag}" for lag in range(1, maxlag + 1)
    ]
    return grown.selectExpr("*", *feats, "1 as node", "cast(null as double) as pred")


def _best_splits(rows: DataFrame, maxlag: int, level: int, min_leaf: int, keys: Sequence[str]) -> DataFrame:
    """Per panel, tree and active node: the node's mean and its best split (null where none is allowed)."""
    k = _cols(keys)
    feats = ", ".join(f"_f{lag}" for lag in range(1, maxlag + 1))
    seen = rows.where(f"node >= {2**level}").selectExpr(*k, "tree", "node", "label", f"posexplode(array({feats})) as (feature, bin)")
    hist = seen.groupBy(*keys, "tree", "node", "feature", "bin").agg(F.expr("count(1) as c"), F.expr("sum(label) as t"), F.expr("sum(label * label) as q"))
    # A tree's histogram is small and bounded; kept together it needs no further shuffle below.
    hist = hist.repartition(*keys, "tree")
    by = "partition by " + ", ".join([*k, "tree", "node", "feature"])
    upto = by + " order by bin rows between unbounded preceding and current row"
    sums = hist.selectExpr("*", f"sum(c) over ({upto}) as nl", f"sum(t) over ({upto}) as tl",
                           f"sum(c) over ({by}) as n", f"sum(t) over ({by}) as total", f"sum(q) over ({by}) as squares")
    sides = sums.selectExpr("*", "n - nl as nr", "tl / nl as lm", "try_divide(total - tl, n - nl) as rm", "squares - total * total / n as spread")
    # Gains are compared as shares of the node's own spread, whatever the label's scale; equal up to rounding, they count
    # as ties: lowest feature, then lowest bin. A spread that is nothing but rounding is none.
    allowed = f"nl >= {min_leaf} and nr >= {min_leaf} and spread > 1e-12 * squares"
    scored = sides.selectExpr("*", f"case when {allowed} then nl * nr / n * (lm - rm) * (lm - rm) end as raw").selectExpr("*", "round(raw / spread, 9) as share").selectExpr(
        "*", "case when share > 0 then raw end as gain")
    best = scored.groupBy(*keys, "tree", "node").agg(
        F.expr("max_by(struct(feature, bin, gain, lm, rm), struct(coalesce(case when gain is not null then share end, -1D), -feature, -bin)) as b"),
        F.expr("max_by(total / n, -feature) as mean"),
    )
    chosen = [f"case when b.gain is not null then b.{c} end as {c}" for c in ("feature", "bin", "gain", "lm", "rm")]
    return best.selectExpr(*k, "tree", "node", "mean", *chosen)


def _with_splits(rows: DataFrame, splits: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """Join the splits to the rows: broadcast while they are few, else salted, as one node may hold most rows."""
    on = [*keys, "tree", "node"]
    if splits.count() <= BROADCAST_SPLITS:
        return rows.join(F.broadcast(splits), on, "left")
    salted = rows.selectExpr("*", f"cast(pmod(`{idx}`, {SALTS}) as int) as _salt")
    return salted.join(splits.selectExpr("*", f"explode(sequence(0, {SALTS - 1})) as _salt"), [*on, "_salt"], "left").drop("_salt")


def grow_trees(rows: DataFrame, maxlag: int, depth: int, min_leaf: int, keys: Sequence[str] = (), idx: str = "idx"):
    """Grow the trees of a started round.

    Returns the rows with node and prediction filled in, and the list of split tables (one per level).
    """
    levels, others = [], [f"`{c}`" for c in rows.columns if c not in ("node", "pred")]
    for level in range(depth):
        table = saved(_best_splits(rows, maxlag, level, min_leaf, keys), "splits")
        levels.append(table)
        left = f"({_case('feature', [f'_f{lag}' for lag in range(1, maxlag + 1)])}) <= bin"
        stay = "mean" if level == 0 else "pred"
        rows = _with_splits(rows, table.drop("gain"), keys, idx).selectExpr(
            *others, f"case when feature is null then node when {left} then 2 * node else 2 * node + 1 end as node",
            f"case when feature is null then {stay} when {left} then lm else rm end as pred")
    return rows, levels


def tree_importances(levels: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Share of each lag in a tree's total gain: tree, feature (lag - 1), importance. Trees without a split are absent."""
    k = _cols(keys)
    parts = [t.where("feature is not null").selectExpr(*k, "tree", "feature", "gain") for t in levels]
    total = reduce(DataFrame.unionByName, parts).groupBy(*keys, "tree", "feature").agg(F.sum("gain").alias("gain"))
    by = ", ".join([*k, "tree"])
    return total.selectExpr(*k, "tree", "feature", f"gain / sum(gain) over (partition by {by}) as importance")


def _tree_stats(rows: DataFrame, names: Sequence[str], number: int, keys: Sequence[str]) -> DataFrame:
    k = _cols(keys)
    return rows.groupBy(*keys, "tree").agg(
        F.expr("count(1) as n"), F.expr("avg((label - pred) * (label - pred)) as mse"), F.expr("var_pop(label) as var"),
    ).selectExpr(*k, f"{number} as round", "tree", f"{text_array(names)}[tree] as x_name", "n", "mse", "1 - try_divide(mse, var) as r2")


def tree_round(panel: DataFrame, label: str, variable: str, maxlag: int, depth: int = 6, min_leaf: int = 10, max_bins: int = 32,
               keys: Sequence[str] = (), fill: float | None = None, idx: str = "idx"):
    """One tree of ``label`` on one variable's lags.

    Returns (rows with label, prediction and residual; metrics; importances per lag).
    """
    lagged = lag_panel(panel, [variable], maxlag, keys, fill, idx)
    if forest.fits(maxlag, max_bins):
        cuts = saved(split_points(lagged, lag_names(variable, maxlag), max_bins, keys), "thresholds")
        chunks = forest.packed_chunks(lagged, cuts, [variable], maxlag, keys, idx, [label])
        state = forest.grow_round(chunks, None, [[variable]], [variable], maxlag, max_bins, [], depth, min_leaf, keys, label)
        metrics = state.selectExpr(*_cols(keys), "element_at(prefix, -1) as x_name", "n", "mse", "1 - try_divide(mse, var) as r2")
        shares = state.selectExpr(*_cols(keys), "aggregate(gains, 0D, (a, x) -> a + x) as _all", "posexplode(gains) as (_at, _gain)").where("_gain > 0")
        shares = shares.selectExpr(*_cols(keys), "_at + 1 as lag", "_gain / _all as importance")
        return forest.predicted_rows(chunks, state, label, variable, maxlag, max_bins, keys, idx), metrics, shares
    base = saved(binned_rows(lagged, [variable], maxlag, max_bins, keys, idx, [label]), "binned")
    started = start_round(base, [0], maxlag, [f"`{label}`"])
    rows, levels = grow_trees(started, maxlag, depth, min_leaf, keys, idx)
    out = rows.selectExpr(*_cols(keys), f"`{idx}`", "label", "pred as prediction", "label - pred as residual")
    metrics = _tree_stats(rows, [variable], 1, keys).select(*keys, "x_name", "n", "mse", "r2")
    shares = tree_importances(levels, keys).select(*keys, (F.col("feature") + 1).alias("lag"), "importance")
    return out, metrics, shares


def ar_tree(panel: DataFrame, variable: str, maxlag: int = 3, depth: int = 5, max_bins: int = 32, keys: Sequence[str] = (),
            idx: str = "idx"):
    """Autoregressive tree of one variable on its own lags, without a leaf minimum."""
    return tree_round(panel, variable, variable, maxlag, depth, 1, max_bins, keys, None, idx)


def _trie(orders: Sequence[Sequence[str]]):
    """Per round: the distinct prefixes, the parent of each, and the prefix of each order."""
    rounds, parent_at = [], {(): 0}
    for j in range(1, len(orders[0]) + 1):
        prefixes = list(dict.fromkeys(tuple(o[:j]) for o in orders))
        at = {p: i for i, p in enumerate(prefixes)}
        rounds.append((prefixes, [parent_at[p[:-1]] for p in prefixes], [at[tuple(o[:j])] for o in orders]))
        parent_at = at
    return rounds


def all_orders(variables: Sequence[str]) -> list[list[str]]:
    """Every order, lexicographic by header position."""
    check_variables(variables)
    orders = [[]]
    for _ in variables:
        orders = [[*o, v] for o in orders for v in variables if v not in o]
    return orders


def _run_chains(base: DataFrame, variables: Sequence[str], orders, maxlag: int, v: float, depth: int, min_leaf: int,
                keys: Sequence[str], idx: str):
    """All rounds of all orders: (statistics per round and tree, rows after the last round, trie)."""
    stats, rows, trie = None, base, _trie(orders)
    for j, (prefixes, parents, _) in enumerate(trie):
        names = [p[-1] for p in prefixes]
        which = [variables.index(n) for n in names]
        if j == 0:
            started = start_round(rows, which, maxlag, [f"`{n}`" for n in names]).drop(*variables)
        else:
            started = start_round(rows, which, maxlag, None, parents, 1.0 if j == 1 else v)
        grown, _ = grow_trees(started, maxlag, depth, min_leaf, keys, idx)
        rows = saved(grown.drop("node", *[f"_f{lag}" for lag in range(1, maxlag + 1)]), "round")
        part = _tree_stats(rows, names, j + 1, keys)
        stats = part if stats is None else stats.unionByName(part)
    return stats, rows, trie


def _chains(stats: DataFrame, trie, orders, maxlag: int, dropped: int, keys: Sequence[str]) -> DataFrame:
    """Statistics per tree, spread to the orders that use it: the same table as the linear chains."""
    uses = "array(" + ", ".join(
        "array(" + ", ".join(_ints([t for t, at in enumerate(of_order) if at == i]) for i in range(len(prefixes))) + ")"
        for prefixes, _, of_order in trie
    ) + ")"
    k, listed = _cols(keys), "array(" + ", ".join(text_array(o) for o in orders) + ")"
    rows = stats.selectExpr("*", f"explode({uses}[round - 1][tree]) as test_id")
    rounds = rows.groupBy(*keys, "test_id").agg(
        F.expr("sort_array(collect_list(struct(round, x_name, mse, r2))) as rounds"), F.max("n").alias("n"))
    named = rounds.selectExpr(*k, "cast(test_id as long) as test_id", "n", "rounds", f"{listed}[test_id] as order")
    return named.selectExpr(*k, "test_id", "order[0] as effect", "element_at(order, -1) as cause", "order", f"{maxlag} as p",
                            "n", f"n + {dropped} as n_rows", "rounds")


def _base(panel, variables, maxlag, max_bins, keys, fill, idx):
    lagged = lag_panel(panel.select(*keys, idx, *variables), variables, maxlag, keys, fill, idx)
    return saved(binned_rows(lagged, variables, maxlag, max_bins, keys, idx), "binned")


def _lagged(panel, variables, maxlag, keys, fill, idx):
    return lag_panel(panel.select(*keys, idx, *variables), variables, maxlag, keys, fill, idx)


def _cuts(lagged, variables, maxlag, max_bins, keys):
    return saved(split_points(lagged, [n for v in variables for n in lag_names(v, maxlag)], max_bins, keys), "thresholds")


def _stored_chains(state: DataFrame, orders: Sequence[Sequence[str]], maxlag: int, dropped: int, keys: Sequence[str]) -> DataFrame:
    """The trees of a state, joined to the orders that use them: the same table as the linear chains."""
    k = _cols(keys)
    plan = state.sparkSession.createDataFrame([(i, list(o)) for i, o in enumerate(orders)], "test_id long, order array<string>")
    steps = plan.selectExpr("test_id", "order", "explode(sequence(1, size(order))) as round").selectExpr("*", "slice(order, 1, round) as prefix")
    rows = state.join(steps, ["round", "prefix"]).selectExpr(*k, "test_id", "order", "n", "struct(round, element_at(prefix, -1) as x_name, mse, 1 - try_divide(mse, var) as r2) as r")
    rounds = rows.groupBy(*keys, "test_id", "order").agg(F.sort_array(F.collect_list("r")).alias("rounds"), F.max("n").alias("n"))
    return rounds.selectExpr(*k, "test_id", "order[0] as effect", "element_at(order, -1) as cause", "order", f"{maxlag} as p", "n", f"n + {dropped} as n_rows", "rounds")


def tree_chains(panel: DataFrame, variables: Sequence[str], maxlag: int, v: float = 0.1, keys: Sequence[str] = (),
                fill: float | None = None, orders: Sequence[Sequence[str]] | None = None, depth: int = 6, min_leaf: int = 10,
                max_bins: int = 32, idx: str = "idx", state_path: str | None = None) -> DataFrame:
    """Tree boosting chains, one row per panel and order, with the MSE and R² of each round. ``state_path`` keeps the trees for increments."""
    names, plan = list(variables), [list(o) for o in orders] if orders else all_orders(variables)
    dropped = maxlag if fill is None else 0
    if forest.fits(maxlag, max_bins):
        lagged = _lagged(panel, names, maxlag, keys, fill, idx)
        cuts = _cuts(lagged, names, maxlag, max_bins, keys)
        state = forest.grow_chains(forest.packed_chunks(lagged, cuts, names, maxlag, keys, idx), plan, names, maxlag, max_bins, v, depth, min_leaf, keys)
        if state_path:
            forest.write_state(state, cuts, names, maxlag, max_bins, state_path)
        return _stored_chains(state, plan, maxlag, dropped, keys)
    if state_path:
        raise ValueError(f"states are kept up to {forest.MOST_CELLS} cells: fewer lags or bins")
    base = _base(panel, names, maxlag, max_bins, keys, fill, idx)
    stats, _, trie = _run_chains(base, names, plan, maxlag, v, depth, min_leaf, keys, idx)
    return _chains(stats, trie, plan, maxlag, dropped, keys)


def tree_chain_tests(panel: DataFrame, variables: Sequence[str], maxlag: int, v: float = 0.1, keys: Sequence[str] = (),
                     n: str = "all", **how) -> DataFrame:
    """All tree chain tests of a panel, significant or not."""
    return chain_f_test(tree_chains(panel, variables, maxlag, v, keys, **how), len(variables), keys, n)


def incremental_tree_tests(panel: DataFrame, old: Sequence[str], new_var: str, maxlag: int, alpha: float, k_cause: int,
                           v: float = 0.1, keys: Sequence[str] = (), fill: float | None = None, mode: str = "replace",
                           all_tests: bool = False, n: str = "all", depth: int = 7, min_leaf: int = 10, max_bins: int = 32,
                           idx: str = "idx"):
    """(significant old tests, new-as-effect tests, new-as-cause tests) with the tree learner."""
    if mode not in ("replace", "condition"):
        raise ValueError("mode must be 'replace' or 'condition'")
    names, k, dropped = [*old, new_var], len(old) + 1, maxlag if fill is None else 0
    if forest.fits(maxlag, max_bins):
        lagged = _lagged(panel, names, maxlag, keys, fill, idx)
        chunks = forest.packed_chunks(lagged, _cuts(lagged, names, maxlag, max_bins, keys), names, maxlag, keys, idx)
        state = forest.grow_chains(chunks, all_orders(old), names, maxlag, max_bins, v, depth, min_leaf, keys)
        return _increment(chunks, state, old, new_var, maxlag, alpha, k_cause, v, keys, dropped, mode, all_tests, n, depth, min_leaf, max_bins)
    base, plan = _base(panel, names, maxlag, max_bins, keys, fill, idx), all_orders(old)
    stats, rows, trie = _run_chains(base, names, plan, maxlag, v, depth, min_leaf, keys, idx)
    tests = cut(chain_f_test(_chains(stats, trie, plan, maxlag, dropped, keys), k, keys, n))
    existing = significant(tests, alpha)

    longer = [[new_var, *o] for o in plan]
    effect_stats, _, effect_trie = _run_chains(base, names, longer, maxlag, v, depth, min_leaf, keys, idx)
    effect = chain_f_test(_chains(effect_stats, effect_trie, longer, maxlag, dropped, keys), k, keys, n)

    # At most one id per order of the plan comes to the driver; only those tests are fitted again.
    wanted = list(range(len(plan))) if all_tests else sorted(r[0] for r in existing.select("test_id").distinct().collect())
    if not wanted:
        return existing, effect, existing.limit(0)
    last, shrink = trie[-1][2], v if len(old) > 1 else 1.0
    started = start_round(rows, [names.index(new_var)] * len(wanted), maxlag, None, [last[t] for t in wanted],
                          0.0 if mode == "replace" else shrink)
    grown, _ = grow_trees(started, maxlag, depth, min_leaf, keys, idx)
    fits = _tree_stats(grown, [new_var] * len(wanted), k, keys).withColumn("test_id", F.expr(f"cast({_ints(wanted)}[tree] as long)"))
    before = tests.select(*keys, "test_id", "effect", "order", F.col("mse_all").alias("mse_prev")) if all_tests else \
        existing.select(*keys, "test_id", "effect", "order", F.col("mse_all").alias("mse_prev"))
    if mode == "condition":
        label_mse = F.when(F.col("r2") < 1, F.col("mse") / (1 - F.col("r2")))
        fits, before = fits.withColumn("mse_prev", label_mse), before.drop("mse_prev")
    joined = fits.select(*keys, "test_id", F.lit(maxlag).alias("p"), "n", (F.col("n") + dropped).alias("n_rows"),
                         F.col("mse").alias("mse_all"), *([] if mode == "replace" else ["mse_prev"])).join(before, [*keys, "test_id"])
    return existing, effect, cause_tests(joined, new_var, k_cause, keys, n)


def _increment(chunks, state, old, new_var, maxlag, alpha, k_cause, v, keys, dropped, mode, all_tests, n, depth, min_leaf, max_bins):
    """The three parts of an increment from packed chunks of all variables and the trees of the old ones, which stay as they are."""
    names, k, plan = [*old, new_var], len(old) + 1, all_orders(old)
    tests = cut(chain_f_test(_stored_chains(state, plan, maxlag, dropped, keys), k, keys, n))
    existing = significant(tests, alpha)
    longer = [[new_var, *o] for o in plan]
    grown = forest.grow_chains(chunks, longer, names, maxlag, max_bins, v, depth, min_leaf, keys)
    effect = chain_f_test(_stored_chains(grown, longer, maxlag, dropped, keys), k, keys, n)

    # At most one id per order of the plan comes to the driver; only those chains are grown one round further.
    wanted = list(range(len(plan))) if all_tests else sorted(r[0] for r in existing.select("test_id").distinct().collect())
    if not wanted:
        return existing, effect, existing.limit(0)
    last = 0.0 if mode == "replace" else v if len(old) > 1 else 1.0
    shrinks = [*[1.0, *[v] * len(old)][:len(old) - 1], last]
    fits = forest.grow_round(chunks, state, [[*plan[t], new_var] for t in wanted], names, maxlag, max_bins, shrinks, depth, min_leaf, keys)
    ids = state.sparkSession.createDataFrame([(t, [*plan[t], new_var]) for t in wanted], "test_id long, prefix array<string>")
    fits = fits.join(ids, "prefix").selectExpr(*_cols(keys), "test_id", f"{maxlag} as p", "n", f"n + {dropped} as n_rows", "mse as mse_all", "var as label_mse")
    before = (tests if all_tests else existing).select(*keys, "test_id", "effect", "order", F.col("mse_all").alias("mse_prev"))
    joined = null_safe_join(fits, before, keys, also=["test_id"])
    # Conditioned on what the old last round left, the error to beat is that of its label about its own mean.
    joined = joined.drop("label_mse") if mode == "replace" else joined.drop("mse_prev").withColumnRenamed("label_mse", "mse_prev")
    return existing, effect, cause_tests(joined, new_var, k_cause, keys, n)


def incremental_tree_from_state(panel: DataFrame, path: str, old: Sequence[str], new_var: str, maxlag: int, alpha: float, k_cause: int,
                                v: float = 0.1, keys: Sequence[str] = (), fill: float | None = None, mode: str = "replace",
                                all_tests: bool = False, n: str = "all", depth: int = 7, min_leaf: int = 10, max_bins: int = 32, idx: str = "idx"):
    """As `incremental_tree_tests`, with the old variables' trees read from ``path`` (see ``tree_chains``): none of them is grown again.

    ``panel`` holds the old variables as they were and the new one. Bins of the old variables are those of the stored trees.
    """
    if mode not in ("replace", "condition"):
        raise ValueError("mode must be 'replace' or 'condition'")
    names = [*old, new_var]
    state, cuts = forest.read_state(panel.sparkSession, path, old, maxlag, max_bins)
    lagged = _lagged(panel, names, maxlag, keys, fill, idx)
    own = _cuts(lagged, [new_var], maxlag, max_bins, keys).withColumnRenamed("thresholds", "_new")
    cuts = null_safe_join(own, cuts, keys).selectExpr(*_cols(keys), "concat(thresholds, _new) as thresholds")
    chunks = forest.packed_chunks(lagged, cuts, names, maxlag, keys, idx)
    return _increment(chunks, state, old, new_var, maxlag, alpha, k_cause, v, keys, maxlag if fill is None else 0, mode, all_tests, n, depth, min_leaf, max_bins)
