"""SQL for DuckDB that computes each query's result independently, on the same tables.

Least squares is done by sequential orthogonalisation with window sums, trees by
one block of subqueries per level, tails by their finite sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from .queries import EVENTS, FOUR, PRIORITIES, SHIPMENTS, THREE, TWO

Z = 1.959963984540054  # fixed value: 0.975 quantile of the normal distribution


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 as \"{name or expr}\""


def with_(parts: Sequence[str], final: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + final


def cte(name: str, body: str) -> str:
    return f"{name} as materialized ({body})"


# --- panels -----------------------------------------------------------------


def _pivot(variable: str, names: dict[str, str], value: str) -> str:
    return ", ".join(f"coalesce(sum({value}) filter ({variable} = '{v}'), 0)::double as \"{n}\"" for n, v in names.items())


def _grid(wide: str, step: str, cols: Sequence[str], keys: Sequence[str] = ()) -> list[str]:
    k = "".join(f"{c}, " for c in keys)
    by = f"group by {', '.join(keys)}" if keys else ""
    part = f"partition by {', '.join(keys)} " if keys else ""
    on = ", ".join([*keys, "t"])
    vals = ", ".join(f'coalesce("{c}", 0.0) as "{c}"' for c in cols)
    return [
        cte("wide", wide),
        cte("grid", f"select {k}unnest(generate_series(min(t), max(t), interval {step})) as t from wide {by}"),
        cte("p", f"select {k}t, row_number() over ({part}order by t) - 1 as idx, {vals} from grid left join wide using ({on})"),
    ]


def _same(names: Sequence[str]) -> dict[str, str]:
    return {v: v for v in names}


def hourly(value: str = "1", keys: Sequence[str] = ()) -> str:
    k = "user_id % 8 as grp, " if keys else ""
    by = "grp, t" if keys else "t"
    return (f"select {k}date_trunc('hour', ts) as t, {_pivot('event_type', _same(EVENTS), value)} from events group by {by}")


def eh(keys: Sequence[str] = ()) -> list[str]:
    return _grid(hourly(keys=keys), "1 hour", EVENTS, keys)


def ev() -> list[str]:
    return _grid(hourly("value"), "1 hour", EVENTS)


def ld(keys: Sequence[str] = ()) -> list[str]:
    k = "".join(f"{c}, " for c in keys)
    wide = (f"select {k}date_trunc('day', l_shipdate) as t, {_pivot('l_returnflag || l_linestatus', SHIPMENTS, 'l_quantity')} "
            f"from lineitem group by {k}t")
    return _grid(wide, "1 day", list(SHIPMENTS), keys)


def od() -> list[str]:
    wide = f"select date_trunc('day', o_orderdate) as t, {_pivot('o_orderpriority', PRIORITIES, '1')} from orders group by t"
    return [cte("wide", wide), cte("p", "select *, row_number() over (order by t) - 1 as idx from wide")]


def lagged(cols: Sequence[str], lags: Sequence[int], keys: Sequence[str] = (), zero: bool = False, source: str = "p",
           name: str = "d") -> str:
    """Columns <v>_<lag>; the first rows are dropped unless zero-filled."""
    part = f"partition by {', '.join(keys)} " if keys else ""
    fill = ", 0.0" if zero else ""
    feats = ", ".join(f'lag("{c}", {lag}{fill}) over ({part}order by idx) as "{c}_{lag}"' for c in cols for lag in lags)
    k = "".join(f"{c}, " for c in keys)
    body = f"select {k}idx, {', '.join(chr(34) + c + chr(34) for c in cols)}, {feats} from {source}"
    return cte(name, body if zero else f"select * from ({body}) where idx >= {max(lags)}")


# --- tails ------------------------------------------------------------------


def f_tail(f: str, d1: int, d2: str) -> str:
    """Upper F tail: finite sum for even d1, complementary finite sum for odd d1 and even d2."""
    g, d2 = f"greatest({f}, 0.0)", f"({d2})::double"
    ratio = f"({d1} * {g} / {d2})"
    if d1 % 2 == 0:
        y = f"({ratio} / (1 + {ratio}))"
        terms = ["1.0"]
        for j in range(1, d1 // 2):
            terms.append("*".join([f"(({d2}/2 + {i}) / {i + 1} * {y})" for i in range(j)]))
        return f"(exp(-{d2} / 2 * ln(1 + {ratio})) * ({' + '.join(terms)}))"
    b = d1 / 2
    summed = (f"list_sum(list_transform(range(0, ({d2} / 2)::bigint), lambda j: "
              f"exp(-j * ln(1 + {ratio}) + lgamma({b} + j) - lgamma({b}) - lgamma(j + 1.0))))")
    return f"(case when {f} <= 0 then 1.0 else 1 - pow({ratio} / (1 + {ratio}), {b}) * {summed} end)"


def chi2_tail(x: str, df: int) -> str:
    h = f"(greatest({x}, 0.0) / 2)"
    terms, fact = [], 1
    for j in range(df // 2):
        fact *= max(j, 1)
        terms.append(f"pow({h}, {j}) / {fact}")
    return f"(exp(-{h}) * ({' + '.join(terms)}))"


# --- least squares by orthogonalisation -------------------------------------


def sweep(source: str, groups: Sequence[str], y: str, xs: Sequence[str], name: str, at: Sequence[int]) -> list[str]:
    """Remove the regressors one by one; ``name`` holds n and rss<i> after the first i regressors, for i in ``at``."""
    g = ", ".join(groups)
    part = f"partition by {g}" if groups else ""
    lead = f"{g}, " if groups else ""
    centred = ", ".join(f'"{c}" - avg("{c}") over ({part}) as z{i}' for i, c in enumerate(xs))
    parts = [cte(f"{name}_0", f'select {lead}"{y}" - avg("{y}") over ({part}) as y, {centred} from {source}')]
    for i in range(len(xs)):
        coef = f"sum({{c}} * z{i}) over ({part}) / nullif(sum(z{i} * z{i}) over ({part}), 0)"
        cols = ["y", *[f"z{j}" for j in range(i + 1, len(xs))]]
        parts.append(cte(f"{name}_{i + 1}", f"select {lead}" + ", ".join(
            f"{c} - z{i} * ({coef.format(c=c)}) as {c}" for c in cols) + f" from {name}_{i}"))
    by = f" group by {g}" if groups else ""
    sums = [f"{name}_s{i} as (select {lead}count(*) as n, sum(y * y) as rss{i} from {name}_{i}{by})" for i in at]
    using = f"join {{t}} using ({g}, n)" if groups else "join {t} using (n)"
    joined = f"{name}_s{at[0]} " + " ".join(using.format(t=f"{name}_s{i}") for i in at[1:])
    return [*parts, *sums, f"{name} as (select * from {joined})"]


def two_regressors(source: str, y: str, x1: str, x2: str, name: str, groups: Sequence[str] = ()) -> list[str]:
    """Closed form: n, intercept a, slopes b1 and b2, means."""
    lead = "".join(f"{c}, " for c in groups)
    by = f" group by {', '.join(groups)}" if groups else ""
    stats = (f"select {lead}count(*) as n, var_pop({x1}) as s11, covar_pop({x1}, {x2}) as s12, var_pop({x2}) as s22, "
             f"covar_pop({x1}, {y}) as s1y, covar_pop({x2}, {y}) as s2y, var_pop({y}) as syy, avg({y}) as my, avg({x1}) as m1, "
             f"avg({x2}) as m2 from {source}{by}")
    slopes = (f"select *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1, "
              f"(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from {name}_m")
    return [cte(f"{name}_m", stats), cte(name, f"select *, my - b1 * m1 - b2 * m2 as a from ({slopes})")]


# --- chains -----------------------------------------------------------------


def _orders(names: Sequence[str]) -> list[tuple[str, ...]]:
    """All orders, lexicographic by header position."""
    return list(permutations(names))


def chain(orders: Sequence[Sequence[str]], v: float, keys: Sequence[str] = (), zero: bool = False,
          ids: Sequence[int] | None = None) -> list[str]:
    """Lag-2 chains on panel p: table ``rounds`` (one row per test and round) and labels lab1.. ."""
    names = list(dict.fromkeys(c for o in orders for c in o))
    ids = list(ids or range(len(orders)))
    k = "".join(f"{c}, " for c in keys)
    gk = [*keys, "test_id"]
    plan = ", ".join(f"({t}::bigint, {j + 1}, '{c}', '{','.join(o)}')" for t, o in zip(ids, orders) for j, c in enumerate(o))
    parts = [
        lagged(names, [1, 2], keys, zero),
        cte("long", " union all ".join(
            f"select {k}idx, '{c}' as x_name, \"{c}\" as y, \"{c}_1\" as x1, \"{c}_2\" as x2 from d" for c in names)),
        f"plan(test_id, round, x_name, ord) as (values {plan})",
        cte("lab1", f"select {k}test_id, idx, y as label from long join plan using (x_name) where round = 1"),
    ]
    depth = len(orders[0])
    for j in range(1, depth + 1):
        x = ", ".join(f"l.{c}" for c in keys) + ", " if keys else ""
        on = " and ".join([f"l.{c} = f.{c}" for c in (*keys, "idx")])
        parts.append(cte(f"row{j}", f"select {x}l.test_id, l.idx, l.label, f.x1, f.x2 from lab{j} l join plan q on "
                                    f"q.test_id = l.test_id and q.round = {j} join long f on f.x_name = q.x_name and {on}"))
        parts += two_regressors(f"row{j}", "label", "x1", "x2", f"fit{j}", gk)
        using = ", ".join(gk)
        shrink = 1.0 if j == 1 else v
        parts.append(cte(f"res{j}", f"select {k}test_id, idx, label, a + b1 * x1 + b2 * x2 as pred from row{j} join fit{j} using ({using})"))
        parts.append(cte(f"lab{j + 1}", f"select {k}test_id, idx, label - {shrink} * pred as label from res{j}"))
        parts.append(cte(f"stat{j}", f"select {k}test_id, {j} as round, count(*) as n, avg((label - pred) * (label - pred)) as mse, "
                                     f"1 - avg((label - pred) * (label - pred)) / var_pop(label) as r2 from res{j} group by {using}"))
    union = " union all ".join(
        f"select {k}test_id, round, s.n, mse, r2, a as intercept, b1, b2 from stat{j} s join fit{j} using ({', '.join(gk)})"
        for j in range(1, depth + 1))
    parts.append(cte("rounds", union))
    return parts


def tested(orders: Sequence[Sequence[str]], k: int, keys: Sequence[str] = (), extra: int = 2, name: str = "tests",
           source: str = "rounds", plan: str = "plan") -> list[str]:
    """F test on the last two rounds; ``extra`` rows were dropped but count."""
    depth = len(orders[0])
    kk = "".join(f"a.{c}, " for c in keys)
    on = " and ".join(f"a.{c} = b.{c}" for c in (*keys, "test_id"))
    base = (f"select {kk}a.test_id, q.ord as \"order\", split_part(q.ord, ',', 1) as effect, split_part(q.ord, ',', -1) as cause, "
            f"b.n + {extra} as n, a.mse as mse_prev, b.mse as mse_all, a.r2 as r2_prev, b.r2 as r2_all "
            f"from {source} a join {source} b on {on} and b.round = {depth} join {plan} q on q.test_id = a.test_id and q.round = 1 "
            f"where a.round = {depth - 1}")
    scored = f"select *, (mse_prev - mse_all) / mse_all * ((n - {2 * k}) / 2.0) as f_score from ({base})"
    return [cte(name, f"select *, {f_tail('f_score', 2, f'n - {2 * k}')} as p_value from ({scored})")]


def test_view(keys: Sequence[str] = (), where: str = "", digits: int = 6, source: str = "tests", lead: str = "") -> str:
    k = "".join(f"{c}, " for c in keys)
    cols = ", ".join(r(c, digits=digits) for c in ("mse_prev", "mse_all", "f_score", "p_value"))
    return f'select {lead}{k}test_id, effect, cause, "order", n, {cols} from {source} {where}'


def _chain_tests(v: float, zero: bool = False, alpha: float | None = None, orders=None, names=EVENTS, extra: int | None = None) -> str:
    orders = orders or _orders(names)
    extra = (0 if zero else 2) if extra is None else extra
    where = "" if alpha is None else f"where p_value < {alpha}"
    return with_([*eh(), *chain(orders, v, zero=zero), *tested(orders, len(names), extra=extra)], test_view(where=where))


def _chain_scalar(cols: str) -> str:
    orders = _orders(EVENTS)
    return with_([*eh(), *chain(orders, 1.0), *tested(orders, 5)], f"select test_id, {cols} from tests")


def _rounds(v: float) -> str:
    orders = _orders(EVENTS)
    cols = ", ".join(r(c) for c in ("mse", "r2", "intercept", "b1", "b2"))
    return with_([*eh(), *chain(orders, v)],
                 f'select test_id, ord as "order", round, x_name, {cols} from rounds join plan using (test_id, round)')


def _grouped_graph() -> str:
    orders, keys = _orders(["af", "no", "ro"]), ["l_linenumber"]
    return with_([*ld(keys), *chain(orders, 0.1, keys), *tested(orders, 3, keys)],
                 test_view(keys, "where p_value < 0.2", digits=4))


# --- incremental ------------------------------------------------------------


def _prefixed(parts: Sequence[str], tag: str) -> list[str]:
    """Rename a chain's CTEs so that two chains fit in one statement."""
    import re

    names = r"\b(d|long|plan|lab\d|row\d|fit\d(?:_m)?|res\d|stat\d|rounds|tests)\b(?!')"
    return [re.sub(names, rf"{tag}_\1", p) for p in parts]


def _cause(k: int, mode: str) -> list[str]:
    """New-as-cause fits of 'error' on the stored chains of click and view (tables lab2, stat2, res2)."""
    label = "label" if mode == "replace" else "label - 0.1 * pred"
    prev = "s.mse" if mode == "replace" else "x.label_mse"
    return [
        lagged(["error"], [1, 2], name="e"),
        cte("crow", f"select test_id, idx, {label} as label, error_1 as x1, error_2 as x2 from res2 join e using (idx)"),
        *two_regressors("crow", "label", "x1", "x2", "cfit", ["test_id"]),
        cte("cstat", "select test_id, count(*) + 2 as n, avg(pow(label - (a + b1 * x1 + b2 * x2), 2)) as mse_all, "
                     "avg(label * label) as label_mse from crow join cfit using (test_id) group by test_id"),
        cte("cscore", f"select x.test_id, x.n, {prev} as mse_prev, x.mse_all, ({prev} - x.mse_all) / x.mse_all * ((x.n - {2 * k}) / 2.0) "
                      "as f_score from cstat x join stat2 s using (test_id)"),
        cte("causes", "select c.*, split_part(ord, ',', 1) as effect, 'error' as cause, ord || ',error' as \"order\", "
                      f"{f_tail('f_score', 2, f'n - {2 * k}')} as p_value from cscore c join plan using (test_id) where round = 1"),
    ]


def _incremental(what: str) -> str:
    old = _orders(TWO)
    longer = [("error", *o) for o in old]
    chains = [*chain(old, 0.1), *tested(old, 3)]
    effects = _prefixed([*chain(longer, 0.1), *tested(longer, 3)], "n")
    if what == "effect":
        return with_([*eh(), *effects], test_view(source="n_tests"))
    if what != "merged":
        return with_([*eh(), *chains, *_cause(4 if what == "replace" else 3, what)], test_view(source="causes"))
    alpha = "p_value < 0.7"
    return with_([*eh(), *chains, *effects, *_cause(4, "replace")], " union all ".join([
        test_view(where=f"where {alpha}", source="n_tests", lead="'effect' as source, "),
        test_view(where=f"where {alpha} and test_id in (select test_id from tests where {alpha})", source="causes", lead="'cause' as source, "),
        test_view(where=f"where {alpha}", lead="'existing' as source, "),
    ]))


# --- trees ------------------------------------------------------------------


def tree(source: str, groups: Sequence[str], depth: int, features: int, name: str, min_leaf: int = 10) -> list[str]:
    """Level-wise regression tree per group on source(groups, idx, label, x1..): ``name`` holds the prediction per row.

    Splits lie between neighbouring values; equal gains go to the lower feature, then the lower value.
    """
    g, parts = ", ".join(groups), []
    xs = ", ".join(f"x{i + 1}" for i in range(features))
    parts.append(cte(f"{name}0", f"select {g}, idx, label, {xs}, 1 as node from {source}"))
    for level in range(depth):
        src, out = f"{name}{level}", f"{name}{level + 1}"
        active = f"where node >= {2 ** level}"
        hist = " union all ".join(
            f"select {g}, node, {i} as f, x{i + 1} as v, count(*) as c, sum(label) as t, sum(label * label) as q from {src} {active} group by {g}, node, x{i + 1}"
            for i in range(features))
        parts.append(cte(f"{name}h{level}", hist))
        by = f"partition by {g}, node, f"
        sums = (f"select *, sum(c) over ({by} order by v) as nl, sum(t) over ({by} order by v) as tl, sum(c) over ({by}) as n, "
                f"sum(t) over ({by}) as total, sum(q) over ({by}) as squares from {name}h{level}")
        gain = "nl * (n - nl) / n * pow(tl / nl - (total - tl) / nullif(n - nl, 0), 2)"
        spread = "squares - total * total / n"
        parts.append(cte(f"{name}g{level}", f"select *, {gain} as gain, round({gain} / nullif({spread}, 0), 9) as share from ({sums}) "
                                            f"where nl >= {min_leaf} and n - nl >= {min_leaf} and {spread} > 1e-12 * squares"))
        parts.append(cte(f"{name}s{level}", f"select * from {name}g{level} where share > 0 "
                                            f"qualify row_number() over (partition by {g}, node order by share desc, f, v) = 1"))
        pick = "case s.f " + " ".join(f"when {i} then r.x{i + 1}" for i in range(features)) + " end"
        on = " and ".join(f"r.{c} = s.{c}" for c in (*groups, "node"))
        cols = ", ".join(f"r.{c}" for c in (*groups, "idx", "label")) + ", " + ", ".join(f"r.x{i + 1}" for i in range(features))
        parts.append(cte(out, f"select {cols}, case when s.f is null then r.node when {pick} <= s.v then 2 * r.node else 2 * r.node + 1 end "
                              f"as node from {src} r left join {name}s{level} s on {on}"))
    parts.append(cte(name, f"select *, avg(label) over (partition by {g}, node) as pred from {name}{depth}"))
    return parts


def _one_tree(label: str, x: str, depth: int, keys: Sequence[str] = (), lags: int = 2, min_leaf: int = 10) -> list[str]:
    k = "".join(f"{c}, " for c in keys)
    names = list(dict.fromkeys([label, x]))
    feats = ", ".join(f"{x}_{i} as x{i}" for i in range(1, lags + 1))
    src = cte("src", f"select {k}1 as one, idx, {label} as label, {feats} from d")
    return [*eh(keys), lagged(names, list(range(1, lags + 1)), keys), src, *tree("src", [*keys, "one"], depth, lags, "tr", min_leaf)]


def tree_chain(orders: Sequence[Sequence[str]], v: float, depth: int, tag: str = "") -> list[str]:
    names = list(dict.fromkeys(c for o in orders for c in o))
    plan = ", ".join(f"({t}::bigint, {j + 1}, '{c}', '{','.join(o)}')" for t, o in enumerate(orders) for j, c in enumerate(o))
    parts = [
        lagged(names, [1, 2], name=f"{tag}d"),
        cte(f"{tag}long", " union all ".join(
            f"select idx, '{c}' as x_name, {c} as y, {c}_1 as x1, {c}_2 as x2 from {tag}d" for c in names)),
        f"{tag}plan(test_id, round, x_name, ord) as (values {plan})",
        cte(f"{tag}lab1", f"select test_id, idx, y as label from {tag}long join {tag}plan using (x_name) where round = 1"),
    ]
    for j in range(1, len(orders[0]) + 1):
        parts.append(cte(f"{tag}in{j}", f"select test_id, l.idx, label, x1, x2 from {tag}lab{j} l join {tag}plan q using (test_id) "
                                        f"join {tag}long f on f.idx = l.idx and f.x_name = q.x_name where q.round = {j}"))
        parts += tree(f"{tag}in{j}", ["test_id"], depth, 2, f"{tag}t{j}x")
        parts.append(cte(f"{tag}lab{j + 1}", f"select test_id, idx, label - {1.0 if j == 1 else v} * pred as label from {tag}t{j}x"))
    parts.append(cte(f"{tag}rounds", " union all ".join(
        f"select test_id, {j} as round, count(*) as n, avg(pow(label - pred, 2)) as mse, null::double as r2 from {tag}t{j}x group by test_id"
        for j in range(1, len(orders[0]) + 1))))
    return parts


def _tree_graph(names: Sequence[str], depth: int) -> str:
    orders = _orders(names)
    return with_([*eh(), *tree_chain(orders, 0.1, depth), *tested(orders, len(names))], test_view(where="where p_value < 0.5"))


def _ar_trees(depth: int) -> str:
    each = [with_(_one_tree(v, v, depth, lags=3, min_leaf=1), f"select '{v}' as variable, count(*) as n, {r('avg(pow(label - pred, 2))', 'mse')}, "
                  f"{r('1 - avg(pow(label - pred, 2)) / var_pop(label)', 'r2')} from tr") for v in EVENTS]
    return " union all ".join(f"select * from ({x})" for x in each)


def _tree_incremental() -> str:
    old = _orders(TWO)
    longer, alpha = [("error", *o) for o in old], "p_value < 0.7"
    parts = [*eh(), *tree_chain(old, 0.1, 2), *tested(old, 3), *tree_chain(longer, 0.1, 2, "n"),
             *tested(longer, 3, name="ntests", source="nrounds", plan="nplan"),
             lagged(["error"], [1, 2], name="e"),
             cte("cin", "select test_id, idx, label, error_1 as x1, error_2 as x2 from t2x join e using (idx)".replace(
                 "label, error_1", "t2x.label, error_1")),
             *tree("cin", ["test_id"], 2, 2, "cx"),
             cte("cscore", "select test_id, n + 2 as n, mse as mse_prev, mse_all, (mse - mse_all) / mse_all * ((n + 2 - 8) / 2.0) as f_score "
                           "from (select test_id, avg(pow(label - pred, 2)) as mse_all from cx group by test_id) "
                           "join rounds using (test_id) where round = 2"),
             cte("causes", "select c.*, split_part(ord, ',', 1) as effect, 'error' as cause, ord || ',error' as \"order\", "
                           f"{f_tail('f_score', 2, 'n - 8')} as p_value from cscore c join plan using (test_id) where round = 1")]
    return with_(parts, " union all ".join([
        test_view(where=f"where {alpha}", source="ntests", lead="'effect' as source, "),
        test_view(where=f"where {alpha} and test_id in (select test_id from tests where {alpha})", source="causes", lead="'cause' as source, "),
        test_view(where=f"where {alpha}", lead="'existing' as source, "),
    ]))


def _importances() -> str:
    parts = _one_tree("click", "click", 3)
    gains = " union all ".join(f"select f, gain from trs{i}" for i in range(3))
    return with_(parts, f"select (f + 1)::bigint as lag, {r('sum(gain) / sum(sum(gain)) over ()', 'importance')} from ({gains}) group by f")


# --- vector autoregressions -------------------------------------------------


def _var1_parts(panel: Sequence[str], limit: str = "") -> list[str]:
    """VAR(1) of click and view: one closed-form fit per equation, and the residual covariance."""
    parts = [*panel, cte("q", f"select * from p {limit}"), lagged(TWO, [1], source="q")]
    for v in TWO:
        parts += two_regressors("d", v, "click_1", "view_1", f"eq_{v}")
    pred = {v: f"(eq_{v}.a + eq_{v}.b1 * click_1 + eq_{v}.b2 * view_1)" for v in TWO}
    pair = {f"s_{a}_{b}": f"sum(({a} - {pred[a]}) * ({b} - {pred[b]})) / (count(*) - 3)" for a in TWO for b in TWO}
    parts.append(cte("sig", "select " + ", ".join(f"{e} as {n}" for n, e in pair.items()) + " from d, eq_click, eq_view"))
    return parts


def _var_fit() -> str:
    cells = [f"select n as nobs, {i * 2 + j} as \"at\", {c} as value from eq_{v}" for i, c in enumerate(("a", "b1", "b2")) for j, v in enumerate(TWO)]
    return with_(_var1_parts(eh()), f"select nobs, \"at\"::bigint as \"at\", {r('value')} from ({' union all '.join(cells)})")


def _var_summary() -> str:
    # (ZᵀZ)⁻¹ diagonal for an intercept and two regressors, from the centred moments
    det = "(s11 * s22 - s12 * s12)"
    inv = {"const": f"1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (n * {det})",
           "click.L1": f"s22 / (n * {det})", "view.L1": f"s11 / (n * {det})"}
    coef = {"const": "a", "click.L1": "b1", "view.L1": "b2"}
    rows = " union all ".join(
        f"select '{v}' as equation, '{t}' as term, {0 if t == 'const' else 1} as lag, {coef[t]} as coef, "
        f"sqrt(({inv[t]}) * s_{v}_{v}) as std_err, n - 3 as d from eq_{v}, sig" for v in TWO for t in coef)
    t2 = "pow(coef / std_err, 2)"
    return with_(_var1_parts(eh()), f"select equation, term, lag::bigint as lag, {r('coef')}, {r('std_err')}, "
                                    f"{r('coef / std_err', 't_stat')}, {r(f_tail(t2, 1, 'd'), 'p_value')} from ({rows})")


def _var_correlation() -> str:
    cells = " union all ".join(f"select '{a}' as row, '{b}' as col, {r(f's_{a}_{b} / sqrt(s_{a}_{a} * s_{b}_{b})', 'correlation')} from sig"
                               for a in TWO for b in TWO)
    return with_(_var1_parts(eh()), cells)


def _forecast_parts(steps: int, limit: str = "") -> list[str]:
    start = "(select * from q order by idx desc limit 1)"
    nxt = {v: f"eq_{v}.a + eq_{v}.b1 * {{s}}click + eq_{v}.b2 * {{s}}view" for v in TWO}
    first = ", ".join(f"{nxt[v].format(s='l.')} as {v}" for v in TWO)
    then = ", ".join(nxt[v].format(s="fc.") for v in TWO)
    # weights: the step-1 power of the coefficient matrix; spread adds weight Σ weightᵀ
    return [*_var1_parts(eh(), limit),
            f"fc as (select 1 as step, {first} from {start} l, eq_click, eq_view union all "
            f"select step + 1, {then} from fc, eq_click, eq_view where step < {steps})"]


def _bands() -> str:
    c, w = ["click", "view"], {}
    A = {(a, i): f"eq_{a}.b{i + 1}" for a in c for i in range(2)}
    new = {(i, j): " + ".join(f"{A[(c[i], m)]} * w{m}{j}" for m in range(2)) for i in range(2) for j in range(2)}
    cols = [f"w{i}{j}" for i in range(2) for j in range(2)]
    weights = (f"ws as (select 1 as step, 1.0::double as w00, 0.0::double as w01, 0.0::double as w10, 1.0::double as w11 union all "
               f"select step + 1, {', '.join(new[(i, j)] for i in range(2) for j in range(2))} from ws, eq_click, eq_view where step < 100)")
    var = {v: " + ".join(f"w{i}{a} * s_{c[a]}_{c[b]} * w{i}{b}" for a in range(2) for b in range(2)) for i, v in enumerate(c)}
    spread = "sp as (select step, " + ", ".join(f"sum({var[v]}) over (order by step) as v_{v}" for v in c) + " from ws, sig)"
    rows = " union all ".join(
        f"select step::bigint as step, '{v}' as variable, {r(v, 'mean')}, {r(f'{v} - {Z} * sqrt(v_{v})', 'lower')}, "
        f"{r(f'{v} + {Z} * sqrt(v_{v})', 'upper')} from fc join sp using (step)" for v in c)
    return with_([*_forecast_parts(100), weights, spread], rows)


def _versus(offset: int) -> str:
    return with_(_forecast_parts(50, "where idx < 500"),
                 f"select step::bigint as step, {r('p.click', 'true_value')}, {r('fc.click', 'predicted_value')} "
                 f"from fc join p on p.idx = 499 + step + {offset}")


def _pair_rows(names: Sequence[str], lag: int, name: str, pairs, keys: Sequence[str] = (), own_only: bool = False) -> tuple[list[str], int, int]:
    """Rows of every pair with regressors ordered: everything but the cause's lags, then the cause's lags."""
    parts, k = [lagged(names, list(range(1, lag + 1)), keys, name=f"{name}d")], "".join(f"{c}, " for c in keys)
    selects = []
    for effect, cause in pairs:
        rest = [effect] if own_only else [v for v in names if v != cause]
        cols = [f"{v}_{i}" for v in rest for i in range(1, lag + 1)] + [f"{cause}_{i}" for i in range(1, lag + 1)]
        listed = ", ".join(f'"{c}" as x{i}' for i, c in enumerate(cols))
        selects.append(f"select {k}'{effect}' as effect, '{cause}' as cause, \"{effect}\" as y, {listed} from {name}d")
    parts.append(cte(name, " union all ".join(selects)))
    return parts, len(cols) - lag, len(cols)


def _var_tests(names: Sequence[str], lags: Sequence[int]) -> list[str]:
    parts, unions, k = [*eh()], [], len(names)
    for lag in lags:
        pairs = [(e, c) for e in names for c in names]
        rows, before, full = _pair_rows(names, lag, f"v{lag}", pairs)
        parts += rows
        parts += sweep(f"v{lag}", ["effect", "cause"], "y", [f"x{i}" for i in range(full)], f"w{lag}", [before, full])
        dfr = f"(n - {1 + k * lag})"
        parts.append(cte(f"u{lag}", f"select effect, cause, {lag}::bigint as lag, {lag} as df1, {k} * {dfr} as df2, "
                                    f"(rss{before} - rss{full}) / {lag} / (rss{full} / {dfr}) as statistic from w{lag}"))
        unions.append(f"select effect, cause, lag, df1, df2, statistic, {f_tail('statistic', lag, 'df2')} as p_value from u{lag}")
    return [*parts, cte("tests", " union all ".join(unions))]


_BEST = "select effect, cause, arg_min(lag, (p_value, lag)) as lag, min(p_value) as p_value from tests where {w} group by effect, cause"
_RUNNING = ("select effect, cause, lag as time_lag, p_value as strength, 'GC' as method from tests where p_value < 0.9 and effect <> cause "
            "qualify p_value < coalesce(min(p_value) over (partition by effect, cause order by lag rows between unbounded preceding "
            "and 1 preceding), 1.0)")


def _wald(cols: str) -> str:
    return with_(_var_tests(TWO, [2]), f"select {cols} from tests where effect = 'click' and cause = 'view'")


def _joint_wald() -> str:
    """Both other variables as causes of click, lag 2, k = 3."""
    rows, _, full = _pair_rows(THREE, 2, "j", [("click", "error")])
    parts = [*eh(), *rows, *sweep("j", ["effect"], "y", [f"x{i}" for i in range(full)], "w", [2, full])]
    stat = f"((rss2 - rss{full}) / 4 / (rss{full} / (n - 7)))"
    return with_(parts, f"select {r(stat, 'statistic')}, 4::bigint as df1, (3 * (n - 7))::bigint as df2, "
                        f"{r(f_tail(stat, 4, '3 * (n - 7)'), 'p_value')} from w")


def _granger(panel, names, lags, keys=()) -> list[str]:
    parts, unions = [*panel], []
    k = "".join(f"{c}, " for c in keys)
    for lag in lags:
        pairs = [(e, c) for e in names for c in names if e != c]
        rows, before, full = _pair_rows(names, lag, f"v{lag}", pairs, keys, own_only=True)
        parts += rows
        parts += sweep(f"v{lag}", [*keys, "effect", "cause"], "y", [f"x{i}" for i in range(full)], f"w{lag}", [before, full])
        d2 = f"(n - {2 * lag + 1})"
        parts.append(cte(f"u{lag}", f"select {k}effect, cause, {lag}::bigint as lag, {d2} as df2, "
                                    f"(rss{before} - rss{full}) / {lag} / (rss{full} / {d2}) as f_score from w{lag}"))
        unions.append(f"select {k}effect, cause, lag, f_score, {f_tail('f_score', lag, 'df2')} as p_value from u{lag}")
    return [*parts, cte("tests", " union all ".join(unions))]


# --- the rest ---------------------------------------------------------------


def _structural(model: str) -> str:
    cols = ", ".join(f"({v} - 150) / 100 as s{i + 1}" for i, v in enumerate(FOUR))
    e = "exp(-{0} * {0} / 2)".format
    root = "sqrt(2.0)"
    eq = {
        "linear": [f"0.95 * {root} * s1_1 - 0.90 * s1_2", "0.5 * s2_2", f"-0.5 * s1_1 + 0.25 * {root} * s3_1 + 0.25 * {root} * s2_1",
                   f"0.95 * s4_1 - 0.25 * {root} * s3_1"],
        "nonlinear": [f"0.125 * {root} * {e('s1_1')}", f"1.2 * {e('s1_1')}", f"-1.05 * {e('s1_1')}",
                      f"-1.15 * {e('s1_1')} + 0.2 * {root} * {e('s4_1')} + 1.35 * {e('s3_1')}"],
    }
    eq["nonlinear2"] = [*eq["nonlinear"]]
    eq["nonlinear2"][1] = f"case when s1_1 > 0 then 1.2 * {e('s1_1')} else -2 * exp(-s1_1 * s1_1) end"
    s = ["s1", "s2", "s3", "s4"]
    out = [r(c) for c in s] + [r(q, f"mean_{c}") for c, q in zip(s, eq[model])] + [r(f"{c} - ({q})", f"eps_{c}") for c, q in zip(s, eq[model])]
    return with_([*ev(), cte("sc", f"select idx, {cols} from p"), lagged(s, [1, 2], source="sc")], f"select idx, {', '.join(out)} from d")


def _pred_rows() -> str:
    parts = [*eh(), *chain([("click", "view", "error")], 0.1)]
    p = [f"res{j}.pred" for j in (1, 2, 3)]
    cols = ", ".join([*[r(c, f"predicted_{i + 1}") for i, c in enumerate(p)], r(" + ".join(p), "pred_y"), r(" + ".join(p[:2]), "last_step")])
    return with_(parts, f"select res1.idx, {cols} from res1 join res2 using (idx) join res3 using (idx)")


def _middle(lags: Sequence[int], cols: Sequence[str]) -> list[str]:
    """Positions 300 to 599 of the hourly counts and their lags (table d)."""
    part = [*eh(), cte("q", "select * from p where idx between 300 and 599")]
    return [*part, lagged(cols, lags, source="q").replace(f"where idx >= {max(lags)}", f"where idx >= {300 + max(lags)}")]


def _slice_tests() -> str:
    orders = _orders(THREE)
    inner = [q.replace("from p)", "from q)").replace("where idx >= 2", "where idx >= 302") for q in chain(orders, 0.1)]
    return with_([*eh(), cte("q", "select * from p where idx between 300 and 599"), *inner, *tested(orders, 3)], test_view())


def _null_key() -> str:
    orders, keys = _orders(THREE), ["grp"]
    wide = (f"select coalesce(nullif(user_id % 5, 0), -1) as grp, date_trunc('hour', ts) as t, {_pivot('event_type', _same(THREE), '1')} "
            "from events group by 1, 2")
    inner = with_([*_grid(wide, "1 hour", THREE, keys), *chain(orders, 0.1, keys), *tested(orders, 3, keys)], test_view(keys, "where p_value < 0.5"))
    return f"select nullif(grp, -1)::varchar as grp, * exclude (grp) from ({inner})"


def _valued(depth: int) -> list[str]:
    """Tree of hourly click values on view's lags, in bins of at most 32: table tr, splits trs<level>."""
    parts = [*ev(), lagged(TWO, [1, 2], name="d")]
    for i in (1, 2):
        c = f"view_{i}"
        parts += [
            cte(f"e{i}", f"select min({c}) as lo, max({c}) as hi from d"),
            cte(f"c{i}", f"select coalesce(least(4095, floor(({c} - lo) / nullif(hi - lo, 0) * 4096)), 0) as cell, count(*) as n, min({c}) as lo, max({c}) as hi "
                         f"from d, e{i} group by 1"),
            cte(f"s{i}", "select n, hi, lead(lo) over (order by cell) as next, count(*) over () as used, sum(n) over (order by cell) as upto, sum(n) over () as total "
                         f"from c{i}"),
            cte(f"t{i}", f"select (hi + next) / 2 as edge from s{i} where next is not null and (used <= 32 or upto * 32 // total > (upto - n) * 32 // total)"),
            cte(f"b{i}", f"select idx, (select count(*) from t{i} where edge < {c}) as x{i} from d"),
        ]
    parts.append(cte("src", "select 1 as one, idx, click as label, x1, x2 from d join b1 using (idx) join b2 using (idx)"))
    return [*parts, *tree("src", ["one"], depth, 2, "tr", 10)]


def _moment_matrix(part: Sequence[str] | None = None) -> str:
    cols = [(f"{v}__lag{i}" if i else v, f"{v}_{i}" if i else v) for v in TWO for i in range(3)]
    cells = " union all ".join(
        f"select count(*) as n, count(*) + 2 as n_rows, '{a}' as row, '{b}' as col, {r(f'avg({x})', 'row_mean')}, "
        f"{r(f'covar_pop({x}, {y}) * count(*)', 'g')} from d" for a, x in cols for b, y in cols)
    return with_(part or [*eh(), lagged(TWO, [1, 2])], cells)


def _fit(cols: str, tail: str = "from f") -> str:
    return with_([*eh(), lagged(TWO, [1, 2]), *two_regressors("d", "click", "click_1", "click_2", "f")], f"select {cols} {tail}")


_PRED = "(a + b1 * click_1 + b2 * click_2)"


def _assembled() -> str:
    cols = ", ".join(f"case when \"{v}\" > 0 then \"{v}\" end as \"{v}\"" for v in THREE)
    any_ = " or ".join(f'"{v}" > 0' for v in THREE)
    return with_([cte("wide", hourly())], f"select strftime(t, '%Y-%m-%d %H:%M:%S') as t, {cols} from wide where {any_}")


def all_sql() -> dict[str, str]:
    two, cols6 = ", ".join(TWO), ", ".join(SHIPMENTS)
    stamp = "strftime(t, '%Y-%m-%d %H:%M:%S') as t"
    scores = [*eh(), cte("sc", "select idx, click / 2 + idx / 300.0 as x from p")]
    levels = [*eh(), cte("lv", "select idx, (idx + 1) / 2000.0 + 0.5 as level from p")]
    values = "select distinct event_type from events"
    best = "select effect, cause, lag, " + r("p_value") + " from ({q})"
    edges = f"select effect, cause, time_lag, {r('strength')}, method from ({_RUNNING})"
    mse = f"avg(pow(click - {_PRED}, 2))"
    sql = {
        "csv_header_roundtrip": with_(eh(), f"select idx, {', '.join(EVENTS)} from p"),
        "csv_headerless_named": with_(eh(), "select idx, click as x1, view as x2 from p"),
        "matrix_roundtrip": with_(ev(), f"select idx::double as idx, {r('round(click, 6)', 'x1', 4)}, {r('round(view, 6)', 'x2', 4)} from p"),
        "edges_csv_roundtrip": with_([*eh(), *chain(_orders(EVENTS), 1.0), *tested(_orders(EVENTS), 5)],
                                     f'select effect, cause, {r("p_value")}, "order" from tests where p_value < 0.9'),
        "panel_wide_events": with_(eh(), f"select idx, {stamp}, {', '.join(EVENTS)} from p"),
        "panel_wide_shipments": with_(ld(), f"select idx, {stamp}, {cols6} from p"),
        "panel_assembled": _assembled(),
        "panel_shape_grouped": with_(ld(["l_linenumber"]), "select l_linenumber, count(*) as n, 6::bigint as k from p group by 1"),
        "time_index": with_(od(), f"select idx, {stamp}, {', '.join(PRIORITIES)} from p"),
        "time_index_grouped": with_([cte("wide", hourly(keys=["grp"]))],
                                    f"select grp, row_number() over (partition by grp order by wide.t) - 1 as idx, {stamp}, click from wide"),
        "calendar_month_end": with_(od(), "select idx, strftime(last_day(date '1979-01-01' + to_months(idx::int)), '%Y-%m-%d') as date, urgent from p"),
        "calendar_daily": with_(od(), "select idx, strftime(date '1900-01-01' + idx::int, '%Y-%m-%d') as date, urgent from p"),
        "lag_zero_fill": with_([*eh(), lagged(TWO, [1, 2], zero=True)], f"select idx, {two}, click_1 as click__lag1, click_2 as click__lag2, "
                                                                       "view_1 as view__lag1, view_2 as view__lag2 from d"),
        "lag_drop": with_([*eh(), lagged(TWO, [1, 2, 3])], f"select idx, {two}, " + ", ".join(
            f"{v}_{i} as {v}__lag{i}" for v in TWO for i in (1, 2, 3)) + " from d"),
        "lag_features": with_([*eh(), lagged(TWO, [1, 2])], "select idx, view_1 as f1, view_2 as f2 from d"),
        "lag_grouped": with_([*ld(["l_linenumber"]), lagged(["af", "no"], [1, 2], ["l_linenumber"])], "select l_linenumber, idx, af, no, " + ", ".join(
            f"{v}_{i} as {v}__lag{i}" for v in ("af", "no") for i in (1, 2)) + " from d"),
        "lag_chunked": with_([*ld(), lagged(["af", "no"], [1, 2, 3])], "select idx, af, no, " + ", ".join(
            f"{v}_{i} as {v}__lag{i}" for v in ("af", "no") for i in (1, 2, 3)) + " from d"),
        "slice_prefix": with_(ld(), f"select idx, {cols6} from p where idx between 0 and 499"),
        "slice_last_p": with_(ld(), f"select idx, {cols6} from p where idx > (select max(idx) from p) - 5"),
        "slice_range": with_(ld(), f"select idx, {cols6} from p where idx between 499 and 548"),
        "preview_rows": with_(ld(), f"select idx, {cols6} from p order by idx limit 10"),
        "structural_mean_linear": _structural("linear"),
        "structural_mean_nonlinear": _structural("nonlinear"),
        "structural_mean_nonlinear2": _structural("nonlinear2"),
        "ols_fit_lag2": with_([*eh(), lagged(TWO, [1, 2]), *two_regressors("d", "click", "view_1", "view_2", "f")],
                              f"select any_value(f.n) as n, {r('any_value(a)', 'intercept')}, {r('any_value(b1)', 'b1')}, {r('any_value(b2)', 'b2')}, "
                              f"{r('avg(pow(click - (a + b1 * view_1 + b2 * view_2), 2))', 'mse')}, "
                              f"{r('1 - avg(pow(click - (a + b1 * view_1 + b2 * view_2), 2)) / var_pop(click)', 'r2')} from d, f"),
        "ols_residual_lag2": _fit(f"idx, {r(_PRED, 'predicted')}, {r(f'click - {_PRED}', 'residual')}", "from d, f"),
        "shrunk_residual": with_([*eh(), lagged(TWO, [1, 2]), *two_regressors("d", "click", "view_1", "view_2", "f")],
                                 f"select idx, {r('click - 0.1 * (a + b1 * view_1 + b2 * view_2)', 'by_rule')}, "
                                 f"{r('click - 0.1 * (a + b1 * view_1 + b2 * view_2)', 'residual')} from d, f"),
        "fit_metrics": _fit(f"count(*) as n, {r(mse, 'mse')}, {r(f'1 - {mse} / var_pop(click)', 'r2')}, "
                            f"{r(f'1 - var_pop(click - {_PRED}) / var_pop(click)', 'explained_variance')}", "from d, f"),
        "cumulative_prediction": _pred_rows(),
        "joint_ols": with_([*eh(), lagged(TWO, [1]), *two_regressors("d", "click", "click_1", "view_1", "f")],
                           f"select any_value(f.n) as n, {r('any_value(a)', 'intercept')}, {r('any_value(b1)', 'b_click')}, {r('any_value(b2)', 'b_view')}, "
                           f"{r('avg(pow(click - (a + b1 * click_1 + b2 * view_1), 2))', 'mse')}, "
                           f"{r('1 - avg(pow(click - (a + b1 * click_1 + b2 * view_1), 2)) / var_pop(click)', 'r2')} from d, f"),
        "moment_matrix": _moment_matrix(),
        "moments_of_slice": _moment_matrix(_middle([1, 2], TWO)),
        "lag_of_slice": with_(_middle([1, 2], EVENTS), "select idx, " + ", ".join(EVENTS) + ", " + ", ".join(f"{v}_{i} as {v}__lag{i}" for v in EVENTS for i in (1, 2)) + " from d"),
        "chain_tests_of_slice": _slice_tests(),
        "time_index_ties": "select event_type, event_id, row_number() over (partition by event_type order by date_trunc('hour', ts), event_id) - 1 as idx from events",
        "causality_graph_null_key": _null_key(),
        "tree_round_values": with_(_valued(3), f"select idx, {r('pred', 'prediction')}, {r('label - pred', 'residual')} from tr"),
        "tree_importances_values": with_(_valued(3), f"select (f + 1)::bigint as lag, {r('sum(gain) / sum(sum(gain)) over ()', 'importance')} from ("
                                                     + " union all ".join(f"select f, gain from trs{i}" for i in range(3)) + ") group by f"),
        "granger_graph_default": with_(_granger(eh(), EVENTS, [1, 2, 3, 4]), best.format(q=_BEST.format(w="p_value < 1e-10"))),
        "var_graph_default": with_(_var_tests(FOUR, [1, 2, 3, 4]), best.format(q=_BEST.format(w="p_value < 0.001"))),
        "boost_chain_linear": _rounds(1.0),
        "boost_chain_shrunk": _rounds(0.1),
        "chain_f_test": _chain_tests(0.1),
        "chain_f_test_zero_fill": _chain_tests(0.1, zero=True),
        "chain_f_test_fitted_n": _chain_tests(1.0, orders=[("click", "view", "error"), ("view", "error", "click")], names=THREE, extra=0),
        "mse_log_ratio": _chain_scalar(r("ln(mse_prev / mse_all)", "log_ratio")),
        "pseudo_f_ratio": _chain_scalar(r("(mse_prev - mse_all) / (mse_all / 996)", "ratio") + ", " + r(
            "case when mse_prev > mse_all then ln((mse_prev - mse_all) / (mse_all / 996)) end", "log_ratio")),
        "r2_change": _chain_scalar(r("abs(r2_all - r2_prev) / r2_prev", "change")),
        "test_plan": (f"with v(name) as ({values}), o as (select a.name as effect, e.name as cause, a.name || ',' || b.name || ',' || c.name "
                      "|| ',' || d.name || ',' || e.name as \"order\" from v a join v b on b.name <> a.name join v c on c.name not in (a.name, b.name) "
                      "join v d on d.name not in (a.name, b.name, c.name) join v e on e.name not in (a.name, b.name, c.name, d.name)) "
                      "select row_number() over (order by \"order\") - 1 as test_id, effect, cause, \"order\", 2 as maxlag from o"),
        "variable_pairs": (f"with v(name) as ({values}), n as (select event_type as cause, count(*) as events from events group by 1) "
                           "select v.name as effect, cause, events from v, n"),
        "causality_graph_linear": _chain_tests(0.1, alpha=0.5),
        "causality_graph_five": _chain_tests(0.1, alpha=0.05, names=EVENTS),
        "causality_graph_grouped": _grouped_graph(),
        "incremental_effect": _incremental("effect"),
        "incremental_cause": _incremental("replace"),
        "incremental_cause_conditioned": _incremental("condition"),
        "incremental_merged": _incremental("merged"),
        "incremental_from_state": _incremental("merged"),
        "incremental_stored": _incremental("merged"),
        "tree_stump_round": with_(_one_tree("click", "click", 1), f"select idx, {r('pred', 'prediction')}, {r('label - pred', 'residual')} from tr"),
        "tree_round": with_(_one_tree("click", "view", 3), f"select idx, {r('pred', 'prediction')}, {r('label - pred', 'residual')} from tr"),
        "tree_round_grouped": with_(_one_tree("click", "view", 2, ["grp"]), f"select grp, idx, {r('pred', 'prediction')} from tr"),
        "tree_importances": _importances(),
        "ar_tree": with_(_one_tree("click", "click", 4, lags=3, min_leaf=1),
                         f"select count(*) as n, {r('avg(pow(label - pred, 2))', 'mse')}, {r('1 - avg(pow(label - pred, 2)) / var_pop(label)', 'r2')} from tr"),
        "causality_graph_tree": _tree_graph(THREE, 2),
        "causality_graph_tree_five": _tree_graph(EVENTS, 6),
        "ar_tree_five": _ar_trees(5),
        "incremental_tree_from_state": _tree_incremental(),
        "incremental_tree": _tree_incremental(),
        "var_dims": with_(eh(), " union all ".join(
            f"select {p}::bigint as p, 5::bigint as k, count(*) - {p} as nobs, {1 + 5 * p}::bigint as df_model, count(*) - {p + 1 + 5 * p} as df_resid from p"
            for p in (1, 5))),
        "var_fit": _var_fit(),
        "var_summary": _var_summary(),
        "var_residual_correlation": _var_correlation(),
        "var_forecast": with_(_forecast_parts(50), " union all ".join(
            f"select step::bigint as step, '{v}' as variable, {r(v, 'mean')} from fc" for v in TWO)),
        "forecast_bands": _bands(),
        "forecast_vs_actual": _versus(0),
        "forecast_vs_actual_shifted": _versus(-1),
        "var_wald_f": _wald(f"{r('statistic')}, df1::bigint as df1, df2::bigint as df2, {r('p_value')}"),
        "var_wald_chi2": _wald(f"{r('2 * statistic', 'statistic')}, 2::bigint as df1, {r(chi2_tail('2 * statistic', 2), 'p_value')}"),
        "var_critical_values": with_([*eh(), cte("s", "select 2.0 * (count(*) - 2 - 5) as d2 from p")],
                                     f"select 'f' as kind, 0.05::double as signif, {r('d2 / 2 * (pow(0.05::double, -2 / d2) - 1)', 'critical_value')} from s "
                                     f"union all select 'wald', 0.05::double, {r('-2 * ln(0.05::double)', 'critical_value')} from s"),
        "var_joint_causality": _joint_wald(),
        "granger_pairs": with_(_granger(eh(), EVENTS, [1, 2, 3, 4]), f"select effect, cause, lag, {r('f_score')}, {r('p_value')} from tests"),
        "granger_best_lag": with_(_granger(eh(), EVENTS, [1, 2, 3, 4]), best.format(q=_BEST.format(w="p_value < 0.3"))),
        "granger_pairs_grouped": with_(_granger(ld(["l_linenumber"]), ["af", "no", "ro"], [2], ["l_linenumber"]),
                                       f"select l_linenumber, effect, cause, {r('f_score', digits=5)}, {r('p_value', digits=5)} from tests"),
        "var_pair_tests": with_(_var_tests(FOUR, [1, 2, 3]), f"select effect, cause, lag, {r('statistic')}, {r('p_value')} from tests"),
        "var_graph": with_(_var_tests(FOUR, [1, 2, 3]), best.format(q=_BEST.format(w="p_value < 0.5"))),
        "var_edges_running_min": with_(_var_tests(FOUR, [1, 2, 3]), edges),
        "var_edges_top20": with_(_var_tests(FOUR, [1, 2, 3]), f"{edges} order by strength, effect, cause limit 20"),
        "var_edges_csv": with_(_var_tests(FOUR, [1, 2, 3]), edges),
        "f_survival_table": with_(scores, "select idx, " + ", ".join(r(f_tail("x", d, "100"), f"p{d}") for d in (2, 4, 3, 6)) + " from sc"),
        "chi2_survival_table": with_(scores, "select idx, " + ", ".join(r(chi2_tail("x", d), f"p{d}") for d in (2, 4, 6)) + " from sc"),
        "quantile_table": with_(levels, f"select idx, {r('50 * (pow(1 - level, -0.02) - 1)', 'f', 5)}, {r('-2 * ln(1 - level)', 'chi2', 5)} from lv"),
    }
    return sql
