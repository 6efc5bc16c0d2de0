import numpy as np
import pytest
from fixtures import known_graph, lags, ols

from lagweave.operators import granger, panel as pn, var

NAMES = ["s1", "s2", "s3", "s4"]


@pytest.fixture(scope="module")
def linear(spark):
    return spark.createDataFrame(known_graph("linear")).repartition(3).cache()


@pytest.fixture(scope="module")
def plain():
    x = known_graph("linear")[NAMES].to_numpy()
    p, k = 2, 4
    z = np.column_stack([np.ones(len(x) - p), x[1:-1], x[:-2]])
    b = np.linalg.lstsq(z, x[p:], rcond=None)[0]
    u = x[p:] - z @ b
    s = u.T @ u / (len(z) - 1 - k * p)
    return x, b, s, np.linalg.inv(z.T @ z)


def test_fit_and_summary(linear, plain):
    _, b, s, inv = plain
    fit = var.var_fit(linear, NAMES, 2)
    row = fit.first()
    np.testing.assert_allclose(np.array(row.params).reshape(b.shape), b, atol=1e-9)
    np.testing.assert_allclose(np.array(row.sigma_u).reshape(4, 4), s, rtol=1e-9)
    np.testing.assert_allclose(np.array(row.ztz_inv).reshape(9, 9), inv, rtol=1e-6, atol=1e-12)
    rows = var.var_summary(fit, NAMES).toPandas()
    err = np.sqrt(np.outer(np.diag(inv), np.diag(s)))
    for i, term in enumerate(var.term_names(NAMES, 2)):
        for j, eq in enumerate(NAMES):
            got = rows[(rows.term == term) & (rows.equation == eq)].iloc[0]
            assert (got.coef, got.std_err) == (pytest.approx(b[i, j]), pytest.approx(err[i, j]))


@pytest.mark.parametrize("caused, causing", [("s3", "s1"), (["s3", "s4"], ["s1", 1]), (2, None)])
def test_wald_statistic_equals_the_restriction_matrix_form(linear, plain, caused, causing):
    _, b, s, inv = plain
    k, p = 4, 2
    e = [NAMES.index(c) if isinstance(c, str) else c for c in (caused if isinstance(caused, list) else [caused])]
    c = [i for i in range(k) if i not in e] if causing is None else [
        NAMES.index(v) if isinstance(v, str) else v for v in (causing if isinstance(causing, list) else [causing])]
    pick = np.zeros((len(c) * len(e) * p, b.size))
    for row, (j, g, f) in enumerate((j, g, f) for j in range(p) for g in c for f in e):
        pick[row, k + f + k * g + k * k * j] = 1
    beta = pick @ b.ravel()
    lam = beta @ np.linalg.inv(pick @ np.kron(inv, s) @ pick.T) @ beta
    fit = var.var_fit(linear, NAMES, 2)
    wald = var.var_causality(fit, NAMES, caused, causing, "wald").first()
    assert (wald.statistic, wald.df1) == (pytest.approx(lam, rel=1e-8), len(pick))
    f = var.var_causality(fit, NAMES, caused, causing, "f").first()
    assert (f.statistic, f.df2) == (pytest.approx(lam / len(pick), rel=1e-8), 4 * (1498 - 9))


def test_arguments_are_checked(linear):
    fit = var.var_fit(linear, NAMES, 1)
    for bad in ({"signif": 1.5}, {"kind": "t"}):
        with pytest.raises(ValueError):
            var.var_causality(fit, NAMES, "s1", "s2", **bad)
    with pytest.raises(TypeError):
        var.var_causality(fit, NAMES, 1.5)


def test_forecast_and_bands(linear, plain):
    x, b, s, _ = plain
    fc = var.var_forecast(var.var_fit(linear, NAMES, 2), pn.last_rows(linear, 2), NAMES, 6, alpha=0.05).toPandas()
    past, weights, spread = x[-2:], [], np.zeros((4, 4))
    a = [b[1:5].T, b[5:9].T]
    for h in range(1, 7):
        past = np.vstack([past, b[0] + a[0] @ past[-1] + a[1] @ past[-2]])
        weights.append(np.eye(4) if h == 1 else sum(m @ w for m, w in zip(a, weights[::-1])))
        spread = spread + weights[-1] @ s @ weights[-1].T
        got = fc[fc.step == h].set_index("variable").loc[NAMES]
        np.testing.assert_allclose(got["mean"], past[-1], atol=1e-8)
        np.testing.assert_allclose(got.upper - got["mean"], 1.959963984540054 * np.sqrt(np.diag(spread)), rtol=1e-8)


def test_var_graph_is_clean_on_the_linear_model(linear):
    edges = var.var_graph(linear, NAMES, [2], alpha=1e-3, keep_self=False).toPandas()
    assert set(zip(edges.cause, edges.effect)) == {("s1", "s3"), ("s2", "s3"), ("s3", "s4")}


def test_each_lag_order_uses_its_own_rows(linear):
    both = {r.p: r.nobs for r in var.var_fit(linear, NAMES, [1, 4]).collect()}
    assert both == {1: 1499, 4: 1496}
    alone = var.var_fit(linear, NAMES, 1).first()
    shared = [r for r in var.var_fit(linear, NAMES, [1, 4]).collect() if r.p == 1][0]
    np.testing.assert_allclose(alone.params, shared.params, atol=1e-10)


def test_granger_pairs(linear):
    pdf = known_graph("linear")
    got = {(r.effect, r.cause, r.lag): r for r in granger.granger_pairs(linear, NAMES, 3).collect()}
    assert len(got) == 36
    for (effect, cause, lag), r in got.items():
        y = pdf[effect].to_numpy()[lag:]
        own, other = lags(pdf[effect].to_numpy(), lag), lags(pdf[cause].to_numpy(), lag)
        rss = [float(np.sum((y - ols(z, y)[1]) ** 2)) for z in (own, np.hstack([own, other]))]
        assert r.f_score == pytest.approx((rss[0] - rss[1]) / lag / (rss[1] / (len(y) - 2 * lag - 1)), rel=1e-6)
    best = {(r.cause, r.effect) for r in granger.granger_graph(linear, NAMES, 3).collect()}
    assert {("s1", "s3"), ("s3", "s4")} <= best
