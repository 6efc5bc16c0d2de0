import math

import numpy as np
import pytest

from lagweave.functions import dist


def even_tail(f, m, d2):
    a, ratio = d2 / 2, 2 * m * f / d2
    y = ratio / (1 + ratio)
    term = total = 1.0
    for j in range(1, m):
        term *= y * (a + j - 1) / j
        total += term
    return math.exp(-a * math.log1p(ratio)) * total


@pytest.mark.parametrize("d2", [5, 50, 700, 1e5, 1.9e6, 2.1e6, 1e9, 1e12])
@pytest.mark.parametrize("m", [1, 2, 5])
def test_f_tail_equals_closed_form(d2, m):
    for f in (0.1, 1, 1.5, 3, 10):
        assert dist.f_tail(f, 2 * m, d2) == pytest.approx(even_tail(f, m, d2), rel=1e-8)


@pytest.mark.parametrize("df", [9_999, 10_001, 100_000, 300_001])
def test_chi2_tail_of_many_degrees_equals_the_recurrence(df):
    """Each two degrees more add one term; from 0 or 1 degree on, where the tail is 0 at such x."""
    a = np.arange(df % 2 / 2, df / 2)
    lgamma = np.array([math.lgamma(v + 1) for v in a])
    for z in (df / 2 + d * math.sqrt(df / 2) for d in (-6, -1, -0.01, 0, 0.3, 2, 7, 20)):
        tail = math.fsum(np.exp(a * math.log(z) - z - lgamma))
        assert dist.chi2_tail(2 * z, df) == pytest.approx(tail, rel=2e-8)


def test_unsettled_fraction_has_no_value(monkeypatch):
    monkeypatch.setattr(dist, "_STEPS", 4)
    assert np.isnan(dist.f_tail(1.0, 500, 600))


def test_edges_of_the_f_tail():
    assert dist.f_tail(np.array([-1.0, 0.0, np.inf, np.nan]), 3, 10).tolist()[:3] == [1.0, 1.0, 0.0]
    assert np.isnan(dist.f_tail(np.nan, 3, 10))


def test_table_quantiles():
    assert dist.f_quantile(0.95, 3, 20) == pytest.approx(3.0984, abs=1e-4)
    assert dist.f_quantile(0.99, 5, 10) == pytest.approx(5.6363, abs=1e-4)
    assert dist.chi2_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert dist.chi2_quantile(0.95, 7) == pytest.approx(14.0671, abs=1e-4)
    assert dist.normal_quantile(0.975) == pytest.approx(1.959963984540054)


@pytest.mark.parametrize("df", [1, 2, 3, 10, 55])
def test_quantiles_invert_tails(df):
    levels = np.array([0.001, 0.05, 0.5, 0.9, 0.999999])
    np.testing.assert_allclose(1 - dist.chi2_tail(dist.chi2_quantile(levels, df), df), levels, rtol=1e-9)
    np.testing.assert_allclose(1 - dist.f_tail(dist.f_quantile(levels, df, 30), df, 30), levels, rtol=1e-9)


def test_columns_agree_with_plain_expressions(spark):
    rows = spark.range(40).selectExpr("id / 4 as x")
    got = rows.select(dist.f_sf("x", 4, 60), dist.f_sf_even("x", 2, 60), dist.chi2_sf("x", 6), dist.chi2_sf_even("x", 3)).toPandas().to_numpy()
    np.testing.assert_allclose(got[:, 0], got[:, 1], rtol=1e-10)
    np.testing.assert_allclose(got[:, 2], got[:, 3], rtol=1e-10)
