"""Small known-graph series and plain numpy versions of the fits, for tests only."""

import numpy as np
import pandas as pd

R2 = np.sqrt(2)


def known_graph(name: str, rows: int = 1500, seed: int = 42) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    e = rng.normal(size=(rows, 4))
    s = np.zeros((rows, 4))
    s[1:3] = e[1:3]
    s[1:3, [0, 3]] += 10
    bell = lambda x: np.exp(-x * x / 2)
    for t in range(3, rows):
        a, b = s[t - 1], s[t - 2]
        if name == "linear":
            s[t] = [0.95 * R2 * a[0] - 0.9 * b[0], 0.5 * b[1], -0.5 * a[0] + 0.25 * R2 * (a[2] + a[1]), 0.95 * a[3] - 0.25 * R2 * a[2]]
        else:
            second = 1.2 * bell(a[0]) if name == "nonlinear" or a[0] > 0 else -2 * np.exp(-a[0] ** 2)
            s[t] = [0.125 * R2 * bell(a[0]), second, -1.05 * bell(a[0]), -1.15 * bell(a[0]) + 0.2 * R2 * bell(a[3]) + 1.35 * bell(a[2])]
        s[t] += e[t]
    out = pd.DataFrame(s, columns=["s1", "s2", "s3", "s4"])
    out.insert(0, "idx", np.arange(rows))
    return out


def lags(x: np.ndarray, p: int, fill=None) -> np.ndarray:
    """Columns lag 1..p of one series; the first p rows are dropped or filled."""
    cols = [np.concatenate([np.zeros(i), x[: len(x) - i]]) for i in range(1, p + 1)]
    out = np.column_stack(cols)
    return out[p:] if fill is None else out


def ols(x: np.ndarray, y: np.ndarray):
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    return beta, z @ beta


def chain_mse(df: pd.DataFrame, order, p: int, v: float, fill=None) -> list[float]:
    label = df[order[0]].to_numpy(float)
    label = label[p:] if fill is None else label
    out = []
    for j, name in enumerate(order):
        _, pred = ols(lags(df[name].to_numpy(float), p, fill), label)
        out.append(float(np.mean((label - pred) ** 2)))
        label = label - (1.0 if j == 0 else v) * pred
    return out
