"""Cross-moments of all variables and their lags: one data pass that serves every linear fit.

Each chunk of a panel yields its count, column means and centred cross-product
matrix; two merge levels combine them exactly, so no task ever holds more than
one chunk or a bounded number of matrices.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.orders import text_array
from .panel import _GAP, CHUNK_ROWS, lag_name, with_halo

_MERGE = 1024


def moment_columns(variables: Sequence[str], maxlag: int) -> list[str]:
    """Column order of the moment matrix: each variable at lag 0, 1, …, maxlag."""
    return [lag_name(v, lag) for v in variables for lag in range(maxlag + 1)]


_STATS = {"n": pa.int64(), "n_rows": pa.int64(), "lo": pa.int64(), "hi": pa.int64(), "means": pa.list_(pa.float64()), "g": pa.list_(pa.float64())}


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    col = table[name].combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _groups(batches, group: Sequence[str]):
    """Tables of neighbouring rows that agree on ``group``; the rows come sorted by it.

    Cheaper than one Arrow stream per group when there are very many small panels.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        change = np.zeros(len(table) - 1, bool)
        for name in group:
            col = table[name].combine_chunks()
            differ = pc.fill_null(pc.not_equal(col[1:], col[:-1]), False)
            null = pc.is_null(col).to_numpy(zero_copy_only=False)
            change |= differ.to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
        starts = [0, *(np.flatnonzero(change) + 1)]
        for lo, hi in zip(starts, starts[1:]):
            yield table.slice(lo, hi - lo)
        held = table.slice(starts[-1])
    if held is not None:
        yield held


def _per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], fn, ddl: str) -> DataFrame:
    """Apply ``fn`` (table to table) to each group: one shuffle on the group, sorted partitions, streamed batches."""
    def run(batches):
        ready, size = [], 0
        for table in _groups(batches, group):
            ready.append(fn(table))
            size += len(ready[-1])
            if size >= 1024:
                yield from pa.concat_tables(ready).combine_chunks().to_batches()
                ready, size = [], 0
        if ready:
            yield from pa.concat_tables(ready).combine_chunks().to_batches()

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, ddl)


def _rows(table: pa.Table, keys: Sequence[str], out: dict, types: dict) -> pa.Table:
    """Result rows of one group, with the group's key values repeated."""
    size = len(next(iter(out.values())))
    fixed = {k: table[k].take(pa.array([0] * size, pa.int64())) for k in keys}
    return pa.table(fixed | {c: pa.array(v, types[c]) for c, v in out.items()})


def _lagged_matrix(x: np.ndarray, halo: int, depth: int) -> np.ndarray:
    """Columns (variable, lag 0..depth) of the rows after the halo; missing lags are 0."""
    m = len(x) - halo
    x = np.vstack([np.zeros((depth - halo, x.shape[1])), x])
    return np.stack([x[depth - lag : depth - lag + m] for lag in range(depth + 1)], axis=2).reshape(m, x.shape[1] * (depth + 1))


def _stats(z: np.ndarray, last: int):
    mean = z.mean(axis=0) if len(z) else np.zeros(z.shape[1])
    d = z - mean
    return len(z), mean, (d[:, -last:].T @ d).ravel()


def _merged(n, mean, g):
    """Count, mean and centred cross-products of the union of disjoint row sets."""
    q = mean.shape[1]
    last = g.shape[1] // q
    total = n.sum()
    centre = n @ mean / max(total, 1)
    d = mean - centre
    return total, centre, (g.sum(axis=0).reshape(last, q) + (d[:, -last:] * n[:, None]).T @ d).ravel()


def moments(panel: DataFrame, variables: Sequence[str], maxlag: int, keys: Sequence[str] = (), fill: float | None = None,
            lags: Sequence[int] | None = None, idx: str = "idx", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Moment table: keys, p, n (rows in the fit), n_rows (rows of the panel), cols, means, g.

    ``p`` is the lag order: rows with p rows before them count (all rows when ``fill``
    is 0). One row per panel and per order in ``lags`` (default: maxlag only).
    ``g`` is the centred cross-product matrix, row-major over ``cols``.
    A panel may begin at any position; rows with fewer than p rows of it before them lack a lag and are left out
    (or filled). ``idx`` must number each panel's rows without gaps; a gap, or a null or NaN in a variable, raises.
    """
    return _moments(panel, variables, maxlag, keys, fill, lags, idx, chunk_rows, len(variables))


def _moments(panel, variables, maxlag, keys, fill, lags, idx, chunk_rows, last: int) -> DataFrame:
    """As `moments`, with the rows of ``g`` that belong to the ``last`` variables only."""
    if fill not in (None, 0):
        raise ValueError("moments support fill=None or fill=0")
    names, keys, depth, drop = list(variables), list(keys), maxlag, fill is None
    orders = sorted(set(lags or [maxlag]))
    if orders[-1] > maxlag or orders[0] < 1:
        raise ValueError("lag orders must lie in 1..maxlag")
    types, order_key = _STATS, {"p": pa.int32()}

    def chunk_stats(table: pa.Table) -> pa.Table:
        at = table["_idx"].to_numpy()
        if (np.diff(at) != 1).any():
            raise ValueError(_GAP)
        x = np.column_stack([table[v].to_numpy() for v in names])
        if (bad := np.isnan(x).any(axis=0)).any():
            where = {k: table[k][0].as_py() for k in keys}
            raise ValueError(f"null or NaN in {[v for v, b in zip(names, bad) if b]} of panel {where}: fill or drop it first")
        halo = int((at // chunk_rows < table["_chunk"][0].as_py()).sum())
        z, at = _lagged_matrix(x, halo, depth), at[halo:]
        out = {c: [] for c in (*order_key, *types)}
        done = {}
        for p in orders if len(z) else []:
            skip = min(len(z), max(0, p - halo)) if drop else 0
            if skip not in done:
                done[skip] = _stats(z[skip:], last * (depth + 1))
            n, mean, g = done[skip]
            for c, v in zip(out, (p, n, len(z), at[0], at[-1], mean, g)):
                out[c].append(v)
        return _rows(table, [*keys, "_super"], out, order_key | types)

    def merge(group, whole=False):
        def run(table: pa.Table) -> pa.Table:
            n, mean, g = _merged(table["n"].to_numpy(), _matrix(table, "means"), _matrix(table, "g"))
            rows, lo, hi = int(table["n_rows"].to_numpy().sum()), table["lo"].to_numpy().min(), table["hi"].to_numpy().max()
            if whole and rows != hi - lo + 1:
                raise ValueError(_GAP)
            return _rows(table, group, {"n": [n], "n_rows": [rows], "lo": [lo], "hi": [hi], "means": [mean], "g": [g]}, types)

        return run

    key_ddl = "".join(f"`{k}` {panel.schema[k].dataType.simpleString()}, " for k in keys)
    stat_ddl = "p int, n long, n_rows long, lo long, hi long, means array<double>, g array<double>"
    quoted = [f"`{k}`" for k in keys]
    rows = panel.selectExpr(*quoted, f"cast(`{idx}` as long) as _idx", *[f"cast(`{v}` as double) as `{v}`" for v in names])
    chunked = with_halo(rows, depth, "_idx", chunk_rows).selectExpr("*", f"cast(floor(_chunk / {_MERGE}) as long) as _super")
    parts = _per_group(chunked, [*keys, "_super", "_chunk"], ["_idx"], chunk_stats, f"{key_ddl}_super long, {stat_ddl}")
    level1, level2 = [*keys, "_super", "p"], [*keys, "p"]
    parts = _per_group(parts, level1, [], merge(level1), f"{key_ddl}_super long, {stat_ddl}")
    total = _per_group(parts, level2, [], merge(level2, True), f"{key_ddl}{stat_ddl}")
    cols = text_array(moment_columns(names, depth))
    return total.selectExpr(*quoted, "p", "n", "n_rows", f"{cols} as cols", "means", "g")


def bordered_moments(stored: DataFrame, panel: DataFrame, old: Sequence[str], new: Sequence[str], maxlag: int, keys: Sequence[str] = (),
                     fill: float | None = None, lags: Sequence[int] | None = None, idx: str = "idx",
                     chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The moment table of ``[*old, *new]``, from a stored one of ``old`` and one pass that forms only products with ``new``.

    ``stored`` must come from the same rows, lag orders and fill; panels or orders that only one side has, other counts of rows or
    other means of the old variables raise.
    """
    border = _moments(panel, [*old, *new], maxlag, keys, fill, lags, idx, chunk_rows, len(new))
    before, b = len(old) * (maxlag + 1), len(new) * (maxlag + 1)
    q = before + b
    names = [*keys, "p"]
    s = stored.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)], F.struct("n", "n_rows", "cols", "means", "g").alias("_s"))
    on = [F.col(f"_{i}").eqNullSafe(border[c]) for i, c in enumerate(names)]
    both = border.select("*", F.struct("n", "n_rows").alias("_b")).join(s, on, "full")
    same = ("_s.n <=> _b.n and _s.n_rows <=> _b.n_rows and _s.cols <=> slice(cols, 1, {0}) and "
            "forall(zip_with(_s.means, slice(means, 1, {0}), (x, y) -> abs(x - y) <= 1e-9 * (1 + abs(x))), ok -> ok)").format(before)
    whole = (f"flatten(concat(transform(sequence(0, {before - 1}), i -> concat(slice(_s.g, i * {before} + 1, {before}), "
             f"transform(sequence(0, {b - 1}), j -> g[j * {q} + i]))), transform(sequence(0, {b - 1}), j -> slice(g, j * {q} + 1, {q}))))")
    fault = "the stored moments belong to other rows, lags or variables"
    return both.select(*[F.col(f"`{c}`") for c in names], "n", "n_rows", "cols", "means",
                       F.expr(f"case when {same} then {whole} else raise_error('{fault}') end").alias("g"))
