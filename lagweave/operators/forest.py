"""Trees of boosting chains without a copied row: one pass over packed chunks a round, whole trees grown from sums by cell.

A row's lags of one variable, as bins, are a cell. Count, sum and sum of squares of a tree's labels by cell are all that growing the
tree asks for, so a round is one pass over the rows, one aggregation and one small task a tree, however deep. Labels are never stored: each pass
replays them from the trees of the rounds before, which one row a tree keeps (`STATE`), written and read again. An increment
therefore grows what is new and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import CHUNK_ROWS, lag_name, null_safe_join
from .staging import saved

#: Cells of a tree at most: what one task grows a tree from. Beyond it the level-wise path takes over.
MOST_CELLS = 40_000
#: One row a panel and tree. The last name of `prefix` is the variable whose lags the tree splits; the first is the effect.
STATE = "round int, prefix array<string>, splits binary, gains array<double>, n long, mse double, var double"
_SPLIT = np.dtype([("node", "<i4"), ("feature", "<i2"), ("bin", "<i2"), ("left", "<f8"), ("right", "<f8")])


def fits(maxlag: int, max_bins: int) -> bool:
    return max_bins ** maxlag <= MOST_CELLS


def _key_fields(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def packed_chunks(lagged: DataFrame, thresholds: DataFrame, variables: Sequence[str], maxlag: int, keys: Sequence[str] = (), idx: str = "idx",
                  also: Sequence[str] = ()) -> DataFrame:
    """One row per panel and chunk of positions: their bins, values and positions as arrays in binary, and the panel's centres.

    `thresholds` has one row a panel with an array of cuts for each variable and lag, in that order; `also` are further labels. A centre is a value near the variable's
    middle that labels are counted from, so that squares don't lose the digits of small deviations.
    """
    names, labels = [lag_name(v, lag) for v in variables for lag in range(1, maxlag + 1)], list(dict.fromkeys([*variables, *also]))
    rows = null_safe_join(lagged.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{idx}`").cast("long").alias("_idx"), *[F.col(f"`{c}`").cast("double") for c in [*names, *labels]]), thresholds.select(*keys, "thresholds"), keys)
    bins = [F.expr(f"cast(size(filter(thresholds[{i}], t -> t < `{c}`)) as short)").alias(f"_b{i}") for i, c in enumerate(names)]
    at = [f"thresholds[{i * maxlag}]" for i in range(len(variables))]
    centres = F.expr(f"array({', '.join(f'coalesce(get({x}, cast(size({x}) / 2 as int)), 0D)' for x in at)})")
    rows = rows.select(*[F.col(f"`{k}`") for k in keys], F.expr(f"cast(floor(_idx / {CHUNK_ROWS}) as long)").alias("_chunk"), "_idx", *bins, *[F.col(f"`{v}`") for v in labels], centres.alias("_centres"))
    wide, k = len(names), len(keys)

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(table["_idx"].to_numpy(), kind="stable")
        column = [table.column(k + 2 + i).to_numpy()[order] for i in range(wide + len(labels))]
        if any(np.isnan(x).any() for x in column[wide:]):
            raise ValueError("a variable of the panel is null")
        out = {"centres": pa.array([table["_centres"][0].as_py()], pa.list_(pa.float64())), "positions": [table["_idx"].to_numpy()[order].tobytes()],
               "bins": [np.stack(column[:wide]).astype("<i2").tobytes()], "values": [np.stack(column[wide:]).astype("<f8").tobytes()]}
        return pa.table([*[table.column(i).slice(0, 1) for i in range(k)], *[pa.array(x, pa.binary()) if isinstance(x, list) else x for x in out.values()]],
                        names=[*keys, *out])

    packed = rows.groupBy(*[F.col(f"`{x}`") for x in keys], "_chunk").applyInArrow(pack, _key_fields(lagged, keys) + "centres array<double>, positions binary, bins binary, values binary")
    return saved(packed, "chunks")


class Chunk:
    """One packed chunk in a task: cells by variable, and the labels of a chain's rounds."""

    def __init__(self, variables: Sequence[str], labels: Sequence[str], maxlag: int, max_bins: int, centres: list[float], positions: bytes, bins: bytes, values: bytes):
        self.names, self.labels, self.base = list(variables), list(labels), max_bins
        self.positions = np.frombuffer(positions, "<i8")
        n = len(self.positions)
        self.bins = np.frombuffer(bins, "<i2").reshape(len(variables), maxlag, n)
        self.values = np.frombuffer(values, "<f8").reshape(len(labels), n)
        self.centres = dict(zip(variables, centres, strict=True))
        self.seen: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def cells(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The variable's cells in use, the cell of each row, and the rows of each cell."""
        if name not in self.seen:
            code = np.zeros(len(self.positions), np.int64)
            for lag in self.bins[self.names.index(name)]:
                code = code * self.base + lag
            used, at = np.unique(code, return_inverse=True)
            self.seen[name] = used, at, np.bincount(at, minlength=len(used))
        return self.seen[name]

    def label(self, effect: str) -> np.ndarray:
        return self.values[self.labels.index(effect)] - self.centres.get(effect, 0.0)

    def predicted(self, name: str, splits: np.ndarray) -> np.ndarray:
        used, at, _ = self.cells(name)
        return leaves(used, self.bins.shape[1], self.base, splits)[at]


def unpacked(cells: np.ndarray, maxlag: int, base: int) -> np.ndarray:
    """[lag, cell]: the bins that a cell stands for."""
    out = np.empty((maxlag, len(cells)), np.int64)
    for i in range(maxlag - 1, -1, -1):
        out[i], cells = cells % base, cells // base
    return out


def leaves(cells: np.ndarray, maxlag: int, base: int, splits: np.ndarray) -> np.ndarray:
    """What a tree predicts for each cell. Its first split row is the root's mean (feature -1), then parents before their children."""
    bins = unpacked(cells, maxlag, base)
    node, out = np.ones(len(cells), np.int64), np.full(len(cells), splits["left"][0])
    for s in splits[1:]:
        here = np.flatnonzero(node == s["node"])
        right = bins[s["feature"], here] > s["bin"]
        node[here] = 2 * s["node"] + right
        out[here] = np.where(right, s["right"], s["left"])
    return out


def grown(cells: np.ndarray, c: np.ndarray, t: np.ndarray, q: np.ndarray, maxlag: int, base: int, depth: int, min_leaf: int):
    """A tree from count, sum and sum of squares by cell: (splits, gain by lag, rows, squared error a row, variance).

    Gains are compared as shares of the node's own spread, to nine digits; equal ones go to the lowest lag, then the lowest bin.
    """
    bins, n = unpacked(cells, maxlag, base), c.sum()
    node, pred = np.ones(len(cells), np.int64), np.full(len(cells), t.sum() / n)
    splits, gains, active = [(1, -1, 0, t.sum() / n, t.sum() / n)], np.zeros(maxlag), [1]
    for _ in range(depth):
        following = []
        for at in active:
            here = np.flatnonzero(node == at)
            rows, total, squares = c[here].sum(), t[here].sum(), q[here].sum()
            spread = squares - total * total / rows
            if not spread > 1e-12 * squares:
                continue
            best = (0.0, 0, 0)
            for lag in range(maxlag):
                bin_ = bins[lag, here]
                nl = np.cumsum(np.bincount(bin_, c[here], base))
                tl = np.cumsum(np.bincount(bin_, t[here], base))
                nr = rows - nl
                fit = (nl >= min_leaf) & (nr >= min_leaf) & (nl > 0) & (nr > 0)
                if not fit.any():
                    continue
                nl, tl, nr, place = nl[fit], tl[fit], nr[fit], np.flatnonzero(fit)
                raw = nl * nr / rows * (tl / nl - (total - tl) / nr) ** 2
                share = np.round(raw / spread, 9)
                k = int(share.argmax())
                if share[k] > best[0]:
                    best = (share[k], lag, int(place[k]), raw[k], tl[k] / nl[k], (total - tl[k]) / nr[k])
            if len(best) == 3:
                continue
            _, lag, cut, gain, low, high = best
            right = bins[lag, here] > cut
            node[here] = 2 * at + right
            pred[here] = np.where(right, high, low)
            splits.append((at, lag, cut, low, high))
            gains[lag] += gain
            following += [2 * at, 2 * at + 1]
        active = following
    mse = max(0.0, float((q - 2 * pred * t + c * pred * pred).sum() / n))
    return np.array(splits, _SPLIT), gains, int(n), mse, max(0.0, float(q.sum() / n - (t.sum() / n) ** 2))


def grow_round(chunks: DataFrame, state: DataFrame | None, wanted: Sequence[Sequence[str]], variables: Sequence[str], maxlag: int, max_bins: int,
               shrinks: Sequence[float], depth: int, min_leaf: int, keys: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """The trees of one round, one row a panel and prefix (`STATE`), saved. `state` holds those of the rounds before.

    `wanted` are prefixes of equal length; `shrinks` says, for each round before, how much of its prediction its label loses. A chain's labels are replayed
    depth first, so a task holds one label for each round, not one for each tree. A chain begins with its first name's own value, or with `label`, if one is given.
    """
    places = {tuple(p): i for i, p in enumerate(wanted)}
    below: dict = {}
    for p in places:
        at = below
        for name in p:
            at = at.setdefault(name, {})
    names, k, length = list(variables), len(keys), len(wanted[0])
    labels = list(dict.fromkeys([*names, *([label] if label else [])]))
    rows = chunks
    if length > 1:
        needed = [p[:j] for p in places for j in range(1, length)]
        texts = sorted({"\x1f".join(p) for p in needed})
        models = state.where(F.array_join("prefix", "\x1f").isin(texts)).groupBy(*[F.col(f"`{x}`") for x in keys]).agg(F.collect_list(F.struct("prefix", "splits")).alias("trees"))
        rows = null_safe_join(chunks, models, keys)

    def sums(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i].as_py() for x in batch.schema.names[k:]}
                chunk = Chunk(names, labels, maxlag, max_bins, row["centres"], row["positions"], row["bins"], row["values"])
                trees = {tuple(t["prefix"]): np.frombuffer(t["splits"], _SPLIT) for t in row.get("trees") or []}

                def walk(at: dict, prefix: tuple, now: np.ndarray):
                    for name, more in at.items():
                        here = (*prefix, name)
                        own = now if prefix else chunk.label(label or name)
                        if len(here) < length:
                            yield from walk(more, here, own - shrinks[len(here) - 1] * chunk.predicted(name, trees[here]) if shrinks[len(here) - 1] else own)
                        else:
                            used, of, count = chunk.cells(name)
                            yield places[here], used, count, np.bincount(of, own, len(used)), np.bincount(of, own * own, len(used))

                for place, used, count, t, q in walk(below, (), np.zeros(0)):
                    own = [batch.column(x).take(pa.array(np.full(len(used), i))) for x in range(k)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(used), place, np.int32)), pa.array(used), pa.array(count.astype(np.int64)), pa.array(t), pa.array(q)],
                                                     names=[*keys, "tree", "cell", "c", "t", "q"])

    fields = _key_fields(chunks, keys)
    by = [F.col(f"`{x}`") for x in keys]
    cells = rows.mapInArrow(sums, fields + "tree int, cell long, c long, t double, q double")
    cells = cells.groupBy(*by, "tree", "cell").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.sum("q").alias("q"))
    listed = [list(p) for p in wanted]

    def grow(table: pa.Table) -> pa.Table:
        cell, c, t, q = (table[x].to_numpy() for x in ("cell", "c", "t", "q"))
        order = np.argsort(cell)
        splits, gains, n, mse, var = grown(cell[order], c[order].astype(float), t[order], q[order], maxlag, max_bins, depth, min_leaf)
        own = [table.column(x).slice(0, 1) for x in range(k)]
        return pa.table([*own, pa.array([length], pa.int32()), pa.array([listed[table["tree"][0].as_py()]], pa.list_(pa.string())), pa.array([splits.tobytes()], pa.binary()),
                         pa.array([gains.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64()), pa.array([mse]), pa.array([var])],
                        names=[*keys, "round", "prefix", "splits", "gains", "n", "mse", "var"])

    return saved(cells.groupBy(*by, "tree").applyInArrow(grow, fields + STATE), "trees")


def grow_chains(chunks: DataFrame, orders: Sequence[Sequence[str]], variables: Sequence[str], maxlag: int, max_bins: int, v: float, depth: int, min_leaf: int,
                keys: Sequence[str] = (), state: DataFrame | None = None, known: Sequence[Sequence[str]] = ()) -> DataFrame:
    """The trees of all prefixes of the orders, with those of `state`. Prefixes in `known` are in the state already and are not grown again."""
    had = {tuple(p) for p in known}
    for j in range(1, len(orders[0]) + 1):
        wanted = [p for p in dict.fromkeys(tuple(o[:j]) for o in orders) if p not in had]
        if wanted:
            new = grow_round(chunks, state, wanted, variables, maxlag, max_bins, [1.0, *[v] * (j - 2)][:j - 1], depth, min_leaf, keys)
            state = new if state is None else state.unionByName(new)
    return state


def predicted_rows(chunks: DataFrame, state: DataFrame, label: str, variable: str, maxlag: int, max_bins: int, keys: Sequence[str] = (), idx: str = "idx") -> DataFrame:
    """Position, label, prediction and residual of every row, for the first-round tree of `label` on the lags of `variable`."""
    models = state.where("round = 1").select(*[F.col(f"`{x}`") for x in keys], "splits")
    rows, k, labels = null_safe_join(chunks, models, keys), len(keys), list(dict.fromkeys([variable, label]))

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i].as_py() for x in batch.schema.names[k:]}
                chunk = Chunk([variable], labels, maxlag, max_bins, row["centres"], row["positions"], row["bins"], row["values"])
                centre = chunk.centres.get(label, 0.0)
                own, found = chunk.label(label) + centre, chunk.predicted(variable, np.frombuffer(row["splits"], _SPLIT)) + centre
                yield pa.RecordBatch.from_arrays([*[batch.column(x).take(pa.array(np.full(len(own), i))) for x in range(k)],
                                                  pa.array(chunk.positions), pa.array(own), pa.array(found), pa.array(own - found)], names=[*keys, idx, "label", "prediction", "residual"])

    return rows.mapInArrow(read, _key_fields(chunks, keys) + f"`{idx}` long, label double, prediction double, residual double")


def write_state(state: DataFrame, thresholds: DataFrame, variables: Sequence[str], maxlag: int, max_bins: int, path: str) -> None:
    """Keep the trees and the cuts of their bins: what an increment starts from. A folder that exists raises."""
    state.write.parquet(f"{path}/trees")
    made = [F.array(*map(F.lit, variables)).alias("variables"), F.lit(int(maxlag)).alias("maxlag"), F.lit(int(max_bins)).alias("max_bins")]
    thresholds.select("*", *made).write.parquet(f"{path}/thresholds")


def read_state(spark: SparkSession, path: str, variables: Sequence[str], maxlag: int, max_bins: int) -> tuple[DataFrame, DataFrame]:
    """Trees and thresholds as written; raises if they were made for other variables, lags or bins."""
    state, thresholds = spark.read.parquet(f"{path}/trees"), spark.read.parquet(f"{path}/thresholds")
    for row in thresholds.select("variables", "maxlag", "max_bins").distinct().collect():
        if (list(row[0]), row[1], row[2]) != (list(variables), maxlag, max_bins):
            raise ValueError(f"the state was made for {list(row[0])} with {row[1]} lags and {row[2]} bins")
    return state, thresholds.drop("variables", "maxlag", "max_bins")
