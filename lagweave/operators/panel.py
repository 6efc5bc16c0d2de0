"""Panels: one row per time step (and panel key), one double column per variable.

No window here spans a whole panel. Positions are counted within value-range
buckets of the time column, and lags are taken within chunks of consecutive
positions that carry a short halo of the previous chunk, so one very long panel
spreads over the cluster like many short ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65536
SALTS = 64
_GAP = "panel positions are not consecutive: densify or index the panel first"

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def lag_name(variable: str, lag: int) -> str:
    return variable if lag == 0 else f"{variable}__lag{lag}"


def lag_names(variable: str, maxlag: int) -> list[str]:
    return [lag_name(variable, lag) for lag in range(1, maxlag + 1)]


def feature_array(variable: str, maxlag: int) -> Column:
    """One variable's lags 1..maxlag as a feature array."""
    return F.array(*lag_names(variable, maxlag))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _step_seconds(step: str) -> int:
    count, unit = step.split() if " " in step else ("1", step)
    return int(count) * _UNIT_SECONDS[unit.rstrip("s")]


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _seconds(kind: str, name: str, step: int = 1) -> str:
    """Whole seconds since 1970, down to the units ``step`` needs.

    A zone-less time is counted on its own clock, whatever the session zone.
    """
    if kind == "timestamp":
        return f"unix_seconds(`{name}`)"
    parts = [f"unix_date(cast(`{name}` as date)) * 86400L"]
    if kind != "date":
        units = [f"hour(`{name}`) * 3600", f"minute(`{name}`) * 60", f"second(`{name}`)"]
        parts += units[: _finest(step)]
    return " + ".join(parts)


def _finest(step: int) -> int:
    """How many of hour, minute, second matter for a step."""
    return 0 if step % 86400 == 0 else 1 if step % 3600 == 0 else 2 if step % 60 == 0 else 3


def _micros(kind: str, name: str) -> str:
    if kind == "timestamp":
        return f"unix_micros(`{name}`)"
    return f"timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', cast(`{name}` as timestamp_ntz))"


def _from_seconds(kind: str, seconds: str) -> str:
    if kind == "timestamp":
        return f"timestamp_seconds({seconds})"
    return f"cast(timestampadd(second, {seconds}, timestamp_ntz'1970-01-01 00:00:00') as {kind})"


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{c}`" for c in names]


def null_safe_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", also: Sequence[str] = ()) -> DataFrame:
    """Equality join on ``keys`` in which null is a value like any other, as in GROUP BY, and on ``also``, where it matches nothing."""
    on = [*keys, *also]
    other = table.withColumnsRenamed({c: f"_on_{c}" for c in on})
    match = [rows[c].eqNullSafe(other[f"_on_{c}"]) for c in keys] + [rows[c] == other[f"_on_{c}"] for c in also]
    if not match:
        return rows.withColumn("_one", F.lit(1)).join(table.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
    return rows.join(other, reduce(lambda x, y: x & y, match), how).drop(*[f"_on_{c}" for c in on])


def attach_by_panel(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a table with one row per panel to the panel's rows.

    A small table is broadcast, by its measured size; beyond it, AQE splits the partitions of a panel that holds most rows.
    """
    return null_safe_join(rows, table, keys)


def discover_variables(df: DataFrame, column: str) -> list[str]:
    """The distinct values of the variable column of a long table, in order; as many as the panel will have columns."""
    return sorted(r[0] for r in df.select(F.col(column).cast("string").alias("v")).distinct().collect() if r[0] is not None)


def assemble_panel(series: Mapping[str, DataFrame], time_col: str, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Put single-variable series side by side; a step missing from a series is null."""
    parts = [
        df.select(*keys, time_col, F.lit(name).alias("_variable"), F.col(value).cast("double").alias("_value"))
        for name, df in series.items()
    ]
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy(*keys, time_col).agg(
        *[F.first(F.when(F.col("_variable") == v, F.col("_value")), ignorenulls=True).alias(v) for v in series]
    )


def long_panel(df: DataFrame, time_col: str, step: str, variable: Column, variables: Mapping[str, str] | Sequence[str],
               value: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Sum a long table (one row per observation) into a wide panel, one row per ``step`` ("1 hour", "1 day", …) with column ``t``.

    ``variables`` maps column names to values of ``variable``; without ``value``
    the observations are counted. Sums are combined before the shuffle, so a hot
    key or time step costs one row per map task.
    """
    names = variables if isinstance(variables, Mapping) else {v: v for v in variables}
    kind, seconds = _kind(df, time_col), _step_seconds(step)
    amount = F.lit(1.0) if value is None else value.cast("double")
    at = F.expr(f"cast(floor(({_seconds(kind, time_col, seconds)}) / {seconds}) as long)")
    rows = df.where(F.col(time_col).isNotNull()).select(*keys, at.alias("_step"), variable.alias("_variable"), amount.alias("_value"))
    sums = rows.groupBy(*keys, "_step").agg(
        *[F.coalesce(F.sum(F.when(F.col("_variable") == v, F.col("_value"))), F.lit(0.0)).alias(name) for name, v in names.items()]
    )
    # A time that cannot be null spares the scan a null check of this expression.
    start = f"coalesce({_from_seconds(kind, f'_step * {seconds}')}, cast(timestamp_ntz'1970-01-01 00:00:00' as {kind}))"
    return sums.selectExpr(*_quoted(keys), f"{start} as t", *_quoted(names))


def densify(panel: DataFrame, time_col: str, step: str, keys: Sequence[str] = (), fill: float | None = 0.0,
            chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Fill gaps to a regular grid from each panel's first to last step and add ``idx``.

    The grid is generated in chunks, one task slot per chunk rather than per
    panel. A null key is a panel of its own. A row without a time, or with one that lies between two steps of its panel, raises.
    """
    seconds, kind, k = _step_seconds(step), _kind(panel, time_col), _quoted(keys)
    values = [c for c in panel.columns if c not in (*keys, time_col)]
    # Free of nulls, so that the join below adds no null check to one use of the panel only.
    missing = f"cast(raise_error('a row of the panel has no {time_col}') as bigint)"
    at = panel.selectExpr(*k, f"coalesce({_seconds(kind, time_col)}, {missing}, 0L) as _at", *_quoted(values))
    # The bounds drag the values along so that both uses of the panel share one shuffle, and its input is scanned once.
    whole = f"struct(_at, {', '.join(_quoted(values))})" if values else "struct(_at)"
    off = f"pmod(_at, {seconds})"
    bounds = at.groupBy(*keys).agg(F.expr(f"min({whole})._at as _lo"), F.expr(f"max({whole})._at as _hi"), F.expr(f"min({off}) <> max({off}) as _off"))
    bounds = bounds.where("_lo is not null").selectExpr(*k, f"case when _off then cast(raise_error('a time lies off the grid of {step}') as bigint) else _lo end as _lo", "_hi")
    chunks = bounds.selectExpr(*k, "_lo", f"cast(floor((_hi - _lo) / {seconds}) as long) + 1 as _n").selectExpr(
        *k, "_lo", "_n", f"explode(sequence(0L, cast(floor((_n - 1) / {chunk_rows}) as long))) as _chunk")
    chunks = chunks.repartition(shuffle_partitions(panel), *keys, "_chunk")
    last = f"least((_chunk + 1) * {chunk_rows}, _n) - 1"
    grid = chunks.selectExpr(*k, "_lo", f"explode(sequence(_chunk * {chunk_rows}, {last})) as idx").selectExpr(
        *k, f"_lo + idx * {seconds} as _at", "idx")
    joined = null_safe_join(grid, at, keys, "left", ["_at"])
    filled = [f"`{v}`" if fill is None else f"coalesce(`{v}`, {float(fill)}D) as `{v}`" for v in values]
    return beginning_at(joined.selectExpr(*k, f"{_from_seconds(kind, '_at')} as `{time_col}`", "idx", *filled), 0)


#: Rows of all panels together that one bucket of the row index is planned to hold.
BUCKET_ROWS = 2_000_000


def with_index(df: DataFrame, time_col: str, keys: Sequence[str] = (), idx: str = "idx", buckets: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Number each panel's rows 0, 1, … in time order, those of equal time in the order of ``ties``.

    Two rows of a panel that agree in all of these have no order, and raise.

    Rows are cut into buckets of about equal size at quantiles of the time
    column (collected once: at most ``buckets`` numbers, so every evaluation
    sees the same cut), ranked within (panel, bucket), and shifted by the rows
    of the earlier buckets. No task holds more than one bucket of a panel.
    ``buckets`` defaults to one for each BUCKET_ROWS rows, counted first, and at least the session's shuffle partitions.
    """
    count = buckets or max(shuffle_partitions(df), df.count() // BUCKET_ROWS)
    kind, k = _kind(df, time_col), _quoted(keys)
    at = _micros(kind, time_col) if kind.startswith(("timestamp", "date")) else f"`{time_col}`"
    rows = df.selectExpr("*", f"cast({at} as double) as _at")
    cuts = rows.approxQuantile("_at", [i / count for i in range(1, count)], 0.1 / count) if count > 1 else []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(rows)
    else:
        rows = rows.withColumn("_bucket", F.lit(0.0))
    by_panel = f"partition by {', '.join(k)} " if k else ""
    before = f"{by_panel}order by _bucket rows between unbounded preceding and 1 preceding"
    offsets = rows.groupBy(*keys, "_bucket").agg(F.expr("count(1) as _rows")).selectExpr(
        *k, "_bucket", f"coalesce(sum(_rows) over ({before}), 0) as _offset")
    within = ", ".join([*k, "_bucket"])
    order = ", ".join(_quoted([time_col, *ties]))
    over = f"over (partition by {within} order by {order})"
    ranked = rows.selectExpr("*", f"row_number() {over} as _rank", f"lag(struct({order})) {over} <=> struct({order}) as _tie")
    at = f"case when _tie then cast(raise_error('rows of equal {time_col}: name columns that order them') as bigint) else cast(_offset + _rank - 1 as long) end as `{idx}`"
    return beginning_at(null_safe_join(ranked, offsets, keys, also=["_bucket"]).selectExpr(*_quoted(df.columns), at), 0, idx)


def with_calendar(df: DataFrame, start: str, freq: str, idx: str = "idx", name: str = "date") -> DataFrame:
    """Attach a calendar date to each position: month ends (``M``) or days (``D``) from ``start``."""
    first, at = F.to_date(F.lit(start)), F.col(idx).cast("int")
    if freq == "M":
        return df.withColumn(name, F.last_day(F.add_months(first, at)))
    if freq == "D":
        return df.withColumn(name, F.date_add(first, at))
    raise ValueError(f"freq must be 'M' or 'D', not {freq!r}")


def panel_shape(df: DataFrame, keys: Sequence[str] = (), not_variables: Sequence[str] = ("t", "idx")) -> DataFrame:
    """Row count n and variable count k, per panel."""
    k = len([c for c in df.columns if c not in (*keys, *not_variables)])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.lit(k).alias("k"))


def with_halo(df: DataFrame, width: int, idx: str = "idx", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk``, repeating the last ``width`` rows of each chunk in the next one."""
    if width > chunk_rows:
        raise ValueError("chunk_rows must be at least the largest lag")
    own = f"cast(floor(`{idx}` / {chunk_rows}) as long)"
    tail = f"`{idx}` - {own} * {chunk_rows} >= {chunk_rows - width}"
    return df.selectExpr("*", f"explode(case when {tail} then array({own}, {own} + 1) else array({own}) end) as _chunk")


def lag_panel(df: DataFrame, variables: Sequence[str], maxlag: int, keys: Sequence[str] = (), fill: float | None = None,
              idx: str = "idx", lags: Sequence[int] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``<var>__lag<L>`` for L in 1..maxlag (or ``lags``).

    A lag is the row so many positions before. ``fill=None`` drops the rows that
    have fewer than the deepest lag's rows before them, so nulls of the data stay visible; a number keeps all rows and fills with
    it. Any gap between positions raises. Where `densify`, `with_index` or `slice_panel` made the positions, the column says at which one
    panels begin, and the check needs no second pass: in later chunks every first row has one before it. Other panels may begin
    anywhere; their rows are counted against their first and last position.
    """
    wanted = list(lags or range(1, maxlag + 1))
    depth = max(wanted)
    over = f"over (partition by {', '.join([*_quoted(keys), '_chunk'])} order by `{idx}`)"
    default = "null" if fill is None else f"{float(fill)}D"
    feats = [f"lag(`{v}`, {lag}, {default}) {over} as `{lag_name(v, lag)}`" for v in variables for lag in wanted]
    begins = first_position(df, idx)
    if begins is None:
        full = df.groupBy(*keys).agg(F.expr(f"count(1) = max(`{idx}`) - min(`{idx}`) + 1 as _full"))
        df = attach_by_panel(df, full, keys)
    rows = with_halo(df, depth, idx, chunk_rows).selectExpr("*", f"lag(`{idx}`, 1) {over} as _before", f"lag(`{idx}`, {depth}) {over} as _deepest", *feats)
    own = f"_chunk = floor(`{idx}` / {chunk_rows})"
    gap = f"_before <> `{idx}` - 1 or " + ("not _full" if begins is None else f"_before is null and _chunk > floor({begins} / {chunk_rows}) and {own}")
    rows = rows.where(f"case when {gap} then cast(raise_error('{_GAP}') as boolean) else {own} end")
    return (rows.where("_deepest is not null") if fill is None else rows).drop("_chunk", "_before", "_deepest", "_full")


_FIRST = "lagweave.first"


def beginning_at(df: DataFrame, first: int, idx: str = "idx") -> DataFrame:
    """Note on the position column that panels begin at ``first`` or within its chunk. Selections keep the note."""
    return df.withMetadata(idx, {_FIRST: int(first)})


def first_position(df: DataFrame, idx: str = "idx") -> int | None:
    return df.schema[idx].metadata.get(_FIRST)


def slice_panel(df: DataFrame, lo: int | None = None, hi: int | None = None, idx: str = "idx") -> DataFrame:
    """Rows at positions lo..hi, both included."""
    if lo is not None:
        begins = first_position(df, idx)
        df = df.where(F.col(idx) >= lo)
        df = df if begins is None else beginning_at(df, max(lo, begins), idx)
    return df if hi is None else df.where(F.col(idx) <= hi)


def last_rows(df: DataFrame, p: int, keys: Sequence[str] = (), idx: str = "idx") -> DataFrame:
    """The rows at the last p positions of each panel; where positions have gaps, these may be fewer than p rows.

    Each task passes on the p last rows of a panel that it has (up to Spark's limit for that, 1000 unless set), whatever the panel's length.
    """
    panel = Window.partitionBy(*keys)
    late = df.withColumn("_rank", F.rank().over(panel.orderBy(F.col(idx).desc_nulls_last()))).where(F.col("_rank") <= p)
    return late.withColumn("_last", F.max(idx).over(panel)).where(F.col(idx) > F.col("_last") - p).select(*df.columns)


def running_min(edges: DataFrame, keys: Sequence[str] = (), lag: str = "lag", p: str = "p_value") -> DataFrame:
    """Walking each pair's lags upwards, keep rows whose p is a new strict minimum (below 1)."""
    before = (
        Window.partitionBy(*keys, "effect", "cause").orderBy(lag).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        edges.withColumn("_best", F.coalesce(F.min(p).over(before), F.lit(1.0)))
        .where(F.col(p) < F.col("_best")).drop("_best")
    )


_E = "exp(-{v} * {v} / 2)"

# Coefficients of the three known-graph models.
_MODELS = {
    "linear": {
        "s1": "0.95 * sqrt(2D) * s1__lag1 - 0.90 * s1__lag2",
        "s2": "0.5 * s2__lag2",
        "s3": "-0.5 * s1__lag1 + 0.25 * sqrt(2D) * s3__lag1 + 0.25 * sqrt(2D) * s2__lag1",
        "s4": "0.95 * s4__lag1 - 0.25 * sqrt(2D) * s3__lag1",
    },
    "nonlinear": {
        "s1": f"0.125 * sqrt(2D) * {_E.format(v='s1__lag1')}",
        "s2": f"1.2 * {_E.format(v='s1__lag1')}",
        "s3": f"-1.05 * {_E.format(v='s1__lag1')}",
        "s4": f"-1.15 * {_E.format(v='s1__lag1')} + 0.2 * sqrt(2D) * {_E.format(v='s4__lag1')}"
              f" + 1.35 * {_E.format(v='s3__lag1')}",
    },
}
_MODELS["nonlinear2"] = _MODELS["nonlinear"] | {
    "s2": f"case when s1__lag1 > 0 then 1.2 * {_E.format(v='s1__lag1')} else -2 * exp(-s1__lag1 * s1__lag1) end"
}


def structural_mean(df: DataFrame, model: str, keys: Sequence[str] = (), idx: str = "idx") -> DataFrame:
    """One-step mean ``mean_s*`` of a known-graph model on observed lags, and innovation ``eps_s*``.

    The panel has variables s1..s4; the first two positions have no full lag set and are dropped.
    """
    if model not in _MODELS:
        raise ValueError(f"unknown model {model!r}")
    names = list(_MODELS[model])
    lagged = lag_panel(df, names, 2, keys, idx=idx)
    out = lagged.select("*", *[F.expr(e).alias(f"mean_{s}") for s, e in _MODELS[model].items()])
    return out.select(
        *df.columns, *[f"mean_{s}" for s in names], *[(F.col(s) - F.col(f"mean_{s}")).alias(f"eps_{s}") for s in names]
    )
