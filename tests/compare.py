"""Run a query and its SQL side by side and compare rows as the driver does (columns by name, rows unordered)."""

from __future__ import annotations

import math
from pathlib import Path


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(cell(v) for v in row) for row in pdf.itertuples(index=False)), key=repr)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view \"{path.stem}\" as select * from '{path}'")
    return con


def difference(spark, con, fn, sql: str, sf_dir: str):
    """None when equal, else a short text; also the number of rows."""
    ours, theirs = fn(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}", len(ours)
    a, b = rows_of(ours), rows_of(theirs)
    if a == b:
        kinds = {c: (str(ours[c].dtype), str(theirs[c].dtype)) for c in ours.columns if ours[c].dtype != theirs[c].dtype}
        return (f"types {kinds}" if kinds else None), len(a)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", len(a)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}", len(a)
