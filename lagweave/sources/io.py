"""CSV panels in, edge lists and numeric matrices out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_panel(spark: SparkSession, path: str, time_col: str | None = None, names: Sequence[str] | None = None,
               skip_rows: int = 0, schema: str | None = None) -> DataFrame:
    """Read a CSV panel.

    With a header, types are inferred unless ``schema`` (DDL) is given; with
    ``names`` the columns are doubles under those names, and ``skip_rows=1``
    discards one header line. ``time_col`` must be one of the columns.
    """
    if names is not None:
        if skip_rows not in (0, 1):
            raise ValueError("skip_rows must be 0 or 1")
        kinds = T.StructType([T.StructField(c, T.DoubleType() if c != time_col else T.LongType()) for c in names])
        df = spark.read.schema(kinds).csv(path, header=bool(skip_rows), enforceSchema=True)
    elif schema is not None:
        df = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    else:
        df = spark.read.csv(path, header=True, inferSchema=True)
    if time_col is not None and time_col not in df.columns:
        raise ValueError(f"no column {time_col!r} in {path}")
    return df


def write_edges(df: DataFrame, path: str, fmt: str = "csv", header: bool = True, sort_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write an edge table; array columns are joined for CSV, rows sorted when asked."""
    if fmt == "csv":
        df = df.select(*[F.array_join(f.name, ",").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
                         for f in df.schema.fields])
    if sort_by:
        df = df.orderBy(*sort_by)
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", header) if fmt == "csv" else writer).save(path)


def store_edges(df: DataFrame, path: str, by: str = "source") -> None:
    """Keep an edge table as Parquet in folders by ``by``; a rerun replaces the folders it has rows for and leaves the others.

    Rows of one folder come from several tasks. Nulls in ``by`` have a folder of their own; a table without rows changes nothing.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_matrix(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write all columns as numbers with six decimals and no header."""
    fixed = df.select(*[F.format_string("%.6f", F.col(c).cast("double")).alias(c) for c in df.columns])
    fixed.write.mode(mode).csv(path, header=False)
