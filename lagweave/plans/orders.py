"""Test plans: orders with the effect first and the candidate cause last, and variable pairs.

Orders grow by exploding the variables not used yet, so the plan is a lazy
projection and needs no join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_array(names: Sequence[str]) -> str:
    """An array literal of texts, as a SQL expression."""
    quoted = (v.replace("\\", "\\\\").replace("'", "\\'") for v in names)
    return "array(" + ", ".join(f"'{v}'" for v in quoted) + ")"


def grow_orders(df: DataFrame, variables: Sequence[str], upto: int) -> DataFrame:
    """Add ``order`` (every ordered choice of ``upto`` variables) and ``test_id``.

    ``test_id`` is the lexicographic rank, by header position, of the first full
    order that starts with the prefix.
    """
    k, names = len(variables), text_array(variables)
    kept = [f"`{c}`" for c in df.columns]
    out = df.selectExpr(*kept, "cast(array() as array<string>) as `order`", "0L as test_id")
    for j in range(upto):
        out = out.selectExpr("*", f"posexplode(array_except({names}, `order`)) as (_pos, _next)").selectExpr(
            *kept, "concat(`order`, array(_next)) as `order`", f"test_id + _pos * {math.factorial(k - 1 - j)}L as test_id")
    return out


def check_variables(variables: Sequence[str]) -> None:
    if len(set(variables)) != len(variables) or len(variables) < 2:
        raise ValueError("variables must be at least two distinct names")


def test_plan(spark: SparkSession, variables: Sequence[str], maxlag: int) -> DataFrame:
    """All k! tests: test_id, effect, cause, order, maxlag."""
    check_variables(variables)
    rows = grow_orders(spark.range(1).select(), variables, len(variables))
    return _named(rows, maxlag)


def explode_orders(df: DataFrame, orders: Sequence[Sequence[str]]) -> DataFrame:
    """Add the given orders to each row, with their position as ``test_id``."""
    lists = "array(" + ", ".join(text_array(o) for o in orders) + ")"
    out = df.selectExpr("*", f"posexplode({lists}) as (test_id, `order`)")
    return out.withColumn("test_id", F.col("test_id").cast("long"))


def _named(rows: DataFrame, maxlag: int) -> DataFrame:
    return rows.select(
        F.col("test_id").cast("long").alias("test_id"), F.element_at("order", 1).alias("effect"),
        F.element_at("order", -1).alias("cause"), "order", F.lit(maxlag).alias("maxlag"),
    )


test_plan.__test__ = False


def explode_pairs(df: DataFrame, variables: Sequence[str], keep_self: bool = False) -> DataFrame:
    """Add every ordered (effect, cause) pair to each row."""
    names = text_array(variables)
    out = df.selectExpr("*", f"explode({names}) as effect").selectExpr("*", f"explode({names}) as cause")
    return out if keep_self else out.where("effect != cause")


def variable_pairs(spark: SparkSession, variables: Sequence[str], keep_self: bool = True) -> DataFrame:
    return explode_pairs(spark.range(1).select(), variables, keep_self)
