"""Generic dataset checks. Each returns the violations; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, null_count) of every column, from one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "null_count")


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that hold NULLs, with how many."""
    return null_counts(df, columns).filter("null_count > 0")


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with `duplicate_count`.

    A key with a NULL in it equals no other; `not_null` is the check for those.
    """
    return (
        df.dropna("any", subset=list(columns))
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .filter("duplicate_count > 1")
    )


def accepted_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the accepted list, with how many rows carry each."""
    return (
        df.groupBy(F.col(column).alias("unexpected_value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter(~F.col("unexpected_value").isin(*values))
    )


def orphan_keys(
    child: DataFrame,
    key: str,
    parent: DataFrame,
    parent_key: str,
    where: Column | None = None,
) -> DataFrame:
    """Child keys without a parent row, with how many child rows carry each.

    The child is reduced to distinct keys before the anti join, so a key held by a
    large share of the rows crosses the network once per task.
    """
    rows = child if where is None else child.filter(where)
    keys = (
        rows.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("orphan_key"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    parents = parent.select(F.col(parent_key).alias("orphan_key"))
    return keys.join(parents, "orphan_key", "left_anti")


def outside_range(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows whose value is not between `low` and `high`."""
    return df.filter(~F.col(column).between(low, high))


def is_empty(df: DataFrame) -> DataFrame:
    """One row (row_count = 0) when the table has no rows, nothing otherwise."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).filter("row_count = 0")


def differing_totals(
    left: DataFrame, right: DataFrame, measures: Sequence[str], names: tuple[str, str]
) -> DataFrame:
    """Compare two one-row totals; the row of both when any measure differs.

    Both are one row by construction, so the right one enters as scalar subqueries.
    """
    row = left.select(
        *[F.col(m).alias(f"{names[0]}_{m}") for m in measures],
        *[right.select(m).scalar().alias(f"{names[1]}_{m}") for m in measures],
    )
    differs = F.lit(False)
    for m in measures:
        differs = differs | ~F.col(f"{names[0]}_{m}").eqNullSafe(F.col(f"{names[1]}_{m}"))
    return row.filter(differs)
