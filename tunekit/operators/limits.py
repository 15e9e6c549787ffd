"""First rows by order, and any first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows by order: each task keeps its own first ``n``, and those are merged."""
    return df.orderBy(*order).limit(n)


def head_rows(df: DataFrame, n: int) -> DataFrame:
    """Any first ``n`` rows; scanning stops once they are found."""
    return df.limit(n)
