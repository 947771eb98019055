"""Top-k, keep-first and keep-last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k_per_group(df: DataFrame, by: list, order: list[Column], k: int, rank: str | None = None):
    """The first ``k`` rows of every group.

    Written as ``row_number() <= k`` so that Spark's window group limit keeps only ``k`` rows per
    group in every map task: a hot group never reaches one task whole.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order (order descending to keep the last)."""
    return top_k_per_group(df, keys, order, 1)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Global top-k; planned as TakeOrderedAndProject."""
    return df.orderBy(*order).limit(k)
