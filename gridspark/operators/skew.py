"""Splitting of hot join keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.session import materialize

SPLIT_ROWS = 500_000


def split_hot_keys(big: DataFrame, small: DataFrame, keys: list[str], rows: int = SPLIT_ROWS):
    """Spread join keys holding more than ``rows`` rows of ``big`` over several partitions.

    Returns both sides with an added ``_part`` column to join on together with ``keys``. Rows of a
    hot key in ``big`` are dealt over ``ceil(n / rows)`` parts and the matching rows of ``small``
    are repeated once per part, so each pair still meets exactly once. All other keys keep the
    single part 0.

    All hot keys are listed, in a stored table: Spark sees its size and sends it to the tasks only if it is small.
    Where there is none, nothing is joined. Splitting never changes the result.
    """
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    hot = materialize(counts.select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return big.withColumn("_part", F.lit(0)), small.withColumn("_part", F.lit(0))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in keys]), parts)
    left = big.join(hot, keys, "left").withColumn("_part", spread.cast("int")).drop("_parts")
    repeated = F.explode(F.sequence(F.lit(0), parts - 1))
    right = small.join(hot, keys, "left").withColumn("_part", repeated).drop("_parts")
    return left, right
