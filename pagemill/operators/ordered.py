"""Ordered per-key state that holds up when one key owns most of the rows.

``lag`` and ``last_value`` over a plain window sort a whole key in one task.
That is right while every key is small. Beyond a checked size the rows are
range-partitioned by (key, order), so that a hot key spreads over many slices;
each slice is solved by itself and one row per (key, slice) carries the state on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

GROUP_ROWS = 5_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group: counts combine before the shuffle, one number comes back."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def with_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    include_current: bool = False,
    group_rows: int = GROUP_ROWS,
    slices: int | None = None,
) -> DataFrame:
    """Add the latest non-null ``value`` of earlier rows (or up to this row) of the same key.

    ``order`` must give a total order within a key. ``group_rows`` is the most rows one
    task may sort for one key; larger keys are cut into ``slices`` ranges (the session's shuffle
    partitions by default), with the same result. A null key is a key like any other.
    """
    keys, order = list(keys), list(order)
    end = Window.currentRow if include_current else -1
    if largest_group(df, keys) <= group_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))

    # checkpointed, because slice numbers must not change when a task is run again
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut_lineage(
        df.withColumn("_value", value)
        .repartitionByRange(n, *keys, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    inside = sliced.withColumn("_inside", F.last("_value", ignorenulls=True).over(w))
    # the latest value of each slice; at most one row per key and slice
    ends = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max(F.when(F.col("_value").isNotNull(), F.struct(*order, F.col("_value").alias("v")))).alias("_end"))
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *(F.col(k).alias(f"_c_{k}") for k in keys),
        F.col("_slice").alias("_c__slice"),
        F.last("_end", ignorenulls=True).over(before)["v"].alias("_carry"),
    )
    same = F.lit(True)
    for k in (*keys, "_slice"):
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return (
        inside.join(carry, same, "left")
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_value", "_slice", "_inside", *carry.columns)
    )
