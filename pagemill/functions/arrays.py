"""Array to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, keep: Sequence[str | Column], array: Column | str, pos: str, item: str) -> DataFrame:
    """One row per array item with its position from 0.

    For a plain explode Spark infers a ``size > 0`` filter and pushes it to the scan, which
    computes a costly array twice. The outer form has no such filter.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
