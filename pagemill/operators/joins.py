"""Joins against a side that is usually small but may not be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Prove that a side is small, in rows and in bytes, from at most ``rows + 1`` of its rows."""
    size = F.lit(16)
    for field in small.schema.fields:
        plain = isinstance(field.dataType, (T.StringType, T.BinaryType))
        value = F.col(f"`{field.name}`") if plain else F.to_json(F.struct(f"`{field.name}`"))
        size = size + F.coalesce(F.octet_length(value), F.lit(0)) + 8
    n, total = small.limit(rows + 1).select(size.alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return n <= rows and (total or 0) <= max_bytes


def join_checked(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread: str, fits: bool, how: str = "inner", salts: int = 64
) -> DataFrame:
    """Join ``big`` with ``small``; broadcast only when ``fits`` says a check proved it small.

    Beyond that the join key gets a salt: rows of ``big`` spread by the hash of
    their ``spread`` column, ``small`` is repeated once per salt. A hot key is then
    handled by many tasks. Only joins that keep no unmatched ``small`` rows fit.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    on = list(on)
    if fits:
        return big.join(F.broadcast(small), on, how)
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted_big.join(salted_small, [*on, "_salt"], how).drop("_salt")


def one_capture(pages: DataFrame, url: str = "url") -> DataFrame:
    """One row per URL, of tables that hold a page more than once.

    The newest capture counts: the greatest of the columns ``fetched_at``, ``ts``, ``attempt`` and ``page_id``
    that are there, then the greater hash of its html. Earlier captures are dropped before the shuffle.
    """
    order = [F.desc_nulls_last(c) for c in ("fetched_at", "ts", "attempt", "page_id") if c in pages.columns]
    order += [F.desc(F.xxhash64(c)) for c in ("html", "markdown", "links") if c in pages.columns]
    newest = F.row_number().over(Window.partitionBy(url).orderBy(*(order or [F.lit(0)])))
    return pages.withColumn("_capture", newest).filter("_capture = 1").drop("_capture")


def pick_rows(big: DataFrame, wanted: DataFrame, on: str, fits: bool | None = None) -> DataFrame:
    """Rows of ``big`` that a following join on ``on`` can meet, found before anything wide is shuffled.

    ``wanted`` should be cheap to read twice (a checkpoint or a small table). When its keys
    do not fit a broadcast, ``big`` comes back as it is and the join itself does the work.
    """
    keys = wanted.select(on)
    if fits_broadcast(keys) if fits is None else fits:
        return big.join(F.broadcast(keys), on, "left_semi")
    return big
