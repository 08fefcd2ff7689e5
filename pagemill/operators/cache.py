"""Response cache as tables: reuse within a time-to-live, retention, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cache_key
from .ordered import GROUP_ROWS, with_last

# Defaults of the cache.
TTL_SECONDS = 900
MAX_ITEMS = 128


def cache_entries(pages: DataFrame, put_ts, prefer: str = "auto") -> DataFrame:
    """Pages as cache rows: ``key``, ``put_ts`` and the page. Failed pages are never cached."""
    good = pages.filter(F.col("error").isNull()) if "error" in pages.columns else pages
    moment = F.lit(put_ts).cast("timestamp") if isinstance(put_ts, str) else put_ts
    return good.select(cache_key(F.col("url"), F.lit(prefer)).alias("key"), moment.alias("put_ts"), *good.columns)


def cached_pages(urls: DataFrame, cache: DataFrame, as_of, prefer: str = "auto", ttl: int = TTL_SECONDS) -> DataFrame:
    """The rows of ``urls`` (url, ...) with a fresh entry: the newest put not after ``as_of`` and at most ``ttl`` seconds old.

    The page comes with ``meta.cache = hit``. One entry per key is picked before pages are joined.
    """
    now = F.lit(as_of).cast("timestamp")
    age = F.unix_micros(now) - F.unix_micros("put_ts")
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("put_ts"), "url"))
    fresh = cache.filter((age >= 0) & (age <= ttl * 1_000_000)).withColumn("_n", newest).filter("_n = 1")
    hit = F.create_map(F.lit("cache"), F.lit("hit"))
    meta = F.map_concat(F.coalesce("meta", F.create_map().cast("map<string,string>")), hit) if "meta" in cache.columns else hit
    page = fresh.withColumn("meta", meta).drop("_n", "put_ts", "url", *(c for c in urls.columns if c != "url"))
    return urls.withColumn("key", cache_key(F.col("url"), F.lit(prefer))).join(page, "key").drop("key").withColumn("error", F.lit(None).cast("string"))


def fresh_entries(cache: DataFrame, columns: Sequence[str], as_of, prefer: str = "auto", ttl: int = TTL_SECONDS) -> DataFrame:
    """url and ``_cached``, the page of its newest fresh entry with ``meta.cache = hit``: one grouping by URL."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("put_ts")
    mine = (F.col("key") == cache_key(F.col("url"), F.lit(prefer))) & (age >= 0) & (age <= ttl * 1_000_000)
    hit = F.create_map(F.lit("cache"), F.lit("hit"))
    meta = F.map_concat(F.coalesce("meta", F.create_map().cast("map<string,string>")), hit) if "meta" in cache.columns else hit
    page = F.struct(*(meta.alias(c) if c == "meta" else F.col(c) for c in columns))
    return cache.filter(mine).groupBy("url").agg(F.max_by(page, "put_ts").alias("_cached"))


def cache_lookup(
    requests: DataFrame,
    puts: DataFrame,
    ttl: int = TTL_SECONDS,
    max_items: int = MAX_ITEMS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Latest put at or before each request of the same key.

    Inputs: ``k, ts, event_id``. Output: the request, ``put_ts`` and ``hit``
    (age <= ttl, inclusive). One ordered pass over the union: no range join.
    """
    asked = requests.select("k", "ts", "event_id", F.lit(1).alias("kind"))
    if max_items <= 0:
        return asked.drop("kind").withColumns(
            {"put_ts": F.lit(None).cast("timestamp"), "hit": F.lit(False)}
        )
    stored = puts.select("k", "ts", "event_id", F.lit(0).alias("kind"))
    both = asked.unionByName(stored)
    put_ts = F.when(F.col("kind") == 0, F.col("ts"))
    age = F.unix_micros("ts") - F.unix_micros("put_ts")
    return (
        with_last(both, ["k"], ["ts", "kind", "event_id"], put_ts, "put_ts", include_current=True,
                  group_rows=group_rows)
        .filter(F.col("kind") == 1)
        .drop("kind")
        .withColumn("hit", F.coalesce(age <= ttl * 1_000_000, F.lit(False)))
    )


def cache_compact(
    requests: DataFrame, puts: DataFrame, as_of, ttl: int = TTL_SECONDS, max_items: int = MAX_ITEMS
) -> DataFrame:
    """Keys worth keeping at ``as_of``: not expired, the ``max_items`` most recently touched.

    A key is touched by a put or a hit. The cut is a top-k over one row per key, which
    Spark takes from the tasks' own top-k lists.
    """
    moments = puts.select("k", "ts", F.col("ts").alias("put_ts")).unionByName(
        cache_lookup(requests, puts, ttl).filter("hit").select("k", "ts", "put_ts")
    )
    now = F.lit(as_of).cast("timestamp")
    return (
        moments.filter(F.col("ts") <= now)
        .groupBy("k")
        .agg(F.max("ts").alias("touched"), F.max("put_ts").alias("put_ts"))
        .filter(F.unix_micros(now) - F.unix_micros("put_ts") <= ttl * 1_000_000)
        .orderBy(F.desc("touched"), "k")
        .limit(max(max_items, 0))
    )


def cache_stats(
    requests: DataFrame, puts: DataFrame, ttl: int = TTL_SECONDS, max_items: int = MAX_ITEMS
) -> DataFrame:
    """One row: distinct keys stored, hits, misses, ttl."""
    looked = cache_lookup(requests, puts, ttl, max_items)
    hits = looked.agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )
    items = puts.select(F.count_distinct("k").alias("items")) if max_items > 0 else None
    stored = items.scalar() if items is not None else F.lit(0).cast("bigint")
    return hits.select(
        F.lit(max_items > 0).alias("enabled"),
        stored.alias("items"),
        "hits",
        "misses",
        F.lit(ttl).cast("bigint").alias("ttl_seconds"),
    )
