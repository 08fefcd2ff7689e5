"""Batch of URLs: ordered dedup, scrape as a join, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_page
from ..functions.urls import strip_space, url_host
from ..schemas import NOT_ATTEMPTED
from ..session import cut_lineage
from .cache import TTL_SECONDS, cached_pages, fresh_entries
from .joins import pick_rows
from .ladder import attach_content, ladder_decisions, page_shape, with_final_url

TOTAL = "(all)"


def dedup_urls(urls: DataFrame, url: str = "raw_url", pos: str = "pos") -> DataFrame:
    """Trimmed, non-empty URLs with the position of their first occurrence."""
    return (
        urls.select(strip_space(F.col(url)).alias("url"), F.col(pos).alias("pos"))
        .filter(F.col("url") != "")
        .groupBy("url")
        .agg(F.min("pos").alias("pos"))
    )


def batch_scrape(
    urls: DataFrame,
    fetch_log: DataFrame,
    prefer: str = "auto",
    include_html: bool = False,
    max_markdown: int | None = None,
    cache: DataFrame | None = None,
    as_of=None,
    ttl: int = TTL_SECONDS,
) -> DataFrame:
    """One page row per distinct URL (``pos`` keeps the input order); failures carry ``error``.

    A URL list that a check proves small is broadcast, so that other attempts are dropped
    where the log is read. Both sides of the narrow join are unique per URL: no skew. The
    html moves once, by attempt. With ``cache`` (see ``cache.cache_entries``) URLs that have a
    fresh entry at ``as_of`` come from there, marked ``meta.cache = hit``, and skip the ladder.
    """
    sizes = {} if max_markdown is None else {"max_markdown": max_markdown}
    wanted = cut_lineage(dedup_urls(urls))
    if cache is not None:
        hits = cut_lineage(cached_pages(wanted, cache, as_of, prefer, ttl))
        missed = wanted.join(hits.select("url"), "url", "left_anti")
        fetched = batch_scrape(missed.withColumnRenamed("url", "raw_url"), fetch_log, prefer, include_html, max_markdown)
        return fetched.unionByName(trim_page(hits, include_html=include_html, **sizes), allowMissingColumns=True)
    log = pick_rows(fetch_log, wanted, "url")
    decided = (
        wanted.join(ladder_decisions(log, prefer), "url", "left")
        .withColumn("_missing", F.col("tier").isNull())
        .withColumn("error", F.when(F.col("_missing"), NOT_ATTEMPTED).otherwise(F.col("error")))
    )
    return trim_page(_blank_missing(attach_content(decided, log)), include_html=include_html, **sizes)


def _blank_missing(pages: DataFrame) -> DataFrame:
    """A URL nobody tried has no page at all."""
    blank = ("final_url", "status", "html", "markdown", "title")
    return pages.withColumns({c: F.when(~F.col("_missing"), F.col(c)) for c in blank}).drop("_missing")


def batch_scrape_bucketed(
    urls: DataFrame,
    fetch_log: DataFrame,
    prefer: str = "auto",
    include_html: bool = False,
    max_markdown: int | None = None,
    cache: DataFrame | None = None,
    as_of=None,
    ttl: int = TTL_SECONDS,
) -> DataFrame:
    """As ``batch_scrape``, over a log and a cache that are stored by URL (``sources.bucketed``).

    Only the URL list is dealt to the buckets. Decision, content and cache entry of a URL meet where they lie:
    one grouping of each table picks them, with the html, and no exchange lies above either scan. Text is
    derived after the join, for the page that counts.
    """
    sizes = {} if max_markdown is None else {"max_markdown": max_markdown}
    wanted = cut_lineage(dedup_urls(urls))
    log = pick_rows(with_final_url(fetch_log), wanted, "url")
    decided = (
        wanted.join(ladder_decisions(log, prefer, carry=("final_url", "html")), "url", "left")
        .withColumn("_missing", F.col("tier").isNull())
        .withColumn("error", F.when(F.col("_missing"), NOT_ATTEMPTED).otherwise(F.col("error")))
    )
    if cache is None:
        return trim_page(_blank_missing(page_shape(decided)), include_html=include_html, **sizes)
    columns = ("final_url", "status", "html", "markdown", "title", "method", "elapsed_ms", "meta")
    hits = decided.join(fresh_entries(cache, columns, as_of, prefer, ttl), "url", "left")
    pages = _blank_missing(page_shape(hits, text=True))
    hit = F.col("_cached").isNotNull()
    cached = {c: F.when(hit, F.col(f"_cached.{c}")).otherwise(F.col(c)) for c in columns}
    pages = pages.withColumns({**cached, "error": F.when(~hit, F.col("error"))}).drop("_cached")
    return trim_page(pages, include_html=include_html, **sizes)


def batch_report(urls: DataFrame, fetch_log: DataFrame, prefer: str = "auto") -> DataFrame:
    """Counts per host and in total (host ``(all)``): requested, unique, succeeded, failed.

    An HTTP error status is still a success; only rows without an answer fail. No html is read
    beyond the checks of the ladder.
    """
    asked = cut_lineage(
        urls.select(F.coalesce(strip_space(F.col("raw_url")), F.lit("")).alias("url"))
        .groupBy("url")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    answered = ladder_decisions(pick_rows(fetch_log, asked, "url"), prefer).select("url", F.col("error").isNull().alias("ok"))
    real = F.col("url") != ""
    ok = F.coalesce("ok", F.lit(False))
    return (
        asked.join(answered, "url", "left")
        .withColumn("host", url_host(F.col("url")))
        .rollup("host")
        .agg(
            F.grouping("host").alias("_total"),
            F.sum("n").alias("requested"),
            F.count_if(real).alias("unique_urls"),
            F.count_if(real & ok).alias("succeeded"),
            F.count_if(real & ~ok).alias("failed"),
        )
        .withColumn("host", F.when(F.col("_total") == 1, TOTAL).otherwise(F.col("host")))
        .drop("_total")
    )
