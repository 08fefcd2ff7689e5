"""Site map: the distinct internal URLs of each root page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_once
from ..functions.urls import path_filter, validate_regex
from .links import with_links

DEFAULT_LIMIT = 200


def with_site_map(pages: DataFrame, include: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Add ``urls``: the first ``limit`` distinct links of a page in document order, then sorted.

    The base and the host are those of ``final_url``. Everything happens inside the
    page's row: no shuffle. A limit below 1 still yields one URL.
    """
    validate_regex(pages, include)
    based = pages if "final_url" in pages.columns else pages.withColumn("final_url", F.col("url"))
    linked = with_links(based.withColumn("_from", F.coalesce("final_url", "url")), base="_from")
    urls = F.col("links")
    if include:
        urls = F.filter(urls, lambda u: path_filter(u, include))
    return linked.withColumn(
        "urls", F.array_sort(F.slice(F.array_distinct(urls), 1, max(limit, 1)))
    ).drop("links", "_from")


def map_site(pages: DataFrame, include: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Rows (root, pos, url): the sorted site map of every page taken as a root."""
    return explode_once(with_site_map(pages, include, limit), [F.col("url").alias("root")], "urls", "pos", "url")
