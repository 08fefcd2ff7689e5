"""Link harvest: the internal page links of each page, in document order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_once
from ..functions.text import WS
from ..functions.urls import (
    LINK_SKIP_PREFIXES,
    build_url,
    is_page_path,
    resolve_pieces,
    starts_with_any,
    strip_space,
    url_pieces,
)

# Fixed value: what counts as the link of an anchor (an anchor's own href; <link>, <use> and the like are no anchors)
ANCHOR_HREF = rf"""(?i)<a(?![\p{{L}}\p{{N}}_])[^>]*?{WS}href=["']([^"']+)["']"""


def raw_hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(ANCHOR_HREF), F.lit(1))


def internal_links(html: Column, base: Column, host: Column) -> Column:
    """Array of clean page URLs of one page; repeats stay.

    ``base`` is the ``url_pieces`` of the page, ``host`` the host to stay on ('' = any).
    All links of a page sit in its own row, so harvesting needs no shuffle.
    """
    hrefs = F.filter(
        F.transform(raw_hrefs(html), strip_space),
        lambda h: (h != "") & ~starts_with_any(h, LINK_SKIP_PREFIXES),
    )
    joined = F.transform(F.transform(hrefs, url_pieces), lambda h: resolve_pieces(base, h))
    kept = F.filter(
        joined,
        lambda r: ((host == "") | (r["netloc"] == host)) & is_page_path(r["scheme"], r["path"]),
    )
    return F.transform(kept, lambda r: build_url(r["scheme"], r["netloc"], r["path"], r["query"]))


def with_links(
    pages: DataFrame, html: str = "html", base: str = "url", root: str | None = None, name: str = "links"
) -> DataFrame:
    """Add the link array. Links resolve against ``base`` and stay on the host of ``root`` (default ``base``)."""
    return (
        pages.withColumns({"_base": url_pieces(F.col(base)), "_host": F.get(url_pieces(F.col(root or base)), 1)})
        .withColumn(name, internal_links(F.col(html), F.col("_base"), F.col("_host")))
        .drop("_base", "_host")
    )


def extract_links(
    pages: DataFrame,
    keys: Sequence[str] = ("url",),
    html: str = "html",
    base: str = "url",
    root: str | None = None,
) -> DataFrame:
    """One row per kept link: the key columns, ``link_pos`` from 0, ``link_url``."""
    return explode_once(with_links(pages, html, base, root), keys, "links", "link_pos", "link_url")
