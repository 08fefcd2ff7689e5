"""Result pages of a web search: links, titles and snippets, both layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_once
from ..functions.text import strip_tags
from ..functions.urls import starts_with_any, unwrap_redirect

# Class names and the rel of the two result layouts.
RESULT_CLASS = "result__a"
SNIPPET_CLASS = "result__snippet"
LITE_REL = "nofollow"
LITE_CELL_CLASS = "result-snippet"
WEB_PREFIXES = ("http://", "https://")


def _elements(html: Column, tag: str) -> Column:
    """(attrs, inner) of all elements of a kind, in page order; an element ends at the first end tag."""
    pattern, page = F.lit(rf"(?isu)<{tag}(\s[^>]*)>(.*?)</{tag}>"), F.coalesce(html, F.lit(""))
    return F.arrays_zip(*(F.regexp_extract_all(page, pattern, F.lit(g)).alias(n) for g, n in ((1, "attrs"), (2, "inner"))))


def _behind(attrs: Column, name: str, value: str) -> Column:
    """The attributes written behind ``name="value"``; empty if it is not there. Links count only behind their mark."""
    return F.regexp_extract(attrs, rf'(?iu)\s{name}="{value}"(.+)', 1)


def _href(attrs: Column) -> Column:
    return F.regexp_extract(attrs, r'(?iu)\shref="([^"]+)"', 1)


def _hits(raw: Column, limit: int) -> Column:
    """Keep web targets, then the first ``limit`` (at least one), then clean their text."""
    targets = F.transform(
        raw, lambda h: F.struct(unwrap_redirect(h["href"]).alias("url"), h["title"], h["snippet"])
    )
    web = F.filter(targets, lambda h: F.coalesce(starts_with_any(h["url"], WEB_PREFIXES), F.lit(False)))
    return F.transform(
        F.slice(web, 1, max(limit, 1)),
        lambda h: F.struct(
            h["url"].alias("url"), strip_tags(h["title"]).alias("title"), strip_tags(h["snippet"]).alias("snippet")
        ),
    )


def html_hits(html: Column, limit: int) -> Column:
    """A result anchor with the next snippet anchor; result anchors before that snippet are passed over."""
    anchors = F.transform(
        _elements(html, "a"),
        lambda e: F.struct(
            _href(_behind(e["attrs"], "class", RESULT_CLASS)).alias("href"),
            (_behind(F.concat(e["attrs"], F.lit(" ")), "class", SNIPPET_CLASS) != "").alias("ends"),
            e["inner"].alias("inner"),
        ),
    )
    hit = "struct<href:string,title:string,snippet:string>"
    start = F.struct(F.lit("").alias("href"), F.lit("").alias("title"), F.array().cast(f"array<{hit}>").alias("hits"))

    def step(acc: Column, e: Column) -> Column:
        pair = F.struct(acc["href"].alias("href"), acc["title"].alias("title"), e["inner"].alias("snippet"))
        opened = F.struct(e["href"].alias("href"), e["inner"].alias("title"), acc["hits"].alias("hits"))
        closed = F.struct(F.lit("").alias("href"), F.lit("").alias("title"), F.array_append(acc["hits"], pair).alias("hits"))
        return F.when((acc["href"] == "") & (e["href"] != ""), opened).when((acc["href"] != "") & e["ends"], closed).otherwise(acc)

    return _hits(F.aggregate(anchors, start, step, lambda acc: acc["hits"]), limit)


def lite_hits(html: Column, limit: int) -> Column:
    """Snippets belong to anchors by position, and skipped anchors count."""
    cells = F.filter(_elements(html, "td"), lambda e: e["attrs"].rlike(rf"""(?iu)class=["']{LITE_CELL_CLASS}["']"""))
    snippets = F.transform(cells, lambda e: e["inner"])
    marked = F.transform(
        _elements(html, "a"),
        lambda e: F.struct(_href(_behind(e["attrs"], "rel", LITE_REL)).alias("href"), e["inner"].alias("title")),
    )
    with_snippets = F.transform(
        F.filter(marked, lambda a: a["href"] != ""),
        lambda a, i: F.struct(a["href"].alias("href"), a["title"].alias("title"), F.get(snippets, i).alias("snippet")),
    )
    return _hits(with_snippets, limit)


def parse_serp(df: DataFrame, layout: str, html: str = "html", limit: int = 10) -> DataFrame:
    """Rows of hits with ``rank`` from 1, beside the other columns of the result page."""
    hits = {"html": html_hits, "lite": lite_hits}[layout](F.col(html), limit)
    others = [c for c in df.columns if c != html]
    return explode_once(df, others, hits, "rank", "hit").select(
        *others, (F.col("rank") + 1).alias("rank"), "hit.url", "hit.title", "hit.snippet"
    )


def parse_serp_first(df: DataFrame, html: str = "html", lite: str = "lite", limit: int = 10) -> DataFrame:
    """Hits of the first answer that has any: html page, lite page, lite page in html layout."""
    answers = [html_hits(F.col(html), limit), lite_hits(F.col(lite), limit), html_hits(F.col(lite), limit)]
    best = F.coalesce(*(F.when(F.size(a) > 0, a) for a in answers))
    others = [c for c in df.columns if c not in (html, lite)]
    return explode_once(df, others, best, "rank", "hit").select(
        *others, (F.col("rank") + 1).alias("rank"), "hit.url", "hit.title", "hit.snippet"
    )
