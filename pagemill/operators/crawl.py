"""Crawls over captured pages: flat harvest and breadth-first walk, many roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import explode_once
from ..functions.text import html_to_text, page_title
from ..functions.urls import path_filter, url_host, validate_regex
from ..schemas import NOT_ATTEMPTED
from ..session import cut_lineage
from .joins import BROADCAST_ROWS, fits_broadcast, one_capture, pick_rows
from .links import with_links
from .selectors import scope_to_selector
from .sitemap import with_site_map

# Crawl defaults, and the over-fetch when a filter follows the site map.
MAX_PAGES = 5
FILTER_OVERFETCH = 4


def _attach_pages(
    visits: DataFrame, pages: DataFrame, css_selector: str | None, fits: bool | None = None
) -> DataFrame:
    """Join visited URLs to their pages; a URL without a page is an error row.

    ``pages`` may be raw (url, html): title and text are then built once per visited page,
    before the join. Of several captures of a page the newest one counts.
    """
    missing = F.col("_found").isNull()
    near = one_capture(pick_rows(pages, visits, "url", fits))
    if "title" not in near.columns:
        near = near.withColumn("title", page_title(F.coalesce("html", F.lit(""))))
    if "markdown" not in near.columns:
        near = near.withColumn("markdown", html_to_text(F.coalesce("html", F.lit(""))))
    have = set(near.columns)
    joined = visits.join(near.withColumn("_found", F.lit(True)), "url", "left")
    no_meta, reason = F.create_map().cast("map<string,string>"), F.create_map(F.lit("error"), F.lit(NOT_ATTEMPTED))

    def old(name: str, default):
        return F.coalesce(name, default) if name in have else default

    error = F.col("error") if "error" in have else F.lit(None).cast("string")
    out = joined.withColumns(
        {
            "error": F.when(missing, NOT_ATTEMPTED).otherwise(error),
            "final_url": old("final_url", F.col("url")),
            "status": F.when(missing, 0).otherwise(old("status", F.lit(200))),
            "html": F.coalesce("html", F.lit("")),
            "method": F.when(missing, "error").otherwise(old("method", F.lit("corpus"))),
            "elapsed_ms": old("elapsed_ms", F.lit(0)),
            "meta": F.when(missing, reason).otherwise(old("meta", no_meta)),
        }
    ).withColumn("markdown", F.coalesce("markdown", F.lit(""))).drop("_found")
    return scope_to_selector(out, css_selector) if css_selector else out


def crawl_flat(
    pages: DataFrame,
    roots: DataFrame | None = None,
    max_pages: int = MAX_PAGES,
    include: str | None = None,
    exclude: str | None = None,
    css_selector: str | None = None,
) -> DataFrame:
    """Pages linked from each root: the first ``max_pages`` of the sorted, filtered site map.

    The root itself is visited only if linked. Output: root, rank and page columns.
    """
    for pattern in (include, exclude):
        validate_regex(pages, pattern)
    filtered = bool(include or exclude)
    starts = pages if roots is None else pages.join(roots.select(F.col("root").alias("url")).distinct(), "url", "left_semi")
    if "error" in starts.columns:
        starts = starts.filter(F.col("error").isNull())
    starts = one_capture(starts)
    mapped = with_site_map(starts, limit=max_pages * FILTER_OVERFETCH if filtered else max_pages)
    kept = F.slice(F.filter("urls", lambda u: path_filter(u, include, exclude)), 1, max(max_pages, 0))
    visits = explode_once(mapped, [F.col("url").alias("root")], kept, "rank", "url")
    # a crawl of the whole corpus visits most pages: no use in looking for the few
    fits = False if roots is None else None
    return _attach_pages(visits.withColumn("rank", F.col("rank") + 1), pages, css_selector, fits)


def page_edges(pages: DataFrame) -> DataFrame:
    """Narrow link table (src, pos, dst) of every page's newest capture; hosts are checked during the walk.

    Links are harvested where the html is read; captures are told apart by narrow rows.
    """
    landed = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    based = pages.withColumns({"_from": landed, "_any_host": F.lit("")})
    when = [c for c in ("fetched_at", "ts", "attempt", "page_id") if c in pages.columns]
    linked = one_capture(with_links(based, base="_from", root="_any_host").select("url", *when, "links", F.xxhash64("html").alias("html")))
    return explode_once(linked, [F.col("url").alias("src")], "links", "pos", "dst")


def crawl_levels(
    pages: DataFrame,
    roots: DataFrame,
    max_pages: int = MAX_PAGES,
    max_depth: int = 1,
    include: str | None = None,
    exclude: str | None = None,
) -> DataFrame:
    """Visited URLs (root, depth, rank, url), breadth first, at most ``max_pages`` per root.

    Order: depth, then the parent's rank, then the link's position. A URL is taken once
    per root, at its discovery. One round per level; each round joins the frontier with
    the link table and drops known URLs. Frontiers hold at most ``max_pages`` rows per
    root and are cut back to a reliable checkpoint, so the plan stays small. A frontier that
    a count proves small is broadcast, and the link table is not shuffled at all.
    """
    for pattern in (include, exclude):
        validate_regex(pages, pattern)
    usable = pages.filter(F.col("error").isNull()) if "error" in pages.columns else pages
    frontier = (
        roots.select(F.col("root"), url_host(F.col("root")).alias("host")).distinct()
        .withColumns({"url": F.col("root"), "depth": F.lit(0), "rank": F.lit(1), "done": F.lit(0)})
        .filter(F.lit(max_pages >= 1))
    )
    if max_depth <= 0:
        return frontier.select("root", "depth", "rank", "url")
    frontier = cut_lineage(frontier)
    fits = fits_broadcast(frontier)
    # a walk stays on its root's host, so pages of other hosts need not be harvested
    if fits and frontier.filter("host = ''").isEmpty():
        hosts = frontier.select("host").distinct()
        usable = pick_rows(usable.withColumn("host", url_host(F.col("url"))), hosts, "host", fits).drop("host")
    edges = cut_lineage(
        page_edges(usable)
        .filter(path_filter(F.col("dst"), include, exclude))
        .withColumn("dst_host", url_host(F.col("dst")))
    )
    levels = [frontier]
    per_root = Window.partitionBy("root")
    for depth in range(1, max_depth + 1):
        seen = levels[0].select("root", "url")
        for level in levels[1:]:
            seen = seen.unionByName(level.select("root", "url"))
        parents = frontier.select(
            "root",
            F.col("url").alias("src"),
            F.col("rank").alias("parent"),
            "host",
            (F.col("done") + F.count(F.lit(1)).over(per_root)).cast("int").alias("done"),
        ).filter(F.col("done") < max_pages)
        met = edges.join(F.broadcast(parents), "src") if fits else parents.join(edges, "src")
        found = (
            met
            .filter((F.col("host") == "") | (F.col("dst_host") == F.col("host")))
            .groupBy("root", "host", F.col("dst").alias("url"))
            .agg(F.min(F.struct("parent", "pos")).alias("at"), F.first("done").alias("done"))
            .join(seen, ["root", "url"], "left_anti")
        )
        frontier = cut_lineage(
            found.withColumn("rank", F.row_number().over(per_root.orderBy("at")))
            .filter(F.col("rank") <= max_pages)
            .filter(F.col("rank") + F.col("done") <= max_pages)
            .select("root", "host", "url", F.lit(depth).alias("depth"), "rank", "done")
        )
        if frontier.isEmpty():
            break
        fits = fits_broadcast(frontier)
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("root", "depth", (F.col("done") + F.col("rank")).alias("rank"), "url")


def crawl_bfs(
    pages: DataFrame,
    roots: DataFrame,
    max_pages: int = MAX_PAGES,
    max_depth: int = 1,
    include: str | None = None,
    exclude: str | None = None,
    css_selector: str | None = None,
) -> DataFrame:
    """``crawl_levels`` with page content. Links come from the full page, scoping from the selector."""
    visits = crawl_levels(pages, roots, max_pages, max_depth, include, exclude)
    return _attach_pages(visits, pages, css_selector)


def crawl_errors(crawled: DataFrame) -> DataFrame:
    """Failed visits by host and reason."""
    return (
        crawled.filter(F.col("error").isNotNull())
        .groupBy(url_host(F.col("url")).alias("host"), F.col("error").alias("reason"))
        .agg(F.count(F.lit(1)).alias("pages"))
    )


def crawl_site(
    pages: DataFrame,
    roots: DataFrame,
    max_pages: int = MAX_PAGES,
    max_depth: int = 0,
    include: str | None = None,
    exclude: str | None = None,
    css_selector: str | None = None,
) -> DataFrame:
    """Flat harvest with ``max_depth`` 0, breadth-first walk beyond."""
    if max_depth > 0:
        return crawl_bfs(pages, roots, max_pages, max_depth, include, exclude, css_selector)
    return crawl_flat(pages, roots, max_pages, include, exclude, css_selector)
