"""Whole jobs composed of operators: research, ingestion of a site, watching pages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import path_filter
from ..operators.batch import batch_scrape
from ..operators.ladder import choose_attempt
from ..operators.monitor import LINE_ENDS, check_incoming, monitor_check, unified_diffs
from ..operators.research import SCRAPE_TOP, citations, evidence_pack, expand_queries
from ..operators.search import search_corpus
from ..operators.sitemap import DEFAULT_LIMIT, map_site
from ..session import cut_lineage
from ..sources.sinks import SnapshotStore, write_rag_jsonl

# Fixed value: hits per pass of a research job.
RESEARCH_LIMIT = 5


class Research(NamedTuple):
    queries: DataFrame
    hits: DataFrame
    evidence: DataFrame
    citations: DataFrame


def deep_research(
    queries: DataFrame,
    pages: DataFrame,
    limit: int = RESEARCH_LIMIT,
    scrape_top: int = SCRAPE_TOP,
    iterations: int = 1,
) -> Research:
    """Search each (query_id, query) in up to three passes over the pages' text, then pack the evidence.

    Hits of all passes stay, repeats included; a page is read once per query.
    """
    passes = expand_queries(queries, iterations)
    asked = passes.select(F.struct("query_id", "pass").alias("asked"), "pass_query")
    corpus = pages.select("url", F.coalesce("markdown", F.lit("")).alias("markdown"))
    found = search_corpus(asked, corpus, limit, query_id="asked", query="pass_query", doc_id="url", text="markdown")
    hits = cut_lineage(found.select("asked.query_id", "asked.pass", "rank", "url", "score"))
    evidence = evidence_pack(hits, pages, scrape_top)
    return Research(passes, hits, evidence, citations(evidence))


def rag_ingest(
    fetch_log: DataFrame,
    roots: DataFrame,
    path: str,
    fetched_at: Column,
    include: str | None = None,
    exclude: str | None = None,
    limit: int = DEFAULT_LIMIT,
) -> None:
    """Map the roots, keep the paths that matter, scrape them as a batch, write JSON lines."""
    starts = fetch_log.join(roots.select(F.col("root").alias("url")).distinct(), "url", "left_semi")
    mapped = map_site(choose_attempt(starts, text=False).filter(F.col("error").isNull()), limit=limit)
    kept = mapped.filter(path_filter(F.col("url"), include, exclude)).select("url").distinct()
    urls = cut_lineage(kept.select(F.lit(0).alias("pos"), F.col("url").alias("raw_url")))
    pages = batch_scrape(urls, fetch_log).filter(F.col("error").isNull())
    write_rag_jsonl(pages.withColumn("fetched_at", fetched_at), path)


def fetched_snapshots(fetch_log: DataFrame, at, prefer: str = "auto") -> DataFrame:
    """One check per URL of a round of fetches at the moment ``at``: the ladder's choice, failures included."""
    moment = F.lit(at).cast("timestamp")
    return choose_attempt(fetch_log, prefer).select(
        "url", moment.alias("ts"), F.xxhash64("url", moment).alias("snapshot_id"), "title", "status", "method",
        F.when(F.col("error").isNull(), F.col("markdown")).alias("text"), "error",
    )


def check_round(store: SnapshotStore, fetch_log: DataFrame, at, prefer: str = "auto") -> DataFrame:
    """Check a round of fetches against the store, then store it: url, check_status, error, lines_added, lines_removed.

    Hashes from the store's index decide, of the buckets of this round's URLs; stored text is read for the buckets
    of the changed URLs alone. Failed fetches are reported and not stored.
    """
    incoming = cut_lineage(fetched_snapshots(fetch_log, at, prefer))
    latest = cut_lineage(store.latest(incoming))
    checked = cut_lineage(check_incoming(latest, incoming.select("url", "text", "error")).select("url", "check_status", "error"))
    changed = checked.filter("check_status = 'changed'").select("url")
    before = store.read(urls=changed).join(latest.join(changed, "url").select("url", "snapshot_id"), ["url", "snapshot_id"], "left_semi")
    texts = before.select("url", F.col("text").alias("old")).join(incoming.select("url", F.col("text").alias("new")), "url")
    old, new = (F.split(c, LINE_ENDS) for c in ("old", "new"))
    delta = cut_lineage(
        texts.select("url", F.size(F.array_except(new, old)).alias("lines_added"), F.size(F.array_except(old, new)).alias("lines_removed"))
    )
    store.append(incoming)
    return checked.join(delta, "url", "left")


def watch(snapshots: DataFrame) -> DataFrame:
    """Every check with its status, and the diff where a page changed."""
    checks = cut_lineage(monitor_check(snapshots))
    diffs = unified_diffs(snapshots, checks=checks).select("snapshot_id", "diff", "diff_truncated")
    return checks.join(diffs, "snapshot_id", "left")
