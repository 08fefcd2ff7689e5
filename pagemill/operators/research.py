"""Research: query variants, numbered evidence, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import NOT_ATTEMPTED
from ..session import cut_lineage
from .joins import one_capture, pick_rows

# Query variants of the second and third pass.
VARIANTS = (
    "{q} comparison alternatives",
    "{q} problems issues criticism",
)
MAX_PASSES = 3
SCRAPE_TOP = 3


def clamp_passes(iterations: int) -> int:
    return max(1, min(iterations, MAX_PASSES))


def expand_queries(
    queries: DataFrame, iterations: int = 1, query: str = "query", variants: Sequence[str] = VARIANTS
) -> DataFrame:
    """One row per query and pass: the other columns, ``pass`` from 0, ``pass_query``."""
    passes = ["{q}", *(variants[i % len(variants)] for i in range(clamp_passes(iterations) - 1))]
    texts = [F.concat(F.lit(p.split("{q}")[0]), F.col(query), F.lit(p.split("{q}")[1])) for p in passes]
    return queries.select("*", F.posexplode(F.array(*texts)).alias("pass", "pass_query"))


def choose_sources(hits: DataFrame, scrape_top: int = SCRAPE_TOP, query_id: str = "query_id") -> DataFrame:
    """Numbered sources (query_id, n, pass, url): per pass the first ``scrape_top`` URLs not chosen before.

    Pass p (from 0) can meet at most ``scrape_top`` URLs known from each of the p passes before
    it, so its first ``scrape_top * (p + 1)`` distinct URLs decide it; that makes the per-query
    fold exact on a bounded list, for any number of passes. With ``scrape_top`` below 1 only the
    first hit of a pass is considered.
    """
    top = max(scrape_top, 1)
    usable = hits.filter(F.coalesce(F.col("url"), F.lit("")) != "")
    if scrape_top < 1:
        usable = usable.filter(F.col("rank") == 1)
    by_rank = Window.partitionBy(query_id, "pass").orderBy("rank", "url")
    firsts = (
        usable.groupBy(query_id, "pass", "url").agg(F.min("rank").alias("rank"))
        .withColumn("_at", F.row_number().over(by_rank))
        .filter(F.col("_at") <= top * (F.col("pass") + 1))
    )
    ordered = firsts.groupBy(query_id).agg(
        F.sort_array(F.collect_list(F.struct(F.col("pass").cast("int").alias("pass"), "_at", "url"))).alias("hits")
    )
    start = F.struct(
        F.array().cast("array<struct<pass:int,url:string>>").alias("chosen"),
        F.lit(-1).alias("pass"),
        F.lit(0).alias("taken"),
    )

    def step(acc, h):
        taken = F.when(acc["pass"] == h["pass"], acc["taken"]).otherwise(0)
        known = F.exists(acc["chosen"], lambda c: c["url"] == h["url"])
        take = (taken < top) & ~known
        entry = F.struct(h["pass"].alias("pass"), h["url"].alias("url"))
        return F.struct(
            F.when(take, F.array_append(acc["chosen"], entry)).otherwise(acc["chosen"]).alias("chosen"),
            h["pass"].alias("pass"),
            (taken + take.cast("int")).alias("taken"),
        )

    chosen = F.aggregate("hits", start, step)["chosen"]
    return ordered.select(query_id, F.posexplode(chosen).alias("pos", "c")).select(
        query_id, (F.col("pos") + 1).alias("n"), F.col("c.pass").alias("pass"), F.col("c.url").alias("url")
    )


def evidence_pack(
    hits: DataFrame, pages: DataFrame, scrape_top: int = SCRAPE_TOP, query_id: str = "query_id"
) -> DataFrame:
    """Chosen sources with their page content; failed sources keep their number."""
    body = pages if "error" in pages.columns else pages.withColumn("error", F.lit(None).cast("string"))
    shown = ("url", "title", "status", "markdown", "method", "elapsed_ms", "error")
    body = body.select(*shown, *(c for c in ("fetched_at", "ts", "attempt", "page_id") if c in body.columns))
    missing = F.col("method").isNull()
    # few narrow rows, kept once: they first pick the pages, so that other page text stays put
    sources = cut_lineage(choose_sources(hits, scrape_top, query_id))
    return (
        sources.join(one_capture(pick_rows(body, sources, "url")).select(*shown), "url", "left")
        .withColumn("error", F.when(missing, NOT_ATTEMPTED).otherwise(F.col("error")))
        .withColumn("method", F.when(missing, "error").otherwise(F.col("method")))
    )


def citations(evidence: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Numbers, URLs and titles of the sources that could be read; gaps in ``n`` stay."""
    return evidence.filter(F.col("error").isNull()).select(query_id, "n", "url", "title")
