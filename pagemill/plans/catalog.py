"""Registered queries: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from ..operators import batch, cache, crawl, ladder, links, monitor, papers, research, search, selectors, serp, sitemap, usage
from ..session import cut_lineage, scratch_path
from ..sources import documents as docs_source
from ..sources import papers as papers_source
from ..sources.bucketed import BucketedTable
from ..sources.latest import LatestIndex
from ..sources import pages as pages_source
from ..sources.pages import as_pages
from ..sources.pings import check_pings
from ..sources.sinks import SnapshotStore, write_rag_jsonl
from ..streaming import jobs
from . import playbooks
from .views import table, view

QUERIES = {}

# parameters of the registered queries; the reference SQL uses the same ones
AS_OF = "2024-01-30 00:00:00"
AS_OF_DAY = "2024-01-20"
EXTRACTION = {
    "name": "headings",
    "baseSelector": "nav a",
    "fields": [
        {"name": "label", "selector": "", "type": "text"},
        {"name": "href", "selector": "", "type": "attribute", "attribute": "href"},
        {"name": "nothing", "selector": "b.none", "type": "text"},
    ],
}
HEADINGS = {"baseSelector": "article", "fields": [{"name": "heading", "selector": "h1", "type": "text"}]}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _flag(c):
    return c.cast("bigint")


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _timed(df: DataFrame) -> DataFrame:
    """The test tables hold zone-less times; the operators work on instants."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _pages(spark, sf):
    return as_pages(table(spark, sf, "pages"))


def _linked(spark, sf):
    return as_pages(view(spark, sf, "linked_pages"))


def _graph(spark, sf):
    return view(spark, sf, "linked_pages").select("url", "html")


def _snapshots(spark, sf):
    return _timed(view(spark, sf, "snapshots")).withColumnRenamed("event_id", "snapshot_id")


# --- scans and scalar columns -------------------------------------------------


@query
def pages_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("url", "final_url", "title", t.content_hash(F.col("markdown")).alias("markdown_hash"))


@query
def block_flags(spark, sf):
    h, s = F.col("html"), F.col("status")
    return view(spark, sf, "fetch_log").select(
        "url", "tier", _flag(t.is_challenge(h, s)).alias("challenge"), _flag(t.is_block(h, s)).alias("blocked")
    )


@query
def skeleton_flags(spark, sf):
    h = F.col("html")
    return view(spark, sf, "fetch_log").select(
        "url", "tier", _flag(t.is_js_skeleton(h, F.col("status"))).alias("skeleton"),
        F.length(t.visible_text(h)).cast("bigint").alias("visible_chars"),
    )


def _log_lines(spark, sf):
    """The fetch log as JSON lines, every 20th page with a line that was cut off."""
    path = scratch_path(spark, "fetch-log")
    log = view(spark, sf, "fetch_log").withColumn("final_url", F.col("url"))
    line = F.to_json(F.struct("url", "final_url", "tier", "attempt", "status", "html", "error", "elapsed_ms"))
    cut = F.concat(F.lit('{"url": "'), F.col("url"), F.lit('", "tier"'))
    log.select(F.when(F.col("page_id") % 20 == 3, cut).otherwise(line).alias("value")).repartition(6).write.text(path)
    return path


def _log_rows(rows):
    return rows.select(
        "url", "tier", F.col("attempt").cast("bigint").alias("attempt"), F.col("status").cast("bigint").alias("status"), "error",
        t.content_hash(F.col("html")).alias("html_hash"), F.lit(None).cast("string").alias("line"),
    )


@query
def fetch_log_json(spark, sf):
    """Attempts read from JSON lines, and the lines that are none."""
    path = _log_lines(spark, sf)
    good = _log_rows(pages_source.read_fetch_log(spark, path, "json"))
    return good.unionByName(pages_source.fetch_log_rejects(spark, path).select("line"), allowMissingColumns=True)


@query
def stream_fetch_log(spark, sf):
    """The same files as a stream, two a trigger."""
    stream = pages_source.stream_fetch_log(spark, _log_lines(spark, sf), "json", files_per_trigger=2)
    return _run(spark, _log_rows(stream), "log-rows").drop("line")


@query
def rag_lines(spark, sf):
    """Pages written as JSON lines and read back."""
    path = scratch_path(spark, "rag")
    write_rag_jsonl(_pages(spark, sf).withColumn("fetched_at", F.lit("2024-01-01T00:00:00Z")), path)
    lines = spark.read.schema("url string, title string, markdown string, fetched_at string").json(path)
    return lines.select("url", "title", t.content_hash(F.col("markdown")).alias("markdown_hash"), "fetched_at")


@query
def page_expression(spark, sf):
    """A user's expression on every page."""
    return pages_source.with_expression(_pages(spark, sf), "cast(length(markdown) - length(replace(markdown, ' ', '')) as bigint)", "blanks").select("url", "blanks")


@query
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("url", t.page_title(F.col("html")).alias("title"))


@query
def page_text(spark, sf):
    return table(spark, sf, "pages").select("url", t.html_to_text(F.col("html")).alias("text"))


@query
def stripped_tags(spark, sf):
    return table(spark, sf, "pages").select("url", t.strip_tags(F.col("html")).alias("stripped"))


@query
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.content_hash(F.col("text")).alias("hash"))


@query
def cache_keys(spark, sf):
    return table(spark, sf, "pages").select("url", t.cache_key(F.col("url"), F.lit("auto")).alias("key"))


@query
def trim_pages(spark, sf):
    page = _pages(spark, sf).select("url", "markdown", "html")
    out = t.trim_page(page, max_markdown=1000, max_html=6000, include_html=True)
    return out.select(
        "url", "markdown", _flag(F.col("markdown_truncated")).alias("markdown_truncated"), "markdown_full_chars",
        F.length("html").cast("bigint").alias("html_chars"),
    )


@query
def fit_text(spark, sf):
    return table(spark, sf, "pages").select("url", t.fit_text(F.col("html"), 20).alias("fit"))


@query
def url_parts(spark, sf):
    return u.with_url_parts(view(spark, sf, "href_cases"), "href").select(
        "page_id", "form", "scheme", "netloc", "path", "query"
    )


@query
def page_url_filter(spark, sf):
    out = u.with_resolved(view(spark, sf, "href_cases"), "url", "href")
    return out.filter(u.is_page_path(F.col("link_scheme"), F.col("link_path"))).select("page_id", "form")


@query
def resolved_links(spark, sf):
    out = u.with_resolved(view(spark, sf, "href_cases"), "url", "href")
    return out.select("page_id", "form", F.col("link_url").alias("resolved"))


@query
def clean_urls(spark, sf):
    return table(spark, sf, "pages").select("url", u.clean_url(F.col("url")).alias("clean"))


@query
def unwrap_links(spark, sf):
    return view(spark, sf, "redirects").select("doc_id", "href", u.unwrap_redirect(F.col("href")).alias("target"))


@query
def snapshot_keys(spark, sf):
    return (
        table(spark, sf, "pages").groupBy(u.snapshot_key(F.col("url")).alias("file_key"))
        .agg(F.count_distinct("url").alias("urls"))
    )


@query
def snapshot_key_collisions(spark, sf):
    """Different URLs that share a key: long ones, cut after 200 characters, and ones that differ in punctuation."""
    page = table(spark, sf, "pages").select("url", "page_id")
    tail = F.repeat(F.lit("a"), F.lit(200))
    forms = F.array(
        F.col("url"), F.concat("url", F.lit("?"), tail, F.lit("1")), F.concat("url", F.lit("?"), tail, F.lit("2")),
        F.concat("url", F.lit("!~")), F.concat("url", F.lit("~!")), F.concat("url", F.lit("~!"), F.col("page_id").cast("string")),
    )
    urls = page.select(F.explode(forms).alias("url"))
    keyed = urls.groupBy(u.snapshot_key(F.col("url")).alias("file_key")).agg(F.count_distinct("url").alias("urls"), F.min("url").alias("first_url"))
    return keyed.filter("urls > 1")


@query
def path_filter(spark, sf):
    kept = u.path_filter(F.col("url"), r"/(en|fr)/", r"page=\d|#top")
    return table(spark, sf, "pages").filter(kept).select("url")


@query
def latest_version_by_platform(spark, sf):
    return usage.latest_version(view(spark, sf, "pings"))


@query
def doc_types(spark, sf):
    files = view(spark, sf, "files")
    kind = docs_source.doc_type(F.col("url"), F.col("content_type"), F.col("head").cast("binary"))
    return files.select("doc_id", kind.alias("doc_type"))


# --- links, extraction, result pages ------------------------------------------


@query
def page_links(spark, sf):
    return links.extract_links(table(spark, sf, "pages"), keys=("page_id",)).select(
        "page_id", F.col("link_pos").cast("bigint").alias("link_pos"), "link_url"
    )


@query
def extract_links_schema(spark, sf):
    return selectors.extract_structured(table(spark, sf, "pages"), EXTRACTION)


@query
def extract_headings(spark, sf):
    return selectors.extract_structured(table(spark, sf, "pages"), HEADINGS)


@query
def scope_article(spark, sf):
    return selectors.scope_to_selector(_linked(spark, sf), "article").select(
        "url", "title", "html", "markdown", F.col("meta")["css_selector"].alias("css_selector")
    )


@query
def scoped_texts(spark, sf):
    scoped = selectors.scoped_text(F.col("html"), F.col("markdown"), "nav a.k, article h1")
    return _linked(spark, sf).select("url", scoped.alias("text"))


@query
def serp_html(spark, sf):
    pages = view(spark, sf, "serp_pages").select("doc_id", "html")
    return serp.parse_serp(pages, "html").withColumn("rank", F.col("rank").cast("bigint"))


@query
def serp_lite(spark, sf):
    pages = view(spark, sf, "serp_pages").select("doc_id", F.col("lite").alias("html"))
    return serp.parse_serp(pages, "lite").withColumn("rank", F.col("rank").cast("bigint"))


@query
def serp_first_answer(spark, sf):
    """Every third result page is walled off in html form, every ninth in both."""
    walled = view(spark, sf, "serp_pages").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.col("html")).alias("html"),
        F.when(F.col("doc_id") % 9 != 0, F.col("lite")).otherwise(F.col("html")).alias("lite"),
    )
    return serp.parse_serp_first(walled, limit=1).withColumn("rank", F.col("rank").cast("bigint"))


# --- selection, batches, cache ------------------------------------------------


@query
def dedup_urls(spark, sf):
    return batch.dedup_urls(view(spark, sf, "url_list"))


def _ladder(spark, sf, prefer):
    out = ladder.ladder_decisions(view(spark, sf, "fetch_log"), prefer)
    return out.select(
        "url", "tier", F.col("status").cast("bigint").alias("status"), F.col("elapsed_ms").cast("bigint").alias("elapsed_ms"),
        _flag(F.col("notes_fast_error")).alias("notes_fast_error"), "fast_error", "error",
    )


@query
def ladder_choice(spark, sf):
    return _ladder(spark, sf, "auto")


@query
def ladder_fast(spark, sf):
    return _ladder(spark, sf, "fast")


@query
def batch_scrape(spark, sf):
    out = batch.batch_scrape(view(spark, sf, "url_list"), view(spark, sf, "fetch_log"), max_markdown=2000)
    return out.select(
        "pos", "url", "final_url", F.col("status").cast("bigint").alias("status"), "title", "markdown", "method", "error"
    )


def _cached_pages(spark, sf):
    """Every fourth page was put into the cache up to 40 minutes ago."""
    stored = table(spark, sf, "pages").filter("page_id % 4 = 0").select(
        "page_id", "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit("").alias("html"),
        F.concat(F.lit("cached "), F.col("page_id").cast("string")).alias("markdown"), F.lit("Cached").alias("title"),
        F.lit("fetch_fast").alias("method"), F.lit(5).alias("elapsed_ms"),
    )
    put = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("page_id") % 40).cast("int"))
    return cache.cache_entries(stored.withColumn("put", put), F.col("put")).drop("put", "page_id")


@query
def batch_scrape_cached(spark, sf):
    entries = _cached_pages(spark, sf)
    out = batch.batch_scrape(view(spark, sf, "url_list"), view(spark, sf, "fetch_log"), max_markdown=2000, cache=entries, as_of=AS_OF)
    return out.select("pos", "url", "title", "method", "error", F.element_at("meta", "cache").alias("cache"))


def _by_url(spark, rows, label, sort=()):
    return BucketedTable.write(rows, scratch_path(spark, label), sort=sort, buckets=8).read()


@query
def batch_scrape_bucketed(spark, sf):
    """As ``batch_scrape``, over the log stored by URL."""
    log = _by_url(spark, view(spark, sf, "fetch_log"), "log", ("tier", "attempt"))
    out = batch.batch_scrape_bucketed(view(spark, sf, "url_list"), log, max_markdown=2000)
    return out.select(
        "pos", "url", "final_url", F.col("status").cast("bigint").alias("status"), "title", "markdown", "method", "error"
    )


@query
def batch_scrape_bucketed_cached(spark, sf):
    """As ``batch_scrape_cached``, with log and cache stored by URL."""
    log = _by_url(spark, view(spark, sf, "fetch_log"), "log", ("tier", "attempt"))
    entries = _by_url(spark, _cached_pages(spark, sf), "cache", ("put_ts",))
    out = batch.batch_scrape_bucketed(view(spark, sf, "url_list"), log, max_markdown=2000, cache=entries, as_of=AS_OF)
    return out.select("pos", "url", "title", "method", "error", F.element_at("meta", "cache").alias("cache"))


@query
def batch_report(spark, sf):
    return batch.batch_report(view(spark, sf, "url_list"), view(spark, sf, "fetch_log"))


def _cache(spark, sf):
    return _timed(view(spark, sf, "cache_requests")), _timed(view(spark, sf, "cache_puts"))


@query
def cache_asof(spark, sf):
    return cache.cache_lookup(*_cache(spark, sf)).select(
        "k", "event_id", _micros("ts").alias("ts_us"), _micros("put_ts").alias("put_us"), _flag(F.col("hit")).alias("hit")
    )


@query
def cache_asof_sliced(spark, sf):
    """As ``cache_asof``, with keys cut into slices."""
    return cache.cache_lookup(*_cache(spark, sf), group_rows=50).select(
        "k", "event_id", _micros("ts").alias("ts_us"), _micros("put_ts").alias("put_us"), _flag(F.col("hit")).alias("hit")
    )


@query
def cache_compact(spark, sf):
    """A week's ttl, so that the retention cut and not only the expiry decides."""
    out = cache.cache_compact(*_cache(spark, sf), as_of=AS_OF, ttl=7 * 86_400, max_items=100)
    return out.select("k", _micros("touched").alias("touched_us"), _micros("put_ts").alias("put_us"))


@query
def cache_stats(spark, sf):
    return cache.cache_stats(*_cache(spark, sf), ttl=86_400).withColumn("enabled", _flag(F.col("enabled")))


# --- site maps and crawls -----------------------------------------------------


@query
def map_site(spark, sf):
    return sitemap.map_site(table(spark, sf, "pages"), limit=4).withColumn("pos", F.col("pos").cast("bigint"))


@query
def map_site_filtered(spark, sf):
    out = sitemap.map_site(table(spark, sf, "pages"), include="[aeiou]$", limit=2)
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query
def site_overview(spark, sf):
    """Every page as a root: title, text length and its sorted site map."""
    return sitemap.with_site_map(_pages(spark, sf)).select(
        "url", "title", F.length("markdown").cast("bigint").alias("text_chars"),
        F.size("urls").cast("bigint").alias("link_count"), F.array_join("urls", " ").alias("urls"),
    )


@query
def crawl_flat(spark, sf):
    out = crawl.crawl_flat(_graph(spark, sf), max_pages=2, exclude=r"up=1|p0$")
    return out.select("root", F.col("rank").cast("bigint").alias("rank"), "url", "title", "markdown", "error")


def _roots(spark, sf):
    """The first page of every host in the graph."""
    home = F.concat(F.lit("https://"), F.col("host"), F.lit("/p0"))
    return view(spark, sf, "linked_pages").select(home.alias("root")).distinct()


@query
def crawl_bfs(spark, sf):
    out = crawl.crawl_bfs(
        _graph(spark, sf), _roots(spark, sf), max_pages=20, max_depth=4, exclude="p5$", css_selector="article"
    )
    return out.select(
        "root", F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"), "url", "title",
        "markdown", "error",
    )


@query
def crawl_bfs_every_page(spark, sf):
    """Each page of the link graph as a root."""
    pages = _graph(spark, sf)
    out = crawl.crawl_levels(pages, pages.select(F.col("url").alias("root")), max_pages=12, max_depth=3)
    return out.select("root", F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"), "url")


def _recaptured(spark, sf):
    return view(spark, sf, "recaptured_pages").select("page_id", "url", "html")


@query
def crawl_recaptured_flat(spark, sf):
    """Every page was captured before: the newest capture counts, once."""
    out = crawl.crawl_flat(_recaptured(spark, sf), max_pages=2, exclude=r"up=1|p0$")
    return out.select("root", F.col("rank").cast("bigint").alias("rank"), "url", "title", "markdown", "error")


@query
def crawl_recaptured(spark, sf):
    out = crawl.crawl_bfs(
        _recaptured(spark, sf), _roots(spark, sf), max_pages=20, max_depth=4, exclude="p5$", css_selector="article"
    )
    return out.select(
        "root", F.col("depth").cast("bigint").alias("depth"), F.col("rank").cast("bigint").alias("rank"), "url", "title",
        "markdown", "error",
    )


@query
def crawl_errors(spark, sf):
    pages = _graph(spark, sf)
    return crawl.crawl_errors(crawl.crawl_bfs(pages, _roots(spark, sf), max_pages=1000, max_depth=3))


# --- search, research, papers -------------------------------------------------


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query
def search_bm25(spark, sf):
    out = search.search_corpus(_asked(spark, sf), table(spark, sf, "documents"), limit=5)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query
def search_index(spark, sf):
    """An index is written once and searched twice: by the benchmark texts, and by their first three words; always pruned."""
    index = search.SearchIndex.write(table(spark, sf, "documents"), scratch_path(spark, "search-index"))
    asked = _asked(spark, sf)
    short = asked.select("query_id", F.substring_index("query", " ", 3).alias("query"))
    found = index.search(asked, limit=5, prune_pairs=0).withColumn("pass", F.lit(0)).unionByName(
        index.search(short, limit=5, prune_pairs=0).withColumn("pass", F.lit(1))
    )
    return found.select("query_id", F.col("pass").cast("bigint").alias("pass"), F.col("rank").cast("bigint").alias("rank"), "doc_id", "score")


@query
def search_snippets(spark, sf):
    docs = table(spark, sf, "documents")
    hits = search.search_corpus(_asked(spark, sf), docs, limit=1)
    return search.with_hit_text(hits, docs).select("query_id", "doc_id", "snippet")


@query
def expand_queries(spark, sf):
    return research.expand_queries(_asked(spark, sf), 3).withColumn("pass", F.col("pass").cast("bigint"))


def _hits(spark, sf):
    """Ranked hits of every event user: three passes that repeat each other's URLs."""
    seen = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return seen.select(
        F.col("user_id").alias("query_id"),
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pass"),
        "event_type", "first",
    ).select(
        "query_id", "pass",
        (F.col("first") * (F.col("pass") * 2 + 1) % 101).alias("rank"),
        F.concat(F.lit("https://s.test/d"), (F.col("first") % 50).cast("string")).alias("url"),
    )


@query
def evidence_pack(spark, sf):
    out = research.evidence_pack(_hits(spark, sf), view(spark, sf, "doc_pages"), scrape_top=2)
    return out.select(
        "query_id", F.col("n").cast("bigint").alias("n"), F.col("pass").cast("bigint").alias("pass"), "url", "title",
        F.col("status").cast("bigint").alias("status"), t.content_hash(F.col("markdown")).alias("markdown_hash"), "method", "error",
    )


@query
def citations(spark, sf):
    out = research.citations(research.evidence_pack(_hits(spark, sf), view(spark, sf, "doc_pages"), scrape_top=2))
    return out.withColumn("n", F.col("n").cast("bigint"))


@query
def evidence_six_passes(spark, sf):
    """Six passes that find the same URLs: each gives the best one that is left."""
    seen = table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pass"),
        (F.col("event_id") % 101).alias("rank"), F.concat(F.lit("https://s.test/d"), (F.col("event_id") % 23).cast("string")).alias("url"),
    )
    out = research.choose_sources(seen, scrape_top=1)
    return out.select("query_id", F.col("n").cast("bigint").alias("n"), F.col("pass").cast("bigint").alias("pass"), "url")


@query
def deep_research(spark, sf):
    out = playbooks.deep_research(_asked(spark, sf), view(spark, sf, "doc_pages"), limit=5, scrape_top=2, iterations=3)
    return out.citations.withColumn("n", F.col("n").cast("bigint"))


def _papers(spark, sf):
    return view(spark, sf, "papers").withColumn("categories", F.array("category"))


@query
def search_papers(spark, sf):
    return papers.search_papers(_papers(spark, sf), "the and", limit=25).select("id", "title")


@query
def search_papers_many(spark, sf):
    """Phrases of three words and lists of six, taken from every 20th document, over one table of postings."""
    words = search.tokens(F.col("text"))
    asked = table(spark, sf, "documents").filter("doc_id % 20 = 0").select(
        F.explode(F.array(
            F.struct(F.concat("doc_id", F.lit("p")).alias("query_id"), F.array_join(F.slice(words, 3, 3), " ").alias("query")),
            F.struct(F.concat("doc_id", F.lit("w")).alias("query_id"), F.array_join(F.slice(words, 2, 6), " ").alias("query")),
        )).alias("q")
    ).select("q.*")
    path = scratch_path(spark, "paper-postings")
    papers.paper_postings(_papers(spark, sf)).write.option("compression", "zstd").parquet(path)
    out = papers.search_papers_many(spark.read.parquet(path), asked, limit=25)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query
def search_papers_words(spark, sf):
    out = papers.search_papers(_papers(spark, sf), 'of "the" and in on', limit=9, category="cs.CV")
    return out.select("id", "title")


@query
def arxiv_entries(spark, sf):
    """Every document wrapped as an Atom feed of one entry."""
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), _entry(), F.lit("</feed>"))
    feeds = table(spark, sf, "documents").select("doc_id", feed.alias("xml"))
    return _flat_papers(papers_source.parse_arxiv(feeds))


def _entry():
    """A document as an Atom entry; what XML does not allow in its text is escaped."""
    words = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        words = F.replace(words, F.lit(sign), F.lit(name))
    d, k = F.col("doc_id").cast("string"), F.lit
    return F.concat(
        k('<entry><id>http://a.test/abs/'), d, k("v1</id><title> "), F.col("source"),
        k("\n  paper </title><summary>"), words, k("</summary><published>2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"),
        k('</published><author><name> A '), F.col("lang"), k(' </name></author><author><name>B</name></author><category term="cs.'),
        F.col("lang"), k('"/><link href="http://a.test/abs/x"/><link title="pdf" href="http://a.test/pdf/'), d, k('"/></entry>'),
    )


@query
def arxiv_feed_scan(spark, sf):
    """The documents as feed files, an entry a line and every 50th cut off; scanned by entry."""
    path = scratch_path(spark, "feeds")
    whole = F.when(F.col("doc_id") % 50 != 7, F.regexp_replace(_entry(), "[\\r\\n]", " "))
    broken = F.concat(F.lit("<entry><id>http://a.test/abs/"), F.col("doc_id").cast("string"), F.lit("</title></entry>"))
    table(spark, sf, "documents").select(F.coalesce(whole, broken).alias("value")).write.text(path)
    return papers_source.read_arxiv_feeds(spark, path).select(
        "id", "url", "pdf_url", "title", F.array_join("authors", "; ").alias("authors"), "summary", "published",
        F.array_join("categories", "; ").alias("categories"), "error", "unread",
    )


@query
def crossref_entries(spark, sf):
    """Every document wrapped as a JSON answer of one work."""
    item = F.struct(
        F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("DOI"),
        F.array("source", "lang").alias("title"),
        F.array(F.struct(F.lit("Ann").alias("given"), F.col("lang").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit("Group").alias("family"))).alias("author"),
        F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("abstract"),
        F.struct(F.array(F.when(F.col("doc_id") % 4 > 0, F.array(F.lit(2024), (F.col("doc_id") % 12 + 1).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("date-parts")).alias("issued"),
    )
    body = F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message")))
    answers = table(spark, sf, "documents").select("doc_id", body.alias("json"))
    return _flat_papers(papers_source.parse_crossref(answers))


def _flat_papers(df):
    return df.select(
        "doc_id", "id", "url", "pdf_url", "title", F.array_join("authors", "; ").alias("authors"), "summary", "published",
        F.array_join("categories", "; ").alias("categories"), "error",
    )


# --- change detection ---------------------------------------------------------


@query
def monitor_status(spark, sf):
    out = monitor.monitor_check(_snapshots(spark, sf))
    return out.select("url", "snapshot_id", "hash", "check_status", "prev_id")


@query
def monitor_status_sliced(spark, sf):
    """As ``monitor_status``, with keys cut into slices."""
    out = monitor.monitor_check(_snapshots(spark, sf), group_rows=50)
    return out.select("url", "snapshot_id", "hash", "check_status", "prev_id")


@query
def snapshot_store_round(spark, sf):
    """Two rounds of fetches through the store: checked, stored, forgotten for some, compacted, read."""
    store = SnapshotStore(spark, scratch_path(spark, "snapshots"))
    log = view(spark, sf, "fetch_log")
    playbooks.check_round(store, log, "2024-01-01 00:00:00")
    page = F.col("page_id")
    later = log.filter("page_id % 9 > 0").withColumn(
        "html", F.when(page % 4 == 0, F.concat("html", F.lit("<p>added line</p>"))).otherwise(F.col("html"))
    )
    checks = cut_lineage(playbooks.check_round(store, later, "2024-01-02 00:00:00"))
    store.forget(log.filter("page_id % 7 = 0").select("url").distinct(), "2024-01-01 12:00:00")
    store.compact(keep=1)
    kept = store.read().select("url", F.date_format("ts", "yyyy-MM-dd").alias("kept_day"), "hash")
    return checks.join(kept, "url", "full").select(
        "url", "check_status", "error", F.col("lines_added").cast("bigint").alias("lines_added"), "kept_day", "hash"
    )


@query
def latest_hashes(spark, sf):
    """Three rounds of checks into the index of latest hashes, some URLs forgotten after the second; then what it knows."""
    index = LatestIndex(spark, scratch_path(spark, "latest"))
    checks = _snapshots(spark, sf).select("url", "ts", "snapshot_id", t.content_hash(F.col("text")).alias("hash"), F.lit(False).alias("forgotten"))
    for n in range(3):
        found = checks.filter(F.pmod("snapshot_id", F.lit(3)) == n)
        gone = found.groupBy("url").agg(F.max("ts").alias("ts")).filter("url LIKE '%7'").select(
            "url", "ts", F.lit(None).cast("bigint").alias("snapshot_id"), F.lit(None).cast("string").alias("hash"), F.lit(True).alias("forgotten")
        )
        index.put(found if n != 1 else found.unionByName(gone), n)
    return index.latest(3).select("url", _micros("ts").alias("ts_us"), "snapshot_id", "hash")


@query
def monitor_line_delta(spark, sf):
    out = monitor.line_delta(_snapshots(spark, sf))
    return out.select(
        "url", "snapshot_id", F.col("lines_added").cast("bigint").alias("lines_added"),
        F.col("lines_removed").cast("bigint").alias("lines_removed"),
    )


@query
def monitor_diffs(spark, sf):
    out = monitor.unified_diffs(_snapshots(spark, sf))
    return out.select("url", "snapshot_id", "diff", _flag(F.col("diff_truncated")).alias("diff_truncated"))


@query
def monitor_history(spark, sf):
    asked = table(spark, sf, "events").select(
        F.concat(F.lit("https://watch.test/"), (F.col("user_id") * 2).cast("string")).alias("url")
    )
    out = monitor.monitor_history(_snapshots(spark, sf), asked)
    return out.select("url", "snapshot_id", F.col("age_rank").cast("bigint").alias("age_rank"), "history_status")


@query
def snapshot_retention(spark, sf):
    out = monitor.snapshot_retention(_snapshots(spark, sf))
    return out.select("url", "snapshot_id", F.col("age_rank").cast("bigint").alias("age_rank"))


@query
def monitor_forget(spark, sf):
    gone = table(spark, sf, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("https://watch.test/"), (F.col("user_id") + 5).cast("string")).alias("url")
    )
    return monitor.forget(_snapshots(spark, sf), gone).select("url", "snapshot_id")


@query
def monitors_overview(spark, sf):
    out = monitor.monitors_overview(_snapshots(spark, sf))
    return out.select(
        "url", _micros("last_checked").alias("last_us"), F.col("status_code").cast("bigint").alias("status_code"),
        F.col("snapshots").cast("bigint").alias("snapshots"),
    )


# --- usage --------------------------------------------------------------------


def _pings(spark, sf):
    return _timed(view(spark, sf, "pings"))


@query
def pings_valid(spark, sf):
    posts = view(spark, sf, "ping_posts").withColumn("received_at", F.col("received_at").cast("timestamp"))
    out = check_pings(posts)
    ok = F.col("reject_reason").isNull()
    return out.select(
        "event_id", *(F.when(ok, F.col(c)).alias(c) for c in ("id", "version", "python", "platform")),
        F.when(ok, F.unix_seconds("ts")).alias("ts_s"), "reject_reason",
    )


@query
def active_users(spark, sf):
    return usage.active_users(_pings(spark, sf))


@query
def active_users_sketched(spark, sf):
    """Estimates from daily sketches, the last five days added later; is each within three errors of the exact count?"""
    pings = _pings(spark, sf)
    late = F.col("ts") >= F.lit("2024-01-26").cast("timestamp")
    sketches = usage.merged_sketches(usage.daily_sketches(pings.filter(~late)), usage.daily_sketches(pings.filter(late)))
    found = usage.active_users_sketched(sketches, "2024-01-30")
    age = F.datediff(F.lit("2024-01-30").cast("date"), F.to_date("ts"))
    exact = pings.agg(*(F.count_distinct(F.when((age >= 0) & (age < d), F.col("id"))).alias(n) for n, d in usage.ACTIVE_DAYS.items()), F.count_distinct("id").alias("total_unique"))
    names = [*usage.ACTIVE_DAYS, "total_unique"]
    truth = exact.select(F.explode(F.array(*(F.struct(F.lit(n).alias("period"), F.col(n).alias("exact")) for n in names))).alias("x")).select("x.*")
    near = F.abs(F.coalesce("users", F.lit(0)) - F.col("exact")) <= 3 * usage.SKETCH_ERROR * F.col("exact")
    return truth.join(found, "period", "left").select("period", "exact", _flag(near).alias("near"))


@query
def users_by_version(spark, sf):
    return usage.users_by(_pings(spark, sf), "version", top=usage.TOP_VERSIONS)


@query
def users_by_platform(spark, sf):
    return usage.users_by(_pings(spark, sf), "platform")


@query
def daily_users(spark, sf):
    return usage.daily_users(_pings(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query
def download_summary(spark, sf):
    return usage.download_summary(view(spark, sf, "downloads"), AS_OF_DAY)


@query
def download_badge(spark, sf):
    return usage.download_badge(view(spark, sf, "downloads"), AS_OF_DAY)


@query
def traffic_summary(spark, sf):
    """Daily rows folded into one series per kind, as a traffic report holds it."""
    daily = view(spark, sf, "traffic")
    series = daily.groupBy("kind").agg(
        F.sum("uniques").alias("uniques"), F.collect_list(F.struct(F.col("cnt").alias("count"))).alias("series")
    )
    return usage.traffic_summary(series)


@query
def ping_cooldown(spark, sf):
    return usage.cooldown(_pings(spark, sf))


@query
def ping_cooldown_far(spark, sf):
    """Pings without an id, and others thousands of years apart."""
    pings = _pings(spark, sf).select(F.when(F.col("event_id") % 89 > 0, F.col("id")).alias("id"), "ts")
    far = pings.select("id").distinct().select("id", F.explode(F.array(F.lit(1), F.lit(250_000_000_000))).alias("s"))
    return usage.cooldown(pings.unionByName(far.select("id", F.timestamp_seconds("s").alias("ts"))))


@query
def sessions(spark, sf):
    out = usage.sessions(_timed(table(spark, sf, "events")), as_of=AS_OF)
    return out.select(
        "user_id", "session_no", _micros("session_start").alias("start_us"), _micros("session_end").alias("end_us"), "events",
        "idle_seconds", _flag(F.col("expired")).alias("expired"),
    )


# --- streams, run over what is there ------------------------------------------


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def _event_stream(spark, sf):
    return _timed(_stream(spark, sf, "events"))


def _run(spark, stream, label):
    return jobs.run_available(stream, scratch_path(spark, label))


def _snapshot_stream(spark, sf):
    return _event_stream(spark, sf).select(
        F.concat(F.lit("https://watch.test/"), F.col("user_id").cast("string")).alias("url"), "ts",
        F.col("event_id").alias("snapshot_id"),
        F.when(F.col("event_id") % 13 != 5, F.concat("event_type", F.lit("\nstatic line"))).alias("text"),
        F.when(F.col("event_id") % 13 == 5, "timeout").alias("error"),
    )


@query
def stream_page_changes(spark, sf):
    out = _run(spark, jobs.page_changes(_snapshot_stream(spark, sf)), "page-changes")
    return out.select("url", "snapshot_id", "hash", "check_status")


@query
def stream_page_changes_by_batch(spark, sf):
    out = jobs.run_page_changes(_snapshot_stream(spark, sf), scratch_path(spark, "page-changes-by-batch"))
    return out.select("url", "snapshot_id", "hash", "check_status")


def _ping_stream(spark, sf):
    return _event_stream(spark, sf).select(
        F.when(F.col("event_id") % 97 == 0, "not-hex")
        .otherwise(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 16)).alias("id"),
        "ts",
    )


@query
def stream_ping_cooldown(spark, sf):
    return _run(spark, jobs.ping_cooldown(_ping_stream(spark, sf)), "cooldown")


@query
def stream_daily_actives(spark, sf):
    """Closed days only: does the sketch's estimate lie within three times its error of the exact count?"""
    out = _run(spark, jobs.daily_actives(_ping_stream(spark, sf)), "daily")
    exact = _pings(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("id").alias("exact"))
    near = F.abs(F.col("users") - F.col("exact")) <= 0.15 * F.col("exact")
    return out.join(exact, "day").select(F.col("day").cast("string").alias("day"), _flag(near).alias("near"))


@query
def stream_daily_actives_exact(spark, sf):
    out = _run(spark, jobs.daily_actives_exact(_ping_stream(spark, sf)), "daily-exact")
    return out.withColumn("day", F.col("day").cast("string"))


@query
def stream_sessions(spark, sf):
    out = _run(spark, jobs.session_stream(_event_stream(spark, sf)), "sessions")
    return out.select("user_id", _micros("session_start").alias("start_us"), _micros("session_end").alias("end_us"), "events")


@query
def stream_attempt_checks(spark, sf):
    answered = view(spark, sf, "fetch_log", _stream).filter(F.col("error").isNull())
    out = _run(spark, jobs.attempt_checks(answered), "checks")
    return out.select(
        "url", "tier", "title", _flag(F.col("blocked")).alias("blocked"), _flag(F.col("skeleton")).alias("skeleton"),
        F.size("links").cast("bigint").alias("link_count"),
    )


@query
def stream_first_seen(spark, sf):
    listed = view(spark, sf, "url_list", _stream).select(u.strip_space(F.col("raw_url")).alias("url")).filter("url <> ''")
    return _run(spark, jobs.first_seen(listed), "first-seen").select("clean_url")
