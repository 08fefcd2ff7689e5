import json

from pyspark.sql import functions as F

from pagemill.plans import playbooks
from pagemill.sources.pages import as_pages, with_expression

LOG = "url string, tier string, attempt int, status int, html string, error string, elapsed_ms int"


def test_rag_ingest(spark, tmp_path):
    pad = "<p>" + "text " * 150 + "</p>"
    rows = [("http://h/", "fast", 1, 200, '<a href="/docs/a">a</a><a href="/tag/b">b</a><a href="/docs/gone">g</a>' + pad, None, 1),
            ("http://h/docs/a", "fast", 1, 200, "<title>A</title>" + pad, None, 1), ("http://h/tag/b", "fast", 1, 200, pad, None, 1)]
    log = spark.createDataFrame(rows, LOG)
    roots = spark.createDataFrame([("http://h/",)], "root string")
    playbooks.rag_ingest(log, roots, str(tmp_path / "out"), F.lit("2024-01-01"), include="/docs/", exclude="/tag/")
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*.json") for x in f.read_text().splitlines()]
    assert [(x["url"], x["title"], x["fetched_at"]) for x in lines] == [("http://h/docs/a", "A", "2024-01-01")]


def test_watch(spark):
    rows = [("u", 1, 1, "a"), ("u", 2, 2, "b"), ("u", 3, 3, "b")]
    snaps = spark.createDataFrame(rows, "url string, s long, snapshot_id long, text string").withColumn("ts", F.timestamp_seconds("s"))
    got = [(r.check_status, r.diff is not None) for r in playbooks.watch(snaps).orderBy("snapshot_id").collect()]
    assert got == [("new", False), ("changed", True), ("unchanged", False)]


def test_user_expression(spark):
    pages = as_pages(spark.createDataFrame([("u", "<p>abc</p>")], "url string, html string"))
    assert with_expression(pages, "upper(markdown)").first()["result"] == "ABC"


def test_research_reads_each_page_once(spark):
    rows = [(f"u{i}", "T", 200, "alpha " * (10 - i) + "beta", "fetch_fast", 1, "down" if i == 1 else None) for i in range(8)]
    pages = spark.createDataFrame(rows, "url string, title string, status int, markdown string, method string, elapsed_ms int, error string")
    asked = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    out = playbooks.deep_research(asked, pages, limit=5, scrape_top=2, iterations=3)
    assert out.hits.count() == 15 and out.queries.count() == 3
    evidence = out.evidence.orderBy("n").collect()
    assert [r.n for r in evidence] == [1, 2, 3, 4, 5] and len({r.url for r in evidence}) == 5
    assert out.citations.count() == 4
