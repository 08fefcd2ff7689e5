"""Derived inputs in SQL that Spark and DuckDB read alike.

The corpus has no blocked pages, no failed fetches and no resolving links, so fetch
logs, link graphs, snapshots and pings are derived from whole tables here.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

TABLES = ("pages", "documents", "events", "benchmark")

VIEWS = {
    # two attempts per page with blocks, shells, short answers and failures
    "fetch_log": """
SELECT page_id, url, 'fast' AS tier, 1 AS attempt,
  CASE WHEN page_id % 10 = 8 THEN NULL WHEN page_id % 10 = 3 THEN 403 WHEN page_id % 10 = 7 THEN 503
       WHEN page_id % 25 = 4 THEN 404 ELSE 200 END AS status,
  CASE WHEN page_id % 10 = 8 THEN NULL
       WHEN page_id % 10 = 5 THEN concat('<html><title>Just a moment...</title>', html)
       WHEN page_id % 10 = 6 THEN concat('<html><script>', repeat('var x=1;', 700), '</script><body><div id="app"></div></body></html>')
       WHEN page_id % 10 = 9 THEN '<html><body>short</body></html>' ELSE html END AS html,
  CASE WHEN page_id % 10 = 8 THEN 'timeout' END AS error,
  CAST(100 + page_id % 400 AS INT) AS elapsed_ms FROM pages
UNION ALL
SELECT page_id, url, 'stealth', 1,
  CASE WHEN page_id % 20 IN (8, 17) THEN NULL WHEN page_id % 30 IN (3, 18) THEN 403 ELSE 200 END,
  CASE WHEN page_id % 20 IN (8, 17) THEN NULL ELSE html END,
  CASE WHEN page_id % 20 IN (8, 17) THEN 'browser crashed' END,
  CAST(2000 + page_id % 900 AS INT) FROM pages""",
    # duplicates, padding, blanks
    "url_list": """
SELECT page_id AS pos, url AS raw_url FROM pages
UNION ALL SELECT page_id + 1000000, concat('  ', url, ' ') FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id + 2000000, '' FROM pages WHERE page_id % 50 = 0
UNION ALL SELECT page_id + 3000000, concat(url, '/absent') FROM pages WHERE page_id % 40 = 0""",
    # seven hosts with tree links, back links, junk links and missing targets
    "linked_pages": """
SELECT page_id, host, r, concat('https://', host, '/p', CAST(r AS STRING)) AS url,
  concat('<html><head><title>Page ', CAST(r AS STRING), '</title><link rel="stylesheet" href="/s.css"></head><body><nav><a href="/p',
    CAST(2 * r + 1 AS STRING), '">l</a><a class="k" href="p', CAST(2 * r + 2 AS STRING), '#x">r</a><a href="/p',
    CAST(CAST(floor((r + 1) / 2.0) AS BIGINT) - 1 AS STRING),
    CASE WHEN r % 2 = 0 THEN '?up=1' ELSE '' END,
    '">u</a><a href="/x.zip">z</a><a href="https://other.test/p1">o</a><a href="mailto:a@b.c">m</a></nav><article><h1>Page ',
    CAST(r AS STRING), '</h1></article></body></html>') AS html
FROM (SELECT page_id, concat('h', CAST(page_id % 7 AS STRING), '.test') AS host, CAST(floor(page_id / 7.0) AS BIGINT) AS r FROM pages) t""",
    # hrefs of every form against every page
    "href_cases": """
SELECT page_id, url, 0 AS form, concat('../up', CAST(page_id AS STRING), '/./x.html?q=1#f') AS href FROM pages
UNION ALL SELECT page_id, url, 1, '/a/../b//c;p=1' FROM pages
UNION ALL SELECT page_id, url, 2, concat('d', CAST(page_id AS STRING), '//e/') FROM pages
UNION ALL SELECT page_id, url, 3, '?only=query' FROM pages
UNION ALL SELECT page_id, url, 4, '//other.test/z#q' FROM pages
UNION ALL SELECT page_id, url, 5, 'HTTPS://Case.test/A/../B' FROM pages
UNION ALL SELECT page_id, url, 6, '../../../..' FROM pages
UNION ALL SELECT page_id, url, 7, concat('file', CAST(page_id AS STRING), '.PDF') FROM pages
UNION ALL SELECT page_id, url, 8, '/img/logo.WEBP?v=2' FROM pages""",
    # every page captured before with other links, and after that once more as it is
    "recaptured_pages": """
SELECT page_id, host, r, url, html FROM linked_pages
UNION ALL SELECT page_id - 1000000, host, r, url, concat('<html><title>Old</title><a href="/p', CAST(r + 3 AS STRING), '">old</a></html>') FROM linked_pages
UNION ALL SELECT page_id - 2000000, host, r, url, html FROM linked_pages WHERE r % 3 = 0""",
    "redirects": """
SELECT doc_id, concat('//duckduckgo.com/l/?x=1&uddg=https%3A%2F%2Fs.test%2Fd', CAST(doc_id AS STRING), '%3Fa%3D1%252B2&rut=1') AS href FROM documents
UNION ALL SELECT doc_id, concat(' //p.test/', source, ' ') FROM documents
UNION ALL SELECT doc_id, 'https://duckduckgo.com/l/?rut=1' FROM documents
UNION ALL SELECT doc_id, concat('https://x.test/', lang) FROM documents
UNION ALL SELECT doc_id, concat('#', lang) FROM documents
UNION ALL SELECT doc_id, 'mailto:a@b.c' FROM documents""",
    "snapshots": """
SELECT event_id, concat('https://watch.test/', CAST(user_id AS STRING)) AS url, ts, 200 AS status,
  concat(event_type, chr(10), 'static line') AS text FROM events""",
    "cache_puts": "SELECT event_id, user_id AS k, ts FROM events WHERE event_type = 'click'",
    "cache_requests": "SELECT event_id, user_id AS k, ts FROM events WHERE event_type = 'view'",
    "pings": """
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'not-hex' ELSE substr(md5(CAST(user_id AS STRING)), 1, 16) END AS id,
  concat('0.', CAST(user_id % 12 AS STRING), '.', CAST(event_id % 3 AS STRING)) AS version, '3.13.0' AS python,
  CASE WHEN user_id % 3 = 0 THEN 'linux' WHEN user_id % 3 = 1 THEN 'darwin' ELSE 'windows' END AS platform, ts FROM events""",
    # posted bodies: good, bad id, bad json, too large, no time
    "ping_posts": """
SELECT event_id, ts AS received_at,
  CASE WHEN event_id % 11 = 1 THEN '{not json'
       WHEN event_id % 11 = 2 THEN concat('{"id": "', repeat('a', 5000), '"}')
       WHEN event_id % 11 = 3 THEN concat('{"id": "XY', CAST(user_id AS STRING), '", "version": "1"}')
       WHEN event_id % 11 = 4 THEN concat('{"id": "', md5(CAST(user_id AS STRING)), md5(CAST(event_id AS STRING)), 'zz", "ts": 0}')
       ELSE concat('{"id": "', md5(CAST(user_id AS STRING)), '", "version": "0.', CAST(user_id % 12 AS STRING), repeat('9', 40),
            '", "python": "3.13.0", "platform": "linux", "ts": ', CAST(1700000000 + event_id AS STRING), '}') END AS body
FROM events""",
    "downloads": """
SELECT CASE WHEN event_id % 3 = 0 THEN 'without_mirrors' ELSE 'with_mirrors' END AS category, CAST(ts AS DATE) AS dl_date,
  count(*) AS downloads FROM events GROUP BY 1, 2""",
    "traffic": """
SELECT CASE WHEN event_type = 'view' THEN 'views' ELSE 'clones' END AS kind, CAST(ts AS DATE) AS day, count(*) AS cnt,
  count(DISTINCT user_id) AS uniques FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2""",
    # one result page per document, both layouts
    "serp_pages": """
SELECT doc_id, concat('<a rel="nofollow" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fs.test%2Fd', CAST(doc_id AS STRING),
    '&rut=1">T <b>', lang, '</b></a><a class="result__snippet" href="#">', text,
    '</a><a class="result__a" href="#">skip</a><a class="result__snippet">s</a>',
    '<a class="result__a" href="//p.test/', source, '">U</a><a class="result__snippet">v</a>') AS html,
  concat('<a rel="nofollow" href="#">skip</a><td class="result-snippet">s0</td><a rel="nofollow" href="https://s.test/d', CAST(doc_id AS STRING),
    '">T ', lang, '</a><td class="result-snippet">', text, '</td><a rel="nofollow" href="//p.test/', source, '">U</a>') AS lite
FROM documents""",
    "papers": """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'arxiv' ELSE 'crossref' END AS source, CAST(doc_id AS STRING) AS id, text AS title,
  concat(lang, ' ', text) AS summary,
  CASE WHEN doc_id % 3 = 0 THEN 'cs.LG' WHEN doc_id % 3 = 1 THEN 'cs.CV' ELSE 'math.ST' END AS category FROM documents""",
    # documents as fetched pages, some of them failed
    "doc_pages": """
SELECT doc_id, concat('https://s.test/d', CAST(doc_id AS STRING)) AS url, concat('T ', source) AS title,
  CASE WHEN doc_id % 7 = 3 THEN NULL ELSE 200 END AS status, text AS markdown, 'fetch_fast' AS method, 10 AS elapsed_ms,
  CASE WHEN doc_id % 7 = 3 THEN 'timeout' END AS error FROM documents""",
    "files": """
SELECT doc_id, concat('https://f.test/', source, CASE WHEN doc_id % 5 = 0 THEN '/a.PDF' WHEN doc_id % 5 = 1 THEN '/b.docx?v=1'
    WHEN doc_id % 5 = 2 THEN '/c.x/raw' WHEN doc_id % 5 = 3 THEN '/d.pptx#s' ELSE '/e' END) AS url,
  CASE WHEN doc_id % 10 = 2 THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation'
       WHEN doc_id % 10 = 9 THEN 'application/pdf' ELSE 'text/plain' END AS content_type,
  CASE WHEN doc_id % 10 = 4 THEN concat('%PDF-1.7 ', lang) ELSE lang END AS head FROM documents""",
}

_READS = re.compile(r"\b(FROM|JOIN) (" + "|".join((*TABLES, *VIEWS)) + r")\b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, read=table) -> DataFrame:
    """A derived view as a DataFrame, without registering anything in the session. ``read`` may give streams."""
    sql = VIEWS[name]
    used = sorted({m[2] for m in _READS.finditer(sql)})
    inputs = {t: view(spark, sf_dir, t, read) if t in VIEWS else read(spark, sf_dir, t) for t in used}
    escaped = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(_READS.sub(r"\1 {\2}", escaped), **inputs)


def with_views(sql: str, *names: str) -> str:
    """The same views as common table expressions in front of a DuckDB query."""
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    body = reduce(lambda s, w: s.removeprefix(w), ("WITH RECURSIVE ", "WITH "), sql.strip())
    joiner = ", " if body != sql.strip() else " "
    return f"WITH {recursive}{heads}{joiner}{body}"
