"""DuckDB SQL for the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

from ..functions.text import CHALLENGE_MARKERS as MARKERS
from ..functions.urls import ASSET_EXTENSIONS as ASSETS
from .views import with_views

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def rep(x, pattern, by):
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def collapse(x):
    return f"trim({rep(x, WS + '+', ' ')}, ' ')"


def strip_tags(x):
    return collapse(rep(f"coalesce({x}, '')", "<[^>]+>", " "))


def title(x):
    return f"nullif({strip_tags(f'''regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, '')"


def without_code(x):
    body = f"coalesce({x}, '')"
    for tag in ("script", "style"):
        body = rep(body, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return body


def entities(x):
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def page_text(x):
    return collapse(entities(rep(without_code(x), "<[^>]+>", " ")))


def visible(x):
    body = f"coalesce({x}, '')"
    for tag in ("script", "style", "noscript"):
        body = rep(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}{WS}*>", " ")
    return collapse(rep(body, "<[^>]+>", " "))


def challenge(h="html", s="status"):
    marks = " OR ".join(f"contains({h}, '{m}')" for m in MARKERS)
    return f"(coalesce({s} IN (403, 503), false) OR coalesce({marks}, false))"


def block(h="html", s="status"):
    return f"(coalesce({s} >= 400, false) OR {challenge(h, s)})"


def skeleton(h="html", s="status"):
    return f"coalesce({s} < 400 AND length({h}) > 5000 AND length({visible(h)}) < 250, false)"


def part(x, n):
    return f"regexp_extract({x}, '{URI}', {n})"


def no_params(path):
    return f"regexp_replace({path}, ';[^/]*$', '')"


def clean(x):
    q = part(x, 4)
    return f"lower({part(x, 1)}) || '://' || {part(x, 2)} || {no_params(part(x, 3))} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END"


def is_page(scheme, path):
    names = ", ".join(f"'{a}'" for a in ASSETS)
    return f"({scheme} IN ('http', 'https') AND lower(regexp_extract({path}, '\\.([^./]*)$', 1)) NOT IN ({names}))"


def resolve_ctes(source, base, href):
    """Steps from (base, href) to a resolved scheme, netloc, path and query, as CTEs ending in ``resolved``."""
    return f"""
split0 AS (SELECT *, lower({part(base, 1)}) AS bs, {part(base, 2)} AS bn, {no_params(part(base, 3))} AS bp, {part(base, 4)} AS bq,
  lower({part(href, 1)}) AS hs, {part(href, 2)} AS hn, {no_params(part(href, 3))} AS hp, {part(href, 3)} AS hraw, {part(href, 4)} AS hq
  FROM {source}),
split1 AS (SELECT *, (hn <> '' OR (hs <> '' AND hs <> bs)) AS own FROM split0),
joined AS (SELECT *,
  CASE WHEN hp LIKE '/%' THEN hp
       ELSE regexp_replace(CASE WHEN regexp_replace(bp, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(bp, '[^/]*$', '') END || hp, '/+', '/', 'g') END AS jp
  FROM split1),
dotted AS (SELECT *,
  CASE WHEN regexp_matches(jp, '(^|/)\\.\\.?(/|$)') THEN
    list_reduce(string_split(jp, '/')[2:], lambda acc, s:
      CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE acc || '/' || s END, '')
      || CASE WHEN regexp_matches(jp, '(^|/)\\.\\.?$') THEN '/' ELSE '' END
    ELSE jp END AS dp FROM joined),
resolved AS (SELECT *, CASE WHEN hs <> '' THEN hs ELSE bs END AS rs, CASE WHEN own THEN hn ELSE bn END AS rn,
  CASE WHEN own THEN hp WHEN hraw = '' THEN bp WHEN dp = '' THEN '/' ELSE dp END AS rp,
  CASE WHEN NOT own AND hraw = '' AND hq = '' THEN bq ELSE hq END AS rq FROM dotted)"""


RESOLVED_URL = "rs || '://' || rn || rp || CASE WHEN rq <> '' THEN '?' || rq ELSE '' END"
HREFS = """regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref=["'']([^"'']+)["'']', 1)"""


def link_ctes(source, key):
    """Kept internal links of ``source`` as the CTE ``kept`` (key, url, pos, link)."""
    return f"""
hrefs0 AS (SELECT {key}, url, unnest({HREFS}) AS h, generate_subscripts({HREFS}, 1) AS pos FROM {source}),
hrefs AS (SELECT {key}, url, trim(h) AS href, pos FROM hrefs0
  WHERE trim(h) <> '' AND NOT regexp_matches(trim(h), '^(#|javascript:|mailto:|tel:)')),
{resolve_ctes('hrefs', 'url', 'href')},
kept AS (SELECT {key}, url, pos, {RESOLVED_URL} AS link FROM resolved
  WHERE (bn = '' OR rn = bn) AND {is_page('rs', 'rp')})"""


ORACLES = {}

ORACLES["pages_scan"] = f"SELECT url, url AS final_url, {title('html')} AS title, sha256({page_text('html')}) AS markdown_hash FROM pages"
ORACLES["block_flags"] = with_views(
    f"SELECT url, tier, CAST({challenge()} AS BIGINT) AS challenge, CAST({block()} AS BIGINT) AS blocked FROM fetch_log", "fetch_log"
)
ORACLES["skeleton_flags"] = with_views(
    f"SELECT url, tier, CAST({skeleton()} AS BIGINT) AS skeleton, length({visible('html')}) AS visible_chars FROM fetch_log", "fetch_log"
)
ORACLES["page_titles"] = f"SELECT url, {title('html')} AS title FROM pages"
ORACLES["page_text"] = f"SELECT url, {page_text('html')} AS text FROM pages"
ORACLES["stripped_tags"] = f"SELECT url, {strip_tags('html')} AS stripped FROM pages"
ORACLES["content_hash"] = "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents"
ORACLES["cache_keys"] = "SELECT url, sha256('auto::' || url) AS key FROM pages"
ORACLES["trim_pages"] = f"""
SELECT url, left(md, 1000) AS markdown, CAST(length(md) > 1000 AS BIGINT) AS markdown_truncated,
  CASE WHEN length(md) > 1000 THEN length(md) END AS markdown_full_chars, CASE WHEN length(html) <= 6000 THEN length(html) END AS html_chars
FROM (SELECT url, html, {page_text('html')} AS md FROM pages) t"""
_BLOCKS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|"
    "li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
ORACLES["fit_text"] = f"""
WITH pieces AS (SELECT url, unnest(regexp_split_to_array({without_code('html')}, '(?i)</?(?:{_BLOCKS})\\b[^>]*>')) AS b FROM pages),
numbered AS (SELECT url, {collapse(entities(rep('b', '<[^>]+>', ' ')))} AS b, row_number() OVER () AS pos FROM pieces)
SELECT p.url, coalesce(string_agg(b, chr(10) ORDER BY pos), '') AS fit FROM pages p
LEFT JOIN (SELECT * FROM numbered WHERE b <> '' AND len(string_split(b, ' ')) >= 20) n ON n.url = p.url GROUP BY p.url"""
ORACLES["url_parts"] = with_views(
    f"""SELECT page_id, form, lower({part('href', 1)}) AS scheme, {part('href', 2)} AS netloc, {no_params(part('href', 3))} AS path,
  {part('href', 4)} AS query FROM href_cases""",
    "href_cases",
)
ORACLES["resolved_links"] = with_views(
    f"WITH {resolve_ctes('href_cases', 'url', 'href')} SELECT page_id, form, {RESOLVED_URL} AS resolved FROM resolved", "href_cases"
)
ORACLES["page_url_filter"] = with_views(
    f"WITH {resolve_ctes('href_cases', 'url', 'href')} SELECT page_id, form FROM resolved WHERE {is_page('rs', 'rp')}", "href_cases"
)
ORACLES["clean_urls"] = f"SELECT url, {clean('url')} AS clean FROM pages"
ORACLES["unwrap_links"] = with_views(
    """
SELECT doc_id, href, CASE WHEN h = '' OR regexp_matches(h, '^(#|javascript:|mailto:)') THEN NULL
  WHEN contains(h, 'duckduckgo.com/') THEN CASE WHEN contains(h, 'uddg=') THEN
    url_decode(replace(url_decode(regexp_extract(h, '[?&]uddg=([^&]+)', 1)), '+', '%2B')) END
  WHEN h LIKE '//%' THEN 'https:' || h ELSE h END AS target
FROM (SELECT *, trim(href) AS h FROM redirects) t""",
    "redirects",
)
ORACLES["snapshot_key_collisions"] = """
WITH u AS (SELECT DISTINCT unnest([url, url || '?' || repeat('a', 200) || '1', url || '?' || repeat('a', 200) || '2', url || '!~', url || '~!',
  url || '~!' || page_id]) AS url FROM pages)
SELECT left(regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g'), 200) AS file_key, count(*) AS urls, min(url) AS first_url
FROM u GROUP BY 1 HAVING count(*) > 1"""
ORACLES["snapshot_keys"] = """
SELECT left(regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g'), 200) AS file_key, count(DISTINCT url) AS urls FROM pages GROUP BY 1"""
ORACLES["path_filter"] = r"SELECT url FROM pages WHERE regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(url, 'page=\d|#top')"
ORACLES["latest_version_by_platform"] = with_views(
    """
SELECT platform, max_by(version, [CAST(x AS INT) FOR x IN string_split(version, '.')]) AS version FROM pings GROUP BY platform""",
    "pings",
)
ORACLES["doc_types"] = with_views(
    """
SELECT doc_id, CASE WHEN contains(content_type, 'pdf') OR e = 'pdf' OR starts_with(head, '%PDF-') THEN 'pdf'
  WHEN contains(content_type, 'wordprocessingml') OR e = 'docx' THEN 'docx'
  WHEN contains(content_type, 'presentationml') OR e = 'pptx' THEN 'pptx' END AS doc_type
FROM (SELECT *, regexp_extract(lower(regexp_replace(url, '[?#].*', '')), '([^.]*)$', 1) AS e FROM files) t""",
    "files",
)

# links, extraction, result pages
ORACLES["page_links"] = f"""
WITH {link_ctes('pages', 'page_id')}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS link_pos, link AS link_url FROM kept"""


def decoded(x):
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


_NAV = """regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">[^<]*</a>')"""
ORACLES["extract_links_schema"] = f"""
SELECT url, pos - 1 AS item_pos, {decoded("regexp_extract(a, '>([^<]*)<', 1)")} AS label,
  {decoded('''regexp_extract(a, 'href="([^"]*)"', 1)''')} AS href, CAST(NULL AS VARCHAR) AS nothing
FROM (SELECT url, unnest({_NAV}) AS a, generate_subscripts({_NAV}, 1) AS pos FROM pages) t"""
ORACLES["extract_headings"] = f"""
SELECT url, CAST(0 AS BIGINT) AS item_pos, trim({decoded("regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)")}) AS heading FROM pages"""
ORACLES["scope_article"] = with_views(
    """
SELECT url, 'Page ' || r AS title, '<article><h1>Page ' || r || '</h1></article>' AS html, 'Page ' || r AS markdown,
  'article' AS css_selector FROM linked_pages""",
    "linked_pages",
)
ORACLES["scoped_texts"] = with_views("SELECT url, 'r' || chr(10) || 'Page ' || r AS text FROM linked_pages", "linked_pages")
_D = "'https://s.test/d' || doc_id"
_TEXT = strip_tags("text")
ORACLES["serp_html"] = f"""
SELECT doc_id, CAST(1 AS BIGINT) AS rank, {_D} AS url, 'T ' || lang AS title, {_TEXT} AS snippet FROM documents
UNION ALL SELECT doc_id, 2, 'https://p.test/' || source, 'U', 'v' FROM documents"""
# the lite layout counts the skipped first anchor: snippets are s0, text, none
ORACLES["serp_lite"] = f"""
SELECT doc_id, CAST(1 AS BIGINT) AS rank, {_D} AS url, 'T ' || lang AS title, {_TEXT} AS snippet FROM documents
UNION ALL SELECT doc_id, 2, 'https://p.test/' || source, 'U', '' FROM documents"""
# both walled: the lite answer holds the html layout; its only nofollow anchor has no lite snippet
ORACLES["serp_first_answer"] = f"""
SELECT doc_id, CAST(1 AS BIGINT) AS rank, {_D} AS url, 'T ' || lang AS title,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE {_TEXT} END AS snippet FROM documents"""

# selection, batches, cache
ORACLES["dedup_urls"] = with_views(
    "SELECT trim(raw_url) AS url, min(pos) AS pos FROM url_list WHERE trim(raw_url) <> '' GROUP BY 1", "url_list"
)
_LADDER = f"""
judged AS (SELECT url, tier, status, elapsed_ms, error, error IS NULL AND {block()} AS blocked,
  error IS NULL AND NOT {block()} AND length(html) > 500 AND NOT {skeleton()} AS good, html FROM fetch_log),
paired AS (SELECT f.url, f.good, f.error AS ferr, f.status AS fst, f.elapsed_ms AS fms, f.html AS fhtml,
  s.blocked AS sblk, s.error AS serr, s.status AS sst, s.elapsed_ms AS sms, s.html AS shtml
  FROM judged f JOIN judged s ON f.url = s.url AND f.tier = 'fast' AND s.tier = 'stealth')"""
ORACLES["ladder_choice"] = with_views(
    f"""
WITH {_LADDER}
SELECT url, CASE WHEN good THEN 'fast' ELSE 'stealth' END AS tier, CAST(CASE WHEN good THEN fst ELSE sst END AS BIGINT) AS status,
  CAST(CASE WHEN good THEN fms WHEN serr IS NULL THEN sms END AS BIGINT) AS elapsed_ms,
  CAST(NOT good AND serr IS NULL AND (sblk OR ferr IS NOT NULL) AS BIGINT) AS notes_fast_error,
  CASE WHEN NOT good AND serr IS NULL THEN ferr END AS fast_error, CASE WHEN NOT good THEN serr END AS error FROM paired""",
    "fetch_log",
)
ORACLES["ladder_fast"] = with_views(
    """
SELECT url, 'fast' AS tier, CAST(status AS BIGINT) AS status, CAST(CASE WHEN error IS NULL THEN elapsed_ms END AS BIGINT) AS elapsed_ms,
  CAST(0 AS BIGINT) AS notes_fast_error, CAST(NULL AS VARCHAR) AS fast_error, error FROM fetch_log WHERE tier = 'fast'""",
    "fetch_log",
)
ORACLES["batch_scrape"] = with_views(
    f"""
WITH {_LADDER},
wanted AS (SELECT trim(raw_url) AS url, min(pos) AS pos FROM url_list WHERE trim(raw_url) <> '' GROUP BY 1),
got AS (SELECT url, good, serr, CASE WHEN good THEN fhtml ELSE coalesce(shtml, '') END AS html, CASE WHEN good THEN fst ELSE coalesce(sst, 0) END AS status FROM paired)
SELECT w.pos, w.url, g.url AS final_url, CAST(g.status AS BIGINT) AS status, {title('g.html')} AS title,
  CASE WHEN g.url IS NOT NULL THEN left({page_text('g.html')}, 2000) END AS markdown,
  CASE WHEN g.url IS NULL OR (NOT good AND serr IS NOT NULL) THEN 'error' WHEN good THEN 'fetch_fast' ELSE 'fetch_stealth' END AS method,
  CASE WHEN g.url IS NULL THEN 'not attempted' WHEN NOT good THEN serr END AS error
FROM wanted w LEFT JOIN got g ON g.url = w.url""",
    "url_list",
    "fetch_log",
)
ORACLES["batch_scrape_cached"] = with_views(
    f"""
WITH {_LADDER},
wanted AS (SELECT trim(raw_url) AS url, min(pos) AS pos FROM url_list WHERE trim(raw_url) <> '' GROUP BY 1),
hit AS (SELECT url FROM pages WHERE page_id % 4 = 0 AND page_id % 40 <= 15),
got AS (SELECT url, good, serr, CASE WHEN good THEN fhtml ELSE coalesce(shtml, '') END AS html FROM paired)
SELECT w.pos, w.url, CASE WHEN h.url IS NOT NULL THEN 'Cached' ELSE {title('g.html')} END AS title,
  CASE WHEN h.url IS NOT NULL THEN 'fetch_fast' WHEN g.url IS NULL OR (NOT good AND serr IS NOT NULL) THEN 'error'
    WHEN good THEN 'fetch_fast' ELSE 'fetch_stealth' END AS method,
  CASE WHEN h.url IS NOT NULL THEN NULL WHEN g.url IS NULL THEN 'not attempted' WHEN NOT good THEN serr END AS error,
  CASE WHEN h.url IS NOT NULL THEN 'hit' END AS cache
FROM wanted w LEFT JOIN got g ON g.url = w.url LEFT JOIN hit h ON h.url = w.url""",
    "url_list",
    "fetch_log",
)
ORACLES["batch_scrape_bucketed"] = ORACLES["batch_scrape"]
ORACLES["batch_scrape_bucketed_cached"] = ORACLES["batch_scrape_cached"]
ORACLES["batch_report"] = with_views(
    f"""
WITH {_LADDER},
asked AS (SELECT trim(raw_url) AS url, count(*) AS n FROM url_list GROUP BY 1),
marked AS (SELECT a.url, a.n, {part('a.url', 2)} AS host, p.url IS NOT NULL AND (p.good OR p.serr IS NULL) AS ok
  FROM asked a LEFT JOIN paired p ON p.url = a.url)
SELECT CASE WHEN grouping(host) = 1 THEN '(all)' ELSE host END AS host, CAST(sum(n) AS BIGINT) AS requested,
  count(*) FILTER (WHERE url <> '') AS unique_urls, count(*) FILTER (WHERE url <> '' AND ok) AS succeeded,
  count(*) FILTER (WHERE url <> '' AND NOT ok) AS failed FROM marked GROUP BY ROLLUP (host)""",
    "url_list",
    "fetch_log",
)
ORACLES["cache_asof"] = with_views(
    """
SELECT r.k, r.event_id, epoch_us(r.ts) AS ts_us, epoch_us(p.ts) AS put_us,
  CAST(coalesce(epoch_us(r.ts) - epoch_us(p.ts) <= 900000000, false) AS BIGINT) AS hit
FROM cache_requests r ASOF LEFT JOIN cache_puts p ON r.k = p.k AND r.ts >= p.ts""",
    "cache_requests",
    "cache_puts",
)
ORACLES["cache_asof_sliced"] = ORACLES["cache_asof"]
ORACLES["cache_compact"] = with_views(
    """
WITH looked AS (SELECT r.k, r.ts, p.ts AS put_ts FROM cache_requests r ASOF JOIN cache_puts p ON r.k = p.k AND r.ts >= p.ts),
moments AS (SELECT k, ts, ts AS put_ts FROM cache_puts
  UNION ALL SELECT k, ts, put_ts FROM looked WHERE epoch_us(ts) - epoch_us(put_ts) <= 604800000000)
SELECT k, epoch_us(max(ts)) AS touched_us, epoch_us(max(put_ts)) AS put_us FROM moments WHERE ts <= TIMESTAMP '2024-01-30 00:00:00'
GROUP BY k HAVING epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(max(put_ts)) <= 604800000000
ORDER BY max(ts) DESC, k LIMIT 100""",
    "cache_requests",
    "cache_puts",
)
ORACLES["cache_stats"] = with_views(
    """
WITH looked AS (SELECT coalesce(epoch_us(r.ts) - epoch_us(p.ts) <= 86400000000, false) AS hit
  FROM cache_requests r ASOF LEFT JOIN cache_puts p ON r.k = p.k AND r.ts >= p.ts)
SELECT CAST(1 AS BIGINT) AS enabled, (SELECT count(DISTINCT k) FROM cache_puts) AS items, count(*) FILTER (WHERE hit) AS hits,
  count(*) FILTER (WHERE NOT hit) AS misses, CAST(86400 AS BIGINT) AS ttl_seconds FROM looked""",
    "cache_requests",
    "cache_puts",
)


# site maps and crawls
def site_map(limit, where="true"):
    return f"""
WITH {link_ctes('pages', 'page_id')},
firsts AS (SELECT url, link, min(pos) AS pos FROM kept WHERE {where} GROUP BY url, link),
cut AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS rn FROM firsts)"""


_SORTED = "SELECT url AS root, row_number() OVER (PARTITION BY url ORDER BY link) - 1 AS pos, link AS url FROM cut WHERE rn <= "
ORACLES["map_site"] = site_map(4) + _SORTED + "4"
ORACLES["map_site_filtered"] = site_map(2, "regexp_matches(link, '[aeiou]$')") + _SORTED + "2"
ORACLES["site_overview"] = f"""{site_map(200)}
SELECT p.url, {title('p.html')} AS title, length({page_text('p.html')}) AS text_chars, count(c.link) AS link_count,
  coalesce(string_agg(c.link, ' ' ORDER BY c.link), '') AS urls
FROM pages p LEFT JOIN (SELECT * FROM cut WHERE rn <= 200) c ON c.url = p.url GROUP BY p.url, p.html"""
ORACLES["crawl_flat"] = with_views(
    f"""
WITH {link_ctes('linked_pages', 'page_id')},
firsts AS (SELECT url, link, min(pos) AS pos FROM kept GROUP BY url, link),
cut AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS rn FROM firsts),
filtered AS (SELECT url AS root, link, row_number() OVER (PARTITION BY url ORDER BY link) AS rank FROM cut
  WHERE rn <= 8 AND NOT regexp_matches(link, 'up=1|p0$'))
SELECT f.root, f.rank, f.link AS url, {title('p.html')} AS title, CASE WHEN p.url IS NULL THEN '' ELSE {page_text('p.html')} END AS markdown,
  CASE WHEN p.url IS NULL THEN 'not attempted' END AS error
FROM filtered f LEFT JOIN linked_pages p ON p.url = f.link WHERE f.rank <= 2""",
    "linked_pages",
)


def walk(roots, depth, pages, where="true"):
    """Breadth-first order as the smallest path of link positions among shortest paths."""
    return f"""
WITH RECURSIVE {link_ctes('linked_pages', 'page_id')},
paths AS (
  SELECT url AS root, url, 0 AS depth, '' AS path FROM linked_pages WHERE {roots}
  UNION SELECT p.root, k.link, p.depth + 1, p.path || lpad(CAST(k.pos AS VARCHAR), 4, '0')
  FROM paths p JOIN kept k ON k.url = p.url WHERE p.depth < {depth} AND {where}),
best AS (SELECT root, url, min(depth) AS depth, min_by(path, (depth, path)) AS path FROM paths GROUP BY root, url),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, path) AS rank FROM best),
visited AS (SELECT root, CAST(depth AS BIGINT) AS depth, rank, url FROM ranked WHERE rank <= {pages})"""


ORACLES["crawl_bfs"] = with_views(
    f"""{walk("r = 0", 4, 20, "NOT regexp_matches(k.link, 'p5$')")}
SELECT v.root, v.depth, v.rank, v.url, {title('p.html')} AS title,
  CASE WHEN p.url IS NULL THEN '' ELSE 'Page ' || p.r END AS markdown, CASE WHEN p.url IS NULL THEN 'not attempted' END AS error
FROM visited v LEFT JOIN linked_pages p ON p.url = v.url""",
    "linked_pages",
)
ORACLES["crawl_recaptured_flat"] = ORACLES["crawl_flat"]
ORACLES["crawl_recaptured"] = ORACLES["crawl_bfs"]
ORACLES["crawl_bfs_every_page"] = with_views(f"{walk('true', 3, 12)} SELECT root, depth, rank, url FROM visited", "linked_pages")
ORACLES["crawl_errors"] = with_views(
    f"""{walk('r = 0', 3, 1000)}
SELECT {part('v.url', 2)} AS host, 'not attempted' AS reason, count(*) AS pages FROM visited v
WHERE v.url NOT IN (SELECT url FROM linked_pages) GROUP BY 1""",
    "linked_pages",
)

_LOG_ROWS = "url, tier, CAST(attempt AS BIGINT) AS attempt, CAST(status AS BIGINT) AS status, error, sha256(coalesce(html, '')) AS html_hash"
ORACLES["stream_fetch_log"] = with_views(f"SELECT {_LOG_ROWS} FROM fetch_log WHERE page_id % 20 <> 3", "fetch_log")
ORACLES["fetch_log_json"] = with_views(
    f"""
SELECT {_LOG_ROWS}, CAST(NULL AS VARCHAR) AS line FROM fetch_log WHERE page_id % 20 <> 3
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, '{{"url": "' || url || '", "tier"' FROM fetch_log WHERE page_id % 20 = 3""",
    "fetch_log",
)
ORACLES["rag_lines"] = f"""
SELECT url, {title('html')} AS title, sha256({page_text('html')}) AS markdown_hash, '2024-01-01T00:00:00Z' AS fetched_at FROM pages"""
ORACLES["page_expression"] = f"""
SELECT url, CAST(length(m) - length(replace(m, ' ', '')) AS BIGINT) AS blanks FROM (SELECT url, {page_text('html')} AS m FROM pages)"""

# search, research, papers
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


_PLAIN = "SELECT item_id AS query_id, 0 AS pass, text AS q FROM benchmark"


def bm25(limit, queries=_PLAIN, docs="documents", doc_id="doc_id", text="text"):
    return f"""
WITH docs AS (SELECT {doc_id}, {_TOKENS.format(text)} AS w FROM {docs}),
stat AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
asked AS (SELECT DISTINCT query_id, pass, term FROM (SELECT query_id, pass, unnest({_TOKENS.format('q')}) AS term FROM ({queries}) b) a),
occ AS (SELECT {doc_id}, len(w) AS dl, unnest(w) AS term FROM docs),
tf AS (SELECT {doc_id}, dl, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, pass, {doc_id},
  round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), stat GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY score DESC, {doc_id}) AS rank FROM scored),
top AS (SELECT query_id, pass, rank, {doc_id}, score FROM ranked WHERE rank <= {limit})"""


ORACLES["search_bm25"] = bm25(5) + " SELECT query_id, rank, doc_id, score FROM top"
_FIRST_WORDS = "SELECT item_id AS query_id, 1 AS pass, array_to_string(string_split(text, ' ')[1:3], ' ') AS q FROM benchmark"
ORACLES["search_index"] = (
    bm25(5, f"{_PLAIN} UNION ALL {_FIRST_WORDS}") + " SELECT query_id, CAST(pass AS BIGINT) AS pass, rank, doc_id, score FROM top"
)
ORACLES["search_snippets"] = bm25(1) + " SELECT query_id, doc_id, text AS snippet FROM top JOIN documents USING (doc_id)"
ORACLES["expand_queries"] = """
SELECT item_id AS query_id, text AS query, CAST(0 AS BIGINT) AS pass, text AS pass_query FROM benchmark
UNION ALL SELECT item_id, text, 1, text || ' comparison alternatives' FROM benchmark
UNION ALL SELECT item_id, text, 2, text || ' problems issues criticism' FROM benchmark"""


def chosen(n, known):
    return f"""
f{n} AS (SELECT query_id, url, min(rank) AS rank FROM hits h WHERE pass = {n} AND NOT EXISTS (
  SELECT 1 FROM ({known}) k WHERE k.query_id = h.query_id AND k.url = h.url) GROUP BY query_id, url),
c{n} AS (SELECT query_id, CAST({n} AS BIGINT) AS pass, url, pos_in_pass FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS pos_in_pass FROM f{n}) t WHERE pos_in_pass <= 2)"""


_PACK = f"""
{chosen(0, "SELECT CAST(NULL AS BIGINT) AS query_id, '' AS url")},
{chosen(1, "SELECT query_id, url FROM c0")},
{chosen(2, "SELECT query_id, url FROM c0 UNION ALL SELECT query_id, url FROM c1")},
numbered AS (SELECT query_id, pass, url, row_number() OVER (PARTITION BY query_id ORDER BY pass, pos_in_pass) AS n
  FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2) t),
evidence AS (SELECT e.query_id, e.n, e.pass, e.url, d.title, CAST(d.status AS BIGINT) AS status, sha256(coalesce(d.markdown, '')) AS markdown_hash,
  coalesce(d.method, 'error') AS method, CASE WHEN d.url IS NULL THEN 'not attempted' ELSE d.error END AS error
  FROM numbered e LEFT JOIN doc_pages d ON d.url = e.url)"""
_EVIDENCE = f"""
WITH firsts AS (SELECT user_id AS query_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2),
hits AS (SELECT query_id, pass, first * (pass * 2 + 1) % 101 AS rank, 'https://s.test/d' || (first % 50) AS url
  FROM firsts, (SELECT unnest([0, 1, 2]) AS pass) p),
{_PACK}"""
_PASSES = """
SELECT item_id AS query_id, 0 AS pass, text AS q FROM benchmark
UNION ALL SELECT item_id, 1, text || ' comparison alternatives' FROM benchmark
UNION ALL SELECT item_id, 2, text || ' problems issues criticism' FROM benchmark"""
ORACLES["deep_research"] = with_views(
    f"""{bm25(5, _PASSES, 'doc_pages', 'url', 'markdown')}, hits AS (SELECT query_id, pass, rank, url FROM top), {_PACK}
SELECT query_id, n, url, title FROM evidence WHERE error IS NULL""",
    "doc_pages",
)
ORACLES["evidence_pack"] = with_views(f"{_EVIDENCE} SELECT * FROM evidence", "doc_pages")
ORACLES["citations"] = with_views(f"{_EVIDENCE} SELECT query_id, n, url, title FROM evidence WHERE error IS NULL", "doc_pages")
ORACLES["evidence_six_passes"] = """
WITH firsts AS (SELECT user_id AS query_id, 'https://s.test/d' || (event_id % 23) AS url, min(event_id % 101) AS rank FROM events GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, url) AS n FROM firsts)
SELECT query_id, n, n - 1 AS pass, url FROM numbered WHERE n <= 6"""
ORACLES["search_papers"] = with_views(
    """
SELECT id, title FROM papers WHERE source = 'arxiv' AND (contains(lower(title), 'the and') OR contains(lower(summary), 'the and'))
ORDER BY id LIMIT 25""",
    "papers",
)
ORACLES["search_papers_words"] = with_views(
    "SELECT id, title FROM papers WHERE source = 'arxiv' AND category = 'cs.CV' AND "
    + " AND ".join(f"(contains(lower(title), '{w}') OR contains(lower(summary), '{w}'))" for w in ("of", "the", "and", "in", "on"))
    + " ORDER BY id LIMIT 9",
    "papers",
)
_P_TOKENS = _TOKENS.format
ORACLES["search_papers_many"] = with_views(
    f"""
WITH d AS (SELECT doc_id, {_P_TOKENS('text')} AS w FROM documents WHERE doc_id % 20 = 0),
q AS (SELECT doc_id || 'p' AS query_id, w[3:5] AS w FROM d UNION ALL SELECT doc_id || 'w', w[2:7] FROM d),
p AS (SELECT id, {_P_TOKENS('title')} AS t, {_P_TOKENS('summary')} AS s FROM papers WHERE source = 'arxiv'),
x AS (SELECT id, t, s, ' ' || array_to_string(t, ' ') || ' ' AS tt, ' ' || array_to_string(s, ' ') || ' ' AS ss FROM p),
m AS (SELECT query_id, id FROM q, x WHERE len(w) > 0 AND CASE WHEN len(w) <= 4
  THEN contains(tt, ' ' || array_to_string(w, ' ') || ' ') OR contains(ss, ' ' || array_to_string(w, ' ') || ' ')
  ELSE list_has_all(list_concat(t, s), w) END)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank, id FROM m QUALIFY rank <= 25""",
    "papers",
)
_PAPER = f"""doc_id || 'v1' AS id, 'http://a.test/abs/' || doc_id || 'v1' AS url, 'http://a.test/pdf/' || doc_id AS pdf_url,
  source || ' paper' AS title, 'A ' || lang || '; B' AS authors, left({collapse('text')}, 1500) AS summary,
  '2024-01-0' || (doc_id % 9 + 1) AS published, 'cs.' || lang AS categories"""
ORACLES["arxiv_entries"] = f"SELECT doc_id, {_PAPER}, CAST(NULL AS VARCHAR) AS error FROM documents"
ORACLES["arxiv_feed_scan"] = f"""
SELECT {_PAPER}, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS unread FROM documents WHERE doc_id % 50 <> 7
UNION ALL SELECT NULL, NULL, NULL, '', '', '', NULL, '', 'unreadable entry', '<entry><id>http://a.test/abs/' || doc_id || '</title></entry>'
FROM documents WHERE doc_id % 50 = 7"""
ORACLES["crossref_entries"] = f"""
SELECT doc_id, '10.1/' || doc_id AS id, 'https://doi.org/10.1/' || doc_id AS url, CAST(NULL AS VARCHAR) AS pdf_url, source AS title,
  'Ann ' || lang || '; Group' AS authors, left({strip_tags("'<p>' || text || '</p>'")}, 1500) AS summary,
  CASE WHEN doc_id % 4 > 0 THEN '2024-' || (doc_id % 12 + 1) END AS published, '' AS categories, CAST(NULL AS VARCHAR) AS error FROM documents"""

# change detection
_CHECKED = """
hashed AS (SELECT url, event_id AS snapshot_id, ts, text, sha256(text) AS hash FROM snapshots),
lagged AS (SELECT *, lag(hash) OVER w AS ph, lag(snapshot_id) OVER w AS prev_id, lag(text) OVER w AS ptext, lag(ts) OVER w AS pts
  FROM hashed WINDOW w AS (PARTITION BY url ORDER BY ts, snapshot_id)),
checked AS (SELECT *, CASE WHEN ph IS NULL THEN 'new' WHEN ph = hash THEN 'unchanged' ELSE 'changed' END AS check_status FROM lagged)"""
ORACLES["monitor_status"] = with_views(f"WITH {_CHECKED} SELECT url, snapshot_id, hash, check_status, prev_id FROM checked", "snapshots")
ORACLES["monitor_status_sliced"] = ORACLES["monitor_status"]
ORACLES["stream_page_changes"] = with_views(
    """
WITH hashed AS (SELECT url, event_id AS snapshot_id, ts, CASE WHEN event_id % 13 <> 5 THEN sha256(text) END AS hash FROM snapshots),
lagged AS (SELECT *, last_value(hash IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph FROM hashed)
SELECT url, snapshot_id, hash, CASE WHEN hash IS NULL THEN 'error' WHEN ph IS NULL THEN 'new' WHEN ph = hash THEN 'unchanged' ELSE 'changed' END AS check_status
FROM lagged""",
    "snapshots",
)
ORACLES["stream_page_changes_by_batch"] = ORACLES["stream_page_changes"]
ORACLES["monitor_line_delta"] = with_views(
    f"""
WITH {_CHECKED}, lines AS (SELECT *, list_distinct(string_split(text, chr(10))) AS n, list_distinct(string_split(ptext, chr(10))) AS o
  FROM checked WHERE check_status = 'changed')
SELECT url, snapshot_id, len(list_filter(n, lambda x: NOT list_contains(o, x))) AS lines_added,
  len(list_filter(o, lambda x: NOT list_contains(n, x))) AS lines_removed FROM lines""",
    "snapshots",
)
ORACLES["monitor_diffs"] = with_views(
    f"""
WITH {_CHECKED}
SELECT url, snapshot_id, '--- ' || url || '@' || strftime(pts, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || '+++ ' || url || '@' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
  || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || '-' || string_split(ptext, chr(10))[1] || chr(10) || '+' || string_split(text, chr(10))[1]
  || chr(10) || ' static line' AS diff, CAST(0 AS BIGINT) AS diff_truncated
FROM checked WHERE check_status = 'changed'""",
    "snapshots",
)
_KEPT = """
ranked AS (SELECT url, event_id AS snapshot_id, row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS age_rank FROM snapshots),
newest AS (SELECT * FROM ranked WHERE age_rank <= 20)"""
ORACLES["latest_hashes"] = with_views(
    """
WITH gone AS (SELECT url, max(ts) AS at FROM snapshots WHERE event_id % 3 = 1 AND url LIKE '%7' GROUP BY url),
alive AS (SELECT s.* FROM snapshots s LEFT JOIN gone g ON g.url = s.url WHERE g.at IS NULL OR s.ts > g.at),
newest AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS n FROM alive)
SELECT url, epoch_us(ts) AS ts_us, event_id AS snapshot_id, sha256(text) AS hash FROM newest WHERE n = 1""",
    "snapshots",
)
ORACLES["snapshot_retention"] = with_views(f"WITH {_KEPT} SELECT url, snapshot_id, age_rank FROM newest", "snapshots")
ORACLES["monitor_history"] = with_views(
    f"""
WITH {_KEPT}, asked AS (SELECT DISTINCT 'https://watch.test/' || (user_id * 2) AS url FROM events)
SELECT a.url, k.snapshot_id, k.age_rank, CASE WHEN k.url IS NULL THEN 'no_history' ELSE 'ok' END AS history_status
FROM asked a LEFT JOIN newest k ON k.url = a.url""",
    "snapshots",
)
ORACLES["monitor_forget"] = with_views(
    """
SELECT url, event_id AS snapshot_id FROM snapshots
WHERE url NOT IN (SELECT 'https://watch.test/' || (user_id + 5) FROM events WHERE event_type = 'error')""",
    "snapshots",
)
ORACLES["monitors_overview"] = with_views(
    """
SELECT url, epoch_us(max(ts)) AS last_us, CAST(200 AS BIGINT) AS status_code, least(count(*), 20) AS snapshots
FROM snapshots GROUP BY url ORDER BY url LIMIT 50""",
    "snapshots",
)

# usage
_NOW = "(SELECT max(ts) FROM pings)"
ORACLES["pings_valid"] = with_views(
    r"""
WITH read AS (SELECT event_id, received_at, body, CASE WHEN json_valid(body) THEN body END AS j FROM ping_posts),
fields AS (SELECT *, left(coalesce(j ->> '$.id', ''), 64) AS pid, left(coalesce(j ->> '$.version', ''), 32) AS pver,
  left(coalesce(j ->> '$.python', ''), 32) AS ppy, left(coalesce(j ->> '$.platform', ''), 32) AS pplat,
  nullif(CAST(j ->> '$.ts' AS BIGINT), 0) AS pts FROM read),
judged AS (SELECT *, CASE WHEN octet_length(encode(body)) > 4096 THEN 'payload too large' WHEN j IS NULL THEN 'bad json'
  WHEN NOT regexp_full_match(pid, '[0-9a-f]{8,64}') THEN 'bad id' END AS reject_reason FROM fields)
SELECT event_id, CASE WHEN reject_reason IS NULL THEN pid END AS id, CASE WHEN reject_reason IS NULL THEN pver END AS version,
  CASE WHEN reject_reason IS NULL THEN ppy END AS python, CASE WHEN reject_reason IS NULL THEN pplat END AS platform,
  CASE WHEN reject_reason IS NULL THEN coalesce(pts, CAST(floor(epoch(received_at)) AS BIGINT)) END AS ts_s, reject_reason FROM judged""",
    "ping_posts",
)
ORACLES["active_users"] = with_views(
    f"""
SELECT count(DISTINCT id) FILTER (WHERE ts > {_NOW} - INTERVAL 1 DAY) AS dau_24h,
  count(DISTINCT id) FILTER (WHERE ts > {_NOW} - INTERVAL 7 DAY) AS wau_7d,
  count(DISTINCT id) FILTER (WHERE ts > {_NOW} - INTERVAL 30 DAY) AS mau_30d, count(DISTINCT id) AS total_unique FROM pings""",
    "pings",
)
_AGE = "date_diff('day', CAST(ts AS DATE), DATE '2024-01-30')"
ORACLES["active_users_sketched"] = with_views(
    f"""
WITH p AS (SELECT id, {_AGE} AS age FROM pings),
e AS (SELECT count(DISTINCT id) FILTER (WHERE age >= 0 AND age < 1) AS dau_24h, count(DISTINCT id) FILTER (WHERE age >= 0 AND age < 7) AS wau_7d,
  count(DISTINCT id) FILTER (WHERE age >= 0 AND age < 30) AS mau_30d, count(DISTINCT id) AS total_unique FROM p)
SELECT 'dau_24h' AS period, dau_24h AS exact, CAST(1 AS BIGINT) AS near FROM e UNION ALL SELECT 'wau_7d', wau_7d, 1 FROM e
UNION ALL SELECT 'mau_30d', mau_30d, 1 FROM e UNION ALL SELECT 'total_unique', total_unique, 1 FROM e""",
    "pings",
)
ORACLES["users_by_version"] = with_views(
    f"""
SELECT version, count(DISTINCT id) AS users FROM pings WHERE ts > {_NOW} - INTERVAL 30 DAY GROUP BY 1 ORDER BY users DESC, version LIMIT 10""",
    "pings",
)
ORACLES["users_by_platform"] = with_views(
    f"SELECT platform, count(DISTINCT id) AS users FROM pings WHERE ts > {_NOW} - INTERVAL 30 DAY GROUP BY 1", "pings"
)
ORACLES["daily_users"] = with_views(
    f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT id) AS users FROM pings WHERE ts > {_NOW} - INTERVAL 30 DAY GROUP BY 1""",
    "pings",
)
ORACLES["download_summary"] = with_views(
    """
SELECT category, CAST(sum(downloads) AS BIGINT) AS downloads FROM downloads WHERE dl_date >= DATE '2024-01-20' - 6 GROUP BY 1""",
    "downloads",
)
ORACLES["download_badge"] = with_views(
    """
SELECT CAST(coalesce(sum(downloads), 0) AS BIGINT) AS downloads FROM downloads
WHERE category = 'without_mirrors' AND dl_date >= DATE '2024-01-20' - 30""",
    "downloads",
)
ORACLES["traffic_summary"] = with_views(
    "SELECT kind, CAST(sum(uniques) AS BIGINT) AS uniques, CAST(sum(cnt) AS BIGINT) AS total FROM traffic GROUP BY 1", "traffic"
)
_COOLDOWN = """
WITH RECURSIVE secs AS (SELECT DISTINCT id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM pings),
accepted AS (SELECT id, min(s) AS s FROM secs GROUP BY id
  UNION ALL SELECT a.id, min(p.s) FROM accepted a JOIN secs p ON p.id = a.id AND p.s >= a.s + 86400 GROUP BY a.id, a.s)
SELECT id, s AS accepted_at FROM accepted"""
ORACLES["ping_cooldown"] = with_views(_COOLDOWN, "pings")
ORACLES["stream_ping_cooldown"] = ORACLES["ping_cooldown"]
ORACLES["ping_cooldown_far"] = with_views(
    """
WITH RECURSIVE p AS (SELECT CASE WHEN event_id % 89 > 0 THEN id END AS id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM pings),
secs AS (SELECT DISTINCT id, s FROM (SELECT * FROM p UNION ALL SELECT id, 1 FROM p UNION ALL SELECT id, 250000000000 FROM p) x),
accepted AS (SELECT id, min(s) AS s FROM secs GROUP BY id
  UNION ALL SELECT a.id, min(p.s) FROM accepted a JOIN secs p ON p.id IS NOT DISTINCT FROM a.id AND p.s >= a.s + 86400 GROUP BY a.id, a.s)
SELECT id, s AS accepted_at FROM accepted""",
    "pings",
)
_SESSIONS = """
WITH gaps AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1
    WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM gaps),
spans AS (SELECT user_id, CAST(session_no AS BIGINT) AS session_no, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS events
  FROM numbered GROUP BY user_id, session_no)"""
ORACLES["sessions"] = f"""{_SESSIONS}
SELECT *, CAST(floor((epoch_us(TIMESTAMP '2024-01-30 00:00:00') - end_us) / 1000000.0) AS BIGINT) AS idle_seconds,
  CAST(epoch_us(TIMESTAMP '2024-01-30 00:00:00') - end_us > 1800000000 AS BIGINT) AS expired FROM spans"""
# a session is out once the watermark, one hour behind the latest event, has passed its padded end
ORACLES["stream_sessions"] = f"""{_SESSIONS}
SELECT user_id, start_us, end_us, events FROM spans
WHERE end_us + 1800000001 <= (SELECT epoch_ms(max(ts)) * 1000 FROM events) - 3600000000"""
# a day is out once the watermark, one day behind the latest ping, has passed its end
ORACLES["stream_daily_actives_exact"] = with_views(
    """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT id) AS users, count(*) AS pings FROM pings
WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM pings) - INTERVAL 1 DAY GROUP BY 1""",
    "pings",
)
ORACLES["stream_daily_actives"] = with_views(
    """
SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(1 AS BIGINT) AS near FROM pings
WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM pings) - INTERVAL 1 DAY""",
    "pings",
)
ORACLES["stream_attempt_checks"] = with_views(
    f"""
WITH answered AS (SELECT *, 2 * page_id + CASE WHEN tier = 'fast' THEN 0 ELSE 1 END AS k FROM fetch_log WHERE error IS NULL),
{link_ctes('answered', 'k')}, counts AS (SELECT k, count(*) AS c FROM kept GROUP BY k)
SELECT p.url, tier, {title('p.html')} AS title, CAST({block('p.html', 'p.status')} AS BIGINT) AS blocked,
  CAST({skeleton('p.html', 'p.status')} AS BIGINT) AS skeleton, coalesce(c, 0) AS link_count FROM answered p LEFT JOIN counts USING (k)""",
    "fetch_log",
)
ORACLES["stream_first_seen"] = with_views(f"SELECT DISTINCT {clean('trim(raw_url)')} AS clean_url FROM url_list WHERE trim(raw_url) <> ''", "url_list")
ORACLES["snapshot_store_round"] = with_views(
    f"""
WITH {_LADDER},
first AS (SELECT url, CASE WHEN good THEN fhtml ELSE shtml END AS html, NOT good AND serr IS NOT NULL AS failed, serr FROM paired),
more AS (SELECT page_id, url, tier, status, elapsed_ms, error, CASE WHEN page_id % 4 = 0 THEN html || '<p>added line</p>' ELSE html END AS html
  FROM fetch_log WHERE page_id % 9 > 0),
judged2 AS (SELECT *, error IS NULL AND NOT {block()} AND length(html) > 500 AND NOT {skeleton()} AS good FROM more),
second AS (SELECT f.page_id, f.url, CASE WHEN f.good THEN f.html ELSE s.html END AS html, NOT f.good AND s.error IS NOT NULL AS failed, s.error AS serr
  FROM judged2 f JOIN judged2 s ON f.url = s.url AND f.tier = 'fast' AND s.tier = 'stealth'),
texts AS (SELECT p.page_id, p.url, a.failed AS f1, b.failed AS f2, b.serr, b.url IS NOT NULL AS again,
  {page_text('a.html')} AS t1, {page_text('b.html')} AS t2
  FROM (SELECT DISTINCT page_id, url FROM fetch_log) p JOIN first a ON a.url = p.url LEFT JOIN second b ON b.url = p.url),
said AS (SELECT *, CASE WHEN NOT again THEN NULL WHEN f2 THEN 'error' WHEN f1 THEN 'new' WHEN t1 = t2 THEN 'unchanged' ELSE 'changed' END AS check_status,
  CASE WHEN again AND NOT f2 THEN '2024-01-02' WHEN NOT f1 AND page_id % 7 <> 0 THEN '2024-01-01' END AS kept_day FROM texts)
SELECT url, check_status, CASE WHEN f2 THEN serr END AS error, CAST(CASE WHEN check_status = 'changed' THEN 1 END AS BIGINT) AS lines_added, kept_day,
  CASE kept_day WHEN '2024-01-02' THEN sha256(t2) WHEN '2024-01-01' THEN sha256(t1) END AS hash
FROM said WHERE check_status IS NOT NULL OR kept_day IS NOT NULL""",
    "fetch_log",
)
