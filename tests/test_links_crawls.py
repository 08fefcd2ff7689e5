"""Link harvest, site maps and crawls on literal pages, and a walk against a plain loop."""

import random

from pyspark.sql import functions as F

from pagemill.operators import crawl, links, sitemap
from pagemill.sources.pages import as_pages

# what is an anchor, what is a page, what stays on the host: one line a rule
CASES = [
    ('<link rel="preload" href="/theme">', None),  # not an anchor
    ('<area href="/map-part">', None),
    ("<A class=c HREF='/Imprint'>", "/Imprint"),
    ("<a\n title='x' href='/news/2031/may'>", "/news/2031/may"),
    ('<a href="/report.docx?rev=4">', "/report.docx?rev=4"),  # documents are pages
    ('<a href="/bundle.mjs?v=1">', None),
    ('<a href="/cover.JPEG">', None),
    ('<a href="/backup.tar">', None),
    ('<a href="#contents">', None),
    ('<a href="JavaScript:open()">', None),
    ('<a href="tel:110">', None),
    ('<a href="mailto:desk@harbour.test">', None),
    ('<a href="http://elsewhere.test/x">', None),
    ('<a href="http://harbour.test/list?p=2&q=a">', "/list?p=2&q=a"),
    ('<a href="berth#row-3">', "/quay/berth"),
    ('<a href="../crew/./ann">', "/crew/ann"),
    ("<aé href='/no'>", None),
    ("<a-card href='/card'>", "/card"),
]
START = "http://harbour.test/quay/"
HTML = "<body>" + "x</a>\n".join(tag for tag, _ in CASES) + "</body>"
KEPT = [path for _, path in CASES if path]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "url string, html string")


def test_harvest(spark):
    rows = links.extract_links(pages_of(spark, [(START, HTML), ("https://no.t/", None)])).collect()
    assert [r.link_url for r in sorted(rows, key=lambda r: r.link_pos)] == ["http://harbour.test" + k for k in KEPT]


def test_map_limit_counts_in_document_order_then_sorts(spark):
    page = pages_of(spark, [(START, HTML)])
    got = [r.url for r in sitemap.map_site(page, limit=3).orderBy("pos").collect()]
    assert got == sorted("http://harbour.test" + k for k in KEPT[:3])
    assert sitemap.map_site(page, limit=0).count() == 1
    assert [r.url for r in sitemap.map_site(page, include="news|card").collect()] == ["http://harbour.test/card", "http://harbour.test/news/2031/may"]


def test_map_uses_the_landing_page(spark):
    moved = spark.createDataFrame([("http://old.t/", "https://new.t/x/", '<a href="y">y</a>')], "url string, final_url string, html string")
    assert [tuple(r) for r in sitemap.map_site(moved).collect()] == [("http://old.t/", 0, "https://new.t/x/y")]


def test_bfs_finds_links_outside_the_scope(spark):
    """Links come from the whole page, text from the selector alone."""
    def page(url, *links):
        menu = "".join(f'<a href="{x}">{x}</a>' for x in links)
        return (url, f"<title>Deck</title><div id=top>{menu}</div><section class=log>entry of {url}</section><p>rest</p>")

    pages = pages_of(spark, [page("http://ship.test/", "/a", "/b"), page("http://ship.test/a", "/c"), page("http://ship.test/b")])
    roots = spark.createDataFrame([("http://ship.test/",)], "root string")
    out = crawl.crawl_bfs(pages, roots, max_pages=3, max_depth=2, css_selector="section.log").orderBy("rank").collect()
    assert [(r.url, r.depth) for r in out] == [("http://ship.test/", 0), ("http://ship.test/a", 1), ("http://ship.test/b", 1)]
    assert [r.markdown for r in out] == [f"entry of {r.url}" for r in out]
    assert {(r.title, r.meta["css_selector"]) for r in out} == {("Deck", "section.log")}


def test_recaptured_pages_count_once(spark):
    rows = [
        (1, "http://r.t/", '<a href="/old">o</a>'), (7, "http://r.t/", '<title>New</title><a href="/a">a</a><a href="/b">b</a>'),
        (2, "http://r.t/a", "<p>first"), (5, "http://r.t/a", "<p>second"), (3, "http://r.t/b", "<p>b"),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    roots = spark.createDataFrame([("http://r.t/",)], "root string")
    flat = crawl.crawl_flat(pages, roots, max_pages=1).collect()
    assert [(r.url, r.markdown) for r in flat] == [("http://r.t/a", "second")]
    walk = crawl.crawl_bfs(pages, roots, max_pages=2, max_depth=1).orderBy("rank").collect()
    assert [(r.url, r.markdown) for r in walk] == [("http://r.t/", "New a b"), ("http://r.t/a", "second")]


def test_flat_crawl_skips_the_root_and_keeps_missing_pages(spark):
    pages = pages_of(spark, [("http://r/", '<a href="/b">b</a><a href="/a">a</a>'), ("http://r/a", "<p>A</p>")])
    roots = spark.createDataFrame([("http://r/",)], "root string")
    out = crawl.crawl_site(pages, roots, max_pages=5).orderBy("rank").collect()
    assert [(r.url, r.status, r.markdown, r.error) for r in out] == [("http://r/a", 200, "A", None), ("http://r/b", 0, "", "not attempted")]
    errors = crawl.crawl_errors(crawl.crawl_site(pages, roots)).collect()
    assert [tuple(r) for r in errors] == [("r", "not attempted", 1)]
    shaped = crawl.crawl_flat(as_pages(pages), roots, css_selector="p").orderBy("rank").collect()
    assert [r.html for r in shaped] == ["<p>A</p>", ""]


def plain_walk(graph, root, max_pages, max_depth):
    seen, frontier, out, depth = {root}, [root], [], 0
    while frontier and depth <= max_depth and len(out) < max_pages:
        following = []
        for page in frontier[: max_pages - len(out)]:
            out.append((root, depth, page))
            for target in graph.get(page, ()) if depth < max_depth else ():
                if target not in seen:
                    seen.add(target)
                    following.append(target)
        frontier, depth = following, depth + 1
    return [(r, d, i + 1, p) for i, (r, d, p) in enumerate(out)]


def test_walk_like_a_plain_loop(spark):
    random.seed(2)
    names = [f"http://h/{i}" for i in range(40)]
    graph = {n: [random.choice(names + ["http://h/gone"]) for _ in range(random.randint(0, 6))] for n in names}
    html = [(n, "".join(f'<a href="{x}">l</a>' for x in out)) for n, out in graph.items()]
    roots = spark.createDataFrame([(n,) for n in names[:12]] + [("http://h/gone#x",)], "root string")
    for max_pages, max_depth in ((7, 3), (100, 2), (1, 2), (0, 1)):
        got = crawl.crawl_levels(pages_of(spark, html), roots, max_pages, max_depth).collect()
        want = [r for (n,) in roots.collect() for r in plain_walk(graph, n, max_pages, max_depth)]
        assert sorted(map(tuple, got)) == sorted(want)


def test_walk_of_a_root_without_host(spark):
    pages = pages_of(spark, [("", '<a href="http://a.t/1">1</a>'), ("http://a.t/1", '<a href="http://b.t/2">2</a>')])
    roots = spark.createDataFrame([("",)], "root string")
    got = crawl.crawl_levels(pages, roots, 5, 2).orderBy("rank").collect()
    assert [r.url for r in got] == ["", "http://a.t/1", "http://b.t/2"]


def test_walk_stays_on_the_host_of_each_root(spark):
    pages = pages_of(spark, [("http://a.t/", '<a href="/1">1</a><a href="http://b.t/">b</a>'), ("http://b.t/", '<a href="http://a.t/">a</a>')])
    roots = spark.createDataFrame([("http://a.t/",), ("http://a.t/1",)], "root string")
    got = crawl.crawl_levels(pages, roots, 5, 2).collect()
    assert sorted((r.root, r.url) for r in got) == [
        ("http://a.t/", "http://a.t/"), ("http://a.t/", "http://a.t/1"), ("http://a.t/1", "http://a.t/1"),
    ]


def test_root_with_fragment_is_found_again_without_it(spark):
    pages = pages_of(spark, [("http://h/a#top", '<a href="/a">self</a>'), ("http://h/a", "x")])
    roots = spark.createDataFrame([("http://h/a#top",)], "root string")
    got = crawl.crawl_levels(pages, roots, 5, 1).orderBy("rank").select("url").collect()
    assert [r.url for r in got] == ["http://h/a#top", "http://h/a"]


def test_root_without_host_keeps_every_host(spark):
    page = spark.createDataFrame([("", '<a href="http://a.t/1">1</a><a href="http://b.t/2">2</a>')], "url string, html string")
    assert links.extract_links(page).count() == 2
    assert links.extract_links(page.withColumn("other", F.lit("http://a.t/")), root="other").count() == 1
