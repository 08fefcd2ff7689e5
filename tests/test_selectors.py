from pyspark.sql import functions as F

from pagemill.functions.markup import compile_selector, parse, select
from pagemill.operators import selectors, serp
from pagemill.sources.pages import as_pages

HTML = (
    "<html><head><title>Menu card</title></head><body><ul class='dish x'><li data-no=1>Soup</li><li data-no=2 class=hot>Stew <i>of</i> beans</li></ul>"
    "<section id=info><h2>Open</h2>daily from <b>six</b></section><small>closed on Mondays</small></body></html>"
)


def pages_of(spark, html=HTML):
    return as_pages(spark.createDataFrame([("http://inn.test/", html)], "url string, html string"))


def test_scope_keeps_the_part_and_the_page_facts(spark):
    r = selectors.scope_to_selector(pages_of(spark), "#info").first()
    assert (r.markdown, r.title, r.method, r.meta) == ("Open daily from six", "Menu card", "corpus", {"css_selector": "#info"})
    assert "Mondays" not in r.html


def test_unusable_scopes_leave_the_page_whole(spark):
    page = pages_of(spark)
    before = page.first()
    for selector in ("table", None, "", "li:("):
        after = selectors.scope_to_selector(page, selector).first()
        assert (after.html, after.markdown, after.meta) == (before.html, before.markdown, {})


def test_scoped_text_by_selector(spark):
    page = pages_of(spark)

    def text(selector):
        return page.select(selectors.scoped_text(F.col("html"), F.col("markdown"), selector)).first()[0]

    assert [text(s) for s in ("li.hot", "h2, small", "table")] == ["Stew\nof\nbeans", "Open\nclosed on Mondays", ""]
    assert text(None) == text("li:(") == page.first().markdown


def rows_of(spark, base, *fields, html=HTML):
    schema = {"fields": [dict(zip(("name", "selector", "type", "attribute"), f)) for f in fields]} | ({"baseSelector": base} if base else {})
    return [tuple(r)[1:] for r in selectors.extract_structured(pages_of(spark, html), schema).orderBy("item_pos").collect()]


def test_extraction_field_kinds(spark):
    items = rows_of(spark, "li", ("dish", "", "text"), ("no", "", "attribute", "data-no"), ("raw", "i", "html"))
    assert items == [(0, "Soup", "1", None), (1, "Stew\nof\nbeans", "2", "<i>of</i>")]
    assert rows_of(spark, "body", ("odd", "b", "?"), ("bad", "li:("), ("first", "li", "text")) == [(0, "six", None, "Soup")]
    assert rows_of(spark, "ol li", ("t", "", "text")) == []
    assert rows_of(spark, None, ("t",), html="no tags") == [(0, "no tags")]


def test_selector_subset():
    root = parse("<div id=a class='x y'><p>1<p>2</p><span data-k=v><p>3</p></span><br>t</div>")
    def count(s):
        return len(list(select(root, compile_selector(s))))
    assert [count(s) for s in ("p", "div > p", "div p", ".x.y", "#a", "[data-k]", "[data-k='v'] p", "[data-k=w]", "p, span", "*")] == [
        3, 2, 3, 1, 1, 1, 1, 0, 4, 6,
    ]


def test_serp_limits(spark):
    html = (
        '<a class="result__a" href="#">skip</a><a class="result__snippet">s</a>'
        '<a class="result__a" href="https://a.t/">A <b>1</b></a> x <a class="result__snippet" href="#">first\n one</a>'
        '<a class="result__a" href="//b.t/">B</a><a class="result__snippet">second</a>'
    )
    df = spark.createDataFrame([(1, html, "")], "id int, html string, lite string")
    got = [tuple(r) for r in serp.parse_serp(df.drop("lite"), "html").collect()]
    assert got == [(1, 1, "https://a.t/", "A 1", "first one"), (1, 2, "https://b.t/", "B", "second")]
    assert serp.parse_serp(df.drop("lite"), "html", limit=0).count() == 1
    swapped = df.select("id", F.lit("walled").alias("html"), F.col("html").alias("lite"))
    assert serp.parse_serp_first(swapped).count() == 2
