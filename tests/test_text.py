"""Markup columns: literal cases, and parity with plain Python on random markup."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pagemill.functions import text as t


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()[0]


SHELL = (
    "<html><head><title>Harbour</title><style>" + "#q i{top:0}" * 300 + "</style></head><body><main id='root'></main><script>"
    + "boot(7);" * 900 + "</script></body></html>"
)
ARTICLE = "<html><body>" + "<p>The ferry leaves the northern quay at six and comes back at nine.</p>" * 90 + "</body></html>"


def test_skeleton(spark):
    flag = t.is_js_skeleton(F.col("html"), F.col("status"))
    assert one(spark, flag, html=SHELL, status=200) is True
    assert one(spark, flag, html=SHELL, status=404) is False
    assert one(spark, flag, html=ARTICLE, status=200) is False
    assert one(spark, flag, html="<body><p>short note</p></body>", status=200) is False
    assert one(spark, flag, html=None, status=200) is False
    assert one(spark, flag, html="<noscript>" + "x" * 9000 + "</noscript>", status=200) is True


def test_blocks(spark):
    h, s = F.col("html"), F.col("status")
    both = F.concat_ws(",", t.is_challenge(h, s).cast("string"), t.is_block(h, s).cast("string"))
    assert one(spark, both, html="fine", status=200) == "false,false"
    assert one(spark, both, html="fine", status=404) == "false,true"
    assert one(spark, both, html="fine", status=503) == "true,true"
    assert one(spark, both, html="x Just a moment... y", status=200) == "true,true"
    assert one(spark, both, html="just a moment...", status=200) == "false,false"
    assert one(spark, both, html=None, status=None) == "false,false"


def test_titles(spark):
    title = t.page_title(F.col("html"))
    assert one(spark, title, html="<title>a b\x1cc<b>  d</b></title>") == "a b c d"
    assert one(spark, title, html="<title> </title>") is None
    assert one(spark, title, html="<p>none</p>") is None
    assert one(spark, title, html="<TITLE lang=x>One\n two</TITLE><title>no</title>") == "One two"
    assert one(spark, title, html="<title>a &amp; b</title>") == "a &amp; b"
    assert one(spark, title, html=None) is None


def test_html_to_text(spark):
    text = t.html_to_text(F.col("html"))
    assert one(spark, text, html="&amp;lt;x&nbsp;y") == "<x y"
    assert one(spark, text, html="a<script>1</script>b<style>2</style>c<noscript>n</noscript>") == "abc n"
    assert one(spark, text, html=None) == ""


def test_hashes(spark):
    assert one(spark, t.content_hash(F.col("x")), x=None) == hashlib.sha256(b"").hexdigest()
    assert one(spark, t.content_hash(F.col("x")), x="é") == hashlib.sha256("é".encode()).hexdigest()
    key = t.cache_key(F.col("u"), F.col("p"))
    assert one(spark, key, u="http://a", p="fast") == hashlib.sha256(b"fast::http://a").hexdigest()


def test_trim(spark):
    df = spark.createDataFrame([("u", "abcdef", "h" * 5), ("v", "abc", "h" * 9)], "url string, markdown string, html string")
    rows = {r.url: r for r in t.trim_page(df, max_markdown=4, max_html=6, include_html=True).collect()}
    assert (rows["u"].markdown, rows["u"].markdown_truncated, rows["u"].markdown_full_chars) == ("abcd", True, 6)
    assert (rows["v"].markdown, rows["v"].markdown_truncated, rows["v"].markdown_full_chars) == ("abc", False, None)
    assert rows["u"].html == "hhhhh" and rows["v"].html is None
    assert "html" not in t.trim_page(df).columns


def test_fit_text(spark):
    html = "<p>one two three</p><div>short</div><script>a b c d</script><p>four <b>five</b> six &amp; seven</p>"
    assert one(spark, t.fit_text(F.col("html"), 3), html=html) == "one two three\nfour five six & seven"


def test_parity_on_random_markup(spark):
    random.seed(11)
    atoms = ["<p>", "</p>", "<script>", "</script>", "</script >", "<STYLE a=b>", "</style>", "<noscript>", "</noscript>", "<title>",
             "</title>", "<", ">", "&amp;", "&lt;", "&nbsp;", " ", "\n", " ", " ", "\x1c", "\x85", "é", "x", "word", "ſ", "ı"]
    cases = ["".join(random.choice(atoms) for _ in range(random.randint(0, 25))) for _ in range(1500)]

    def collapse(s):
        return re.sub(r"\s+", " ", s).strip()

    def plain_text(h):
        for tag in ("script", "style"):
            h = re.sub(rf"<{tag}[^>]*>.*?</{tag}>", "", h, flags=re.I | re.S)
        h = re.sub("<[^>]+>", " ", h)
        for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            h = h.replace(a, b)
        return collapse(h)

    def seen(h):
        for tag in ("script", "style", "noscript"):
            h = re.sub(rf"<{tag}\b[^>]*>.*?</{tag}\s*>", " ", h, flags=re.I | re.S)
        return collapse(re.sub("<[^>]+>", " ", h))

    def head(h):
        m = re.search("<title[^>]*>(.*?)</title>", h, flags=re.I | re.S)
        return (collapse(re.sub("<[^>]+>", " ", m[1])) or None) if m else None

    h = F.col("h")
    rows = spark.createDataFrame([(c,) for c in cases], "h string").select(
        h, t.html_to_text(h), t.visible_text(h), t.page_title(h)
    )
    for case, text, visible, title in rows.collect():
        assert (text, visible, title) == (plain_text(case), seen(case), head(case)), repr(case)
