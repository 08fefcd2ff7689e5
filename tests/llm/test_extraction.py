import html
import math
import random
import re
import time

import pytest

from pagemill.llm import extraction


def article(page):
    """The article element of the test pages, by rule: tags away, references decoded, white space as one space."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", " ", inner))).split())


def test_whole_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extraction.extract_main_text(pages).collect()}
    assert got == {k: (u, t, len(t)) for k, (u, t) in want.items()}


STORY = "<h2>Ferry back in service</h2><p>The ferry runs again after <a href='/w'>six weeks</a> in the dock, and travellers are glad &mdash; very.</p>" \
    "<p>A second   paragraph\nsays more about the ferry,<br>its crew and <b>its</b> new en<i>gine</i>.</p><ul><li>first trip at six</li><li>last at nine</li></ul>"
TEXT = "Ferry back in service The ferry runs again after six weeks in the dock, and travellers are glad — very. " \
    "A second paragraph says more about the ferry, its crew and its new engine. first trip at six last at nine"
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Section {i}</a></li>" for i in range(12)) + "</ul>"
TALK = "<p>" + "I have so much to say about this ferry that it will not fit. " * 12 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='site-header'>Harbour News</div><div>{MENU}</div><div id=main><div>{STORY}</div></div><div class='footer'>(c) Harbour</div></body>",
        f"<html><head><title>x</title><style>p{{}}</style></head><body><nav>{MENU}</nav><article>{STORY}<aside>Buy a boat</aside></article><section id='comments'>{TALK}</section></body>",
        f"<body><div class='cookie-notice'>We use cookies. Agree?</div><main>{STORY}<form><input><p>Your mail</p></form><script>if (a < b) x('<p>no</p>')</script></main><div class=sidebar>{MENU}</div></body>",
        f"<body class='has-comments'><div class='page sidebar-left'><div class=nav>{MENU}</div><main class='content no-sidebar'><header>{STORY[:30]}</header>{STORY[30:]}</main></div></body>",
        f"<body><div><div class='advert'>Great boats, cheap, buy now, every day of the week</div>{STORY}</div><div class=user-comments>{TALK}</div>",
    ],
)
def test_layouts(page):
    assert extraction.main_text(page) == TEXT


def test_damaged_and_plain():
    assert extraction.main_text("no markup &lt;here&gt; &#233;") == "no markup <here> é"
    assert extraction.main_text("<p>one<p>two</b></i><div>three") == "one two three"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert extraction.main_text(deep) == "deep"
    assert extraction.main_text("<!-- only --><script>x</script>") == ""


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "w", "<p>" + "word " * 50_000, 3), (4, "x", "<p>a", 4), (4, "x", "<p>a", 4), (None, None, "<b>z", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in extraction.extract_main_text(pages).collect()), key=repr)
    assert got == sorted([(1, "u", 0), (2, None, 0), (3, "w", 249_999), (4, "x", 1), (4, "x", 1), (None, None, 1)], key=repr)
    assert extraction.extract_main_text(pages.limit(0)).count() == 0


def prose(tag, n, size):
    """n paragraphs of about ``size`` characters."""
    return [" ".join(f"{tag}{k}word{i}" for i in range(size // 9)) + "." for k in range(n)]


@pytest.mark.parametrize("counts", [(3, 3), (6, 6, 6), (2, 5, 1, 3)])
@pytest.mark.parametrize("wrap", ["section", "div"])
def test_articles_in_several_sections(counts, wrap):
    parts = [[f"Part {k} of it", *prose("abcd"[k], n, 450)] for k, n in enumerate(counts)]
    body = "".join(f"<{wrap}><h2>{x[0]}</h2>{''.join(f'<p>{t}</p>' for t in x[1:])}</{wrap}>" for x in parts)
    for page in (f"<body><div>{MENU}</div>{body}<div>{MENU}</div></body>", f"<body><ul>{MENU}</ul><div><div>{body}</div></div>"):
        assert extraction.main_text(page) == " ".join(t for x in parts for t in x)


LONG = [f"<p>{t}</p>" for t in prose("s", 6, 450)]
SAID = " ".join(prose("s", 6, 450))


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><article><h2 id='related-work'>Related work</h2>{LONG[0]}<h2 id=search>Search</h2>{''.join(LONG[1:])}</article></body>",
         f"Related work {SAID[: len(prose('s', 1, 450)[0])]} Search {SAID[len(prose('s', 1, 450)[0]) + 1 :]}"),
        (f"<body><nav>{MENU}</nav><div class='page sidebar-left'><div class=nav>{MENU}</div><div>{''.join(LONG)}</div></div></body>", SAID),
        ("<body>" + "".join(f"<div class='elementor-widget'><div class='elementor-widget-container'>{p}</div></div>" for p in LONG) + "</body>", SAID),
        (f"<body><article>{''.join(LONG[:5])}<section class=related>{LONG[5]}</section><div class=related>{MENU}</div></article></body>", SAID),
        (f"<html><head><title>x</title><meta name=a><p>{LONG[0][3:]}{''.join(LONG[1:])}", SAID),
        (f"<head><title>x</title><div id=page>{''.join(LONG)}</div>", SAID),
        ("<head><title>x</title>bare words", "bare words"),
        (f"<body><article>{''.join(LONG)}<h2>Sources</h2><ul><li><a href='/a'>First source</a></li><li><a href='/b'>Second source</a></li></ul></article>",
         SAID + " Sources First source Second source"),
        (f"<body><div>{''.join(LONG)}</div><div class='comments'>{TALK}</div><div class=widget><p>About us, in a few words</p></div>", SAID),
    ],
)
def test_names_and_heads_do_not_empty_a_page(page, text):
    assert extraction.main_text(page) == text


PROSE = " ".join(prose("o", 3, 400))
SECOND = " ".join(prose("q", 3, 400))


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><body>{PROSE}<br>{SECOND}</body></html>", f"{PROSE} {SECOND}"),
        (f"<body><h1>Head</h1>{PROSE}</body>", f"Head {PROSE}"),
        (f"<body><font size='2'>{PROSE}</font></body>", PROSE),
        (f"<body>{PROSE} <a href='/x'>a link</a> {SECOND}", f"{PROSE} a link {SECOND}"),
        (f"<body><nav>{MENU}</nav>{PROSE}<p>{SECOND}</p></body>", f"{PROSE} {SECOND}"),
        (f"<body><p>{PROSE}</p></body></html> {SECOND}", f"{PROSE} {SECOND}"),
        (f"<body><div><![foo</div><p>{PROSE}</p></body>", PROSE),
        (f"<body><p>{PROSE}</p><![endif--></body>", PROSE),
        (f"<body><![-- x --><p>{PROSE}</p>", PROSE),
        (f"<?xml version='1.0'?><!DOCTYPE html><p>{PROSE}</p></>", PROSE),
        (f"<body><p>{PROSE}</p><!-- never closed <p>{SECOND}</p>", PROSE),
        (f"<body><!--><p>{PROSE}</p><!-- a -- b --!><p>{SECOND}</p>", f"{PROSE} {SECOND}"),
        (f"<body><p title='a > b' data-x=\"it's\">{PROSE}</p><p title='the hidden class=comment'>{SECOND}</p>", f"{PROSE} {SECOND}"),
        (f"<body><article><h2>A</h2><p>{PROSE}</p></article><article><h2>B</h2><p>{SECOND}</p></article></body>", f"A {PROSE} B {SECOND}"),
        (f"<body><article><p>{PROSE}</p></article><article><a href='/1'>Other news of the day</a></article></body>", PROSE),
        (f"<body><p>{PROSE} 3 < 4 &amp; 5 > 4</p>", f"{PROSE} 3 < 4 & 5 > 4"),
        (f"<body><p>{PROSE}</p><p>cut <a href='/never", f"{PROSE} cut"),
    ],
)
def test_common_and_damaged_pages(page, text):
    assert extraction.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    ["<div>" * 20_000 + "x", "<b>" * 20_000 + "x", "<article>" * 20_000 + "x", "<a " * 20_000, "<a x='>' " * 20_000, "<a x='" * 20_000, "<!--" * 20_000,
     "<ul><li>" + "<b>" * 20_000 + "<li></li>" * 20_000, "<p>" * 50_000, "<" * 100_000, "<script>" * 20_000, f"<a {'= ' * 50_000}>x"],
    ids=lambda page: page[:12],
)
def test_long_and_deep_pages_take_linear_time(page):
    t0 = time.process_time()
    extraction.main_text(page)
    assert time.process_time() - t0 < 1


def test_odd_pages_do_not_stop_the_others(spark):
    rows = [(k, "u", h) for k, h in enumerate(["<div><![foo</div>", "<![endif-->", "<![-- x -->", "<!", "<", "</", "<a", "<p>fine", "\x00<é>&#0;&#xffffffff;"])]
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[7] == "fine"


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.4 or depth > 6:
            out.append("word " * rng.randint(1, 30))
        else:
            tag = rng.choice("div p span a b section ul li nav script em table br".split())
            out.append(f"<{tag}>" if tag == "br" else f"<{tag}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def slow_counts(node):
    """(chars, tags, link chars, link tags) by plain recursion."""
    chars = tags = link_chars = link_tags = 0
    for part in node.parts:
        if isinstance(part, str):
            chars += sum(not c.isspace() for c in part)
        elif not part.aside:
            c, t, lc, lt = slow_counts(part)
            chars, tags, link_chars, link_tags = chars + c, tags + t, link_chars + lc, link_tags + lt
            tags += part.tag not in extraction.VOID
            link_tags += part.tag == "a"
    return chars, tags, chars if node.tag == "a" else link_chars, link_tags


def slow_density(node, ratio):
    c, t, lc, lt = slow_counts(node)
    if not c:
        return 0.0
    t, lt = max(t, 1), max(lt, 1)
    base = math.log(c * lc / max(c - lc, 1) + ratio * c + math.e)
    return c / t * math.log(max(c / max(lc, 1) * (t / lt), 1.0)) / base


def test_densities_by_recursion():
    rng = random.Random(4)
    for _ in range(150):
        body = extraction._Tree(random_page(rng)).root
        extraction._set_runs(body)
        nodes = extraction._measure(body)
        c, _, lc, _ = slow_counts(body)
        ratio = lc / c if c else 0.0
        for node in nodes:
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == slow_counts(node)
            assert math.isclose(node.density, slow_density(node, ratio), abs_tol=1e-9)
            inner = [p for p in node.parts if isinstance(p, extraction.Node) and not p.aside]
            assert math.isclose(node.total, sum(slow_density(p, ratio) for p in inner), abs_tol=1e-9)
