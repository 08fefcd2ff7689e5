"""URL columns: parity of the join with urllib, literal cases for the rest."""

import random
import urllib.parse as up

from pyspark.sql import functions as F

from pagemill.functions import urls as u

BASES = ["http://x.example/a/b", "https://h.t", "https://h.t/", "http://h.t/a/b/c?q=1#f", "http://h.t/a//b/", "http://h.t/a;p/b;q?z", "HTTP://H.T/x"]
ATOMS = ["..", ".", "a", "", "b;p=1", "x.html", "c", "?q=1", "#f", "/", "//", "?", "é", "a b", "%zz", "https://o.t/a/../b", "//n.t/p", ";p"]


def expected(base, href):
    try:
        p = up.urlparse(up.urljoin(base, href))
    except ValueError:
        return None
    return f"{p.scheme}://{p.netloc}{p.path}" + (f"?{p.query}" if p.query else "")


def test_join_like_urllib(spark):
    random.seed(5)
    rows = []
    for _ in range(3000):
        if random.random() < 0.6:
            href = "/".join(random.choice(ATOMS[:7]) for _ in range(random.randint(1, 6)))
        else:
            href = "".join(random.choice(ATOMS) for _ in range(random.randint(1, 4)))
        href = random.choice(["", "/"]) + href + random.choice(["", "", "?q=2", "#z"])
        if href.strip():
            rows.append((random.choice(BASES), href))
    rows += [("http://h.t/a", "http:foo"), ("http://h.t/a", "http://[bad"), ("http://h.t/a/b", "../z;p=1?q=1#f")]
    got = u.with_resolved(spark.createDataFrame(rows, "b string, h string"), "b", "h")
    for r in got.collect():
        want = expected(r.b, r.h)
        if want and not want.startswith(("http://", "https://")):
            # other schemes are never pages; urllib keeps ;params for unknown ones
            assert r.link_scheme not in ("http", "https")
        else:
            assert r.link_url == want, (r.b, r.h)


def values(spark, fn, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[1] for r in df.select("i", fn(F.col("x"))).orderBy("i").collect()]


def test_page_urls(spark):
    paths = ["/a.css", "/a.CSS", "/a.pdf", "/a.docx", "/v1.2/readme", "/x.tar.gz", "/", "", "/.js", "/css"]
    keep = values(spark, lambda x: u.is_page_path(F.lit("https"), x), paths)
    assert keep == [False, False, True, True, True, False, True, True, False, True]
    assert values(spark, lambda x: u.is_page_path(x, F.lit("/a")), ["ftp", "http"]) == [False, True]


def test_clean(spark):
    assert values(spark, u.clean_url, ["HTTPS://H.t/a/;p?q#f", "http://h", "http://h/a/../b?x"]) == [
        "https://H.t/a/?q", "http://h", "http://h/a/../b?x",
    ]


def test_unwrap(spark):
    links = ["//duckduckgo.com/l/?uddg=a%2525b", "//duckduckgo.com/l/?uddg=bad%zz", "//duckduckgo.com/l/?uddg=a%2Bb+c",
             "https://duckduckgo.com/?q=1", " //p.t/x ", "#a", "mailto:x", "javascript:1", "", "http://k.t/", "rel"]
    assert values(spark, u.unwrap_redirect, links) == [
        "a%b", "bad%zz", "a+b c", None, "https://p.t/x", None, None, None, None, "http://k.t/", "rel",
    ]


def test_snapshot_key_and_versions(spark):
    keys = values(spark, u.snapshot_key, ["https://a.b/c?d=é", "", "x" * 300])
    assert keys == ["https___a.b_c_d__", "url", "x" * 200]
    versions = ["0.10.0", "0.9.1", "0.9", "1.0b1", ""]
    assert values(spark, u.version_key, versions) == [[0, 10, 0], [0, 9, 1], [0, 9], [0], [0]]
    assert values(spark, lambda v: u.path_filter(v, "do.s", "/tag/"), ["/docs", "/docs/tag/", "/x"]) == [True, False, False]
