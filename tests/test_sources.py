"""Documents, papers, pings, sinks and the snapshot store."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from pagemill.operators.monitor import monitor_check
from pagemill.sources import documents, papers, pings, sinks
from pagemill.sources.pages import read_fetch_log

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def packed(**files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return buffer.getvalue()


def para(*texts):
    return "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts) + "</w:p>"


def docx():
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("Hel", "lo") + para(" ") + para("World") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('d')}</w:tr></w:tbl>"
    return packed(**{"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'})


def pptx(n):
    ids = "".join(f'<p:sldId r:id="r{i}"/>' for i in range(n))
    files = {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="slides/s{i}.xml"/>' for i in range(n)) + "</Relationships>",
    }
    for i in range(n):
        text = f"<a:p><a:r><a:t>line {i}</a:t></a:r></a:p><a:p><a:r><a:t>more</a:t></a:r></a:p>" if i != 1 else "<a:p/>"
        files[f"ppt/slides/s{i}.xml"] = (
            f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree><p:sp><p:txBody>{text}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
        )
    return packed(**files)


def test_documents(spark, tmp_path):
    for name, body in (("a.docx", docx()), ("b.pptx", pptx(4)), ("c.pdf", b"%PDF-1.4"), ("d.docx", b"broken"), ("e.bin", b"x"), ("f", b"%PDF-1")):
        (tmp_path / name).write_bytes(body)
    files = documents.read_documents(spark, str(tmp_path))
    got = {r.url.rsplit("/", 1)[1]: r for r in documents.document_text(files, max_pages=3).collect()}
    assert (got["a.docx"].markdown, got["a.docx"].pages_or_sections) == ("Hello\n\nWorld\n\na | b\nc | d", 3)
    assert (got["b.pptx"].markdown, got["b.pptx"].pages_or_sections) == ("## Slide 1\n\nline 0\nmore\n\n## Slide 3\n\nline 2\nmore", 3)
    assert got["c.pdf"].error and got["f"].doc_type == "pdf" and got["c.pdf"].markdown is None
    assert got["d.docx"].error.startswith("docx parse failed")
    assert got["e.bin"].error == "unsupported document type (content-type='', ext='bin')"
    assert got["a.docx"].bytes == len(docx())


def test_arxiv(spark):
    entry = (
        "<entry><id> http://a/abs/2401.1v2 </id><title> A\n title </title><summary>" + "s " * 1000 + "</summary><published>2024-01-02</published>"
        "<author><name> Ann </name></author><author><name></name></author><category term='cs.LG'/><category/>"
        "<link href='h'/><link title='pdf' href='p1'/><link title='pdf' href='p2'/></entry><entry><title>bare</title></entry>"
    )
    feeds = [("f1", f'<feed xmlns="http://www.w3.org/2005/Atom">{entry}</feed>'), ("f2", "not xml"), ("f3", "<feed></feed>")]
    rows = papers.parse_arxiv(spark.createDataFrame(feeds, "f string, xml string")).collect()
    full = next(r for r in rows if r.f == "f1" and r.entry_pos == 0)
    assert (full.id, full.url, full.pdf_url, full.title) == ("2401.1v2", "http://a/abs/2401.1v2", "p2", "A title")
    assert (full.authors, full.categories, full.published) == (["Ann"], ["cs.LG"], "2024-01-02") and len(full.summary) == 1500
    bare = next(r for r in rows if r.f == "f1" and r.entry_pos == 1)
    assert (bare.id, bare.url, bare.title, bare.authors, bare.summary, bare.published) == (None, None, "bare", [], "", None)
    assert [r.error for r in rows if r.f == "f2"] == ["unreadable feed"]
    assert not [r for r in rows if r.f == "f3"]


def test_crossref(spark):
    works = [
        {"DOI": "10.1/x", "title": ["One", "Two"], "author": [{"given": f"G{i}", "family": "F"} for i in range(20)] , "abstract": "<p>a</p> <b>b</b>",
         "issued": {"date-parts": [[2024, 3]]}, "URL": "http://u"},
        {"DOI": "10.1/y", "author": [{"family": "Only"}], "issued": {"date-parts": [[]]}},
        {"title": []},
    ]
    body = json.dumps({"message": {"items": works}})
    rows = papers.parse_crossref(spark.createDataFrame([(1, body), (2, "{oops"), (3, '{"message": {}}')], "k int, json string")).collect()
    a, b, c = sorted((r for r in rows if r.k == 1), key=lambda r: r.entry_pos)
    assert (a.title, a.url, a.summary, a.published, len(a.authors)) == ("One", "http://u", "a b", "2024-3", 12)
    assert (b.url, b.authors, b.published, b.title) == ("https://doi.org/10.1/y", ["Only"], None, "")
    assert (c.id, c.url, c.authors) == (None, None, [])
    assert [r.error for r in rows if r.k == 2] == ["unreadable answer"] and not [r for r in rows if r.k == 3]


def test_pings(spark):
    bodies = ['{"id": "0123456789abcdef", "version": "0.7.2", "python": "3.13.0", "platform": "linux", "ts": 1700000000}',
              '{"id": "' + "a" * 70 + '", "ts": "x"}', '{"id": "ABCDEF0123"}', "nope", '{"id": "' + "a" * 5000 + '"}', '{"id": "0123456789", "ts": 0}', "[]",
              '{"id": "abcdef01\\n"}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string").withColumn("received_at", F.timestamp_seconds(F.lit(5)))
    good, bad = pings.read_pings(df)
    assert {r.i: r.reject_reason for r in bad.collect()} == {2: "bad id", 3: "bad json", 4: "payload too large", 6: "bad id", 7: "bad id"}
    got = {r.i: r for r in good.withColumn("s", F.unix_seconds("ts")).collect()}
    assert (got[0].version, got[0].s, len(got[1].id), got[1].s, got[5].s) == ("0.7.2", 1700000000, 64, 5, 5)


def test_rag_lines(spark, tmp_path):
    df = spark.createDataFrame([("u", None, "text", "2024-01-01T00:00:00Z")], "url string, title string, markdown string, fetched_at string")
    sinks.write_rag_jsonl(df, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*.json") for x in f.read_text().splitlines()]
    assert lines == [{"url": "u", "title": None, "markdown": "text", "fetched_at": "2024-01-01T00:00:00Z"}]


def test_snapshot_store(spark, tmp_path):
    store = sinks.SnapshotStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.history("u").first().history_status == "no_history"

    def rows(first, last, url="u"):
        return spark.range(first, last).select(
            F.lit(url).alias("url"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("snapshot_id"), F.lit("T").alias("title"),
            F.lit(200).alias("status"), F.lit("fetch_fast").alias("method"), (F.col("id") / 2).cast("int").cast("string").alias("text"),
        )

    store.append(rows(0, 15))
    store.append(rows(15, 30))
    store.append(rows(100, 103, "v"))
    assert store.latest().filter("url = 'u'").first().snapshot_id == 29
    assert [r.snapshot_id for r in store.history("u").orderBy("age_rank").collect()] == list(range(29, 9, -1))
    statuses = monitor_check(store.read("u")).groupBy("check_status").count().collect()
    assert {r.check_status: r["count"] for r in statuses} == {"new": 1, "changed": 14, "unchanged": 15}
    store.compact()
    assert store.read().count() == 23
    store.forget(spark.createDataFrame([("u",)], "url string"), "1970-01-01 00:00:29")
    assert store.read().count() == 3 and store.history("u").first().history_status == "no_history"
    store.append(rows(30, 31))
    store.compact()
    assert store.read("u").count() == 1 and store.read().count() == 4


def test_fetch_log_formats(spark, tmp_path):
    df = spark.createDataFrame([("u", "u", "fast", 1, 200, "<p>", None, 5)], "url string, final_url string, tier string, attempt int, status int, html string, error string, elapsed_ms int")
    for fmt in ("json", "parquet"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        assert [tuple(r) for r in read_fetch_log(spark, str(tmp_path / fmt), fmt).collect()] == [tuple(r) for r in df.collect()]
