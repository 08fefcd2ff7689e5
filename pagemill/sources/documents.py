"""Office documents: type sniff and text, failures as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import drop_params, url_pieces

# Type marks in content types and contents, and the page cap.
PDF_MAGIC = b"%PDF-"
MAX_PAGES = 50
PDF_ERROR = "pdf text needs a codec that is not installed"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (url, content, content_type)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), "content", F.lit("").alias("content_type"))


def url_ending(url: Column) -> Column:
    path = F.lower(drop_params(F.get(url_pieces(url), 2)))
    return F.substring_index(path, ".", -1)


def doc_type(url: Column, content_type: Column, content: Column) -> Column:
    """pdf, docx, pptx or null; the first sign that matches wins."""
    ctype, ending = F.coalesce(content_type, F.lit("")), url_ending(url)
    magic = F.substring(content, 1, len(PDF_MAGIC)) == F.lit(PDF_MAGIC)
    return (
        F.when(F.contains(ctype, F.lit("pdf")) | (ending == "pdf") | F.coalesce(magic, F.lit(False)), "pdf")
        .when(F.contains(ctype, F.lit("officedocument.wordprocessingml")) | (ending == "docx"), "docx")
        .when(F.contains(ctype, F.lit("presentationml")) | (ending == "pptx"), "pptx")
    )


def _runs(paragraph, ns: str, line_break: str) -> str:
    marks = {f"{ns}t": None, f"{ns}tab": "\t", f"{ns}br": line_break, f"{ns}cr": line_break}
    return "".join((e.text or "") if marks[e.tag] is None else marks[e.tag] for e in paragraph.iter() if e.tag in marks)


def _docx(content: bytes, _max_pages: int) -> tuple[str, int]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    paragraphs = [_runs(p, _W, "\n") for p in body.findall(f"{_W}p")]
    blocks = "\n\n".join(p for p in paragraphs if p.strip())
    for table in body.findall(f"{_W}tbl"):
        lines, above = [], []
        for row in table.findall(f"{_W}tr"):
            cells: list[str] = []
            for cell in row.findall(f"{_W}tc"):
                span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                merge = cell.find(f"{_W}tcPr/{_W}vMerge")
                text = "\n".join(_runs(p, _W, "\n") for p in cell.findall(f"{_W}p"))
                if merge is not None and merge.get(f"{_W}val") != "restart" and len(cells) < len(above):
                    text = above[len(cells)]
                cells.extend([text] * int(span.get(f"{_W}val") if span is not None else 1))
            lines.append(" | ".join(cells))
            above = cells
        blocks += "\n\n" + "\n".join(lines)
    return blocks, len(paragraphs)


def _pptx(content: bytes, max_pages: int) -> tuple[str, int]:
    slides, n = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        rels = ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in rels}
        show = ElementTree.fromstring(z.read("ppt/presentation.xml"))
        for ref in show.findall(f"{_P}sldIdLst/{_P}sldId")[: max(max_pages, 0)]:
            target = targets[ref.get(f"{_R}id")]
            slide = ElementTree.fromstring(z.read(target if target.startswith("ppt/") else f"ppt/{target}"))
            n += 1
            frames = [
                "\n".join(_runs(p, _A, "\v") for p in frame.findall(f"{_A}p"))
                for frame in slide.findall(f"{_P}cSld/{_P}spTree/{_P}sp/{_P}txBody")
            ]
            texts = [t for t in frames if t.strip()]
            if texts:
                slides.append(f"## Slide {n}\n\n" + "\n\n".join(texts))
    return "\n\n".join(slides), n


def document_text(docs: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(url, content, content_type) to (url, doc_type, markdown, pages_or_sections, bytes, error)."""
    readers = {"docx": _docx, "pptx": _pptx}
    typed = docs.select(
        "url",
        doc_type(F.col("url"), F.col("content_type"), F.col("content")).alias("doc_type"),
        F.coalesce("content_type", F.lit("")).alias("content_type"),
        url_ending(F.col("url")).alias("ending"),
        "content",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, kind, ctype, ending, content in batch.itertuples(index=False, name=None):
                text = pages = error = None
                if kind == "pdf":
                    error = PDF_ERROR
                elif kind not in readers:
                    kind, error = None, f"unsupported document type (content-type={ctype!r}, ext={ending!r})"
                else:
                    try:
                        text, pages = readers[kind](bytes(content), max_pages)
                        text = text.strip()
                    except Exception as e:  # noqa: BLE001 - one bad file must not stop the job
                        error = f"{kind} parse failed: {e}"
                rows.append((url, kind, text, pages, len(content or b""), error))
            yield pd.DataFrame(
                rows, columns=["url", "doc_type", "markdown", "pages_or_sections", "bytes", "error"]
            ).astype({"pages_or_sections": "Int32"})

    return typed.mapInPandas(
        run,
        "url string, doc_type string, markdown string, pages_or_sections int, bytes bigint, error string",
    )
