"""Paper feeds: Atom XML and JSON answers to one paper shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse_space, strip_tags
from ..functions.urls import strip_space

# Caps on summaries (characters) and on JSON author lists.
SUMMARY_CHARS = 1500
MAX_JSON_AUTHORS = 12
DOI_PREFIX = "https://doi.org/"

_ATOM = (
    "entry array<struct<id:string,title:string,summary:string,published:string,"
    "author:array<struct<name:string>>,category:array<struct<_term:string>>,"
    "link:array<struct<_title:string,_href:string>>>>"
)
_ENTRY = (
    "id string, title string, summary string, published string, author array<struct<name:string>>, "
    "category array<struct<_term:string>>, link array<struct<_title:string,_href:string>>"
)
_JSON = (
    "message struct<items:array<struct<DOI:string,URL:string,title:array<string>,abstract:string,"
    "author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>>>>"
)


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def parse_arxiv(df: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per Atom entry; an unreadable feed is one row with ``error``."""
    others = [c for c in df.columns if c != xml]
    feed = F.from_xml(F.col(xml), _ATOM, {"ignoreNamespace": "true"})
    parsed = df.select(*others, F.col(xml), feed.alias("feed"))
    readable = F.contains(_blank(F.col(xml)), F.lit("<feed"))
    rows = parsed.select(
        *others,
        F.when(~readable, "unreadable feed").alias("error"),
        F.posexplode_outer("feed.entry").alias("entry_pos", "e"),
    ).filter(F.col("e").isNotNull() | F.col("error").isNotNull())
    return _atom_papers(rows, [*others, "entry_pos"])


def read_arxiv_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Atom feeds as files, one row per entry; an entry that cannot be read is a row with ``error`` and its text.

    Files are read in pieces that end with an entry, so a large feed is split over many tasks and never held
    whole. An entry that is cut off by the end of its file is read as far as it goes.
    """
    ends = spark.read.option("lineSep", "</entry>").text(path)
    # what stands before the first entry is the head of the feed; an entry before the last one of a piece has no end
    pieces = F.split("value", r"<entry(?=[\s>])")
    begun = ends.select(F.posexplode(pieces).alias("at", "body"), (F.size(pieces) - 1).alias("last")).filter("at > 0")
    text = F.concat(F.lit("<entry"), F.col("body"), F.when(F.col("at") == F.col("last"), "</entry>").otherwise(""))
    options = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = begun.select(text.alias("text")).select("text", F.from_xml("text", f"{_ENTRY}, _corrupt string", options).alias("e"))
    unread = F.col("e").isNull() | F.col("e._corrupt").isNotNull()
    rows = parsed.select("e", F.when(unread, F.col("text")).alias("unread"), F.when(unread, "unreadable entry").alias("error"))
    return _atom_papers(rows, ["unread"])


def _atom_papers(rows: DataFrame, others: list[str]) -> DataFrame:
    """Entries ``e`` in paper shape."""
    abs_id = strip_space(_blank(F.col("e.id")))
    names = F.transform("e.author", lambda a: strip_space(_blank(a["name"])))
    terms = F.transform("e.category", lambda c: _blank(c["_term"]))
    pdfs = F.filter("e.link", lambda link: link["_title"] == "pdf")
    none = F.array().cast("array<string>")
    return rows.select(
        *others,
        F.lit("arxiv").alias("source"),
        F.nullif(F.element_at(F.split(abs_id, "/"), -1), F.lit("")).alias("id"),
        F.lit(None).cast("string").alias("doi"),
        F.nullif(abs_id, F.lit("")).alias("url"),
        F.try_element_at(pdfs, F.lit(-1))["_href"].alias("pdf_url"),
        collapse_space(_blank(F.col("e.title"))).alias("title"),
        F.coalesce(F.filter(names, lambda n: n != ""), none).alias("authors"),
        F.left(collapse_space(_blank(F.col("e.summary"))), F.lit(SUMMARY_CHARS)).alias("summary"),
        F.nullif(strip_space(_blank(F.col("e.published"))), F.lit("")).alias("published"),
        F.coalesce(F.filter(terms, lambda t: t != ""), none).alias("categories"),
        "error",
    )


def parse_crossref(df: DataFrame, body: str = "json") -> DataFrame:
    """One row per work; an unreadable answer is one row with ``error``."""
    others = [c for c in df.columns if c != body]
    parsed = df.select(
        *others,
        F.when(F.try_parse_json(body).isNull(), "unreadable answer").alias("error"),
        F.from_json(F.col(body), _JSON).alias("m"),
    )
    rows = parsed.select(*others, "error", F.posexplode_outer("m.message.items").alias("entry_pos", "e")).filter(
        F.col("e").isNotNull() | F.col("error").isNotNull()
    )
    doi = F.nullif(F.col("e.DOI"), F.lit(""))
    people = F.transform(
        F.slice(F.coalesce("e.author", F.array().cast("array<struct<given:string,family:string>>")), 1, MAX_JSON_AUTHORS),
        lambda a: F.trim(F.concat(_blank(a["given"]), F.lit(" "), _blank(a["family"]))),
    )
    parts = F.get(F.col("e.issued")["date-parts"], 0)
    return rows.select(
        *others,
        "entry_pos",
        F.lit("crossref").alias("source"),
        doi.alias("id"),
        doi.alias("doi"),
        F.coalesce(F.nullif(F.col("e.URL"), F.lit("")), F.concat(F.lit(DOI_PREFIX), doi)).alias("url"),
        F.lit(None).cast("string").alias("pdf_url"),
        _blank(F.get("e.title", 0)).alias("title"),
        people.alias("authors"),
        F.left(strip_tags(F.col("e.abstract")), F.lit(SUMMARY_CHARS)).alias("summary"),
        F.nullif(F.array_join(F.transform(parts, lambda p: p.cast("string")), "-"), F.lit("")).alias("published"),
        F.array().cast("array<string>").alias("categories"),
        "error",
    )
