"""Selector jobs: structured extraction, scoping, scoped text.

Page markup needs a real tree, so these run in Python on Arrow batches, page by page,
with only the html and the keys crossing over. Nothing is shuffled.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import compile_selector, parse, select
from ..functions.text import html_to_text

DEFAULT_BASE = "body"
DEFAULT_ATTRIBUTE = "href"


def _compiled(selector: str | None):
    try:
        return compile_selector(selector) if selector else None
    except ValueError:
        return False


def schema_columns(schema: dict) -> list[str]:
    """Output columns of an extraction schema, in order, each once."""
    return list(dict.fromkeys(f.get("name", f.get("selector", "?")) for f in schema.get("fields", [])))


def _field_reader(field: dict):
    steps, kind = _compiled(field.get("selector")), field.get("type", "text")
    attribute = field.get("attribute", DEFAULT_ATTRIBUTE)

    def read(item):
        if steps is False:
            return None
        node = item if steps is None else next(select(item, steps), None)
        if node is None:
            return None
        if kind == "attribute":
            return node.attrs.get(attribute)
        return node.outer_html() if kind == "html" else node.text()

    return read


def extract_structured(
    pages: DataFrame, schema: dict, keys: Sequence[str] = ("url",), html: str = "html"
) -> DataFrame:
    """One row per base match: keys, ``item_pos`` from 0, one string column per field.

    A field takes its first match inside the item; no selector means the item itself.
    """
    base_selector = schema.get("baseSelector", DEFAULT_BASE)
    base = compile_selector(base_selector)
    fields = schema.get("fields", [])
    names, keys = schema_columns(schema), list(keys)
    key_fields = [pages.schema[k] for k in keys]
    out = T.StructType(
        [*key_fields, T.StructField("item_pos", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = [(f.get("name", f.get("selector", "?")), _field_reader(f)) for f in fields]
        for batch in batches:
            rows = []
            for values in batch.itertuples(index=False, name=None):
                root = parse(values[-1])
                items = list(select(root, base)) or ([root] if base_selector == DEFAULT_BASE else [])
                for pos, item in enumerate(items):
                    got = {name: read(item) for name, read in readers}
                    rows.append((*values[:-1], pos, *(got[n] for n in names)))
            yield pd.DataFrame(rows, columns=out.names)

    return pages.select(*keys, html).mapInPandas(run, out)


def _scoped(selector: str, as_text: bool):
    steps = compile_selector(selector)

    @F.pandas_udf(T.StringType())
    def scoped(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            out = []
            for html in batch:
                nodes = list(select(parse(html), steps)) if html else []
                if as_text:
                    out.append("\n".join(n.text() for n in nodes))
                else:
                    out.append("\n".join(n.outer_html() for n in nodes) if nodes else None)
            yield pd.Series(out, dtype=object)

    return scoped


def scope_to_selector(pages: DataFrame, selector: str | None) -> DataFrame:
    """Cut html to the selector's matches and rebuild the text; title and method stay.

    No selector, no match, a bad selector or an empty page: the page stays as it is.
    """
    if not selector:
        return pages
    if _compiled(selector) is False:
        warnings.warn(f"selector {selector!r} cannot be used; pages keep their full html", stacklevel=2)
        return pages
    found = F.col("_scoped").isNotNull()
    entry = F.create_map(F.lit("css_selector"), F.lit(selector))
    others = F.map_filter("meta", lambda k, _: k != "css_selector")
    return (
        pages.withColumn("_scoped", _scoped(selector, as_text=False)(F.col("html")))
        .withColumns(
            {
                "html": F.coalesce("_scoped", "html"),
                "markdown": F.when(found, html_to_text(F.col("_scoped"))).otherwise(F.col("markdown")),
                "meta": F.when(found, F.map_concat(others, entry)).otherwise(F.col("meta")),
            }
        )
        .drop("_scoped")
    )


def scoped_text(html: Column, markdown: Column, selector: str | None) -> Column:
    """Text of all matches, '' without a match; the page text without a usable selector."""
    if not selector or _compiled(selector) is False:
        return markdown
    return _scoped(selector, as_text=True)(html)
