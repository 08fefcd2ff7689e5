"""Markup and text columns (block checks, title, visible text, hashes, trimming)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The Unicode white space that counts as blank in page text.
# Java's \s is ASCII only, so the class is spelled out. The rare ones sit behind a
# range check that rejects ASCII at once, which halves the cost per character.
WS = r"[\t-\r\x1c-\x20[\x85-\u3000&&[\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"

# Statuses and page markers of an anti-bot challenge.
CHALLENGE_STATUSES = (403, 503)
CHALLENGE_MARKERS = (
    "cf-mitigated",
    "cf-chl-bypass",
    "challenge-platform",
    "Just a moment...",
    "cf-challenge",
)

# Thresholds in characters.
SKELETON_MIN_HTML = 5000
SKELETON_MAX_TEXT = 250
MAX_MARKDOWN_CHARS = 60_000
MAX_HTML_CHARS = 200_000

# Tags that start or end a block of text.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|"
    "form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|"
    "th|thead|title|tr|ul"
)

_ANY_TAG = r"<[^>]+>"
_WORD_END = r"(?![\p{L}\p{N}_])"


def _empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def collapse_space(text: Column) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def strip_tags(text: Column) -> Column:
    return collapse_space(F.regexp_replace(_empty_if_null(text), _ANY_TAG, " "))


def _drop_element(html: Column, tag: str, by: str, strict_end: bool) -> Column:
    # visible_text accepts blanks in the end tag and needs a whole tag name,
    # html_to_text does neither
    start, end = (_WORD_END, WS + "*") if strict_end else ("", "")
    return F.regexp_replace(html, f"(?isu)<{tag}{start}[^>]*>.*?</{tag}{end}>", by)


def visible_text(html: Column) -> Column:
    """What a reader sees without scripts; entities stay encoded."""
    body = _empty_if_null(html)
    for tag in ("script", "style", "noscript"):
        body = _drop_element(body, tag, " ", strict_end=True)
    return collapse_space(F.regexp_replace(body, _ANY_TAG, " "))


def _decode_basic_entities(text: Column) -> Column:
    # the order matters: "&amp;lt;" ends up as "<"
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _without_code(html: Column) -> Column:
    body = _empty_if_null(html)
    for tag in ("script", "style"):
        body = _drop_element(body, tag, "", strict_end=False)
    return body


def html_to_text(html: Column) -> Column:
    """Plain text of a page: no scripts or styles, four entities decoded."""
    text = F.regexp_replace(_without_code(html), _ANY_TAG, " ")
    return collapse_space(_decode_basic_entities(text))


def page_title(html: Column) -> Column:
    inner = F.regexp_extract(_empty_if_null(html), r"(?isu)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(strip_tags(inner), F.lit(""))


def is_challenge(html: Column, status: Column) -> Column:
    found = F.coalesce(status.isin(*CHALLENGE_STATUSES), F.lit(False))
    for marker in CHALLENGE_MARKERS:
        found = found | F.coalesce(F.contains(html, F.lit(marker)), F.lit(False))
    return found


def is_block(html: Column, status: Column) -> Column:
    return F.coalesce(status >= 400, F.lit(False)) | is_challenge(html, status)


def is_js_skeleton(html: Column, status: Column) -> Column:
    """A large page without readable text. The text is only built for large pages."""
    large = (status < 400) & (F.length(html) > SKELETON_MIN_HTML)
    return F.when(large, F.length(visible_text(html)) < SKELETON_MAX_TEXT).otherwise(F.lit(False))


def content_hash(text: Column) -> Column:
    return F.sha2(_empty_if_null(text), 256)


def cache_key(url: Column, prefer: Column) -> Column:
    return F.sha2(F.concat(prefer, F.lit("::"), url), 256)


def fit_text(html: Column, min_words: int = 50) -> Column:
    """The text blocks of a page with at least ``min_words`` words, one per line."""
    pieces = F.split(_without_code(html), f"(?i)</?(?:{BLOCK_TAGS}){_WORD_END}[^>]*>")
    blocks = F.transform(
        pieces,
        lambda b: collapse_space(_decode_basic_entities(F.regexp_replace(b, _ANY_TAG, " "))),
    )
    kept = F.filter(blocks, lambda b: (b != "") & (F.size(F.split(b, " ")) >= min_words))
    return F.array_join(kept, "\n")


def trim_page(
    df: DataFrame,
    max_markdown: int = MAX_MARKDOWN_CHARS,
    max_html: int = MAX_HTML_CHARS,
    include_html: bool = False,
) -> DataFrame:
    """Cap the text of each page and say so; drop html unless asked for and small."""
    size = F.length("markdown")
    cut = F.coalesce(size > max_markdown, F.lit(False))
    out = df.withColumns(
        {
            "markdown_truncated": cut,
            "markdown_full_chars": F.when(cut, size.cast("bigint")),
            "markdown": F.when(cut, F.substring("markdown", 1, max_markdown)).otherwise(F.col("markdown")),
        }
    )
    if "html" not in df.columns:
        return out
    if not include_html:
        return out.drop("html")
    return out.withColumn("html", F.when(F.length("html") <= max_html, F.col("html")))
