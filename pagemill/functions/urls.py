"""URL columns: split, resolve, clean, filter, unwrap, version order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS

# Endings of files that are never pages.
ASSET_EXTENSIONS = (
    "css", "js", "mjs", "map",
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "avif", "tiff",
    "woff", "woff2", "ttf", "otf", "eot",
    "mp3", "mp4", "webm", "ogg", "wav", "avi", "mov",
    "zip", "tar", "gz", "rar", "7z",
)

# Href starts that lead to no page.
LINK_SKIP_PREFIXES = ("#", "javascript:", "mailto:", "tel:")
REDIRECT_SKIP_PREFIXES = ("#", "javascript:", "mailto:")
REDIRECT_HOST = "duckduckgo.com"

# RFC 3986 appendix B, with the scheme's alphabet of section 3.1.
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$"
_CUT = "\u0001"


def strip_space(text: Column) -> Column:
    """Unicode-aware trim."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    found = F.startswith(text, F.lit(prefixes[0]))
    for prefix in prefixes[1:]:
        found = found | F.startswith(text, F.lit(prefix))
    return found


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def url_pieces(url: Column) -> Column:
    """``[scheme, netloc, path, query]`` of a URL in one regex pass; absent pieces are ''."""
    # as browsers do: no leading controls, no tabs or newlines anywhere
    tidy = F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n" + _CUT, "")
    marked = F.regexp_replace(tidy, _URI, _CUT.join(("$1", "$2", "$3", "$4")))
    return F.split(marked, _CUT)


def with_url_parts(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Add scheme, netloc, path, query. ``;params`` of the last segment are not part of the path."""
    raw = f"{prefix}_pieces"
    return (
        df.withColumn(raw, url_pieces(F.col(url)))
        .withColumns(
            {
                f"{prefix}scheme": F.lower(F.get(raw, 0)),
                f"{prefix}netloc": F.get(raw, 1),
                f"{prefix}path": drop_params(F.get(raw, 2)),
                f"{prefix}query": F.get(raw, 3),
            }
        )
        .drop(raw)
    )


def drop_params(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(";")), F.regexp_replace(path, ";[^/]*$", "")).otherwise(path)


def url_host(url: Column) -> Column:
    return F.get(url_pieces(url), 1)


def is_page_path(scheme: Column, path: Column) -> Column:
    """http(s) and no asset ending on the last path segment."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))
    return scheme.isin("http", "https") & ~ending.isin(*ASSET_EXTENSIONS)


def build_url(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
    return F.concat(
        scheme, F.lit("://"), netloc, path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def clean_url(url: Column) -> Column:
    """URL without fragment and params; no case folding beyond the scheme."""
    return _let(
        url_pieces(url),
        lambda p: build_url(F.lower(F.get(p, 0)), F.get(p, 1), drop_params(F.get(p, 2)), F.get(p, 3)),
    )


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; a trailing one leaves a slash; never above the root."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
        lambda acc: F.array_join(acc, "/"),
    )
    end = F.when(path.rlike(r"(^|/)\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(folded, end), r"^(?=[^/]|\z)", "/")


def _join_path(base_path: Column, path: Column) -> Column:
    # only a relative path loses its empty segments
    relative = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(base_path, r"[^/]*\z", ""), path), "/+", "/")
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(relative)
    return _let(joined, lambda j: F.when(j.rlike(r"(^|/)\.\.?(/|\z)"), _fold_dots(j)).otherwise(j))


def resolve_pieces(base: Column, href: Column) -> Column:
    """RFC 3986 join of two ``url_pieces`` arrays: a struct of scheme, netloc, path, query.

    Null when the host of ``href`` has an unbalanced ``[``.
    """

    def named(pieces: Column, tag: str) -> list[Column]:
        return [
            F.lower(F.get(pieces, 0)).alias(f"{tag}s"),
            F.get(pieces, 1).alias(f"{tag}n"),
            drop_params(F.get(pieces, 2)).alias(f"{tag}p"),
            F.get(pieces, 3).alias(f"{tag}q"),
        ]

    def join(v: Column) -> Column:
        own = (v["hn"] != "") | ((v["hs"] != "") & (v["hs"] != v["bs"]))
        same_page = ~own & (v["raw"] == "")
        bad_host = F.contains(v["hn"], F.lit("[")) != F.contains(v["hn"], F.lit("]"))
        joined = F.struct(
            F.when(v["hs"] != "", v["hs"]).otherwise(v["bs"]).alias("scheme"),
            F.when(own, v["hn"]).otherwise(v["bn"]).alias("netloc"),
            F.when(own, v["hp"]).when(same_page, v["bp"]).otherwise(_join_path(v["bp"], v["hp"])).alias("path"),
            F.when(same_page & (v["hq"] == ""), v["bq"]).otherwise(v["hq"]).alias("query"),
        )
        return F.when(~bad_host, joined)

    return _let(F.struct(*named(base, "b"), *named(href, "h"), F.get(href, 2).alias("raw")), join)


def with_resolved(df: DataFrame, base: str, href: str, prefix: str = "link_") -> DataFrame:
    """Resolve the column ``href`` against ``base``: adds scheme, netloc, path, query, url."""
    b, h, r = f"{prefix}_base", f"{prefix}_href", f"{prefix}_joined"
    parts = ("scheme", "netloc", "path", "query")
    return (
        df.withColumns({b: url_pieces(F.col(base)), h: url_pieces(F.col(href))})
        .withColumn(r, resolve_pieces(F.col(b), F.col(h)))
        .withColumns({f"{prefix}{p}": F.col(r)[p] for p in parts})
        .withColumn(f"{prefix}url", build_url(*(F.col(r)[p] for p in parts)))
        .drop(b, h, r)
    )


def unwrap_redirect(href: Column) -> Column:
    """Target of a search engine's redirect link; null when there is none."""

    def target(link: Column) -> Column:
        part = url_pieces(link)
        raw = F.nullif(F.regexp_extract(F.get(part, 3), r"(?:^|&)uddg=([^&]+)", 1), F.lit(""))
        # form decoding first; the second pass must leave a plus sign alone
        once = F.coalesce(F.try_url_decode(raw), raw)
        twice = _let(once, lambda o: F.coalesce(F.try_url_decode(F.replace(o, F.lit("+"), F.lit("%2B"))), o))
        return (
            F.when((link == "") | starts_with_any(link, REDIRECT_SKIP_PREFIXES), F.lit(None))
            .when(F.contains(F.get(part, 1), F.lit(REDIRECT_HOST)), twice)
            .when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link))
            .otherwise(link)
        )

    return _let(strip_space(href), target)


def snapshot_key(url: Column) -> Column:
    """File-safe form of a URL. Distinct URLs can share one, so nothing is joined on it."""
    safe = F.left(F.regexp_replace(url, "[^a-zA-Z0-9._-]", "_"), F.lit(200))
    return F.when(safe == "", F.lit("url")).otherwise(safe)


def path_filter(url: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Include regex must match somewhere, then the exclude regex must not."""
    keep = F.lit(True)
    if include:
        keep = keep & url.rlike(include)
    if exclude:
        keep = keep & ~url.rlike(exclude)
    return keep


def validate_regex(df: DataFrame, pattern: str | None) -> str | None:
    """Fail before the real work when a pattern cannot be compiled: one row is matched with it."""
    if pattern:
        df.sparkSession.range(1).select(F.lit("").rlike(pattern)).first()
    return pattern


def version_key(version: Column) -> Column:
    """Dotted version as an orderable array; a non-numeric version sorts lowest."""
    numbers = F.transform(F.split(version, r"\."), lambda p: strip_space(p).try_cast("int"))
    return F.when(F.forall(numbers, lambda n: n.isNotNull()), numbers).otherwise(F.array(F.lit(0)))
