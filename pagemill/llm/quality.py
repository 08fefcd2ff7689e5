"""Quality rules: word counts and repetition inside a text, line frequency across the documents of a host.

Only DataFrame functions. One pass over the texts makes a narrow table of counts and line hashes; everything
that is shuffled afterwards is hashes and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE, WORD, whole, words_of

MIN_WORDS = 50
#: Percent of words in repeated three-word windows above which a text fails.
MAX_REPEAT_PERCENT = 50
#: A line in more distinct documents of one host than this is page furniture.
MAX_DOCS_PER_HOST = 10
#: A document that keeps less than this percent of its words is depleted.
MIN_KEPT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def line_hash(line: Column) -> Column:
    """64-bit hash of a line in lower case, numbers as 0, white space as one space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " ")))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once: columns used inside a lambda are computed at every call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more: sort the windows, mark equal neighbours."""

    def windows(w: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.slice(w, F.lit(1), F.size(w) - 2),
                lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
            )
        )

    def starts(ranked: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(ranked, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                F.get(ranked, k + 1)["h"] == x["h"], F.lit(False)
            )

        return F.transform(F.filter(ranked, repeated), lambda x: x["i"])

    covered = _bind(_bind(words, windows), starts)
    return F.size(F.array_distinct(F.flatten(F.transform(covered, lambda i: F.array(i, i + 1, i + 2))))).cast("long")


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0


def text_counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The base counts of a text, given its words and those of its lines that have a word."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_repeat_words(words)),
    }


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    max_docs: int = MAX_DOCS_PER_HOST,
    min_kept_percent: int = MIN_KEPT_PERCENT,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``n_common_words`` (in lines above the limit) and ``kept``.

    A line of a host is common when more than ``max_docs`` distinct documents of that host have it; documents are
    distinct when the sequences of their normalised lines differ, so copies of one text don't make its lines
    common. A document is depleted when its other lines hold less than ``min_kept_percent``
    of its words. Null text is empty and fails; a null host is a host of its own; equal rows get equal
    results; an empty table gives an empty result. Of the input only doc_id, text and the host are read.
    """
    read = docs.select(F.col("doc_id"), F.col(host).alias("_host"), whole("text").alias("_text")).select(
        "*", words_of(F.col("_text")).alias("_words"), F.filter(F.split(F.col("_text"), "\n", -1), _has_word).alias("_kept")
    )
    hashed = F.transform("_kept", lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    # rows are numbered once and kept: numbers must not change when a task runs again
    base = cut_lineage(
        read.select(
            "doc_id",
            "_host",
            F.xxhash64("doc_id", "_host", "_text").alias("row_hash"),
            *[c.alias(name) for name, c in text_counts(F.col("_text"), F.col("_words"), F.col("_kept")).items()],
            hashed.alias("_lines"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    seen = base.select("_host", F.explode(F.array_distinct("_lines.h")).alias("h"), F.xxhash64("_lines.h").alias("text"))
    common = (
        seen.distinct().groupBy("_host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_docs)
        .select(F.col("_host").alias("_c_host"), F.col("h").alias("_c_h"))
    )
    held = base.select("_row", "_host", F.inline("_lines")).groupBy("_row", "_host", "h").agg(F.sum("w").alias("w"))
    lost = (
        held.join(common, F.col("_host").eqNullSafe(F.col("_c_host")) & (F.col("h") == F.col("_c_h")), "left_semi")
        .groupBy(F.col("_row").alias("_l_row"))
        .agg(F.sum("w").alias("_lost"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    n_lost = F.coalesce(F.col("_lost"), F.lit(0).cast("long"))
    return base.join(lost, F.col("_row") == F.col("_l_row"), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        n_lost.alias("n_common_words"),
        (~failed & (100 * (F.col("n_words") - n_lost) >= min_kept_percent * F.col("n_words"))).alias("kept"),
        "row_hash",
    )
