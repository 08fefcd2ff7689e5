"""Corpus search: BM25 over documents, many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import BROADCAST_ROWS, fits_broadcast, join_checked, pick_rows

# BM25 parameters and score precision.
K1 = 1.2
B = 0.75
SCORE_DIGITS = 6
SEARCH_LIMIT = 10
# parts are whole numbers of this unit: sums are exact, so ranks do not depend on the order of a sum
UNITS = 10**10
# scores are rounded before they are ranked: a document this near below a bound may still draw level
ROUNDING = 2 * UNITS // 10**SCORE_DIGITS
# (query, posting) pairs that are scored without looking for bounds
PRUNE_PAIRS = 20_000_000
# postings of a query's rarest terms that are summed to find the first bound
SEED_POSTINGS = 1000
INDEX_BUCKETS = 256
# bytes of text that are counted at once, or one document
COUNT_BYTES = 8 << 20


# ASCII is tested first; \p classes are costly and only needed beyond it
_NO_TOKEN = r"[^a-z0-9[\x80-\x{10ffff}&&[\p{L}\p{N}]]]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NO_TOKEN), "")


def spaced_tokens(text: Column) -> Column:
    """The same in one string, runs of anything else being a space."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NO_TOKEN, " ")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, term, tf, dl) of (doc_id, words in one string); the empty term marks each document."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - size) // COUNT_BYTES
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(size)]):
            ids, texts = (batch.column(c).slice(start, end - start) for c in (0, 1))
            lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
            rows, words = pc.list_parent_indices(lists).to_numpy(), lists.flatten().dictionary_encode()
            kept = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[codes := words.indices.to_numpy()]
            n = max(len(words.dictionary), 1)
            keys, tf = np.unique(rows[kept].astype(np.int64) * n + codes[kept], return_counts=True)
            marks = np.arange(end - start)
            dl = np.bincount(rows[kept], minlength=end - start).astype(np.int32)
            at = np.concatenate([marks, keys // n])
            terms = pa.concat_arrays([pa.array([""] * len(marks), pa.string()), words.dictionary.take(pa.array(keys % n)).cast(pa.string())])
            tfs = np.concatenate([np.ones(len(marks), np.int64), tf])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), terms, pa.array(tfs), pa.array(dl[at])], ["doc_id", "term", "tf", "dl"])


def _counted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf, dl) of every document; counts of rows with one id are added up."""
    words = spaced_tokens(F.col(text))
    kind = docs.schema[doc_id].dataType.simpleString()
    counts = docs.select(F.col(doc_id).alias("doc_id"), words.alias("words")).mapInArrow(_count_words, f"doc_id {kind}, term string, tf bigint, dl int")
    # a document's words are in one row and are counted where they are read; only repeated ids need a shuffle
    if not docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        counts = counts.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    return counts.select(F.col("doc_id").alias(doc_id), "term", "tf", "dl")


def corpus_figures(counts: DataFrame) -> DataFrame:
    """n and avgdl as one row, from the counts of the empty term."""
    return counts.filter("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))


def term_counts(docs: DataFrame, doc_id: str, text: str, terms: DataFrame, fits: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, tf, dl) of the given ``terms`` in the corpus, and its figures (n, avgdl) as one row."""
    # the empty term, which no text has, marks each document: the corpus figures come from the same scan
    wanted = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    counts = cut_lineage(join_checked(_counted(docs, doc_id, text), wanted, ["term"], doc_id, fits, "left_semi"))
    return counts.filter("term <> ''"), corpus_figures(counts)


def impacts(counts: DataFrame, corpus: DataFrame, doc_id: str) -> DataFrame:
    """Postings (term, doc_id, impact).

    The impact of a term in a document is its BM25 part before the term's weight; it does not depend on the query,
    so a list can be ordered by it and its greatest value bounds what the term adds to any document.
    """
    norm = K1 * (1 - B + B * F.col("dl") / corpus.select("avgdl").scalar())
    return counts.select("term", doc_id, (F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("impact"))


def term_figures(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    """Terms (term, df, idf, most): weight and greatest part, in UNITS."""
    idf = F.log(1 + (corpus.select("n").scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5))
    sizes = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("impact")).withColumn("idf", idf)
    return sizes.select("term", "df", "idf", _part().alias("most"))


def _part() -> Column:
    return F.round(F.col("idf") * F.col("impact") * UNITS).cast("long")


def best_documents(
    asked: DataFrame,
    postings: DataFrame,
    terms: DataFrame,
    limit: int,
    query_id: str,
    doc_id: str,
    fits: bool = True,
    seed_postings: int = SEED_POSTINGS,
    prune_pairs: int = PRUNE_PAIRS,
) -> DataFrame:
    """query_id, rank, doc_id, score of the ``limit`` best documents, with lists of frequent terms read for finalists only.

    A query's rarest terms are summed first: the ``limit``-th best sum is a score that ``limit`` documents reach.
    Terms whose greatest impacts together stay below it cannot bring up a document by themselves, so no
    (query, document) pair is made from their lists. Documents that could still reach the bound with all of
    those terms get them looked up; only they are scored in full. The result is that of a full scoring, which
    up to ``prune_pairs`` (query, posting) pairs is done outright, as it costs less than the rounds.
    """
    limit = max(limit, 1)
    known = cut_lineage(join_checked(terms, asked, ["term"], "term", fits).select(query_id, "term", "df", "idf", "most"))
    rarest = Window.partitionBy(query_id).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = known.withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).filter(F.col("before") < seed_postings)

    def sums(chosen: DataFrame) -> DataFrame:
        met = join_checked(postings, chosen.select(query_id, "term", "idf"), ["term"], doc_id, fits)
        return met.groupBy(query_id, doc_id).agg(F.sum(_part()).alias("part"))

    def bound(parts: DataFrame) -> DataFrame:
        best = Window.partitionBy(query_id).orderBy(F.desc("part"), doc_id)
        return parts.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= limit).groupBy(query_id).agg(
            F.max(F.when(F.col("at") == limit, F.col("part"))).alias("bound")
        )

    def ranked(parts: DataFrame) -> DataFrame:
        scored = parts.select(query_id, doc_id, F.round(F.col("part") / UNITS, SCORE_DIGITS).alias("score"))
        best = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit).select(query_id, "rank", doc_id, "score")

    if prune_pairs and (known.agg(F.sum("df")).first()[0] or 0) <= prune_pairs:
        return ranked(sums(known))
    weakest = Window.partitionBy(query_id).orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = cut_lineage(
        known.join(bound(sums(seeds)), query_id, "left")
        .withColumn("reach", F.sum("most").over(weakest))
        .withColumn("weak", F.coalesce(F.col("reach") + ROUNDING < F.col("bound"), F.lit(False)))
    )
    strong, weak = split.filter("NOT weak"), split.filter("weak")
    parts = cut_lineage(sums(strong))
    rest = weak.groupBy(query_id).agg(F.sum("most").alias("rest"))
    finalists = cut_lineage(
        parts.join(bound(parts), query_id).join(rest, query_id, "left")
        .filter(F.col("bound").isNull() | (F.col("part") + F.coalesce("rest", F.lit(0)) + ROUNDING >= F.col("bound")))
        .select(query_id, doc_id, "part")
    )
    # the lists of weak terms meet finalists only, by document
    looked_up = finalists.join(weak.select(query_id, "term", "idf"), query_id)
    lists = join_checked(postings, weak.select("term").distinct(), ["term"], doc_id, fits, "left_semi")
    near = pick_rows(lists, finalists.select(doc_id).distinct(), doc_id)
    added = looked_up.join(near, ["term", doc_id]).select(query_id, doc_id, _part().alias("part"))
    return ranked(finalists.unionByName(added).groupBy(query_id, doc_id).agg(F.sum("part").alias("part")))


def _asked_terms(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    return queries.select(query_id, F.explode(F.array_distinct(tokens(F.col(query)))).alias("term")).distinct()


def search_corpus(
    queries: DataFrame,
    docs: DataFrame,
    limit: int = SEARCH_LIMIT,
    query_id: str = "query_id",
    query: str = "query",
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Top ``limit`` documents per query: query_id, rank from 1, doc_id, score.

    One scan of the corpus counts the query terms; for many searches over the same corpus write a
    ``SearchIndex`` once. Ties go to the lower id.
    """
    asked = cut_lineage(_asked_terms(queries, query_id, query))
    fits = fits_broadcast(asked, broadcast_rows)
    counts, corpus = term_counts(docs, doc_id, text, asked, fits)
    corpus = cut_lineage(corpus)
    postings = impacts(counts, corpus, doc_id)
    return best_documents(asked, postings, cut_lineage(term_figures(postings, corpus)), limit, query_id, doc_id, fits)


class SearchIndex:
    """Postings of a corpus kept between searches.

    ``postings`` (term, doc_id, impact) lie in buckets of terms, each list ordered by impact from high to low;
    ``terms`` has the figures of every term, ``counts`` the occurrences they come from. A long list is written by
    several tasks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> SearchIndex:
        """Index all of ``docs``, into a folder that is not there yet."""
        index = cls(docs.sparkSession, path)
        # texts are read once: bounds of the ranges, figures and lists come from the stored counts
        _counted(docs, doc_id, text).withColumnRenamed(doc_id, "doc_id").write.parquet(f"{index.path}/counts")
        counts = docs.sparkSession.read.parquet(f"{index.path}/counts")
        corpus = cut_lineage(corpus_figures(counts))
        kept = impacts(counts.filter("term <> ''"), corpus, "doc_id").select(index.bucket().alias("bucket"), "term", "doc_id", "impact")
        order = ["bucket", "term", F.desc("impact"), "doc_id"]
        kept.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{index.path}/postings")
        stored = docs.sparkSession.read.parquet(f"{index.path}/postings")
        term_figures(stored, corpus).write.parquet(f"{index.path}/terms")
        return index

    @staticmethod
    def bucket() -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(INDEX_BUCKETS)).cast("int")

    def search(
        self,
        queries: DataFrame,
        limit: int = SEARCH_LIMIT,
        query_id: str = "query_id",
        query: str = "query",
        broadcast_rows: int = BROADCAST_ROWS,
        prune_pairs: int = PRUNE_PAIRS,
    ) -> DataFrame:
        """As ``search_corpus`` over the indexed documents; only the buckets of the query's terms are read."""
        asked = cut_lineage(_asked_terms(queries, query_id, query))
        fits = fits_broadcast(asked, broadcast_rows)
        buckets = [r[0] for r in asked.select(self.bucket()).distinct().collect()]  # at most INDEX_BUCKETS
        mine = F.col("bucket").isin(buckets) if buckets else F.lit(False)
        postings = self.spark.read.parquet(f"{self.path}/postings").filter(mine).drop("bucket")
        terms = self.spark.read.parquet(f"{self.path}/terms")
        return best_documents(asked, postings, terms, limit, query_id, "doc_id", fits, prune_pairs=prune_pairs)


def with_hit_text(
    hits: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_chars: int | None = None
) -> DataFrame:
    """Add the text of ranked hits as ``snippet``, whole unless the caller limits it; other documents stay unread."""
    shown = F.col(text) if max_chars is None else F.left(text, F.lit(max_chars))
    body = docs.select(doc_id, shown.alias("snippet"))
    kept = cut_lineage(hits)
    return kept.join(pick_rows(body, kept, doc_id), doc_id)
