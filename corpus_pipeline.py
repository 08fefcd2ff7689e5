"""The corpus pipeline: five stages, each working on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontamination, linededup, mixing, quality, simhash
from pagemill.llm.common import DOCUMENT_COLUMNS, table
from pagemill.session import scratch_path

#: Alignment, fingerprints and tiling have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    goes = quality.quality_rules(docs).filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_row")).distinct()
    marked = docs.withColumn("_hash", F.xxhash64("doc_id", "source", F.coalesce("text", F.lit(""))))
    same = (F.col("_hash") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return marked.join(goes, same, "left_anti").select(*DOCUMENT_COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the blocks of lines it shares with an earlier one."""
    left = linededup.dedup_lines(docs.select(*DOCUMENT_COLUMNS))
    chars = F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*DOCUMENT_COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one_of_each(docs.select(*DOCUMENT_COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    marked = docs.select(*DOCUMENT_COLUMNS).withColumn("_row", F.xxhash64("doc_id", "text"))
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    leaks = decontamination.contaminated_pairs(marked.select(F.col("_row").alias("doc_id"), "text"), items)
    goes = leaks.select(F.col("doc_id").alias("_row")).distinct()
    return marked.join(goes, "_row", "left_anti").select(*DOCUMENT_COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of times each is repeated and its words with repeats."""
    mixed = mixing.mix_sources(docs.select(*DOCUMENT_COLUMNS)).filter("mix_taken > 0")
    return mixed.select(
        *DOCUMENT_COLUMNS, F.expr("mix_taken div mix_size").alias("repeats"), F.col("mix_taken").alias("taken")
    )


STAGES: list[tuple[str, Callable]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
