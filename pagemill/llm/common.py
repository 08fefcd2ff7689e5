"""Shared columns of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, an empty string where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def whole_text_batches(df: DataFrame, rows: int = 1000) -> None:
    """Whole texts go to Python: hand it at most ``rows`` at a time (a lower setting of the session stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(df.sparkSession.conf.get(key))
    if held <= 0 or held > rows:
        df.sparkSession.conf.set(key, str(rows))


def finite_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty and has only finite components."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))

    return df.filter(F.coalesce(F.size(column) > 0, F.lit(False)) & F.coalesce(F.forall(column, finite), F.lit(False)))
