"""Page corpus and fetch-log scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_text, page_title
from ..schemas import FETCH_LOG


def as_pages(raw: DataFrame, status: int = 200, method: str = "corpus") -> DataFrame:
    """Raw (url, html) rows in page shape; columns nobody selects are never computed."""
    return raw.select(
        *[c for c in raw.columns if c not in ("url", "html")],
        "url",
        F.col("url").alias("final_url"),
        F.lit(status).alias("status"),
        F.coalesce("html", F.lit("")).alias("html"),
        html_to_text(F.col("html")).alias("markdown"),
        page_title(F.col("html")).alias("title"),
        F.lit(method).alias("method"),
        F.lit(0).alias("elapsed_ms"),
        F.create_map().cast("map<string,string>").alias("meta"),
    )


def with_expression(pages: DataFrame, expression: str, name: str = "result") -> DataFrame:
    """A user's SQL expression per page; a bad expression fails when the plan is built."""
    return pages.withColumn(name, F.expr(expression))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return as_pages(spark.read.parquet(path))


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured attempts, parquet or JSON lines. Of JSON, lines that cannot be read are left to ``fetch_log_rejects``."""
    rows = spark.read.schema(_with_rest(fmt)).format(fmt).options(**_REST).load(path)
    return _read_lines(rows) if fmt == "json" else rows


def fetch_log_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the JSON lines that are no attempt."""
    rows = spark.read.schema(_with_rest("json")).format("json").options(**_REST).load(path)
    return rows.filter(_broken()).select(F.input_file_name().alias("file"), F.col("_broken").alias("line"))


#: Broken JSON lines arrive whole in a column of their own.
_REST = {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}


def _with_rest(fmt: str) -> str:
    return f"{FETCH_LOG}, _broken string" if fmt == "json" else FETCH_LOG


def _broken():
    return F.col("_broken").isNotNull() | F.col("url").isNull()


def _read_lines(rows: DataFrame) -> DataFrame:
    return rows.filter(~_broken()).drop("_broken")


def stream_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """The same attempts as a stream of files, so many of them a trigger."""
    rows = (
        spark.readStream.schema(_with_rest(fmt))
        .option("maxFilesPerTrigger", files_per_trigger)
        .options(**_REST)
        .format(fmt)
        .load(path)
    )
    return _read_lines(rows) if fmt == "json" else rows
