"""Sinks: JSON lines of page text, and the snapshot store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.monitor import KEEP_SNAPSHOTS, monitor_history, snapshot_retention
from ..schemas import SNAPSHOT
from .latest import BUCKETS, LatestIndex, buckets_of, rows_at, url_bucket


def write_rag_jsonl(pages: DataFrame, path: str, fetched_at: str = "fetched_at", mode: str = "errorifexists") -> None:
    """One JSON line {url, title, markdown, fetched_at} per page; nulls are written."""
    pages.select("url", "title", "markdown", F.col(fetched_at).alias("fetched_at")).write.mode(mode).option(
        "ignoreNullFields", "false"
    ).json(path)


class SnapshotStore:
    """Append-only snapshots in parquet, partitioned by a hash bucket of the URL.

    Forgetting appends a tombstone; ``compact`` writes the kept rows as a new generation,
    which readers take once its mark is written. The newest hash of every URL is kept beside
    the snapshots in a ``LatestIndex``, one batch per round. One writer at a time.
    """

    BUCKETS = BUCKETS

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = LatestIndex(spark, f"{self.path}/latest")

    def _numbers(self, name: str) -> list[int]:
        marks = rows_at(self.spark, f"{self.path}/{name}", "n bigint")
        return [] if marks is None else sorted(r[0] for r in marks.collect())

    def _mark(self, name: str, n: int) -> None:
        self.spark.range(1).select(F.lit(n).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _generation(self) -> int:
        """The newest complete generation; the first one is there from the start."""
        return max(self._numbers("generations"), default=0)

    def _round(self) -> int:
        return max(self._numbers("rounds"), default=-1) + 1

    def _dir(self, generation: int) -> str:
        return f"{self.path}/gen={generation}"

    def _write(self, rows: DataFrame, generation: int, mode: str = "append") -> None:
        # rebalancing gives each bucket few files and splits a bucket with a hot URL
        placed = rows.withColumn("bucket", url_bucket()).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "url", "ts")
        placed.write.mode(mode).partitionBy("bucket").parquet(self._dir(generation))

    def _store(self, rows: DataFrame) -> None:
        """Rows to the newest generation, their newest hashes to the index."""
        n = self._round()
        self._write(rows, self._generation())
        self.index.put(rows, n)
        self._mark("rounds", n)

    def append(self, snapshots: DataFrame) -> None:
        """Store checks. Rows need url, ts, snapshot_id, status, title, method, text; those with ``error`` set are not stored."""
        if "error" in snapshots.columns:
            snapshots = snapshots.filter(F.col("error").isNull())
        iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        rows = snapshots.select(
            "url", "ts", "snapshot_id", iso.alias("iso"), content_hash(F.col("text")).alias("hash"),
            "title", F.col("status").cast("int").alias("status"), "method", "text",
            F.lit(False).alias("forgotten"),
        )
        self._store(rows)

    def forget(self, urls: DataFrame, at: str) -> None:
        """Drop everything stored for the URLs up to the moment ``at``."""
        rows = urls.select(
            "url", F.lit(at).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("snapshot_id"),
            *(F.lit(None).cast("string").alias(c) for c in ("iso", "hash", "title")),
            F.lit(None).cast("int").alias("status"),
            *(F.lit(None).cast("string").alias(c) for c in ("method", "text")),
            F.lit(True).alias("forgotten"),
        )
        self._store(rows)

    def read(self, url: str | None = None, urls: DataFrame | None = None) -> DataFrame:
        """Live snapshots; for a single URL, or some ``urls``, only their buckets are read."""
        rows = rows_at(self.spark, self._dir(self._generation()), f"{SNAPSHOT}, forgotten boolean, bucket int")
        if rows is None:
            return self.spark.createDataFrame([], SNAPSHOT)
        if url is not None:
            urls = self.spark.range(1).select(F.lit(url).alias("url"))
        if urls is not None:
            buckets = buckets_of(urls)
            rows = rows.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False)).join(urls.select("url").distinct(), "url", "left_semi")
        gone = rows.filter("forgotten").groupBy("url").agg(F.max("ts").alias("_gone"))
        return (
            rows.filter(~F.col("forgotten"))
            .join(gone, "url", "left")
            .filter(F.col("_gone").isNull() | (F.col("ts") > F.col("_gone")))
            .drop("_gone", "forgotten", "bucket")
        )

    def latest(self, urls: DataFrame | None = None) -> DataFrame:
        """url, ts, snapshot_id, hash of the newest snapshot per URL, from the index; with ``urls`` from their buckets."""
        return self.index.latest(self._round(), urls)

    def drop_old(self) -> None:
        """Empty the generations before the newest complete one; nobody may be reading them."""
        for old in self._numbers("generations") + [0]:
            held = rows_at(self.spark, self._dir(old), f"{SNAPSHOT}, forgotten boolean, bucket int")
            if old < self._generation() and held is not None:
                held.limit(0).drop("bucket").write.mode("overwrite").parquet(self._dir(old))

    def history(self, url: str) -> DataFrame:
        asked = self.spark.range(1).select(F.lit(url).alias("url"))
        return monitor_history(self.read(url), asked)

    def compact(self, keep: int = KEEP_SNAPSHOTS) -> None:
        """Keep the newest ``keep`` snapshots per URL, as a new generation."""
        now = self._generation()
        kept = snapshot_retention(self.read(), keep).drop("age_rank").withColumn("forgotten", F.lit(False))
        # a generation without its mark is the rest of a broken run
        self._write(kept, now + 1, "overwrite")
        self._mark("generations", now + 1)
