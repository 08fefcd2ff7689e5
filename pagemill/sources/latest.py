"""Latest content hash per URL as a side table: deltas by bucket, merged on read, compacted by epoch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
#: Batches of an epoch: so many deltas are merged on read at most.
EPOCH_BATCHES = 16
LATEST = "url string, ts timestamp, snapshot_id bigint, hash string, forgotten boolean"


def url_bucket(url: Column | str = "url") -> Column:
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def buckets_of(urls: DataFrame) -> list[int]:
    """The buckets of some URLs: at most BUCKETS numbers."""
    return sorted(r[0] for r in urls.select(url_bucket()).distinct().collect())


def rows_at(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The parquet rows under a path, or None if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


class LatestIndex:
    """Newest (ts, snapshot_id, hash) per URL, without a look at the snapshots themselves.

    Batch b belongs to epoch b // EPOCH_BATCHES. A batch writes one delta, of the URLs it met; an epoch starts
    from a base that holds the merged rows of all earlier epochs. So a read touches one base and the deltas of
    one epoch, of the asked buckets only, however many batches there were. A repeated batch replaces its
    delta; a base counts once its mark is written. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _base(self, epoch: int) -> str:
        return f"{self.path}/base/epoch={epoch}"

    def _deltas(self, epoch: int) -> str:
        return f"{self.path}/delta/epoch={epoch}"

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        """One row per URL: the newest one after the newest mark of forgetting, or else that mark."""
        state = F.struct("ts", "snapshot_id", "hash", "forgotten")
        newest = rows.groupBy("url").agg(
            F.max(F.when(~F.col("forgotten"), state)).alias("kept"), F.max(F.when(F.col("forgotten"), state)).alias("gone")
        )
        alive = F.col("gone").isNull() | (F.col("kept.ts") > F.col("gone.ts"))
        return newest.select("url", F.when(alive & F.col("kept").isNotNull(), F.col("kept")).otherwise(F.col("gone")).alias("s")).select("url", "s.*")

    def _rows(self, epoch: int, before: int | None, buckets: list[int] | None) -> DataFrame:
        parts = []
        if epoch:
            self._ensure_base(epoch)
            parts.append(rows_at(self.spark, self._base(epoch), f"{LATEST}, bucket int"))
        deltas = rows_at(self.spark, self._deltas(epoch), f"{LATEST}, batch bigint, bucket int")
        if deltas is not None:
            parts.append((deltas if before is None else deltas.filter(F.col("batch") < before)).drop("batch"))
        if not parts:
            return self.spark.createDataFrame([], f"{LATEST}, bucket int")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))

    def _ensure_base(self, epoch: int) -> None:
        if rows_at(self.spark, f"{self.path}/complete/epoch={epoch}", "epoch bigint") is None:
            merged = self.merged(self._rows(epoch - 1, None, None))
            self._write(merged, self._base(epoch))
            self.spark.range(1).select(F.lit(epoch).cast("long").alias("epoch")).write.mode("overwrite").parquet(f"{self.path}/complete/epoch={epoch}")

    @staticmethod
    def _write(rows: DataFrame, path: str) -> None:
        placed = rows.withColumn("bucket", url_bucket()).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "url")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(path)

    def put(self, rows: DataFrame, batch: int) -> None:
        """Write the delta of a batch: url, ts, snapshot_id, hash, forgotten; several rows of a URL are merged."""
        self._write(self.merged(rows.select("url", "ts", "snapshot_id", "hash", "forgotten")), f"{self._deltas(batch // EPOCH_BATCHES)}/batch={batch}")

    def latest(self, batch: int, urls: DataFrame | None = None) -> DataFrame:
        """url, ts, snapshot_id, hash as of the start of ``batch``; with ``urls`` only their buckets are read."""
        held = self._rows(batch // EPOCH_BATCHES, batch, None if urls is None else buckets_of(urls))
        newest = self.merged(held.drop("bucket")).filter(~F.col("forgotten")).drop("forgotten")
        return newest if urls is None else newest.join(urls.select("url").distinct(), "url", "left_semi")
