"""Stream transformations. Each takes and returns a streaming DataFrame (batch ones work too where stateless)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import content_hash, html_to_text, is_block, is_challenge, is_js_skeleton, page_title
from ..functions.urls import clean_url
from ..operators.links import with_links
from ..operators.monitor import monitor_check
from ..operators.usage import COOLDOWN_SECONDS, SESSION_GAP_SECONDS
from ..sources.latest import LatestIndex


def attempt_checks(attempts: DataFrame) -> DataFrame:
    """Per fetch attempt: block flags, title, text and links. Stateless; html is dropped."""
    html, status = F.col("html"), F.col("status")
    linked = with_links(attempts, base="url")
    return linked.withColumns(
        {
            "challenge": is_challenge(html, status),
            "blocked": is_block(html, status),
            "skeleton": is_js_skeleton(html, status),
            "title": page_title(html),
            "markdown": html_to_text(html),
        }
    ).drop("html")


def _hashed(snapshots: DataFrame) -> DataFrame:
    error = F.col("error") if "error" in snapshots.columns else F.lit(None).cast("string")
    digest = F.when(error.isNull(), content_hash(F.col("text")))
    return snapshots.select("url", "ts", "snapshot_id", digest.alias("hash"), error.alias("error"))


def page_changes(snapshots: DataFrame, idle_seconds: int | None = None, lateness: str = "1 hour") -> DataFrame:
    """new / unchanged / changed / error per check against the last hash kept per URL.

    Only hashes enter the state operator, ordered by (ts, snapshot_id) inside a batch. A failed
    check (``error`` set) is reported and never becomes the state. With ``idle_seconds`` a check that comes so long
    after the last good one is new again; a timer of event time drops the state once the watermark (``lateness``
    behind) has passed that moment. A URL with more checks in a batch than one task takes belongs to
    ``run_page_changes``.
    """
    narrow = _hashed(snapshots)
    if idle_seconds is not None:
        narrow = narrow.withWatermark("ts", lateness)
    return narrow.groupBy("url").transformWithStateInPandas(
        _LastHash(idle_seconds),
        "url string, ts timestamp, snapshot_id bigint, hash string, check_status string",
        "Append",
        "None" if idle_seconds is None else "EventTime",
    )


class _LastHash(StatefulProcessor):
    """The last hash of a URL and when it was seen, as value state; dropped by a timer, unless it is kept for ever."""

    def __init__(self, idle_seconds: int | None):
        self.idle_ms = None if idle_seconds is None else idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string, ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        checks = pd.concat(list(rows)).sort_values(["ts", "snapshot_id"])
        times = checks["ts"].astype("datetime64[us]").astype("int64") // 1000
        status = []
        for digest, failed, ms in zip(checks["hash"], checks["error"].notna(), times.tolist()):
            if failed:
                status.append("error")
                continue
            idle = last is not None and self.idle_ms is not None and ms - last[1] >= self.idle_ms
            status.append("new" if last is None or idle else "unchanged" if last[0] == digest else "changed")
            last = (digest, ms)
        if last is not None:
            self.last.update((last[0], last[1]))
            if self.idle_ms is not None:
                self.handle.registerTimer(last[1] + self.idle_ms)
        yield checks.assign(url=key[0], check_status=status)[["url", "ts", "snapshot_id", "hash", "check_status"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # an older timer of the same URL finds a later check and leaves it
        held = self.last.get()
        if held is not None and held[1] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())


def run_page_changes(snapshots: DataFrame, path: str) -> DataFrame:
    """``page_changes`` for streams with very hot URLs; runs what is there and returns the statuses.

    Each micro-batch is checked by the batch operator, which splits a hot URL over tasks. The latest hashes lie
    in a ``LatestIndex``: a batch reads the buckets of its URLs, from one base and the deltas of one epoch,
    and writes one delta. Batches are written under their own id, so a repeated batch replaces itself.
    """
    spark = snapshots.sparkSession
    narrow = _hashed(snapshots)
    index = LatestIndex(spark, f"{path}/latest")

    def check(batch: DataFrame, batch_id: int) -> None:
        before = index.latest(batch_id, batch).withColumns({"error": F.lit(None).cast("string"), "fresh": F.lit(False)})
        rows = batch.withColumn("fresh", F.lit(True)).unionByName(before)
        fresh = rows.filter("fresh").select("snapshot_id")
        checked = monitor_check(rows.drop("fresh")).join(fresh, "snapshot_id", "left_semi")
        checked.write.mode("overwrite").parquet(f"{path}/checks/batch={batch_id}")
        good = rows.filter(F.col("error").isNull())
        index.put(good.withColumn("forgotten", F.lit(False)), batch_id)

    query = (
        narrow.writeStream.foreachBatch(check)
        .option("checkpointLocation", f"{path}/_state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = "url string, ts timestamp, snapshot_id bigint, hash string, check_status string, error string, prev_id bigint"
    return spark.read.schema(schema).parquet(f"{path}/checks/*")


def daily_actives(pings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Approximate distinct ids per UTC day, emitted when the day is complete."""
    return (
        pings.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"))
        .agg(F.approx_count_distinct("id").alias("users"))
        .select(F.to_date("window.start").alias("day"), "users")
    )


def daily_actives_exact(pings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Exact distinct ids per UTC day: one state row per day and id, then a count per closed day.

    Repeated pings of an id combine before the shuffle, so a hot id costs one row per task.
    """
    per_id = (
        pings.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "id")
        .agg(F.count(F.lit(1)).alias("pings"))
    )
    return (
        per_id.groupBy(F.window(F.window_time("window"), "1 day").alias("d"))
        .agg(F.count(F.lit(1)).alias("users"), F.sum("pings").alias("pings"))
        .select(F.to_date("d.start").alias("day"), "users", "pings")
    )


def ping_cooldown(pings: DataFrame, gap: int = COOLDOWN_SECONDS, lateness: str | None = None) -> DataFrame:
    """Accepted pings per id; the state is the last accepted second.

    Each task first reduces what it has read to distinct (id, second) pairs, so a hot id costs no more than the
    seconds of its pings in the state operator. A window or a dedup operator would not do: the next window
    starts at the last accepted ping. With ``lateness`` a timer drops the state of an id once the watermark has
    passed the end of its gap: what comes then is accepted with and without it.
    """
    narrow = pings.select("id", "ts") if lateness is None else pings.select("id", "ts").withWatermark("ts", lateness)
    # the watermark column stays a timestamp of whole seconds
    seconds = narrow.mapInArrow(_distinct_seconds, "id string, ts timestamp") if lateness is None else narrow
    return seconds.groupBy("id").transformWithStateInPandas(
        _LastAccepted(gap, lateness is not None), "id string, accepted_at bigint", "Append", "None" if lateness is None else "EventTime"
    )


def _distinct_seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct ids and whole seconds of each batch of rows."""
    for batch in batches:
        second = pc.floor_temporal(batch.column(1), unit="second")
        pairs = pa.table({"id": batch.column(0), "ts": second}).group_by(["id", "ts"]).aggregate([])
        yield from pairs.to_batches()


class _LastAccepted(StatefulProcessor):
    """The last accepted second of an id as value state, dropped by a timer of event time."""

    def __init__(self, gap: int, expires: bool):
        self.gap, self.expires = gap, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "s bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        last = held[0] if held is not None else None
        # floored times of the epoch's seconds, whatever unit pandas keeps them in
        seconds = sorted(set().union(*((r["ts"].astype("datetime64[us]").astype("int64") // 1_000_000).tolist() for r in rows)))
        accepted = []
        for s in seconds:
            if last is None or s - last >= self.gap:
                accepted.append(s)
                last = s
        if accepted:
            self.last.update((last,))
            if self.expires:
                self.handle.registerTimer((last + self.gap) * 1000)
            yield pd.DataFrame({"id": key[0], "accepted_at": accepted})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # an older timer of the same id finds a later second and leaves it
        held = self.last.get()
        if held is not None and (held[0] + self.gap) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())


def session_stream(
    events: DataFrame, key: str = "user_id", gap: int = SESSION_GAP_SECONDS, lateness: str = "1 hour"
) -> DataFrame:
    """Closed sessions. The window gap is one microsecond longer, because a pause of exactly ``gap`` stays inside."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(key, F.session_window("ts", f"{gap} seconds 1 microsecond").alias("w"))
        .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("events"))
        .select(key, "session_start", "session_end", "events")
    )


def first_seen(urls: DataFrame, url: str = "url", within: str | None = None, ts: str = "ts") -> DataFrame:
    """Each clean URL once, as a visited set. ``within`` bounds the state by event time."""
    cleaned = urls.withColumn("clean_url", clean_url(F.col(url)))
    if within:
        return cleaned.withWatermark(ts, within).dropDuplicatesWithinWatermark(["clean_url"])
    return cleaned.dropDuplicates(["clean_url"])


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with timers and time to live needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_available(stream: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> DataFrame:
    """Run a stream over what is there now into files under ``path``; returns the written rows."""
    with rocksdb_state(stream.sparkSession):
        query = (
            stream.writeStream.format(fmt)
            .outputMode(mode)
            .option("checkpointLocation", f"{path}/_state")
            .trigger(availableNow=True)
            .start(f"{path}/rows")
        )
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).format(fmt).load(f"{path}/rows")
