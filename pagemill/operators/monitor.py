"""Change monitoring: status, history, retention, diffs over snapshot tables.

Snapshots: ``url, ts, snapshot_id, text, ...``; ``snapshot_id`` is unique and breaks ties.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash
from .ordered import GROUP_ROWS, with_last

# Snapshots kept per URL, diff size in characters, rows of an overview.
KEEP_SNAPSHOTS = 20
MAX_DIFF_CHARS = 20_000
DIFF_CONTEXT = 2
OVERVIEW_ROWS = 50
LINE_ENDS = "\r\n|\n|\r"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"

def monitor_check(snapshots: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Status of every check: new, unchanged, changed (by content hash) or error.

    Only hashes travel; a stored ``hash`` column is used as it is. A failed check (``error`` set) is reported and never becomes the
    state to compare with. Output: url, ts, snapshot_id, hash, status, prev_id, prev_ts.
    """
    error = F.col("error") if "error" in snapshots.columns else F.lit(None).cast("string")
    digest = F.col("hash") if "hash" in snapshots.columns else content_hash(F.col("text"))
    checks = snapshots.select(
        "url", "ts", "snapshot_id", error.alias("error"), F.when(error.isNull(), digest).alias("hash"),
    )
    state = F.when(F.col("error").isNull(), F.struct("hash", "snapshot_id", "ts"))
    prev = with_last(checks, ["url"], ["ts", "snapshot_id"], state, "_prev", group_rows=group_rows)
    status = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("_prev").isNull(), "new")
        .when(F.col("_prev.hash") == F.col("hash"), "unchanged")
        .otherwise("changed")
    )
    compared = F.col("error").isNull()
    return prev.select(
        "url", "ts", "snapshot_id", "hash", status.alias("check_status"), "error",
        F.when(compared, F.col("_prev.snapshot_id")).alias("prev_id"),
        F.when(compared, F.col("_prev.ts")).alias("prev_ts"),
    )


def check_incoming(latest: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incremental form: one new fetch per URL against the latest stored hash per URL."""
    known = latest.select("url", F.col("hash").alias("_known"))
    new_hash = content_hash(F.col("text"))
    return (
        incoming.join(known, "url", "left")
        .withColumn("hash", F.when(F.col("error").isNull(), new_hash))
        .withColumn(
            "check_status",
            F.when(F.col("error").isNotNull(), "error")
            .when(F.col("_known").isNull(), "new")
            .when(F.col("_known") == F.col("hash"), "unchanged")
            .otherwise("changed"),
        )
        .drop("_known")
    )


def changed_texts(snapshots: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Old and new text of the changed checks only, joined by unique snapshot ids."""
    changed = (monitor_check(snapshots) if checks is None else checks).filter(F.col("check_status") == "changed")
    text = snapshots.select(F.col("snapshot_id").alias("_id"), "text")
    old = text.select(F.col("_id").alias("prev_id"), F.col("text").alias("old_text"))
    new = text.select(F.col("_id").alias("snapshot_id"), F.col("text").alias("new_text"))
    return changed.join(old, "prev_id").join(new, "snapshot_id")


def line_delta(snapshots: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Distinct lines that came and went, per changed check.

    Lines are hashed where the text is read; their hashes go through the one ordered pass, text does not.
    """
    error = F.col("error") if "error" in snapshots.columns else F.lit(None).cast("string")
    lines = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), LINE_ENDS), lambda x: F.xxhash64(x)))
    checks = snapshots.select("url", "ts", "snapshot_id", error.alias("error"), content_hash(F.col("text")).alias("hash"), lines.alias("lines"))
    state = F.when(F.col("error").isNull(), F.struct("hash", "lines"))
    prev = with_last(checks, ["url"], ["ts", "snapshot_id"], state, "_prev", group_rows=group_rows)
    changed = prev.filter(F.col("error").isNull() & (F.col("_prev.hash") != F.col("hash")))
    return changed.select(
        "url", "ts", "snapshot_id",
        F.size(F.array_except("lines", "_prev.lines")).alias("lines_added"),
        F.size(F.array_except("_prev.lines", "lines")).alias("lines_removed"),
    )


@F.pandas_udf(T.StringType())
def _unified(url: pd.Series, old: pd.Series, new: pd.Series, old_iso: pd.Series, new_iso: pd.Series) -> pd.Series:
    def one(u, a, b, at, bt):
        lines = difflib.unified_diff(
            (a or "").splitlines(), (b or "").splitlines(), f"{u}@{at}", f"{u}@{bt}", lineterm="", n=DIFF_CONTEXT
        )
        return "\n".join(lines)

    return pd.Series([one(*row) for row in zip(url, old, new, old_iso, new_iso)], dtype=object)


def unified_diffs(snapshots: DataFrame, max_chars: int = MAX_DIFF_CHARS, checks: DataFrame | None = None) -> DataFrame:
    """Unified diff of each changed check; none when only line endings changed. ``checks`` saves checking again."""
    full = _unified("url", "old_text", "new_text", F.date_format("prev_ts", ISO), F.date_format("ts", ISO))
    return (
        changed_texts(snapshots, checks)
        .withColumn("_full", F.nullif(full, F.lit("")))
        .select(
            "url", "ts", "snapshot_id",
            F.left("_full", F.lit(max_chars)).alias("diff"),
            (F.length("_full") > max_chars).alias("diff_truncated"),
        )
    )


def snapshot_retention(snapshots: DataFrame, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """The newest ``keep`` snapshots per URL with ``age_rank`` from 1.

    Spark limits each group to ``keep`` rows before the shuffle, so hot URLs stay cheap.
    """
    newest = Window.partitionBy("url").orderBy(F.desc("ts"), F.desc("snapshot_id"))
    return snapshots.withColumn("age_rank", F.row_number().over(newest)).filter(F.col("age_rank") <= keep)


def monitor_history(snapshots: DataFrame, urls: DataFrame | None = None, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """Kept snapshots, newest first by ``age_rank``. Asked URLs without data give ``no_history``."""
    if urls is None:
        return snapshot_retention(snapshots, keep).withColumn("history_status", F.lit("ok"))
    asked = urls.select("url").distinct()
    kept = snapshot_retention(snapshots.join(asked, "url", "left_semi"), keep)
    return asked.join(kept, "url", "left").withColumn(
        "history_status", F.when(F.col("age_rank").isNull(), "no_history").otherwise("ok")
    )


def forget(snapshots: DataFrame, urls: DataFrame) -> DataFrame:
    """All snapshots but those of the given URLs."""
    return snapshots.join(urls.select("url").distinct(), "url", "left_anti")


def monitors_overview(snapshots: DataFrame, limit: int = OVERVIEW_ROWS, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """Per URL: last check, its status and title, snapshots kept; the first ``limit`` URLs."""
    title = F.col("title") if "title" in snapshots.columns else F.lit(None).cast("string")
    last = F.struct("ts", "snapshot_id", "status", title.alias("title"))
    return (
        snapshots.groupBy("url")
        .agg(F.max(last).alias("last"), F.least(F.count(F.lit(1)), F.lit(keep)).alias("snapshots"))
        .select("url", F.col("last.ts").alias("last_checked"), F.col("last.status").alias("status_code"),
                F.col("last.title").alias("title"), "snapshots")
        .orderBy("url")
        .limit(limit)
    )
