"""Usage analytics: active users, downloads, traffic, ping cooldown, sessions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import GROUP_ROWS, with_last

# Windows and gaps of the usage reports.
DAY_SECONDS = 86_400
ACTIVE_DAYS = {"dau_24h": 1, "wau_7d": 7, "mau_30d": 30}
REPORT_DAYS = 30
TOP_VERSIONS = 10
COOLDOWN_SECONDS = 86_400
SESSION_GAP_SECONDS = 1800
DOWNLOAD_DAYS = 7
BADGE_DAYS = 30
BADGE_CATEGORY = "without_mirrors"


def as_of_or_latest(df: DataFrame, as_of: datetime | str | None, ts: str = "ts") -> Column:
    """The report moment: as given, else the latest row. Never the wall clock."""
    if as_of is not None:
        return F.lit(as_of).cast("timestamp")
    return df.select(F.max(ts)).scalar()


def _since(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def active_users(pings: DataFrame, as_of=None, approx: bool = False) -> DataFrame:
    """One row: distinct ids seen strictly after now minus 1, 7 and 30 days, and ever.

    An id is active when its latest ping is, so one max per id (combined before the
    shuffle) replaces four distinct counts. ``approx`` sketches and shuffles almost nothing.
    """
    now = as_of_or_latest(pings, as_of)
    if approx:
        counts = {n: F.approx_count_distinct(F.when(F.col("ts") > F.col("_now") - F.make_dt_interval(F.lit(d)), F.col("id")))
                  for n, d in ACTIVE_DAYS.items()}
        return pings.withColumn("_now", now).agg(
            *(c.alias(n) for n, c in counts.items()), F.approx_count_distinct("id").alias("total_unique")
        )
    last = pings.groupBy("id").agg(F.max("ts").alias("last")).withColumn("_now", now)
    return last.agg(
        *(F.count_if(F.col("last") > _since(F.col("_now"), d)).alias(n) for n, d in ACTIVE_DAYS.items()),
        F.count(F.lit(1)).alias("total_unique"),
    )


#: Logarithm of the buckets of a sketch: a standard error of about 1.6 percent.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def daily_sketches(pings: DataFrame) -> DataFrame:
    """(day, sketch): a mergeable sketch of the distinct ids of each UTC day, a few kB whatever the pings are."""
    day = F.to_date("ts").alias("day")
    return pings.filter(F.col("ts").isNotNull()).groupBy(day).agg(F.hll_sketch_agg("id", F.lit(SKETCH_BITS)).alias("sketch"))


def merged_sketches(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored days and the days of new pings as one table; a day in both is merged, its pings are not read again."""
    return stored.select("day", "sketch").unionByName(new.select("day", "sketch")).groupBy("day").agg(F.hll_union_agg("sketch").alias("sketch"))


def active_users_sketched(sketches: DataFrame, as_of_day=None) -> DataFrame:
    """(period, users): estimated distinct ids of the last 1, 7 and 30 whole days up to ``as_of_day``, and of all days.

    Only sketches are read. The estimate is within a few times SKETCH_ERROR of the exact count; small counts are exact.
    """
    now = F.lit(as_of_day).cast("date") if as_of_day is not None else sketches.select(F.max("day")).scalar()
    age = F.datediff(F.col("_now"), "day")
    periods = F.array(*(F.when((age >= 0) & (age < days), F.lit(name)) for name, days in ACTIVE_DAYS.items()), F.lit("total_unique"))
    held = sketches.withColumn("_now", now).select(F.explode(F.array_compact(periods)).alias("period"), "sketch")
    return held.groupBy("period").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))


def _recent(pings: DataFrame, as_of, days: int = REPORT_DAYS) -> DataFrame:
    return pings.filter(F.col("ts") > _since(as_of_or_latest(pings, as_of), days))


def users_by(pings: DataFrame, column: str, as_of=None, top: int | None = None) -> DataFrame:
    """Distinct recent ids per value of ``column``, most users first, ties by value."""
    counted = (
        _recent(pings, as_of)
        .groupBy(column)
        .agg(F.count_distinct("id").alias("users"))
        .orderBy(F.desc("users"), column)
    )
    return counted.limit(top) if top else counted


def daily_users(pings: DataFrame, as_of=None) -> DataFrame:
    """Distinct recent ids per UTC day."""
    return (
        _recent(pings, as_of)
        .groupBy(F.to_date("ts").alias("day"))
        .agg(F.count_distinct("id").alias("users"))
        .orderBy("day")
    )


def latest_version(pings: DataFrame, by: str = "platform") -> DataFrame:
    """Highest version per group in numeric order, not text order."""
    from ..functions.urls import version_key

    return pings.groupBy(by).agg(F.max_by("version", F.struct(version_key(F.col("version")), "version")).alias("version"))


def download_summary(downloads: DataFrame, as_of: date | str, days: int = DOWNLOAD_DAYS) -> DataFrame:
    """Downloads per category over the last ``days`` days including ``as_of``."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    return downloads.filter(F.col("dl_date") >= cutoff).groupBy("category").agg(F.sum("downloads").alias("downloads"))


def download_badge(downloads: DataFrame, as_of: date | str) -> DataFrame:
    """One row: 30-day downloads of the badge category."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), BADGE_DAYS)
    return downloads.filter((F.col("category") == BADGE_CATEGORY) & (F.col("dl_date") >= cutoff)).agg(
        F.coalesce(F.sum("downloads"), F.lit(0)).alias("downloads")
    )


def traffic_summary(traffic: DataFrame, series: str = "series") -> DataFrame:
    """Per kind: reported uniques and the total of the nested daily counts."""
    zero = F.lit(0).cast("bigint")
    total = F.aggregate(series, zero, lambda acc, d: acc + F.coalesce(d["count"].cast("bigint"), zero))
    return traffic.select(
        "kind", F.coalesce("uniques", zero).alias("uniques"), F.coalesce(total, zero).alias("total")
    )


def cooldown(pings: DataFrame, key: str = "id", gap: int = COOLDOWN_SECONDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Accepted pings (key, accepted_at in epoch seconds): the first, then each one at least
    ``gap`` seconds after the last accepted one. A null key is a key like any other.

    Equal seconds are merged first. Every second then points to the first one of its key that is ``gap`` later,
    found in one ordered pass over seconds and seconds plus gap. Accepted ones are those that the first second
    of a key reaches. Pointers of one, two, four, ... steps come from joining a table of pointers with itself,
    so a chain of n accepted pings takes about log2(n) rounds; its joins are on (key, second), which is unique,
    so a key with most of the pings is spread like any other.
    """
    seconds = cut_lineage(pings.filter(F.col("ts").isNotNull()).select(F.col(key).alias("_key"), F.unix_seconds("ts").alias("s")).distinct())
    if gap <= 0:
        return seconds.select(F.col("_key").alias(key), F.col("s").alias("accepted_at"))
    # the ordered pass runs from late to early: the last second met before s + gap is the first one after it
    probed = seconds.select("_key", (-F.col("s")).alias("down"), F.lit(0).alias("probe"), "s").unionByName(
        seconds.select("_key", (-F.col("s") - gap).alias("down"), F.lit(1).alias("probe"), "s")
    )
    met = with_last(probed, ["_key"], ["down", "probe", "s"], F.when(F.col("probe") == 0, F.col("s")), "next", group_rows=group_rows)
    jump = cut_lineage(met.filter("probe = 1 AND next IS NOT NULL").select("_key", "s", "next"))
    longest = seconds.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("hi"), F.min("s").alias("lo")).agg(
        F.max(F.least(F.col("n"), F.expr(f"(hi - lo) div {gap} + 1")))
    )
    jumps, steps, most = [jump], 1, (longest.first()[0] or 1) - 1
    while 2 * steps <= most:
        first, then = jump.alias("a"), jump.alias("b")
        onward = F.col("a._key").eqNullSafe(F.col("b._key")) & (F.col("a.next") == F.col("b.s"))
        jump = cut_lineage(first.join(then, onward).select("a._key", "a.s", "b.next"))
        jumps.append(jump)
        steps *= 2
    # from the longest pointers to the shortest: each one doubles what is reached, in one plan
    reached = seconds.groupBy("_key").agg(F.min("s").alias("s"))
    for jump in reversed(jumps):
        ahead = jump.select(F.col("_key").alias("_k"), F.col("s").alias("_s"), "next")
        both = reached.join(ahead, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("s") == F.col("_s")), "left")
        reached = both.select("_key", F.explode(F.array_compact(F.array("s", "next"))).alias("s"))
    return reached.select(F.col("_key").alias(key), F.col("s").alias("accepted_at"))


def sessions(events: DataFrame, key: str = "user_id", gap: int = SESSION_GAP_SECONDS, as_of=None) -> DataFrame:
    """Sessions per key: split where the pause exceeds ``gap`` seconds; idle time and expiry at ``as_of``.

    Events of one ``gap``-wide time slot can never be split, so slots are aggregated first
    (before the shuffle) and only slots are ordered: a key holds one row per active slot,
    however many events it has.
    """
    now = F.unix_micros(as_of_or_latest(events, as_of))
    micros = gap * 1_000_000
    at = F.unix_micros("ts")
    slots = (
        events.groupBy(key, F.floor(at / micros).alias("slot"))
        .agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(key).orderBy("slot")
    starts = F.col("first") - F.lag("last").over(w) > micros
    return (
        slots.withColumn("_starts", F.coalesce(starts, F.lit(True)).cast("int"))
        .withColumn("session_no", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "session_no")
        .agg(F.min("first").alias("_first"), F.max("last").alias("_last"), F.sum("n").alias("events"))
        .withColumn("_idle", F.floor((now - F.col("_last")) / 1_000_000))
        .select(
            key, "session_no", F.timestamp_micros("_first").alias("session_start"),
            F.timestamp_micros("_last").alias("session_end"), "events", F.col("_idle").alias("idle_seconds"),
            (now - F.col("_last") > micros).alias("expired"),
        )
    )
