"""Monitoring, usage and streams: literal cases, plain loops, one file against many."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import monitor, usage
from pagemill.streaming import jobs


def snapshots(spark, rows):
    df = spark.createDataFrame(rows, "url string, s long, snapshot_id long, text string, error string")
    return df.withColumn("ts", F.timestamp_seconds("s")).withColumn("status", F.lit(200))


def test_check_status_and_diff(spark):
    rows = [("u", 1, 1, "a\nb\nc", None), ("u", 2, 2, "a\nb\nc", None), ("u", 3, 3, None, "down"), ("u", 4, 4, "a\nB\nc\nd", None),
            ("v", 1, 5, "x\r\ny", None), ("v", 2, 6, "x\ny", None)]
    snaps = snapshots(spark, rows)
    for limit in (10**6, 1):
        got = {r.snapshot_id: (r.check_status, r.prev_id) for r in monitor.monitor_check(snaps, limit).collect()}
        assert got == {1: ("new", None), 2: ("unchanged", 1), 3: ("error", None), 4: ("changed", 2), 5: ("new", None), 6: ("changed", 5)}
    diffs = {r.snapshot_id: r for r in monitor.unified_diffs(snaps).collect()}
    assert diffs[4].diff.split("\n") == [
        "--- u@1970-01-01T00:00:02Z", "+++ u@1970-01-01T00:00:04Z", "@@ -1,3 +1,4 @@", " a", "-b", "+B", " c", "+d",
    ]
    assert diffs[6].diff is None
    cut = {r.snapshot_id: r for r in monitor.unified_diffs(snaps, 5).collect()}
    assert (cut[4].diff, cut[4].diff_truncated) == ("--- u", True)
    delta = {r.snapshot_id: (r.lines_added, r.lines_removed) for r in monitor.line_delta(snaps).collect()}
    assert delta == {4: (2, 1), 6: (0, 0)}


def test_incremental_check(spark):
    old = snapshots(spark, [("u", 1, 1, "a", None), ("v", 1, 2, "b", None)])
    latest = old.select("url", F.sha2("text", 256).alias("hash"))
    new = snapshots(spark, [("u", 2, 3, "a", None), ("v", 2, 4, "c", None), ("w", 2, 5, "d", None), ("x", 2, 6, None, "down")])
    got = {r.url: r.check_status for r in monitor.check_incoming(latest, new).collect()}
    assert got == {"u": "unchanged", "v": "changed", "w": "new", "x": "error"}


def test_history_and_overview(spark):
    snaps = snapshots(spark, [("u", i, i, str(i), None) for i in range(25)] + [("v", 1, 99, "v", None)])
    asked = spark.createDataFrame([("u",), ("none",)], "url string")
    rows = monitor.monitor_history(snaps, asked).orderBy("age_rank").collect()
    assert [r.snapshot_id for r in rows if r.url == "u"] == list(range(24, 4, -1))
    assert [r.history_status for r in rows if r.url == "none"] == ["no_history"]
    assert [(r.url, r.snapshots) for r in monitor.monitors_overview(snaps).collect()] == [("u", 20), ("v", 1)]
    assert {r.url for r in monitor.forget(snaps, asked).collect()} == {"v"}


def test_download_window(spark):
    rows = [("without_mirrors", "2031-05-20", 7), ("with_mirrors", "2031-05-14", 40), ("without_mirrors", "2031-04-21", 300)]
    df = spark.createDataFrame(rows, "category string, d string, downloads long").withColumn("dl_date", F.to_date("d"))
    assert {r.category: r.downloads for r in usage.download_summary(df, "2031-05-20").collect()} == {"without_mirrors": 7, "with_mirrors": 40}
    assert usage.download_badge(df, "2031-05-20").first().downloads == 307
    assert usage.download_badge(df, "2031-05-22").first().downloads == 7


def test_traffic(spark):
    df = spark.createDataFrame([("views", 3, [(4,), (6,)]), ("clones", None, None)], "kind string, uniques long, series array<struct<count:int>>")
    assert [tuple(r) for r in usage.traffic_summary(df).collect()] == [("views", 3, 10), ("clones", 0, 0)]


def random_pings(n=4000, days=200):
    random.seed(9)
    return [("hot" if random.random() < 0.4 else f"id{random.randint(0, 30)}", random.randint(0, days * 86_400)) for _ in range(n)]


def plain_cooldown(rows, gap):
    last, out = {}, set()
    for k, s in sorted(rows, key=lambda r: r[1]):
        if k not in last or s - last[k] >= gap:
            last[k] = s
            out.add((k, s))
    return out


@pytest.mark.parametrize("group_rows", [5_000_000, 50])
def test_cooldown_like_a_plain_loop(spark, group_rows):
    rows = random_pings()
    df = spark.createDataFrame(rows, "id string, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    got = [tuple(r) for r in usage.cooldown(df, group_rows=group_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_cooldown(rows, 86_400)


def test_cooldown_of_ten_years_and_of_a_hot_key(spark):
    random.seed(10)
    rows = [("decade", d * 86_400 + random.randint(-3000, 3000)) for d in range(3650) for _ in range(2)]
    rows += [("hot", random.randint(0, 40 * 86_400)) for _ in range(20_000)] + [("one", 5), (None, 7), (None, 86_407), (None, 86_406)]
    df = spark.createDataFrame(rows, "id string, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    for group_rows in (5_000_000, 2_000):
        got = [tuple(r) for r in usage.cooldown(df, group_rows=group_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_cooldown(rows, 86_400)
    assert usage.cooldown(df.limit(0)).count() == 0
    assert {tuple(r) for r in usage.cooldown(df, gap=0).collect()} == set(rows)
    plan = usage.cooldown(df)._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "Window" not in plan.split("Physical Plan")[1]


def test_sessions_like_a_plain_loop(spark):
    rows = [(k, s // 40) for k, s in random_pings()] + [("edge", 0), ("edge", 1800), ("edge", 3601)]
    df = spark.createDataFrame(rows, "user_id string, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    want, open_ = [], {}
    for k, s in sorted(rows, key=lambda r: (r[0], r[1])):
        if k in open_ and s - open_[k][2] <= 1800:
            open_[k][2] = s
            open_[k][3] += 1
        else:
            open_[k] = [k, s, s, 1]
            want.append(open_[k])
    got = usage.sessions(df, as_of="1970-01-02 00:00:00").select(
        "user_id", F.unix_seconds("session_start"), F.unix_seconds("session_end"), "events", "idle_seconds", "expired"
    )
    rows_got = sorted(tuple(r) for r in got.collect())
    assert [r[:4] for r in rows_got] == sorted(map(tuple, want))
    assert all(r[4] == 86_400 - r[2] and r[5] == (r[4] > 1800) for r in rows_got)


def test_active_users_edges(spark):
    day = 86_400
    rows = [("a", 40 * day), ("b", 39 * day), ("c", 39 * day + 1), ("d", 10 * day), ("e", 10 * day + 1)]
    df = spark.createDataFrame(rows, "id string, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    assert tuple(usage.active_users(df).first()) == (2, 3, 4, 5)
    assert tuple(usage.active_users(df, as_of="1970-02-10 00:00:00", approx=True).first()) == (2, 3, 4, 5)


@pytest.mark.parametrize("files", [1, 7])
def test_streams_match_batch(spark, small, tmp_path, files):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # files in time order, so that late data is not part of this test
    parts = events.repartitionByRange(files, "ts").withColumn("_p", F.spark_partition_id()).cache()
    for p in range(files):
        parts.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def snaps(df):
        return df.select(F.col("user_id").cast("string").alias("url"), "ts", F.col("event_id").alias("snapshot_id"), F.col("event_type").alias("text"))

    def pings(df):
        return df.select(F.col("user_id").cast("string").alias("id"), "ts")

    def rows(df, *cols):
        return sorted(tuple(r) for r in df.select(*cols).collect())

    out = jobs.run_available(jobs.page_changes(snaps(stream())), str(tmp_path / "changes"))
    assert rows(out, "snapshot_id", "check_status") == rows(monitor.monitor_check(snaps(events)), "snapshot_id", "check_status")
    out = jobs.run_page_changes(snaps(stream()), str(tmp_path / "by_batch"))
    assert rows(out, "snapshot_id", "check_status") == rows(monitor.monitor_check(snaps(events)), "snapshot_id", "check_status")
    out = jobs.run_available(jobs.ping_cooldown(pings(stream())), str(tmp_path / "cooldown"))
    assert rows(out, "id", "accepted_at") == rows(usage.cooldown(pings(events)), "id", "accepted_at")
    out = jobs.run_available(jobs.session_stream(stream()), str(tmp_path / "sessions"))
    closed = usage.sessions(events).filter("idle_seconds > 3600 + 1801")
    assert rows(out, "user_id", "session_start", "events") == rows(closed, "user_id", "session_start", "events")
    urls = stream().select(F.concat(F.lit("http://h/"), "event_type", F.lit("#"), "event_id").alias("url"), "ts")
    assert jobs.run_available(jobs.first_seen(urls), str(tmp_path / "seen")).count() == 5
    assert jobs.run_available(jobs.first_seen(urls, within="40 days"), str(tmp_path / "seen2")).count() == 5
    days = jobs.run_available(jobs.daily_actives(pings(stream())), str(tmp_path / "days"))
    assert 27 <= days.count() <= 30
    exact = jobs.run_available(jobs.daily_actives_exact(pings(stream())), str(tmp_path / "exact"))
    per_day = usage.daily_users(pings(events))
    want = {r.day: r.users for r in per_day.collect()}
    got = {r.day: r.users for r in exact.collect()}
    assert 27 <= len(got) <= 30 and all(want[day] == users for day, users in got.items())
