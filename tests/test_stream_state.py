"""Keyed stream state: restarts, time to live, timers, hot keys."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from pagemill.streaming import jobs

PINGS = "id string, s long"


def plain(rows, gap=86_400):
    last, out = {}, set()
    for k, s in sorted(rows, key=lambda r: r[1]):
        if k not in last or s - last[k] >= gap:
            last[k] = s
            out.add((k, s))
    return out


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def pings(spark, path):
    stream = spark.readStream.schema(PINGS).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.select("id", F.timestamp_seconds("s").alias("ts"))


def test_cooldown_goes_on_after_a_restart(spark, tmp_path):
    random.seed(3)
    rows = [(f"id{random.randint(0, 5)}", random.randint(0, 20 * 86_400)) for _ in range(400)]
    rows.sort(key=lambda r: r[1])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        write(spark, rows[100 * k : 100 * (k + 1)], PINGS, source)
        got = jobs.run_available(jobs.ping_cooldown(pings(spark, source)), out)
        assert {tuple(r) for r in got.collect()} == plain(rows[: 100 * (k + 1)])


def test_timers_drop_state_that_no_longer_matters(spark, tmp_path):
    day = 86_400
    rounds = [[(f"old{i}", 100 + i) for i in range(50)], [("new", 3 * day)], [("new", 6 * day), ("old1", 6 * day + 5)], [("new", 9 * day)]]
    source = str(tmp_path / "in")
    held = []
    for k, rows in enumerate(rounds):
        write(spark, rows, PINGS, source)
        with jobs.rocksdb_state(spark):
            query = (
                jobs.ping_cooldown(pings(spark, source), lateness="1 hour").writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
            )
            query.awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == plain([r for part in rounds[: k + 1] for r in part])
        held.append([json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1])
    assert held[0] >= 50 and held[-1] < 20


def test_hot_id_reaches_the_state_as_distinct_seconds():
    at = [1_700_000_000_000_000 + i % 3 * 1_000_000 + i for i in range(9_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["hot"] * 9_000), pa.array(at, pa.timestamp("us", "UTC"))], names=["id", "ts"])
    (out,) = jobs._distinct_seconds(iter([batch]))
    assert sorted(out.column(1).cast(pa.int64()).to_pylist()) == [1_700_000_000_000_000 + i * 1_000_000 for i in range(3)]
    assert sum(len(b) for b in jobs._distinct_seconds(iter([batch.slice(0, 0)]))) == 0


def test_hot_id_split_over_files(spark, tmp_path):
    rows = [("hot", i // 40) for i in range(20_000)] + [("hot", 90_000 + i // 40) for i in range(20_000)] + [(None, 5), (None, 6)]
    source = str(tmp_path / "in")
    for k in range(4):
        write(spark, rows[k::4], PINGS, source)
    stream = spark.readStream.schema(PINGS).parquet(source).select("id", F.timestamp_seconds("s").alias("ts"))
    got = jobs.run_available(jobs.ping_cooldown(stream), str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == {("hot", 0), ("hot", 90_000), (None, 5)}


def test_idle_urls_are_forgotten_also_after_a_restart(spark, tmp_path):
    schema = "url string, s long, snapshot_id long, text string"

    def run(idle, name):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("s")).drop("s")
        out = jobs.run_available(jobs.page_changes(stream, idle, "10 seconds"), str(tmp_path / name))
        return {(r.url, r.snapshot_id): r.check_status for r in out.collect()}

    rounds = [
        [("u", 1, 1, "a"), ("u", 2, 2, "a"), ("v", 1, 3, "b"), ("w", 1, 4, "c")],
        [("w", 90, 5, "c"), ("x", 500, 6, "d")],
        [("u", 520, 7, "a"), ("u", 530, 8, "c"), ("w", 515, 9, "c"), ("w", 516, 10, "c")],
    ]
    for rows in rounds:
        write(spark, rows, schema, str(tmp_path / "in"))
        kept, idle = run(None, "kept"), run(100, "idle")
    same = {("u", 1): "new", ("u", 2): "unchanged", ("v", 3): "new", ("w", 4): "new", ("w", 5): "unchanged", ("x", 6): "new", ("u", 8): "changed", ("w", 10): "unchanged"}
    assert kept == same | {("u", 7): "unchanged", ("w", 9): "unchanged"}
    assert idle == same | {("u", 7): "new", ("w", 9): "new"}


def test_the_session_setting_comes_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with jobs.rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before
