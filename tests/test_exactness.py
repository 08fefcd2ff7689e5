"""Limits and switches that must not change a result: slices, chunks, passes, captures, broadcasts, failed checks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators import research, usage
from pagemill.operators.joins import fits_broadcast
from pagemill.operators.ordered import with_last
from pagemill.sources.sinks import SnapshotStore
from pagemill.streaming import jobs


def test_slices_of_a_hot_and_a_null_key(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, i])) for i in range(3000) for k in (["hot", None][i % 2],)] + [("rare", 1, 5), ("rare", 2, None)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    whole = {(r.k, r.at): r.last for r in with_last(df, ["k"], ["at"], F.col("v"), "last").collect()}
    cut = with_last(df, ["k"], ["at"], F.col("v"), "last", group_rows=10, slices=6)
    assert {(r.k, r.at): r.last for r in cut.collect()} == whole and sum(v is not None for v in whole.values()) > 2900
    # the hot keys do lie in several slices
    placed = df.repartitionByRange(6, "k", "at").withColumn("s", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("s").alias("n"))
    n = {r.k: r.n for r in placed.collect()}
    assert n["hot"] > 1 and n[None] > 1 and sum(n.values()) >= 4


@pytest.mark.parametrize("rows", [3, 5_000_000])
def test_cooldown_with_null_ids_and_far_times(spark, rows):
    seconds = [1, 2_678_390, 2_678_410, 86_401, 9_000_000_000, 9_000_050_000, 250_000_000_000]
    df = spark.createDataFrame([(k, s) for k in (None, "a") for s in seconds], "id string, s long")
    pings = df.select("id", F.timestamp_seconds("s").alias("ts"))
    got = {(r.id, r.accepted_at) for r in usage.cooldown(pings, group_rows=rows).collect()}
    assert got == {(k, s) for k in (None, "a") for s in (1, 86_401, 2_678_390, 9_000_000_000, 250_000_000_000)}


def test_six_passes_of_the_same_hits(spark):
    hits = [(1, p, r, f"http://u/{r}") for p in range(6) for r in range(1, 9)]
    got = research.choose_sources(spark.createDataFrame(hits, "query_id int, pass int, rank int, url string"), 1)
    assert [(r.n, r["pass"], r.url) for r in got.orderBy("n").collect()] == [(p + 1, p, f"http://u/{p + 1}") for p in range(6)]


def test_broadcasts_are_bounded_in_bytes(spark):
    wide = spark.range(20).select(F.repeat(F.lit("x"), 10_000).alias("url"), F.array("id").alias("a"))
    assert fits_broadcast(wide) and not fits_broadcast(wide, max_bytes=100_000) and not fits_broadcast(wide, rows=19)


def test_failed_checks_are_no_state(spark, tmp_path):
    rows = [("u", 1, "a", None), ("u", 2, None, "timeout"), ("u", 3, "a", None), ("v", 1, None, "timeout")]
    snaps = spark.createDataFrame(rows, "url string, snapshot_id long, text string, error string").withColumn("ts", F.timestamp_seconds("snapshot_id"))
    want = {("u", 1): "new", ("u", 2): "error", ("u", 3): "unchanged", ("v", 1): "error"}
    for files in (1, 4):
        path = str(tmp_path / f"in{files}")
        by_time = snaps.withColumn("n", F.row_number().over(Window.orderBy("ts", "url")))
        for k in range(files):
            by_time.filter(F.col("n") % files == (k + 1) % files).drop("n").coalesce(1).write.mode("append").parquet(path)
        for name, run in (("state", lambda s, p: jobs.run_available(jobs.page_changes(s), p)), ("batch", jobs.run_page_changes)):
            stream = spark.readStream.schema(snaps.schema).option("maxFilesPerTrigger", 1).parquet(path)
            got = run(stream, str(tmp_path / f"{name}{files}"))
            assert {(r.url, r.snapshot_id): r.check_status for r in got.collect()} == want
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.append(snaps.withColumns({"title": F.lit("t"), "status": F.lit(200), "method": F.lit("m")}))
    assert sorted(r.snapshot_id for r in store.read().collect()) == [1, 3]
    store._write(store.read().withColumn("forgotten", F.lit(False)), 1)  # left by a broken compaction
    (tmp_path / "store" / "gen=1" / "_SUCCESS").rename(tmp_path / "mark")
    store.compact()
    store.drop_old()
    assert store._generation() == 1 and spark.read.parquet(str(tmp_path / "store" / "gen=0")).count() == 0
    assert sorted(r.snapshot_id for r in store.read().collect()) == [1, 3]
