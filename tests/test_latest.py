"""The index of latest hashes: merging, epochs, repeated batches, pruned buckets."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.sources import latest
from pagemill.sources.sinks import SnapshotStore

SCHEMA = "url string, t long, snapshot_id long, hash string, forgotten boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def plain(rows):
    """url -> (t, snapshot_id, hash) of the newest row after the newest mark."""
    out = {}
    for url in {r[0] for r in rows}:
        gone = max((r[1] for r in rows if r[0] == url and r[4]), default=None)
        kept = [r[1:4] for r in rows if r[0] == url and not r[4] and (gone is None or r[1] > gone)]
        if kept:
            out[url] = max(kept)
    return out


def known(df):
    return {r.url: (r.t, r.snapshot_id, r.hash) for r in df.withColumn("t", F.unix_seconds("ts")).collect()}


@pytest.mark.parametrize("epoch", [2, 16])
def test_rounds_epochs_and_repeats(spark, tmp_path, monkeypatch, epoch):
    monkeypatch.setattr(latest, "EPOCH_BATCHES", epoch)
    rng = random.Random(epoch)
    index = latest.LatestIndex(spark, str(tmp_path / "index"))
    assert known(index.latest(0)) == {}
    rows = []
    for batch in range(6):
        new = []
        for i in range(12):
            url, gone = f"u{rng.randint(0, 9)}", rng.random() < 0.2
            new.append((url, rng.randint(0, 40), None if gone else 100 * batch + i, None if gone else f"h{rng.randint(0, 3)}", gone))
        if batch == 3:  # a batch that failed half way and comes again
            index.put(frame(spark, [("u0", 99, 1, "wrong", False)]), batch)
            assert known(index.latest(batch)) == plain(rows)
        index.put(frame(spark, new), batch)
        assert known(index.latest(batch)) == plain(rows)
        rows += new
        assert known(index.latest(batch + 1)) == plain(rows)
        asked = frame(spark, [("u1", 0, 0, "", False), ("u5", 0, 0, "", False), ("none", 0, 0, "", False)])
        assert known(index.latest(batch + 1, asked)) == {u: v for u, v in plain(rows).items() if u in ("u1", "u5")}


def test_only_the_buckets_of_the_asked_urls_are_read(spark, tmp_path):
    index = latest.LatestIndex(spark, str(tmp_path / "index"))
    index.put(frame(spark, [(f"https://w.test/{i}", i, i, f"h{i}", False) for i in range(500)]), 0)
    asked = spark.createDataFrame([("https://w.test/7",)], "url string")
    found = index.latest(1, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    (bucket,) = latest.buckets_of(asked)
    assert f"= {bucket})" in plan.split("PartitionFilters: [")[1].split("]")[0] + ")"
    assert [r.hash for r in found.collect()] == ["h7"]
    files = {r[0] for r in found.select(F.input_file_name()).collect()}
    assert len(files) <= 1


def test_store_rounds_use_the_index(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def rows(ids, at):
        return spark.createDataFrame([(f"u{i}", at, 1000 * at + i, f"text {i % 3} {at}") for i in ids], "url string, t long, snapshot_id long, text string").select(
            "url", F.timestamp_seconds("t").alias("ts"), "snapshot_id", F.lit("T").alias("title"), F.lit(200).alias("status"), F.lit("m").alias("method"), "text"
        )

    store.append(rows(range(20), 1))
    store.append(rows(range(10), 2))
    store.forget(spark.createDataFrame([("u3",), ("u15",)], "url string"), "1970-01-01 00:00:01")
    store.append(rows([15], 3))
    store.compact(keep=1)
    want = {r.url: r.snapshot_id for r in store.read().groupBy("url").agg(F.max("snapshot_id").alias("snapshot_id")).collect()}
    assert {r.url: r.snapshot_id for r in store.latest().collect()} == want
    assert want["u3"] == 2003 and want["u15"] == 3015 and len(want) == 20
    assert [r.snapshot_id for r in store.read(urls=spark.createDataFrame([("u4",)], "url string")).collect()] == [2004]
