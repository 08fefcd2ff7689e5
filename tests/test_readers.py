"""Feeds and fetch logs as files, mergeable sketches, bounded first-seen state."""

import json
import random

from pyspark.sql import functions as F

from pagemill.operators import usage
from pagemill.sources import pages, papers
from pagemill.streaming import jobs

GOOD = {"url": "u", "final_url": "u/", "tier": "fast", "attempt": 1, "status": 200, "html": "<p>a\nb", "error": None, "elapsed_ms": 5}


def test_broken_log_lines_are_kept_apart(spark, tmp_path):
    lines = [json.dumps(GOOD), '{"url": "v", "tier', "", "nonsense", "[]", json.dumps(GOOD | {"url": "w", "status": None}), '{"tier": "fast"}']
    (tmp_path / "log").mkdir()
    for k in range(2):
        (tmp_path / "log" / f"part{k}.json").write_text("\n".join(lines[k::2]) + "\n")
    path = str(tmp_path / "log")
    good = pages.read_fetch_log(spark, path, "json")
    assert sorted((r.url, r.status, r.html) for r in good.collect()) == [("u", 200, "<p>a\nb"), ("w", None, "<p>a\nb")]
    assert {r.line for r in pages.fetch_log_rejects(spark, path).collect() if r.line} >= {'{"url": "v", "tier', "nonsense"}
    out = jobs.run_available(pages.stream_fetch_log(spark, path, "json", files_per_trigger=1), str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, good.collect()))


def test_a_large_feed_is_read_by_several_tasks(spark, tmp_path):
    entry = '<entry><id>http://a.test/abs/{0}</id><title>Paper\n {0} &amp; more</title><author><name>Ann</name></author><link title="pdf" href="p{0}"/></entry>\n'
    body = "".join(entry.format(i) for i in range(3000))
    (tmp_path / "feed.xml").write_text(f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>\n{body}<entry><id>x</title></entry></feed>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = papers.read_arxiv_feeds(spark, str(tmp_path / "feed.xml"))
        assert found.rdd.getNumPartitions() > 4
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    good = {r.id: (r.title, r.pdf_url, r.authors) for r in rows if r.error is None}
    assert good == {str(i): (f"Paper {i} & more", f"p{i}", ["Ann"]) for i in range(3000)}
    assert [r.error for r in rows if r.error] == ["unreadable entry"]


def test_sketches_merge_without_a_rescan(spark):
    random.seed(4)
    rows = [(f"id{random.randint(0, 20_000)}", random.randint(0, 40 * 86_400 - 1)) for _ in range(60_000)]
    pings = spark.createDataFrame(rows, "id string, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    day = lambda n: (F.unix_seconds("ts") / 86_400).cast("int") == n
    old = F.unix_seconds("ts") < 39 * 86_400
    stored = usage.daily_sketches(pings.filter(old))
    # the last day comes in two pieces
    half = F.xxhash64("id", "ts") % 2 == 0
    for piece in (half, ~half):
        stored = usage.merged_sketches(stored, usage.daily_sketches(pings.filter(day(39) & piece)))
    assert stored.count() == 40
    got = {r.period: r.users for r in usage.active_users_sketched(stored).collect()}
    for name, days in {**usage.ACTIVE_DAYS, "total_unique": 40}.items():
        exact = len({k for k, s in rows if s >= (40 - days) * 86_400})
        assert abs(got[name] - exact) <= 4 * usage.SKETCH_ERROR * exact
    assert usage.active_users_sketched(stored.limit(0)).count() == 0


def test_first_seen_with_bounded_state(spark, tmp_path):
    schema = "url string, s long"
    rounds = [[(f"http://h/{i}", 100 + 10 * k + i % 10) for i in range(40 * k, 40 * k + 40)] for k in range(5)]
    rounds[4] += [("http://h/161#again", 147), ("http://h/1", 149)]  # a repeat inside the delay, and one after it
    held = []
    for rows in rounds:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("s"))
        query = (
            jobs.first_seen(stream, within="15 seconds").select("clean_url").writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination()
        held.append([json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1])
    seen = [r.clean_url for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    missing = {f"http://h/{i}" for i in range(200)} - set(seen)
    assert not missing, sorted(missing)
    assert seen.count("http://h/161") == 1 and seen.count("http://h/1") == 2
    assert max(held) < 160  # 200 URLs were seen
