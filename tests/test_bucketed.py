"""Tables stored by URL: no exchange above their scans, same rows as from plain tables."""

import re

import pytest
from pyspark.sql import functions as F

from pagemill.operators import batch, cache
from pagemill.sources.bucketed import BucketedTable

LONG = "<title>T</title><p>" + "word " * 200 + "</p>"
LOG = "url string, tier string, attempt int, status int, html string, error string, elapsed_ms int"
AS_OF = "2024-01-01 00:10:00"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = []
    for i in range(60):
        for tier in ("fast", "stealth"):
            for attempt in range(1, 1 + (300 if i == 7 else 2)):  # one URL with very many attempts
                failed = (i + attempt) % 5 == 0
                html = None if failed else LONG.replace("word", f"{tier}{attempt}") if i % 3 or tier == "stealth" else "<p>short"
                rows.append((f"u{i}", tier, attempt, None if failed else 200 if i % 4 else 403, html, "timeout" if failed else None, attempt))
    log = spark.createDataFrame(rows, LOG)
    pages = spark.createDataFrame(
        [(f"u{i}", f"u{i}/", 200, "", f"cached {i}", "C", "fetch_fast", 3, s) for i in range(0, 60, 4) for s in (0, 100 + i, 9_999)],
        "url string, final_url string, status int, html string, markdown string, title string, method string, elapsed_ms int, s long",
    )
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("s"))
    entries = cache.cache_entries(pages.withColumn("put", at), F.col("put")).drop("put", "s")
    folder = tmp_path_factory.mktemp("bucketed")
    stored = [
        BucketedTable.write(df, str(folder / name), sort=sort, buckets=4).path
        for name, df, sort in (("log", log, ("tier", "attempt")), ("cache", entries, ("put_ts",)))
    ]
    urls = spark.createDataFrame([(i, f" u{i % 70} ") for i in range(90)] + [(99, ""), (98, None)], "pos int, raw_url string")
    return urls, log, entries, [BucketedTable(spark, p).read() for p in stored]


def canonical(df):
    return sorted((tuple(sorted((k, repr(v)) for k, v in r.asDict().items() if k != "meta")), sorted((r.meta or {}).items())) for r in df.collect())


@pytest.mark.parametrize("prefer", ["auto", "fast"])
@pytest.mark.parametrize("cached", [False, True])
@pytest.mark.parametrize("small", [True, False])
def test_same_rows_as_from_plain_tables(tables, monkeypatch, prefer, cached, small):
    urls, log, entries, (by_url, stored) = tables
    if not small:  # a URL list beyond the broadcast
        monkeypatch.setattr(batch, "pick_rows", lambda big, wanted, on: big)
    how = {"prefer": prefer, "include_html": True}
    asked = {"as_of": AS_OF}
    plain = batch.batch_scrape(urls, log, **how, **({"cache": entries, **asked} if cached else {}))
    bucketed = batch.batch_scrape_bucketed(urls, by_url, **how, **({"cache": stored, **asked} if cached else {}))
    got, want = canonical(bucketed.select(sorted(bucketed.columns))), canonical(plain.select(sorted(bucketed.columns)))
    assert got == want and len(got) == 70


def exchanged(df):
    """Scans that lie below an exchange, by the indentation of the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+\-|*()0-9]*", x)[0]) for x in lines]
    found = []
    for i, line in enumerate(lines):
        if re.search(r"(?<!Broadcast)Exchange ", line):
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                if "FileScan" in lines[j]:
                    found.append(lines[j])
    return found, sum("FileScan" in x for x in lines)


def test_no_exchange_above_either_scan(spark, tables, monkeypatch):
    urls, log, entries, (by_url, stored) = tables
    monkeypatch.setattr(batch, "pick_rows", lambda big, wanted, on: big)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = batch.batch_scrape_bucketed(urls, by_url, cache=stored, as_of=AS_OF)
        below, scans = exchanged(out)
        assert below == [] and scans == 2
        again, scans = exchanged(stored.repartition(3).groupBy("url").count())
        assert again and scans == 1  # the check sees exchanges
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_file_for_each_bucket(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("u"), (F.col("id") % 50).cast("string")).alias("url"), "id")
    stored = BucketedTable.write(rows, str(tmp_path / "t"), sort=("id",), buckets=5)
    files = list((tmp_path / "t" / "rows").glob("part-*.parquet"))
    assert len(files) == 5
    assert stored.read().count() == 1000 and stored.read().columns == ["url", "id"]
    empty = BucketedTable.write(rows.limit(0), str(tmp_path / "e"), buckets=3)
    assert empty.read().count() == 0
