"""Ladder, batches, cache, research and search on small inputs, and beyond the checked sizes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.operators import batch, cache, ladder, papers, research, search
from pagemill.operators.joins import join_checked
from pagemill.operators.ordered import with_last

LONG = "<p>" + "word " * 200 + "</p>"
LOG = "url string, tier string, attempt int, status int, html string, error string, elapsed_ms int"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def test_ladder_auto(spark):
    fetched = log(
        spark,
        ("good", "fast", 1, 200, LONG, None, 1), ("good", "stealth", 1, 200, LONG, None, 9),
        ("short", "fast", 1, 200, "<p>x</p>", None, 1), ("short", "stealth", 1, 404, LONG, None, 9),
        ("raised", "fast", 1, None, None, "boom", 1), ("raised", "stealth", 1, 200, "<p>ok</p>", None, 9),
        ("both", "fast", 1, None, None, "boom", 1), ("both", "stealth", 1, None, None, "crash", 9),
        ("only", "fast", 1, 403, LONG, None, 1),
        ("latest", "fast", 1, 503, LONG, None, 1), ("latest", "fast", 2, 200, LONG, None, 2), ("latest", "stealth", 1, 200, LONG, None, 9),
    )
    got = {r.url: r for r in ladder.choose_attempt(fetched).collect()}
    assert (got["good"].method, got["good"].meta, got["good"].error) == ("fetch_fast", {}, None)
    # a blocked last resort always notes the first error, here none
    assert (got["short"].method, got["short"].status, got["short"].meta) == ("fetch_stealth", 404, {"fast_error": None})
    assert (got["raised"].markdown, got["raised"].meta) == ("ok", {"fast_error": "boom"})
    assert (got["both"].method, got["both"].status, got["both"].error, got["both"].meta) == ("error", 0, "crash", {"error": "crash"})
    assert got["only"].error == "not attempted"
    assert (got["latest"].method, got["latest"].elapsed_ms) == ("fetch_fast", 2)
    fast = {r.url: r for r in ladder.choose_attempt(fetched, "fast").collect()}
    assert (fast["only"].status, fast["raised"].error, fast["short"].markdown) == (403, "boom", "x")
    assert {r.tier for r in ladder.ladder_decisions(fetched, "llm").collect()} == {"fast", "stealth"}


def test_batch(spark):
    urls = spark.createDataFrame([(1, " a "), (2, "b"), (3, "a"), (4, ""), (5, None), (6, " ")], "pos int, raw_url string")
    fetched = log(spark, ("a", "fast", 1, 404, LONG, None, 1), ("a", "stealth", 1, 404, LONG, None, 3))
    rows = batch.batch_scrape(urls, fetched, max_markdown=9).orderBy("pos").collect()
    assert [(r.url, r.pos, r.status, r.error, r.method) for r in rows] == [
        ("a", 1, 404, None, "fetch_stealth"), ("b", 2, None, "not attempted", "error"),
    ]
    assert (rows[0].markdown, rows[0].markdown_truncated) == ("word word", True)
    total = batch.batch_report(urls, fetched).filter("host = '(all)'").first()
    assert tuple(total)[1:] == (6, 2, 1, 1)


def plain_last(rows, include):
    out, last = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before = last.get(k)
        if v is not None:
            last[k] = v
        out[i] = last.get(k) if include else before
    return out


def test_hot_key_gives_the_same_last_value(spark):
    random.seed(7)
    rows = [("hot" if random.random() < 0.5 else f"k{random.randint(0, 20)}", random.randint(0, 300), i,
             i if random.random() < 0.3 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int").repartition(5)
    for include in (False, True):
        for limit in (10**6, 50):
            got = with_last(df, ["k"], ["t", "i"], F.col("v"), "last", include, group_rows=limit)
            assert {r.i: r["last"] for r in got.collect()} == plain_last(rows, include)


def test_salted_join_gives_the_same_rows(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c")], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        results = [sorted(map(repr, join_checked(big, small, ["k"], "id", fits, how).collect())) for fits in (True, False)]
        assert results[0] == results[1] and results[0]


def test_cache_window_is_inclusive(spark):
    puts = spark.createDataFrame([("a", 100, 1), ("a", 2000, 2)], "k string, s long, event_id int")
    asks = spark.createDataFrame([("a", 99, 3), ("a", 1000, 4), ("a", 1001, 5), ("a", 2000, 6), ("b", 2000, 7)], "k string, s long, event_id int")
    puts, asks = (d.select("k", F.timestamp_seconds("s").alias("ts"), "event_id") for d in (puts, asks))
    for rows in (10**6, 1):
        got = {r.event_id: r.hit for r in cache.cache_lookup(asks, puts, group_rows=rows).collect()}
        assert got == {3: False, 4: True, 5: False, 6: True, 7: False}
    assert not any(r.hit for r in cache.cache_lookup(asks, puts, max_items=0).collect())
    stats = cache.cache_stats(asks, puts).first()
    assert (stats["enabled"], stats["items"], stats["hits"], stats["misses"]) == (True, 1, 2, 3)
    kept = cache.cache_compact(asks, puts, as_of="1970-01-01 00:48:20").collect()
    assert [r.k for r in kept] == ["a"]
    assert cache.cache_compact(asks, puts, as_of="1970-01-01 00:48:21").count() == 0


def plain_sources(hits, top):
    seen, out = set(), []
    for p in range(3):
        taken = []
        for url in [h[3] for h in sorted(h for h in hits if h[1] == p)]:
            if url and url not in seen:
                seen.add(url)
                taken.append(url)
            if len(taken) >= top:
                break
        out += [(p, u) for u in taken]
    return out


def test_sources_like_a_plain_loop(spark):
    random.seed(3)
    rows = [(q, p, r, random.choice(["", None] + [f"u{i}" for i in range(8)])) for q in range(12) for p in range(3) for r in range(1, 11)]
    df = spark.createDataFrame(rows, "query_id int, pass int, rank int, url string")
    for top in (0, 1, 2, 4):
        got = {}
        for r in research.choose_sources(df, top).orderBy("query_id", "n").collect():
            got.setdefault(r.query_id, []).append((r["pass"], r.url))
        for q in range(12):
            assert got.get(q, []) == plain_sources([h for h in rows if h[0] == q], top), (q, top)


def test_expand_queries(spark):
    df = spark.createDataFrame([("x",)], "query string")
    texts = [r.pass_query for r in research.expand_queries(df, 9).collect()]
    assert texts == ["x", "x comparison alternatives", "x problems issues criticism"]
    assert research.expand_queries(df, 0).count() == 1


def test_search_without_broadcast_agrees(spark):
    docs = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 4)} word{i % 7} Éa") for i in range(60)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "beta word3"), (2, "ALPHA éa"), (3, "nothing")], "query_id int, query string")
    small = sorted(map(tuple, search.search_corpus(asked, docs, 7).collect()))
    salted = sorted(map(tuple, search.search_corpus(asked, docs, 7, broadcast_rows=1).collect()))
    assert small == salted and {r[0] for r in small} == {1, 2} and len(small) == 14


def plain_bm25(asked, docs, limit):
    """Every document scored for every query; asked and docs are (id, text)."""
    import math
    import re
    from collections import Counter

    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    held = {d: Counter(cut(t)) for d, t in docs}
    size = {d: sum(c.values()) for d, c in held.items()}
    mean = sum(size.values()) / len(docs)
    df = Counter(w for c in held.values() for w in c)
    out = []
    for q, text in asked:
        scores = []
        for d, c in held.items():
            terms = [w for w in set(cut(text)) if w in c]
            if terms:
                parts = (
                    math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / mean)) for w in terms
                )
                scores.append((-round(sum(parts), 6), d))
        out += [(q, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out)


def skewed_corpus(n=400):
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    weight = [1 / (1 + i) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.randint(0, 60)))) for i in range(n)]
    docs += [(n + i, t) for i, t in enumerate([None, "", "w0 w0 w0", "w299 w298", docs[5][1], docs[5][1]])]
    asked = [(q, " ".join(rng.choices(words, weight, k=rng.randint(1, 12)) + (["w250"] if q % 3 else []))) for q in range(25)]
    return [*asked, (90, "unknown"), (91, ""), (92, "w0"), (93, "w299 w0 w1 w2")], docs


@pytest.mark.parametrize("limit, seeds, pairs", [(1, 1, 0), (5, 10, 0), (50, 1000, 0), (5, 10, 10**9)])
def test_pruned_search_gives_the_full_ranking(spark, monkeypatch, limit, seeds, pairs):
    asked, docs = skewed_corpus()
    monkeypatch.setattr(search.best_documents, "__defaults__", (True, seeds, pairs))
    frames = spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(docs, "doc_id int, text string")
    got = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in search.search_corpus(*frames, limit).collect())
    want = plain_bm25(asked, docs, limit)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) <= 1e-6 for g, w in zip(got, want))


def test_search_index_is_searched_again_and_read_in_part(spark, tmp_path):
    asked, docs = skewed_corpus()
    df = spark.createDataFrame(docs, "doc_id int, text string")
    index = search.SearchIndex.write(df, str(tmp_path / "index"))
    for part in (asked[:9], asked[9:]):
        frame = spark.createDataFrame(part, "query_id int, query string")
        again = search.SearchIndex(spark, index.path).search(frame, 4)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, search.search_corpus(frame, df, 4).collect()))
    lists = spark.read.parquet(f"{index.path}/postings")
    # each list from high to low impact, in as many files as the writing tasks needed
    for path in {r[0] for r in lists.select("_metadata.file_path").distinct().collect()}:
        rows = [(r.term, -r.impact) for r in spark.read.parquet(path).collect()]
        assert rows == sorted(rows)


def test_lists_of_weak_terms_make_no_pairs(spark, monkeypatch):
    """The common term cannot lift a document over the bound: its 2,000 documents never meet the query."""
    docs = [(i, "common " * (1 + i % 2) + ("rare special" if i % 400 == 0 else "")) for i in range(2000)]
    frames = spark.createDataFrame([(1, "rare special common")], "query_id int, query string"), spark.createDataFrame(docs, "doc_id int, text string")
    made = []
    plain = search.cut_lineage
    monkeypatch.setattr(search.best_documents, "__defaults__", (True, 1000, 0))

    def seen(df):
        out = plain(df)
        if "part" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(search, "cut_lineage", seen)
    assert [r.doc_id for r in search.search_corpus(*frames, 5).orderBy("rank").collect()] == [0, 400, 800, 1200, 1600]
    assert made == [5, 5]


def test_many_paper_searches_match_whole_tokens(spark):
    rows = [
        ("arxiv", "1", "Bathe andes", "the sea and the and", ["Ann Lee"]), ("arxiv", "2", "The And", None, None),
        ("arxiv", "3", "deep nets", "of learning things", ["Bo"]), ("arxiv", "4", "nets deep deep nets", "", ["Ann"]),
        ("crossref", "5", "deep nets", "the and", []), ("arxiv", "6", "deep, nets!", "x x x x", ["x"]),
    ]
    df = spark.createDataFrame(rows, "source string, id string, title string, summary string, authors array<string>")
    asked = [(1, "the and"), (2, "deep nets"), (3, "nets deep deep"), (4, "things of deep nets learning"), (5, ""), (6, None), (7, "ann lee"), (8, "x x x"), (9, "x x x x x"), (10, "bo deep")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    postings = papers.paper_postings(df)
    got = {}
    for r in sorted(papers.search_papers_many(postings, queries, 25).collect()):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {1: ["1", "2"], 2: ["3", "4", "6"], 3: ["4"], 4: ["3"], 7: ["1"], 8: ["6"], 9: ["6"]}
    other = papers.search_papers_many(postings, queries, 25, source="crossref")
    assert sorted((r.query_id, r.id) for r in other.collect()) == [(1, "5"), (2, "5"), (3, "5")]
    assert papers.search_papers_many(postings, queries, 25, source="web").count() == 0
    assert papers.search_papers_many(postings, queries, 1).filter("query_id = 2").collect()[0].id == "3"


def test_search_papers(spark):
    rows = [("arxiv", str(i), f"Deep nets {i}", "on learning of things", ["cs.LG"] if i % 2 else ["cs.CV"]) for i in range(30)]
    df = spark.createDataFrame(rows, "source string, id string, title string, summary string, categories array<string>")
    assert papers.search_papers(df, "deep NETS").count() == 8
    assert papers.search_papers(df, '"deep" nets', limit=99).count() == 25
    assert papers.search_papers(df, "nets deep").count() == 0
    assert papers.search_papers(df, "things of deep nets learning", category="cs.LG", limit=25).count() == 15
    assert papers.search_papers(df, "  ").count() == papers.search_papers(df, "deep", source="web").count() == 0


def test_rounds_of_paper_searches_give_the_plain_result(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices("abcdefg", [9, 7, 5, 3, 2, 1, 1], k=rng.randint(0, 12))) for _ in range(300)]
    rows = [("arxiv", str(i) if i else None, t, texts[-i], None) for i, t in enumerate(texts)]
    asked = [(q, " ".join(rng.choices("abcdefgh", [9, 7, 5, 3, 2, 1, 1, 1], k=rng.randint(1, 7)))) for q in range(60)]
    df = spark.createDataFrame(rows, "source string, id string, title string, summary string, authors array<string>")
    queries = spark.createDataFrame(asked, "query_id int, query string")

    def found(words, *fields):
        if 1 < len(words) <= 4:
            return any(f" {' '.join(words)} " in f" {f} " for f in fields)
        return all(any(w in f.split() for f in fields) for w in words)

    want = []
    for q, text in asked:
        words = text.split()
        ids = sorted(r[1] for r in rows if r[1] and found(words, r[2], r[3]))
        ids = ([None] if len(set(words)) == 1 and len(words) not in (2, 3, 4) and found(words, *rows[0][2:4]) else []) + ids
        want += [(q, rank, i) for rank, i in enumerate(ids[:5], 1)]
    postings = papers.paper_postings(df)
    for most in (10**6, 10):
        got = papers.search_papers_many(postings, queries, 5, round_papers=most).collect()
        assert sorted(map(tuple, got), key=lambda r: r[:2]) == want


def test_frequent_phrases_do_not_meet_all_papers(spark, monkeypatch):
    """20 queries that each of 30,000 papers matches: 600,000 pairs, of which 500 are wanted."""
    df = spark.range(30_000).select(
        F.lit("arxiv").alias("source"), F.format_string("%05d", "id").alias("id"), F.lit("the and of").alias("title"), F.lit("it").alias("summary")
    )
    queries = spark.range(20).select(F.col("id").alias("query_id"), F.lit("the and of").alias("query"))
    made = []
    plain = papers.cut_lineage

    def seen(df):
        out = plain(df)
        if "id" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(papers, "cut_lineage", seen)
    got = papers.search_papers_many(papers.paper_postings(df), queries, 25).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in got) == [(q, i + 1, f"{i:05d}") for q in range(20) for i in range(25)]
    assert 0 < sum(made) < 60_000


def test_words_are_counted_where_they_are_read(spark, tmp_path):
    """No shuffle of counts for unique ids; repeated and null ids add up; the postings need no join with their terms."""
    docs = [(1, "A b a, é!"), (2, None), (3, " ,; "), (None, "x x"), (4, "b" * 30)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    want = {(1, "", 1, 4), (1, "a", 2, 4), (1, "b", 1, 4), (1, "é", 1, 4), (2, "", 1, 0), (3, "", 1, 0), (None, "", 1, 2), (None, "x", 2, 2), (4, "", 1, 1), (4, "b" * 30, 1, 1)}
    counts = search._counted(df, "doc_id", "text")
    assert set(map(tuple, counts.collect())) == want and counts.count() == len(want)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    twice = search._counted(df.unionByName(df), "doc_id", "text")
    assert set(map(tuple, twice.collect())) == {(i, t, 2 * n, dl) for i, t, n, dl in want}
    index = search.SearchIndex.write(df, str(tmp_path / "index"))
    assert spark.read.parquet(f"{index.path}/postings").count() == 5


def test_a_search_keeps_its_counts_once(spark, monkeypatch):
    """The postings follow from the stored counts: no second copy of them is written."""
    kept = []
    plain = search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df: (kept.append(set(df.columns)), plain(df))[1])
    docs = spark.createDataFrame([(i, f"a b{i % 3}") for i in range(9)], "doc_id int, text string")
    search.search_corpus(spark.createDataFrame([(1, "b1 a")], "query_id int, query string"), docs, 2).collect()
    assert sum({"doc_id", "term"} <= columns for columns in kept) == 1


def test_paper_searches_match_where_papers_are_read(spark, monkeypatch):
    """A row for each paper, queries in several blocks, repeated and missing ids, words of any length; the plain result."""
    rng = random.Random(5)
    words = ["a", "b", "c", "d", "é1", "long" * 9, "zz"]
    text = lambda k: " ".join(rng.choices(words, [9, 7, 5, 3, 2, 1, 1], k=k))
    rows = [("arxiv", None if i % 40 == 7 else f"{i % 90:03d}", text(rng.randint(0, 30)), text(rng.randint(0, 9)) if i % 5 else None) for i in range(200)]
    rows += [("crossref", "000", "a b c d", "zz")]
    asked = [(q, text(rng.randint(0, 9))) for q in range(150)] + [(149, "a"), (150, "a nowhere"), (151, "a b c d nowhere"), (152, "é1, LONG" + "long" * 8)]
    df = spark.createDataFrame(rows, "source string, id string, title string, summary string")
    queries = spark.createDataFrame(asked, "query_id int, query string")
    by_id = {}
    for kind, i, *fields in rows:
        if kind == "arxiv":
            by_id.setdefault(i, []).append([f or "" for f in fields])

    def matches(query):
        w = query.lower().replace(",", "").split()
        for i, papers_of in by_id.items():
            fields = [f for x in papers_of for f in x]
            held = {t for f in fields for t in f.split()}
            if 1 < len(w) <= 4:
                if i is not None and any(f" {' '.join(w)} " in f" {f} " for f in fields):
                    yield i
            elif w and set(w) <= held and (i is not None or len(set(w)) == 1):
                yield i

    want = []
    for q, query in asked:
        if q != 149:  # not unique
            ids = sorted(matches(query), key=lambda i: (i is not None, i))
            want += [(q, rank, i) for rank, i in enumerate(ids[:25], 1)]
    postings = papers.paper_postings(df)
    assert postings.count() == len(rows)  # not one row for each place
    for block, pairs, most in ((500_000, 1 << 21, 10**6), (40, 50, 10)):
        monkeypatch.setattr(papers, "ASKED_ROWS", block)
        monkeypatch.setattr(papers, "MATCH_PAIRS", pairs)
        got = papers.search_papers_many(postings, queries, 25, round_papers=most).collect()
        assert sorted(map(tuple, got), key=lambda r: r[:2]) == want


def test_many_paper_searches_go_to_the_papers(spark):
    """Matching sees whole rows: no table of places is shuffled, however many queries there are."""
    asked = pa.table({"query_id": [1, 2, 3, 4], "phrase": [True, True, False, False], "words": [["a", "b"], ["a", "b", "a", "c"], ["c", "a"], ["x"]]})
    ids, fields = pa.array(["1", "2", None, "4"]), pa.array([["a b a c", ""], ["a c", "b"], ["x a b"], []])
    kind = np.array([3, 3, 3, 3])
    got = papers._match(papers._Asked(asked), ids, fields, kind)
    assert sorted(zip(*(c.to_pylist() for c in got)), key=str) == [(1, "1"), (2, "1"), (3, "1"), (3, "2"), (4, None)]
    lists_only = papers._match(papers._Asked(asked), ids, fields, np.array([2, 1, 1, 1]))
    assert sorted(zip(*(c.to_pylist() for c in lists_only)), key=str) == [(3, "1")]
    nobody = papers._match(papers._Asked(asked.slice(0, 0)), ids, fields, kind)
    assert len(nobody[0]) == 0
