import re
from collections import defaultdict

import duckdb
import pytest

from pagemill.llm import mixing, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fair(sizes, weights=(1, 2, 3)):
    """Water filling step by step: reshare the excess until no target is above three times its source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not above:
            return target | {s: weight[s] * level for s in free}
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def check(df):
    rows = df.collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORDS.findall(r.text or ""))
        assert r.mix_size == n and r.mix_taken <= 3 * n and (n == 0 or r.mix_taken % n == 0)
        sizes[r.source] += n
        taken[r.source] += r.mix_taken
    want = fair(sizes)
    most = defaultdict(int)
    for r in rows:
        most[r.source] = max(most[r.source], r.mix_size)
        assert r.mix_source_size == sizes[r.source] and r.mix_target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s]
    return rows


def test_targets_and_words_taken(documents):
    rows = check(mixing.mix_sources(documents))
    again = {r.doc_id: r.mix_taken for r in mixing.mix_sources(documents.repartition(3)).collect()}
    assert again == {r.doc_id: r.mix_taken for r in rows}


def test_odd_rows(odd, nothing):
    out = mixing.mix_sources(odd)
    assert out.columns == [c for c in odd.columns if c != "mix_size"] + ["mix_size", "mix_source_size", "mix_target", "mix_taken"]
    rows = check(out)
    assert len(rows) == odd.count()
    assert len({r.mix_taken for r in rows if r.doc_id == 7}) == 1
    assert mixing.mix_sources(nothing).count() == 0


def test_flow_prefers_fresh_words():
    # b and c share a pattern; a's words alone cannot fill its quota without repeats
    supply = [(("a",), 10), (("a", "b"), 30), (("b",), 10)]
    sent = mixing.cheapest_flow(supply, {"a": 30, "b": 20})
    assert sum(x.get("a", 0) for x in sent) == 30 and sum(x.get("b", 0) for x in sent) == 20
    assert [sum(x.values()) for x in sent] == [10, 30, 10]
    # all must be repeated: evenly, none a third time
    sent = mixing.cheapest_flow(supply, {"a": 60, "b": 40})
    assert [sum(x.values()) for x in sent] == [20, 60, 20]
    # no way past three passes
    assert mixing.cheapest_flow([(("a",), 5)], {"a": 99})[0] == {"a": 15}


def test_overlapping_sources(make):
    from pyspark.sql import functions as F

    docs = make([(i, " ".join(["w"] * 5), "en", "a" if i % 2 else "b") for i in range(40)])
    both = docs.withColumn("member", F.when(F.col("doc_id") < 20, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source")))
    rows = mixing.mix_sources(both, members=F.col("member"), quotas={"a": 100, "b": 50}).collect()
    assert abs(sum(r.mix_taken for r in rows) - 150) <= 15


def test_sql_agrees(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLES["op9_mix_sources"]).select("doc_id, size, source_size, target, taken").fetchall())
    assert sorted(map(tuple, queries.op9_mix_sources(spark, small).collect())) == want


def test_many_single_sources(make, documents, monkeypatch):
    rows = [(i, " ".join(["w"] * (1 + i % 13 + (400 if i % 1000 == 0 else 0))), "en", f"host{i % 4200}") for i in range(5000)]
    check(mixing.mix_sources(make([*rows, (9000, "no source here", "en", None)])))
    quotas = {r.source: 700 for r in documents.select("source").distinct().collect()}
    want = [sorted(map(tuple, mixing.mix_sources(documents, **k).collect())) for k in ({}, {"quotas": quotas})]
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", 3)
    assert [sorted(map(tuple, mixing.mix_sources(documents, **k).collect())) for k in ({}, {"quotas": quotas})] == want


def test_ten_thousand_overlapping_patterns(spark):
    """Each pair of sources has three patterns; its flow does not depend on the other pairs."""
    kinds = [lambda k: [f"a{k}"], lambda k: [f"a{k}", f"b{k}"], lambda k: [f"b{k}"]]
    rows = [(3 * k + j, "w " * (2 + j), kinds[j](k)) for k in range(3400) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, member array<string>")
    quotas = {f"{x}{k}": n for k in range(3400) for x, n in (("a", 4), ("b", 5))}
    taken = {r.doc_id: r.mix_taken for r in mixing.mix_sources(docs, members=docs["member"], quotas=quotas).select("doc_id", "mix_taken").collect()}
    assert len(taken) == 10_200
    # nine words are wanted of nine there are: everything once
    assert all(taken[i] == 2 + i % 3 for i in taken)


def brute_flow(supply, quotas, repeats=3):
    """Most words, then least cost, over all ways to send them."""
    import itertools

    slots = [(i, s) for i, (held, _) in enumerate(supply) for s in held if s in quotas]
    best = (0, 0)
    for sent in itertools.product(*(range(min(repeats * supply[i][1], quotas[s]) + 1) for i, s in slots)):
        per, got = [0] * len(supply), defaultdict(int)
        for (i, s), n in zip(slots, sent):
            per[i] += n
            got[s] += n
        if all(got[s] <= quotas[s] for s in got) and all(p <= repeats * n for p, (_, n) in zip(per, supply)):
            cost = sum((w // n) ** 2 for p, (_, n) in zip(per, supply) for w in range(p)) if all(n for _, n in supply) else 0
            best = max(best, (sum(per), -cost))
    return best


def test_flow_is_the_cheapest():
    import random

    rng = random.Random(2)
    for _ in range(60):
        supply = [(tuple(sorted(rng.sample("abc", rng.randint(1, 2)))), rng.randint(1, 2)) for _ in range(3)]
        quotas = {s: rng.randint(0, 5) for s in "abc"}
        sent = mixing.cheapest_flow(supply, quotas)
        per = [sum(x.values()) for x in sent]
        cost = sum((w // n) ** 2 for p, (_, n) in zip(per, supply) for w in range(p))
        assert (sum(per), -cost) == brute_flow(supply, quotas)
