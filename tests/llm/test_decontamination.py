import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import decontamination as dc


def naive_coverage(item, doc, least):
    """Greedy string tiling by the definition: longest unmarked match, again and again."""
    a, b = [False] * len(item), [False] * len(doc)
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sum(a)
        a[i : i + n] = [True] * n
        b[j : j + n] = [True] * n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=3, max_size=14), st.lists(st.integers(1, 4), max_size=20))
def test_tiles(item, doc):
    seeds = [(i, np.array([j for j in range(len(doc) - 2) if item[i : i + 3] == doc[j : j + 3]], dtype=np.int64)) for i in range(len(item) - 2)]
    runs = dc.equal_runs([s for s in seeds if len(s[1])], len(item), len(doc), 3)
    for a, b, k in runs:
        assert item[a : a + k] == doc[b : b + k]
        assert a == 0 or b == 0 or item[a - 1] != doc[b - 1]
        assert a + k == len(item) or b + k == len(doc) or item[a + k] != doc[b + k]
    tiles = dc.tile(item, doc, runs, 3)
    assert sum(t[2] for t in tiles) == naive_coverage(item, doc, 3)
    assert all(item[a : a + n] == doc[b : b + n] for a, b, n in tiles)


def pairs(docs, items, **kw):
    return sorted((r.doc_id, r.item_id, r.covered_tokens, r.item_tokens) for r in dc.contaminated_pairs(docs, items, **kw).collect())


@pytest.mark.parametrize("block_chars", [8_000_000, 300])
def test_against_brute_force(spark, documents, small, block_chars):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    docs = documents.filter("length(text) < 2500")
    want = []
    for i in items.collect():
        a = dc.tokens_of(i.text)
        grams = {tuple(a[k : k + 5]) for k in range(len(a) - 4)}
        for d in docs.collect():
            b = dc.tokens_of(d.text)
            if any(tuple(b[k : k + 5]) in grams for k in range(len(b) - 4)):
                n = naive_coverage(a, b, 5)
                if n >= dc.MIN_COVERAGE * len(a):
                    want.append((d.doc_id, i.item_id, n, len(a)))
    assert want and pairs(docs, items, block_chars=block_chars) == sorted(want)


def test_reordered_changed_and_clean(spark, make):
    w = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, None), (3, ""), (4, "Only three tokens")], "item_id long, text string")
    docs = make([
        (1, "intro " + " ".join(w[40:] + ["x"] + w[20:40] + ["y"] + w[:20]) + " outro"),
        (2, " ".join(x.upper() + "," for x in w)),
        (3, " ".join(w[:20])),
        (4, " ".join(x for i in range(0, 60, 4) for x in [*w[i : i + 4], "no"])),
        (5, "say only three tokens now"), (6, "only three"), (7, "first\nOnly three tokens.\nlast"),
    ])
    assert pairs(docs, items) == [(1, 1, 60, 60), (2, 1, 60, 60), (7, 4, 3, 3)]


def test_short_items_never_match_inside_a_sentence(spark, make):
    items = spark.createDataFrame([(1, "yes"), (2, "Paris"), (3, "5")], "item_id long, text string")
    docs = make([(1, "yes, we went to Paris and 5 other towns"), (2, "Where?\nParis\nyes yes"), (3, "5"), (4, "")])
    assert pairs(docs, items) == [(2, 2, 1, 1), (3, 3, 1, 1)]


@pytest.mark.parametrize("doc", ["same " * 200_000, "a b " * 100_000, " ".join(f"x{i % 7}" for i in range(150_000))], ids=["one", "two", "seven"])
def test_repetitive_long_texts_take_linear_time(doc):
    block = dc.ItemBlock([(1, "same " * 200), (2, "a b " * 100), (3, " ".join(f"x{i % 7}" for i in range(210)))], 5)
    t0 = time.process_time()
    (found,) = block.matches(doc)
    assert found[1] == found[2] and time.process_time() - t0 < 5


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "same text here"), (2, None)], "item_id long, text string")
    assert pairs(odd, items) == [(5, 1, 3, 3), (6, 1, 3, 3)]
    assert pairs(nothing, items) == [] and pairs(odd, items.limit(0)) == []
    assert dc.contaminated_pairs(odd, items.limit(0)).columns == dc.contaminated_pairs(odd, items).columns
