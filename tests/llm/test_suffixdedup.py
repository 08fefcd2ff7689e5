import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import suffixdedup


def brute(rows, length):
    seen = Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone, kept, runs, last = 0, bytearray(), 0, -1
        for p in range(len(b)):
            if p + length <= len(b) and seen[b[p : p + length]] > 1:
                if p >= last:
                    runs += p > last or not runs
                last = p + length
            if p < last:
                gone += 1
            else:
                kept.append(b[p])
        out.append((doc_id, len(b), gone, runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("length,anchor,large", [(200, 56, 50_000), (200, 56, 1), (40, 12, 50_000), (40, 12, 2)])
def test_against_brute_force(documents, length, anchor, large):
    rows = [(r.doc_id, r.text[:4000]) for r in documents.limit(120).collect()]
    docs = documents.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixdedup.remove_repeats(docs, length, anchor, large)) == brute(rows, length)


def test_periods_copies_and_ends(make):
    p = "".join(chr(97 + i * 7 % 26) for i in range(230)) + "é"
    rows = [(1, "a" * 450), (2, "xy" * 300 + p), (3, p), (4, p), (5, "q" + p[:199]), (6, "ab" * 99), (7, p[31:] + "end"), (8, "-" * 199)]
    assert got(suffixdedup.remove_repeats(make(rows))) == brute(rows, 200)


def test_chunks_meet(make, monkeypatch):
    rows = [(1, "".join(f"{i * i:x}," for i in range(3000))), (2, "z" + "".join(f"{i * i:x}," for i in range(700, 1500)) + "b" * 700)]
    monkeypatch.setattr(suffixdedup, "CHUNK", 512)
    import numpy as np

    small = [suffixdedup.anchors_of(t.encode()) for _, t in rows]
    monkeypatch.undo()
    for a, (_, t) in zip(small, rows):
        assert all(np.array_equal(x, y) for x, y in zip(a, suffixdedup.anchors_of(t.encode())))
    assert got(suffixdedup.remove_repeats(make(rows))) == brute(rows, 200)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    short = [(i, t if t is None or len(t) < 5000 else None) for i, t in rows]
    docs = odd.sparkSession.createDataFrame(short, "doc_id long, text string")
    assert got(suffixdedup.remove_repeats(docs)) == brute(short, 200)
    assert suffixdedup.remove_repeats(odd).count() == len(rows)
    assert suffixdedup.remove_repeats(nothing).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12))
def test_interval_tree(prefixes):
    n = len(prefixes) + 1
    want = set()
    for a in range(n):
        for b in range(a + 2, n + 1):
            low = min(prefixes[a : b - 1])
            if (a == 0 or prefixes[a - 1] < low) and (b == n or prefixes[b - 1] < low):
                want.add((low, a, b))
    found = list(suffixdedup.interval_tree(prefixes))
    assert want <= set(found)
    assert {(a, b) for _, a, b in found} == {(a, b) for _, a, b in want} | {(0, n)}
