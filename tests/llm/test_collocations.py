import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import collocations

PIECE, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=30, top=2000, held=80):
    """All n-grams in dictionaries; rows are (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            total[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + k] for q, b in able.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= held * f[q[i : i + k]]}
        best = []
        for p, a in able.items():
            if p not in gone:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def got(docs, **more):
    return sorted(tuple(r) for r in collocations.collocations(docs, **more).collect())


@pytest.mark.parametrize("least", [30, 4])
def test_whole_table(documents, least):
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    want = brute(rows, least)
    assert len(want) > 20
    assert got(documents, min_count=least) == want


def test_pieces_cuts_and_holders(make):
    said = [
        ("en", "New  York\tCity, new york city. NEW YORK? city " * 6), ("en", "york new york new york new\n" * 5), ("de", "a b c d e " * 9),
        (None, "über den wolken\rüber den wolken!" * 4), ("und", "über den wolken " * 3), ("en", "x x x x x x x x"), ("", "lone pair;" * 5),
    ]
    rows = [(k, text, lang) for k, (lang, text) in enumerate(said)]
    for more in ({"min_count": 3}, {"min_count": 3, "top": 2}, {"min_count": 5, "held_percent": 100}):
        keys = {"min_count": "least", "top": "top", "held_percent": "held"}
        assert got(make(rows, extra=True), **more) == brute([(x, t) for _, t, x in rows], **{keys[k]: v for k, v in more.items()})


def test_chunks_split_at_pieces_only(make, monkeypatch, documents):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 1000)
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").limit(60).collect()]
    rows.append(("en", "one two three four " * 200))
    made = make([(k, t, x) for k, (x, t) in enumerate(rows)])
    assert got(made, min_count=5) == brute(rows, 5)


def test_odd_rows(odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert got(odd, min_count=1, top=50) == brute(rows, 1, 50)
    assert got(nothing) == []


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(3)
    for capacity in (5, 40, 400):
        keys = rng.zipf(1.3, 20_000) % 3000
        truth = Counter(keys.tolist())
        least = len(keys) // capacity + 1
        halves = [collocations.MisraGries(capacity) for _ in range(2)]
        for at in range(0, len(keys), 500):
            k, n = np.unique(keys[at : at + 500], return_counts=True)
            halves[at // 500 % 2].add(k, n)
        whole = halves[0]
        halves[1].settle()
        whole.add(halves[1].keys, halves[1].counts)
        whole.lost += halves[1].lost
        kept = set(whole.at_least(least).tolist())
        assert len(whole.keys) <= capacity
        assert {k for k, n in truth.items() if n >= least} <= kept
        assert whole.lost < least


def test_a_full_bitmap_changes_nothing(documents, monkeypatch):
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    monkeypatch.setattr(collocations.Survivors, "have", lambda self, h: np.ones(len(h), dtype=bool))
    assert got(documents) == brute(rows)
