import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import linededup


def lines_left(rows, least=linededup.MIN_BLOCK_WORDS):
    """Text of every document without its blocks in any earlier one, by aligning all pairs."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    hashed = []
    for doc_id, text in ordered:
        h, w = linededup.line_hashes(text)
        at = np.flatnonzero(w > 0)
        hashed.append((h[at].tolist(), w[at].tolist(), at.tolist()))
    out = {}
    for k, (doc_id, text) in enumerate(ordered):
        h, w, at = hashed[k]
        gone = set()
        for other in range(k):
            for a, b in linededup.common_blocks(hashed[other][0], h, w, least) if set(h) & set(hashed[other][0]) else ():
                gone.update(at[a:b])
        out[doc_id] = text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_against_all_pairs(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(documents).collect()}
    assert got == lines_left(rows)


def passage(tag, n=25):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_passages_go_from_later_documents_only(make):
    p, q = passage("p"), "\n".join(passage(f"q{j}", 12) for j in range(3))
    rows = [(1, f"first\n{p}\nend"), (2, f"two\n\n{q}\nx"), (3, f"{p}\nmine {passage('m')}\n{q}"), (4, passage("clean"))]
    left = {r.doc_id: (r.text, r.n_removed_lines) for r in linededup.dedup_lines(make(rows)).collect()}
    assert left[1] == (rows[0][1], 0) and left[2] == (rows[1][1], 0) and left[4] == (rows[3][1], 0)
    assert left[3] == ("mine " + passage("m"), 4)


def test_a_passage_that_very_many_share(make):
    """Far above the limit of rare lines: found by its runs."""
    p = "\n".join(passage(f"c{j}", 9) for j in range(4))
    rows = [(k, f"own {passage(f'o{k}', 6)}\n{p}") for k in range(60)]
    left = {r.doc_id: r.n_removed_lines for r in linededup.dedup_lines(make(rows), rare=4).collect()}
    assert left == {k: 4 if k else 0 for k in range(60)}


def test_short_common_lines_stay(make):
    rows = [(k, f"All rights reserved here.\n{passage(f'o{k}')}") for k in range(5)]
    assert linededup.dedup_lines(make(rows)).filter("n_removed_lines > 0").count() == 0


def test_odd_rows(odd, nothing):
    out = linededup.dedup_lines(odd)
    assert set(odd.columns) - {"_row", "_gone"} <= set(out.columns)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in out.collect()), key=repr)
    assert got == sorted(((r.doc_id, r.text, (r.text or "").count("\n") + 1, 0) for r in odd.collect()), key=repr)
    assert linededup.dedup_lines(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=25), st.lists(st.integers(0, 9), max_size=25))
def test_patience_is_an_alignment(a, b):
    pairs = linededup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.data())
def test_runs_cover_every_shared_block(words, data):
    """Each line of a block with enough words lies in a run that the block alone has as well."""
    n = len(words)
    h = np.array([hash((i, w)) & (1 << 63) - 1 for i, w in enumerate(words)], dtype=np.uint64)
    w = np.array(words)
    a = data.draw(st.integers(0, n - 1))
    b = data.draw(st.integers(a + 1, n))
    if sum(words[a:b]) < 20:
        return
    keys = set(linededup.run_keys(h, w, 20).tolist())
    inside = set(linededup.run_keys(h[a:b], w[a:b], 20).tolist())
    assert inside and inside <= keys | inside and len(inside & keys) >= 1


def contained(a, b, words, least):
    """Lines of ``b`` in any stretch of ``least`` words that stands in ``a`` as it is, by looking at every stretch."""
    gone = set()
    for start in range(len(b)):
        for end in range(start + 1, len(b) + 1):
            if sum(words[start:end]) >= least and any(a[i : i + end - start] == b[start:end] for i in range(len(a))):
                gone.update(range(start, end))
    return gone


def test_blocks_that_recur_or_cross(make):
    p, q = ("\n".join(passage(f"{tag}{j}", 8) for j in range(4)) for tag in "pq")
    own = {k: passage(k, 5) for k in "stuvwxyz"}
    rows = [
        (1, f"{own['s']}\n{p}\n{own['t']}\n{q}"),
        (2, f"{own['u']}\n{p}\n{own['v']}\n{p}\n{own['w']}"),
        (3, f"{q}\n{own['x']}\n{p}\n{own['y']}\n{q}\n{own['z']}\n{q}"),
    ]
    left = {r.doc_id: r.text for r in linededup.dedup_lines(make(rows)).collect()}
    assert left == {1: rows[0][1], 2: "\n".join(own[k] for k in "uvw"), 3: "\n".join(own[k] for k in "xyz")}
    # the first holder has it twice
    rows = [(1, f"{p}\n{own['s']}\n{p}"), (2, f"{own['u']}\n{p}\n{own['v']}")]
    left = {r.doc_id: r.text for r in linededup.dedup_lines(make(rows)).collect()}
    assert left == {1: rows[0][1], 2: f"{own['u']}\n{own['v']}"}


def test_against_every_stretch_of_earlier_documents(documents):
    docs = documents.filter("doc_id % 2 = 0 AND n_chars < 6000")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs, least=8).collect()}
    hashed = []
    for doc_id, text in rows:
        h, w = linededup.line_hashes(text)
        at = np.flatnonzero(w > 0).tolist()
        b, words = h[at].tolist(), w[at].tolist()
        gone = {at[j] for a in hashed if set(a) & set(b) for j in contained(a, b, words, 8)}
        assert got[doc_id] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        hashed.append(b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=20), st.lists(st.integers(0, 5), max_size=20))
def test_no_shared_stretch_stays(a, b):
    words = [3 + x for x in b]
    gone = {j for start, end in linededup.common_blocks(a, b, words, 12) for j in range(start, end)}
    assert gone == contained(a, b, words, 12)
