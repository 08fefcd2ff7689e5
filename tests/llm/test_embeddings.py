import math

import numpy as np
import pytest
from pagemill.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(vec_id, n_links, component_id, kept) from all pairs; rows are (vec_id, vector, label)."""
    able = [
        None if v is None or label is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, dtype=float)
        for _, v, label in rows
    ]
    n = len(rows)
    near = np.zeros((n, n), dtype=bool)
    for label in {r[2] for r in rows}:
        for size in {len(v) for v in able if v is not None}:
            at = [i for i in range(n) if rows[i][2] == label and able[i] is not None and len(able[i]) == size]
            if at:
                m = np.stack([able[i] / np.linalg.norm(able[i]) for i in at])
                near[np.ix_(at, at)] = m @ m.T >= 0.98
    np.fill_diagonal(near, False)
    name = [math.inf if r[0] is None else r[0] for r in rows]
    while True:
        new = [min([name[i], *(name[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
        if new == name:
            break
        name = new
    name = [None if x == math.inf else x for x in name]
    return sorted(((r[0], int(near[i].sum()), name[i], name[i] == r[0]) for i, r in enumerate(rows)), key=repr)


def got(spark, rows, schema=SCHEMA, **more):
    df = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in embeddings.link_vectors(df, **more).collect()), key=repr)


def groups(rng, sizes, width=64, spread=0.012):
    """Near copies round random centres, mostly linked inside a group, and loose vectors."""
    rows = []
    for k, size in enumerate(sizes):
        centre = rng.normal(size=width)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((len(rows), (centre + rng.normal(size=width) * spread).tolist(), k % 2))
    rows += [(len(rows) + i, rng.normal(size=width).tolist(), i % 2) for i in range(150)]
    return rows


@pytest.mark.parametrize("block", [embeddings.BLOCK, 16])
def test_groups_against_all_pairs(spark, block):
    rows = groups(np.random.default_rng(5), (70, 25, 8, 3, 2, 2, 2), spread=0.008)
    assert got(spark, rows, block=block) == brute(rows)


def test_recall_near_the_bound(spark):
    rows = groups(np.random.default_rng(6), [2] * 300 + [60], spread=0.0175)
    want, have = brute(rows), got(spark, rows)
    links = sum(r[1] for r in want)
    assert 300 < links
    assert sum(r[1] for r in have) >= 0.98 * links
    assert all(h[1] <= w[1] for h, w in zip(sorted(have, key=lambda r: r[0]), sorted(want, key=lambda r: r[0])))


def test_table_against_all_pairs(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted((tuple(r) for r in embeddings.link_vectors(df).collect()), key=repr) == brute(rows)


def test_odd_rows(spark):
    e = [0.0] * 64
    one, two = [1.0, *e[1:]], [0.0, 1.0, *e[2:]]
    rows = [
        (1, None, 1), (2, [], 1), (3, e, 1), (4, [None, *one[1:]], 1), (5, [float("nan"), *one[1:]], 1), (6, [float("inf"), *one[1:]], 1),
        (7, one, None), (8, one, None), (9, one, 1), (10, one, 1), (11, [3.0, *e[1:]], 1), (11, [3.0, *e[1:]], 1), (12, two, 1), (13, one, 2),
        (None, one, 2), (None, two, 2), (14, [1.0, 0.0], 1), (15, [2.0, 0.1], 1), (16, [-1.0, *e[1:]], 1), (17, [1e-30, *e[1:]], 1), (18, [1e38] * 64, 3), (19, [2e38] * 64, 3),
    ]
    assert got(spark, rows) == brute(rows)
    wide = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", node long, h1 string, n int")
    assert sorted((tuple(r) for r in embeddings.link_vectors(wide).collect()), key=repr) == brute(rows)
    assert got(spark, []) == []


def test_other_widths_and_types(spark):
    rng = np.random.default_rng(8)
    rows = groups(rng, (5, 3), width=100, spread=0.004) + [(1000 + r[0], r[1], r[2]) for r in groups(rng, (6, 2), width=8, spread=0.01)]
    schema = "vec_id int, embedding array<double>, label string"
    rows = [(a, b, str(c)) for a, b, c in rows]
    assert got(spark, rows, schema) == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    codes = embeddings.Codes(64, 8, 8)
    rng = np.random.default_rng(9)
    a = rng.normal(size=(4000, 64))
    b = a + rng.normal(size=(4000, 64)) * 0.2
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    read = [codes.decode(codes.encode(x)) for x in (a, b)]
    (ra, rb), (fa, fb) = [codes.readings(*x) for x in read], [x[1] for x in read]
    true = (a * b).sum(axis=1)
    est = np.array([codes.estimates(ra[i : i + 1], rb[i : i + 1])[0, 0] for i in range(4000)])
    assert abs((est - true).mean()) < 0.01
    near = true >= embeddings.MIN_COSINE
    least = np.array([codes.least_estimates(fa[i : i + 1], fb[i : i + 1])[0, 0] for i in range(4000)])
    assert near.sum() > 1000 and (est[near] >= least[near]).mean() > 0.999
    far = np.array([codes.estimates(ra[i : i + 1], rb[i - 1 : i])[0, 0] for i in range(1, 4000)])
    assert (far >= least[1:]).mean() < 0.001


def test_tables_follow_from_the_share_missed():
    assert embeddings.key_bits(10) == embeddings.LEAST_BITS
    assert embeddings.key_bits(10**9) == 19
    for bits in (8, 12, 19):
        same = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - same) ** embeddings.table_count(bits) <= embeddings.MISSED
