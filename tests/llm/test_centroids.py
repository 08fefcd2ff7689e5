import hashlib
import math

import numpy as np
import pytest

from pagemill.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, clusters=40, rounds=5, components=64):
    """Plain integers all the way; rows are (vec_id, vector)."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    hashed = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in hashed[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)))
        return out

    for _ in range(rounds):
        mine = assign()
        for k in range(len(centres)):
            held = [v for (_, v), (_, c) in zip(kept, mine) if c == k]
            if held:
                centres[k] = [sum(col) // len(held) for col in zip(*held)]
    mine = assign()
    per = {k: sum(d for d, c in mine if c == k) for k in range(len(centres))}
    total = sum(d for d, _ in mine)
    fit = lambda n: n if n < 1 << 63 else None
    short = {k: all(d < 1 << 63 for d, c in mine if c == k) for k in per}
    return sorted(
        (
            (i, k, fit(d), fit(per[k]) if short[k] else None, fit(total) if all(short.values()) else None,
             hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest())
            for (i, _), (d, k) in zip(kept, mine)
        ),
        key=repr,
    )


def got(df, **more):
    return sorted((tuple(r) for r in centroids.cluster_vectors(df, **more).collect()), key=repr)


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    assert got(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("pivots", [1, 3, 16, 60])
def test_clustered_vectors(spark, pivots):
    rng = np.random.default_rng(pivots)
    middle = rng.normal(size=(12, 64)) * 2
    rows = [(i, (middle[i % 12] + rng.normal(size=64) * 0.3).tolist(), 0) for i in range(400)]
    assert got(spark.createDataFrame(rows, SCHEMA), pivots=pivots, clusters=15) == brute(rows_of(rows), 15)


def rows_of(rows):
    return [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]]) for r in rows]


def test_ties_copies_and_huge_components(spark):
    e = [0.0] * 63
    rows = [(i, [float(i % 3), *e], 0) for i in range(60)] + [(100 + i, [(-1.0) ** i * 3e37, *e], 0) for i in range(6)]
    rows += [(200 + i, [(-1.0) ** i * 4e6, 1e-3, *e[1:]], 0) for i in range(6)]
    assert got(spark.createDataFrame(rows, SCHEMA), clusters=8) == brute(rows_of(rows), 8)


def test_odd_rows(spark):
    e = [0.5] * 64
    rows = [
        (1, None, 0), (2, [], 0), (3, e[1:], 0), (4, [None, *e[1:]], 0), (5, [float("nan"), *e[1:]], 0), (6, [float("-inf"), *e[1:]], 0),
        (7, e, 0), (7, e, 0), (7, [-0.001, *e[1:]], 0), (None, e, None), (None, [0.0] * 64, 1),
    ]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", apex string, cluster int, key int")
    assert got(df) == brute(rows_of(rows))
    assert got(df.limit(0)) == [] and got(df.filter("vec_id < 7")) == []


def test_bounds_hold_the_distance_between_them():
    rng = np.random.default_rng(1)
    points = rng.integers(-500, 500, size=(300, 64)).astype(float)
    simplex = centroids.Simplex(points[:40].tolist(), 10)
    assert len(simplex.pivots) == 10
    x, y = (simplex.apex(p / simplex.unit) for p in (points[:150], points[150:]))
    true = np.linalg.norm(points[:150] - points[150:], axis=1) / simplex.unit
    lower = np.linalg.norm(x - y, axis=1)
    turned = y * np.array([1.0] * 9 + [-1.0])
    assert (lower <= true + 1e-9).all() and (true <= np.linalg.norm(x - turned, axis=1) + 1e-9).all()
    may = centroids.candidates(points[:150].astype(np.int64), x, points[150:].astype(np.int64), y, simplex.unit)
    gaps = np.linalg.norm(points[:150, None] - points[None, 150:], axis=2)
    assert may[np.arange(150), gaps.argmin(axis=1)].all()


def test_the_filter_leaves_few_of_well_parted_centroids():
    rng = np.random.default_rng(2)
    middle = np.floor(rng.normal(size=(40, 64)) * 1000)
    simplex = centroids.Simplex(middle.tolist())
    near = np.floor(middle[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 64)) * 100)
    x, y = (simplex.apex(p / simplex.unit) for p in (near, middle))
    assert centroids.candidates(near.astype(np.int64), x, middle.astype(np.int64), y, simplex.unit).sum(axis=1).mean() < 1.5
