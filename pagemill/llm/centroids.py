"""Centroid clustering of integer vectors with an n-simplex filter before the exact comparison.

The distances of a vector to a few pivots are taken once. They place it as the apex over the simplex of the
pivots: its coordinates in the space the pivots span and, last, its height above that space. Of two apexes
the plain Euclidean distance is never above the true distance, and the distance with one height turned
round never below it. A centroid whose lower bound exceeds the least upper bound of a vector cannot be its
nearest one, nor can one whose lower bound exceeds the distance to the most promising centroid; the rest are
compared exactly, in integers.

Vectors stay where they are. A round sends the centroids and their apexes to the tasks and brings sums per
cluster, component and digit back: both grow with clusters times components, not with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import finite_vectors

COMPONENTS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = "2"
#: Most pivots of the simplex, chosen among the first centroids.
PIVOTS = CLUSTERS
#: Rows that are compared at a time.
BLOCK = 1024
#: Components below this size keep squared distances of 64 components inside 64 bits.
SMALL = 1 << 27
#: Sums travel as digits of so many bits, so that they stay exact whatever the components are.
DIGIT_BITS = 24
#: Slack of the bounds, as a share of the squared lengths: rounding only ever lets more centroids through.
SLACK = 1e-6


def scaled_components(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) for every component, as whole doubles (exact: the scale is a power of two)."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), np.finfo(np.float64).min, np.finfo(np.float64).max)


def exact(whole: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: of 64 bits where squares fit, of any size otherwise."""
    if not whole.size or np.abs(whole).max() < SMALL:
        return whole.astype(np.int64)
    return np.array([int(x) for x in whole.ravel()], dtype=object).reshape(whole.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to those of ``b``, pair by pair."""
    if a.dtype != b.dtype:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(axis=-1)


class Simplex:
    """Pivots in general position and the coordinates of their simplex, a lower triangle."""

    def __init__(self, points: Sequence[Sequence[int]], most: int = PIVOTS):
        pivots = np.array(points, dtype=np.float64)
        self.unit = max(1.0, float(np.abs(pivots).max())) if pivots.size else 1.0
        pivots /= self.unit
        self.pivots, self.base = pivots[:1], np.zeros((1, 0))
        while len(self.pivots) < min(most, len(points)):
            height = self.apex(pivots)[:, -1]
            far = int(height.argmax())  # the point that stands highest over the simplex so far
            if height[far] <= 1e-3:
                break
            row = self.apex(pivots[far : far + 1])[0]
            self.base = np.vstack([np.hstack([self.base, np.zeros((len(self.base), 1))]), row])
            self.pivots = np.vstack([self.pivots, pivots[far]])

    def apex(self, vectors: np.ndarray) -> np.ndarray:
        """Apex coordinates from the distances to the pivots; the last one is the height."""
        gap = ((vectors[:, None, :] - self.pivots[None, :, :]) ** 2).sum(axis=2)
        n = len(self.pivots)
        side = (gap[:, :1] - gap[:, 1:] + (self.base[1:] ** 2).sum(axis=1)) / 2
        inner = np.linalg.solve(self.base[1:, : n - 1], side.T).T if n > 1 else np.zeros((len(vectors), 0))
        height = np.sqrt(np.maximum(gap[:, 0] - (inner**2).sum(axis=1), 0.0))
        return np.hstack([inner, height[:, None]])


def bounds(apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of vectors (rows) and centroids (columns), with SLACK."""
    inner = ((apexes[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(axis=2)
    high, low = apexes[:, None, -1], centres[None, :, -1]
    slack = SLACK * ((apexes**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :])
    return inner + (high - low) ** 2 - slack, inner + (high + low) ** 2 + slack


def candidates(whole: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray, unit: float) -> np.ndarray:
    """Which centroids (columns) may be nearest to which vectors (rows).

    The one whose bounds promise most is measured exactly; it and the least upper bound say what a lower bound may reach.
    """
    lower, upper = bounds(apexes, centres)
    guess = (lower + upper).argmin(axis=1)
    measured = squared(whole, centroids[guess]).astype(np.float64) / unit**2
    limit = np.minimum(measured * (1 + SLACK), upper.min(axis=1))
    may = lower <= limit[:, None]
    may[np.arange(len(whole)), guess] = True
    return may


def nearest(
    whole: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray, unit: float
) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid of every row; ties go to the smaller number."""
    cluster, distance = np.zeros(len(whole), dtype=np.int32), np.zeros(len(whole), dtype=object)
    for at in range(0, len(whole), BLOCK):
        part = exact(whole[at : at + BLOCK])
        row, number = np.nonzero(candidates(part, apexes[at : at + BLOCK], centroids, centres, unit))
        gap = squared(part[row], centroids[number])
        order = np.lexsort((number, gap, row)) if gap.dtype != object else np.array(
            sorted(range(len(row)), key=lambda k: (row[k], gap[k], number[k]))
        )
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        cluster[at : at + BLOCK] = number[first]
        distance[at : at + BLOCK] = gap[first]
    return cluster, distance


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _digits(total: int) -> list[int]:
    """Signed digits of DIGIT_BITS bits, the lowest first."""
    sign, left, out = (-1 if total < 0 else 1), abs(total), []
    while left:
        out.append(sign * (left & ((1 << DIGIT_BITS) - 1)))
        left >>= DIGIT_BITS
    return out


def _cluster_sums(placed: DataFrame, centroids: np.ndarray, centres: np.ndarray, unit: float) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """Vectors of every cluster and the exact sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = scaled_components(_rows(batch, "embedding"))
            cluster, _ = nearest(whole, _rows(batch, "apex"), centroids, centres, unit)
            c, at, n = [], [], []
            for k in np.unique(cluster):
                mine = whole[cluster == k]
                c.append(int(k)), at.append(-1), n.append(len(mine))
                for i, total in enumerate(exact(mine).sum(axis=0)):
                    for d, digit in enumerate(_digits(int(total))):
                        c.append(int(k)), at.append(i + len(mine[0]) * d), n.append(digit)
            yield pa.RecordBatch.from_pydict(
                {"cluster": pa.array(c, pa.int32()), "at": pa.array(at, pa.int32()), "n": pa.array(n, pa.int64())}
            )

    rows = placed.mapInArrow(run, "cluster int, at int, n long").groupBy("cluster", "at").agg(F.sum("n").alias("n")).collect()
    counts, sums, width = {}, {}, centroids.shape[1]
    for cluster, at, n in rows:
        if at < 0:
            counts[cluster] = n
        else:
            total = sums.setdefault(cluster, np.zeros(width, dtype=object))
            total[at % width] += n << DIGIT_BITS * (at // width)
    return counts, sums


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: str = SEED, pivots: int = PIVOTS
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that can be clustered.

    Those are the rows whose ``embedding`` has exactly ``components`` components, none of them null, NaN or
    infinite; components become floor(256 * x). The first centroids are the vectors with the smallest hash of
    seed and vec_id (a null id hashes as an empty one; equal hashes in the order of their components); with
    fewer vectors than ``clusters`` there are as many clusters as vectors. Equal rows are vectors of their own
    and get equal results; empty clusters keep their centroid; an empty table gives an empty result. A
    squared distance or a sum of them that no long can hold is null. Only vec_id and embedding are read.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    usable = finite_vectors(vectors.select("vec_id", "embedding")).filter(F.size("embedding") == components)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = usable.select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(clusters).collect()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return vectors.sparkSession.createDataFrame([], schema)
    whole = scaled_components(np.array([r["embedding"] for r in seeds], dtype=np.float64))
    centroids = exact(whole)
    simplex = Simplex(whole.tolist(), pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = [simplex.apex(part / simplex.unit) for part in np.array_split(scaled_components(_rows(batch, "embedding")), 1 + len(batch) // BLOCK)]
            apex = pa.array(list(np.vstack(apexes)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, apex], names=["vec_id", "embedding", "apex"])

    element = dict(usable.dtypes)["embedding"]
    placed = cut_lineage(usable.mapInArrow(place, f"vec_id {kind}, embedding {element}, apex array<double>"))

    def centres() -> np.ndarray:
        return simplex.apex(centroids.astype(np.float64) / simplex.unit)

    for _ in range(rounds):
        counts, sums = _cluster_sums(placed, centroids, centres(), simplex.unit)
        moved = [[int(s) // counts[k] for s in sums.get(k, [0] * components)] if k in counts else list(map(int, c)) for k, c in enumerate(centroids)]
        centroids = np.array(moved, dtype=object)
        if max(abs(x) for c in moved for x in c) < SMALL:
            centroids = centroids.astype(np.int64)
    last, tops = centroids, centres()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(scaled_components(_rows(batch, "embedding")), _rows(batch, "apex"), last, tops, simplex.unit)
            fits = [int(d) if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = cut_lineage(placed.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    # one row per cluster; a sum with a distance that did not fit does not fit either
    known = F.count("distance") == F.count(F.lit(1))
    total = F.when(known, F.sum(F.col("distance").cast("decimal(38,0)")))
    per = assigned.groupBy(F.col("cluster").alias("_k")).agg(total.alias("_sum")).collect()
    every = None if any(r["_sum"] is None for r in per) else sum(int(r["_sum"]) for r in per)

    def as_long(n) -> int | None:
        return int(n) if n is not None and int(n) < 1 << 63 else None

    said = [(r["_k"], as_long(r["_sum"]), as_long(every), ",".join(str(int(x)) for x in last[r["_k"]])) for r in per]
    facts = vectors.sparkSession.createDataFrame(said, "_k int, cluster_inertia long, inertia long, centroid string")
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col("_k")).select(  # at most ``clusters`` rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256")
    )
