"""Near-duplicate vectors by binary codes of random rotations with stored correction factors.

A vector is turned by a few independent random rotations and only the signs are kept. A code, read as a unit
vector, has inner product f with its own vector; f is stored. Turned back and divided by f, the code of one
rotation and that of another one give an inner product whose expectation is the cosine of the two vectors,
with a variance that f tells. Pairs whose estimate lies beyond the confidence bound are dropped; the
others are computed exactly, in double precision, and only those links count.

Pairs are looked for in tables keyed by a few bits of the codes. Bits grow with the logarithm of the rows,
the number of tables follows from the share of links that may be missed. A pair counts in the first table
in which it meets, and it is never written down: blocks of a bucket return one row per vector, with its
links counted and its smallest linked vector in the block. Wide rows stay where they are: the tables carry
codes, and the exact step fetches the vectors that have a candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast, join_checked
from ..session import cut_lineage
from .graph import star_components

MIN_COSINE = 0.98
#: Share of links at exactly MIN_COSINE that no table may show; closer links are missed far more rarely.
MISSED = 0.002
#: Standard deviations of the confidence bound.
DEVIATIONS = 4.0
ROTATIONS = 2
#: Vectors of one label that share a bucket on average, and the fewest bits of a key.
BUCKET_ROWS, LEAST_BITS = 2500, 8
#: Vectors on a side of a block; larger buckets are compared block by block, in as many tasks.
BLOCK = 2048
SEED = 20240


def key_bits(rows: int) -> int:
    """Bits of a key for labels of at most ``rows`` vectors."""
    return max(LEAST_BITS, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)))


def table_count(bits: int, cosine: float = MIN_COSINE, missed: float = MISSED) -> int:
    """Tables needed so that a pair at ``cosine`` shares a key in one of them: a sign agrees with chance 1 - angle / pi."""
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(missed) / math.log1p(-same)))


class Codes:
    """Rotations, keys and estimates for vectors of ``width`` components."""

    def __init__(self, width: int, bits: int, tables: int):
        self.width, self.bits, self.tables = width, bits, tables
        self.size = 64 * math.ceil(width / 64)  # padded with zeros, so that a code fills whole words
        self.turns = max(ROTATIONS, math.ceil(bits * tables / self.size))
        rng = np.random.default_rng([SEED, width])
        spun = [np.linalg.qr(rng.standard_normal((self.size, self.size))) for _ in range(self.turns)]
        self.rotations = [(q * np.sign(np.diag(r))).astype(np.float64) for q, r in spun]
        self.picked = rng.permutation(self.turns * self.size)[: bits * tables].reshape(tables, bits)

    @property
    def code_bytes(self) -> int:
        return self.turns * self.size // 8

    def encode(self, vectors: np.ndarray) -> list[bytes]:
        """Signs of every rotation, then the correction factors as floats, for unit vectors."""
        padded = np.pad(vectors, ((0, 0), (0, self.size - self.width)))
        turned = [padded @ r for r in self.rotations]
        signs = np.packbits(np.hstack(turned) > 0, axis=1)
        factors = np.stack([np.abs(t).sum(axis=1) / math.sqrt(self.size) for t in turned], axis=1).astype(np.float32)
        return [s.tobytes() + f.tobytes() for s, f in zip(signs, factors)]

    def decode(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits and correction factors."""
        raw = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1)
        signs = np.unpackbits(raw[:, : self.code_bytes], axis=1)
        return signs, np.ascontiguousarray(raw[:, self.code_bytes :]).view(np.float32).astype(np.float64)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """The key of every vector (rows) in every table (columns)."""
        return signs[:, self.picked] @ (1 << np.arange(self.bits, dtype=np.int64))

    def readings(self, signs: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Per vector and rotation the code as a vector of the original space, divided by its factor."""
        spun = signs.reshape(len(signs), self.turns, self.size).astype(np.float64) * 2 - 1
        return np.stack(
            [(spun[:, w] / math.sqrt(self.size)) @ r.T / factors[:, w, None] for w, r in enumerate(self.rotations)], axis=1
        )

    def estimates(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unbiased cosines of readings: the mean over pairs of different rotations."""
        every = a.sum(axis=1) @ b.sum(axis=1).T
        own = a.reshape(len(a), -1) @ b.reshape(len(b), -1).T
        return (every - own) / (self.turns * (self.turns - 1))

    def least_estimates(self, a: np.ndarray, b: np.ndarray, cosine: float = MIN_COSINE) -> np.ndarray:
        """The estimate that a pair at ``cosine`` or above reaches, DEVIATIONS standard deviations down, from both factors."""
        va, vb = (1 / np.square(f).mean(axis=1) - 1 for f in (a, b))
        free = max(self.size - 1, 1)
        own = (1 - cosine**2) * (va[:, None] + vb[None, :]) / (self.turns * free)
        cross = va[:, None] * vb[None, :] / (free * self.turns * (self.turns - 1))
        return cosine - DEVIATIONS * np.sqrt(own + cross)


def unit_rows(batch_column: pa.ListArray) -> np.ndarray:
    """Vectors as unit rows in double precision; scaled first, so that no square over- or underflows."""
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(batch_column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.square(rows).sum(axis=1, keepdims=True))


#: A bucket: the pair of slices of a block makes it a group.
BUCKET = ("bucket", "table")
#: Rows of a side that are compared at a time.
STRIPE = 256


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], codes_of) -> Iterator[tuple[Codes, dict[str, np.ndarray]]]:
    """Groups of two rows or more, of rows sorted by width and ``keys``; a group may go on in the next batch."""
    rest: dict[str, np.ndarray] | None = None

    def whole_groups(rows: dict[str, np.ndarray], final: bool):
        change = np.zeros(len(rows["node"]) - 1, dtype=bool)
        for k in keys:
            change |= rows[k][1:] != rows[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(change) + 1]
        found = [{c: v[a:b] for c, v in rows.items()} for a, b in zip(cuts, cuts[1:]) if b - a > 1 or b == cuts[-1]]
        return (found, None) if final else (found[:-1], found[-1])

    for batch in batches:
        widths = _column(batch, "width").to_numpy()
        starts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(batch)]
        for at, end in zip(starts, starts[1:]):
            if at == end:
                continue
            part, codes = batch.slice(at, end - at), codes_of(int(widths[at]))
            signs, factors = codes.decode(_column(part, "code").to_pylist())
            rows = {k: _column(part, k).to_numpy(zero_copy_only=False) for k in part.schema.names if k not in ("code", "embedding")}
            rows |= {"keys": codes.keys(signs), "readings": codes.readings(signs, factors), "factors": factors}
            if "embedding" in part.schema.names:
                rows["unit"] = unit_rows(_column(part, "embedding"))
            if rest is not None and rest["width"][0] == widths[at]:
                rows = {k: np.concatenate([rest[k], v]) for k, v in rows.items()}
            elif rest is not None:
                yield from ((codes_of(int(rest["width"][0])), g) for g in whole_groups(rest, True)[0] if len(g["node"]) > 1)
            found, rest = whole_groups(rows, False)
            yield from ((codes, g) for g in found if len(g["node"]) > 1)
    if rest is not None and len(rest["node"]) > 1:
        yield codes_of(int(rest["width"][0])), rest


def _own_pairs(codes: Codes, group: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In stripes, rows a, rows b and which of their pairs the bound lets through and this table shows first."""
    left, node, table = group["left"], group["node"], int(group["table"][0])
    one = group["i"][0] == group["j"][0]
    side, b = np.flatnonzero(left), np.flatnonzero(left if one else ~left)
    for at in range(0, len(side), STRIPE):
        a = side[at : at + STRIPE]
        ok = codes.estimates(group["readings"][a], group["readings"][b]) >= codes.least_estimates(group["factors"][a], group["factors"][b])
        if one:
            ok &= node[a][:, None] < node[b][None, :]
        x, y = np.nonzero(ok)
        if table and len(x):
            earlier = (group["keys"][a[x], :table] == group["keys"][b[y], :table]).any(axis=1)
            ok[x[earlier], y[earlier]] = False
        yield a, b, ok


def _in_blocks(entries: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Entries dealt to tasks as groups of ``keys`` and a pair of slices (i, j), sorted.

    A bucket of more than ``block`` vectors is cut into slices; every pair of slices is a group of its own, so no
    group holds much more than two blocks and a hot bucket spreads over many tasks. ``left`` says which side a
    vector is on.
    """
    hot = cut_lineage(entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block))
    cut = join_checked(entries, hot, keys, "node", fits_broadcast(hot), "left")
    slices = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit("slice")), F.col("_s")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_s") - 1),
        lambda o: F.struct(F.least(o, F.col("_own")).alias("i"), F.greatest(o, F.col("_own")).alias("j"), (F.col("_own") <= o).alias("left")),
    )
    dealt = cut.withColumn("_s", slices).withColumn("_own", own).withColumn("_b", F.explode(pairs))
    order = ["width", *keys, "i", "j"]
    return dealt.select(*entries.columns, "_b.i", "_b.j", "_b.left").repartition(*order).sortWithinPartitions(*order)


def near_links(vectors: DataFrame, classes: DataFrame, bits: int, tables: int, block: int = BLOCK) -> DataFrame:
    """(node, links, root): linked vectors (copies counted) of a node in a block, and an edge to another node or to itself.

    ``classes`` has node, label, width, code, h1, h2, n (copies) and first of every different vector, ``vectors``
    vec_id, label, h1, h2 and embedding.
    """

    def maker():
        made: dict[int, Codes] = {}

        def codes_of(width: int) -> Codes:
            if width not in made:
                made[width] = Codes(width, bits, tables)
            return made[width]

        return codes_of

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_of = maker()
        for batch in batches:
            width = _column(batch, "width").to_numpy()
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                codes = codes_of(int(w))
                keys = codes.keys(codes.decode(_column(part, "code").to_pylist())[0])
                for t in range(tables):
                    table = pa.array(np.full(len(part), t, np.int32))
                    yield pa.RecordBatch.from_arrays([*part.columns, table, pa.array(keys[:, t].copy())], names=[*part.schema.names, "table", "key"])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, group in _groups(batches, (*BUCKET, "i", "j"), maker()):
            held = np.zeros(len(group["node"]), dtype=bool)
            for a, b, ok in _own_pairs(codes, group):
                held[a] |= ok.any(axis=1)
                held[b] |= ok.any(axis=0)
            if held.any():
                yield pa.RecordBatch.from_pydict({k: pa.array(group[k][held]) for k in ("node", *BUCKET)})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, group in _groups(batches, ("label", *BUCKET, "i", "j"), maker()):
            node, n, unit = group["node"], group["n"], group["unit"]
            links, root, joined = np.zeros(len(n), dtype=np.int64), node.copy(), [np.zeros((2, 0), dtype=np.int64)]
            for a, b, ok in _own_pairs(codes, group):
                ok &= unit[a] @ unit[b].T >= MIN_COSINE
                links[a] += ok @ n[b]
                links[b] += n[a] @ ok
                for x in np.flatnonzero(ok.any(axis=1)):
                    # what one vector links, and all that had been linked to any of it, hangs on the least root
                    met = np.append(b[ok[x]], a[x])
                    old = np.unique(root[met])
                    root[met] = old[0]
                    joined.append(np.stack([old[1:], np.full(len(old) - 1, old[0])]))
            if links.any():
                more = np.hstack(joined)
                some = links > 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array(np.concatenate([node[some], more[0]])),
                        "links": pa.array(np.concatenate([links[some], np.zeros(len(more[0]), dtype=np.int64)])),
                        "root": pa.array(np.concatenate([root[some], more[1]])),
                    }
                )

    spread = classes.select("node", "width", "code", F.xxhash64("label", "width").alias("group")).mapInArrow(
        entries, "node long, width int, code binary, group long, table int, key long"
    )
    spread = spread.select("node", "width", "code", "table", F.xxhash64("group", "table", "key").alias("bucket"))
    flagged = cut_lineage(
        _in_blocks(spread, ["bucket", "table"], block).mapInArrow(flag, "node long, bucket long, table int").distinct()
    )
    # the vectors that have a candidate, fetched once each by their first holder
    wanted = flagged.select("node").distinct().join(classes, "node").select(
        "node", "width", "n", "code", *[F.col(c).alias(f"_{c}") for c in ("label", "h1", "h2", "first")]
    )
    same = F.col("vec_id").eqNullSafe(F.col("_first"))
    for c in ("label", "h1", "h2"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    held = vectors.join(wanted, same).dropDuplicates(["node"]).select("node", "label", "width", "n", "code", "embedding")
    return _in_blocks(flagged.join(held, "node"), ["label", *BUCKET], block).mapInArrow(link, "node long, links long, root long")


def _comparable() -> Column:
    """Finite in all components and not zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def link_vectors(vectors: DataFrame, label: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Two rows link when their labels are equal and not null and the cosine of their ``embedding`` is MIN_COSINE
    or more. Null, empty and zero vectors, those with a null, NaN or infinite component and those without a
    label link with nothing, and vectors of different lengths never link. Copies of a vector link with each other
    and count each; they are found by two 64-bit hashes of all components. ``component_id`` is the smallest
    vec_id reachable, null ids last; ``kept`` says that it is the row's own. Equal rows get equal results; an
    empty table gives an empty result. Only vec_id, the label and embedding are read.
    """
    marked = vectors.select(
        "vec_id", F.when(_comparable(), F.col(label)).cast("string").alias("label"), "embedding",
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("again"), "embedding").alias("h2"),
    )
    usable = marked.filter("label IS NOT NULL")
    largest = usable.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = key_bits(largest)
    tables = table_count(bits)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Codes] = {}
        for batch in batches:
            width = batch.column(4).value_lengths().to_numpy()
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                codes = made[int(w)] = made.get(int(w)) or Codes(int(w), bits, tables)
                packed = pa.array(codes.encode(unit_rows(part.column(4))), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(np.full(len(part), w, np.int32)), packed], names=["vec_id", "label", "h1", "h2", "width", "code"]
                )

    kind = dict(vectors.dtypes)["vec_id"]
    coded = usable.select("vec_id", "label", "h1", "h2", "embedding").mapInArrow(
        encode, f"vec_id {kind}, label string, h1 long, h2 long, width int, code binary"
    )
    # numbered once and kept: numbers must not change when a task runs again
    classes = cut_lineage(
        coded.groupBy("label", "h1", "h2", "width").agg(
            F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.max("code").alias("code")
        ).withColumn("node", F.monotonically_increasing_id())
    )
    found = cut_lineage(near_links(usable, classes, bits, tables, block))
    roots = star_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = (
        classes.select("node", "label", "h1", "h2", "n", "first").join(links, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    named = rooted.filter("links IS NOT NULL").groupBy("root").agg(F.min("first").alias("component"))
    facts = rooted.join(named, "root", "left").select(
        F.col("label").alias("_label"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "first").alias("_component"),
    )
    rows = marked.select("vec_id", "label", "h1", "h2")
    same = (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    component = F.coalesce("_component", "vec_id")
    return rows.join(facts, same, "left").select(
        "vec_id", F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
