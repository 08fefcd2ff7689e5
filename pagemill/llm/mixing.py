"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. Each pattern can give its words once for
nothing and again at a rising price (convex repetition costs); each source can take its quota. The cheapest
flow says how many words every pattern gives; inside a pattern a seeded order says which documents give
them. Each connected component of patterns and sources is a flow of its own, solved in a task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import count_words, whole
from .graph import star_components

MAX_REPEATS = 3
SEED = "mix-1"
#: Tables of at most so many patterns are broadcast; larger ones are joined.
BROADCAST_PATTERNS = 4096
BUCKET_DIGITS = 3


def shared_targets(sizes: dict, weights: Sequence[int] = (1, 2, 3), cap: int = MAX_REPEATS) -> dict:
    """Shares of the total size by weight, none above ``cap`` times its source; the excess is reshared.

    ``sizes`` maps a source (or None) to its words. Sources in code point order, None last, get the
    weights in turn. Sources are capped in the order of size per weight until none is above the level.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, weight_left = sum(sizes.values()), sum(weight.values())
    targets = {}
    for s in sorted(order, key=lambda s: (sizes[s] / weight[s], s is None, s or "")):
        if cap * sizes[s] * weight_left < weight[s] * left:
            targets[s] = float(cap * sizes[s])
            left, weight_left = left - cap * sizes[s], weight_left - weight[s]
        else:
            targets[s] = weight[s] * left / weight_left
    return targets


def cheapest_flow(supply: list[tuple[tuple, int]], quotas: dict, repeats: int = MAX_REPEATS) -> list[dict]:
    """Words each pattern sends to each of its sources, at least total repetition cost.

    ``supply`` is (sources of the pattern, its words). The r-th pass over a pattern costs r * r a word more
    than none, so repeats spread evenly before any pattern is read a third time. Successive cheapest
    augmenting paths; with integer capacities the flow is integer.
    """
    sources = list(quotas)
    n = len(supply)
    source_node = {s: 1 + n + i for i, s in enumerate(sources)}
    sink = 1 + n + len(sources)
    heads: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room, price = [], [], []

    def edge(a: int, b: int, capacity: int, cost: int) -> None:
        for here, there, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            heads[here].append(len(to))
            to.append(there)
            room.append(c)
            price.append(p)

    for i, (members, size) in enumerate(supply):
        for r in range(repeats):
            edge(0, 1 + i, size, r * r)
        for s in members:
            if s in source_node:
                edge(1 + i, source_node[s], repeats * size, 0)
    for s in sources:
        edge(source_node[s], sink, int(quotas[s]), 0)

    while True:
        best = [None] * (sink + 1)
        via = [-1] * (sink + 1)
        best[0] = 0
        queue, queued = deque([0]), {0}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in heads[a]:
                b = to[e]
                if room[e] > 0 and (best[b] is None or best[a] + price[e] < best[b]):
                    best[b], via[b] = best[a] + price[e], e
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        if best[sink] is None:
            break
        path, at = [], sink
        while at:
            path.append(via[at])
            at = to[via[at] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    name = {v: k for k, v in source_node.items()}
    return [
        {name[to[e]]: room[e ^ 1] for e in heads[1 + i] if to[e] in name and room[e ^ 1] and not e & 1} for i in range(n)
    ]


def _order_key(seed: str) -> Column:
    """A seeded order that does not depend on where a row is read; equal rows are equal in it."""
    text_hash = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    row = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_hash)
    return F.md5(row.cast("binary"))


def _targets(sizes: DataFrame, total: int, quotas: dict | None, weights: Sequence[int], repeats: int) -> DataFrame:
    """(source, source_size, target) of every source: the given quotas, or what ``shared_targets`` says, for any number of them.

    Where sources overlap, ``total`` words are shared, not the words per membership.
    """
    if quotas is not None:
        given = sizes.sparkSession.createDataFrame([(k, float(t)) for k, t in quotas.items()], "q_source string, quota double")
        return sizes.join(given, F.col("source").eqNullSafe(F.col("q_source")), "left").select(
            "source", F.col("size").alias("source_size"), F.coalesce("quota", F.lit(0.0)).alias("target")
        )
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    level = Window.orderBy(F.col("size").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    big = lambda c: c.cast("decimal(38,0)")
    below = F.coalesce(F.sum("size").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("size").over(Window.partitionBy())
    ranked = sizes.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("long")).select(
        "*",
        F.row_number().over(level).alias("pos"),
        every.alias("every"),
        (every - repeats * below).alias("left"),
        F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weight_left"),
    )
    shared = big(repeats * F.col("size")) * F.col("weight_left") >= big(F.col("left")) * F.col("weight")
    first = ranked.filter(shared).agg(F.min(F.struct("pos", "left", "weight_left")).alias("f"))
    target = F.when(F.col("f").isNull() | (F.col("pos") < F.col("f.pos")), (repeats * F.col("size")).cast("double")).otherwise(
        (F.col("weight") * F.col("f.left")).cast("double") / F.col("f.weight_left")
    )
    scaled = F.when(F.col("every") == total, target).otherwise(target * (F.lit(float(total)) / F.col("every")))
    return ranked.crossJoin(F.broadcast(first)).select("source", F.col("size").alias("source_size"), scaled.alias("target"))


def _source_node(source: Column) -> Column:
    return F.when(source.isNull(), "null").otherwise(F.concat(F.lit("s:"), source))


def _plan(patterns: DataFrame, quotas: dict | None, weights: Sequence[int], repeats: int) -> DataFrame:
    """Passes and rest of every pattern by the cheapest flow of its component.

    Patterns and sources that no pattern connects share no words: each connected component is a flow of its own,
    solved in the task that gets it. A pattern of one source, which no other pattern has, is a component by itself.
    """
    members = patterns.select("mix_members", F.explode("mix_members").alias("source"), "size")
    sizes = cut_lineage(members.groupBy("source").agg(F.sum("size").alias("size")))
    total = patterns.agg(F.sum("size")).first()[0] or 0
    targets = cut_lineage(_targets(sizes, total, quotas, weights, repeats))
    pattern_node = F.concat(F.lit("p:"), F.to_json(F.struct("mix_members"), {"ignoreNullFields": "false"}))
    edges = members.filter(F.size("mix_members") > 1).select(pattern_node.alias("a"), _source_node(F.col("source")).alias("b"))
    roots = star_components(edges)
    # a pattern belongs to the component of its first source, with all its others
    nodes = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    named = patterns.withColumn("_at", F.coalesce(_source_node(F.get("mix_members", F.lit(0))), F.lit("none"))).join(
        nodes, F.col("_at") == F.col("_node"), "left"
    ).select(F.coalesce("_root", "_at").alias("component"), "mix_members", "size")
    wanted = targets.withColumn("_at", _source_node(F.col("source"))).join(nodes, F.col("_at") == F.col("_node"), "left").select(
        F.coalesce("_root", "_at").alias("component"), "source", "source_size", "target", F.lit(True).alias("is_source")
    )
    both = named.unionByName(wanted, allowMissingColumns=True)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        said = rows["is_source"].notna()
        facts = {(None if pd.isna(r.source) else r.source): (int(r.source_size), float(r.target)) for r in rows[said].itertuples()}
        supply = sorted(
            ((tuple(m), int(n)) for m, n in zip(rows["mix_members"][~said], rows["size"][~said])), key=lambda p: [(s is None, s or "") for s in p[0]]
        )
        sent = cheapest_flow(supply, {s: t for s, (_, t) in facts.items()}, repeats)
        plan = []
        for (held, size), words in zip(supply, sent):
            passes, rest = divmod(sum(words.values()), size) if size else (0, 0)
            source_size, target = facts.get(held[0], (0, 0.0)) if held else (0, 0.0)
            plan.append((list(held), passes, rest, source_size, target))
        return pd.DataFrame(plan, columns=["mix_p_members", "mix_p_passes", "mix_p_rest", "mix_p_source_size", "mix_p_target"])

    return both.groupBy("component").applyInPandas(
        solve, "mix_p_members array<string>, mix_p_passes long, mix_p_rest long, mix_p_source_size long, mix_p_target double"
    )


def mix_sources(
    docs: DataFrame,
    members: Column | None = None,
    quotas: dict | None = None,
    weights: Sequence[int] = (1, 2, 3),
    repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """All rows of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_taken`` (words, repeats counted).

    ``members`` is an array of the sources a document belongs to; by default its ``source`` alone. Without
    ``quotas`` the targets are ``shared_targets``. Every document is taken a whole number of times, at most
    ``repeats``; within a pattern the counts differ by one at most. Null text is empty (size 0, taken 0),
    a null source is a source of its own, equal rows are treated alike, an empty table stays empty.
    Columns whose names begin with ``mix_`` are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    members = F.array(F.col("source")) if members is None else F.array_sort(F.array_distinct(members))
    sized = docs.withColumns({"mix_members": members, "mix_size": count_words(whole("text")), "mix_key": _order_key(seed)})
    narrow = cut_lineage(sized.select("mix_members", "mix_size", "mix_key"))

    patterns = cut_lineage(narrow.groupBy("mix_members").agg(F.sum("mix_size").alias("size")))
    few = patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    small = F.broadcast if few else lambda df: df
    plan = small(cut_lineage(_plan(patterns, quotas, weights, repeats)))

    # the last pass over a pattern stops at a key: found by hash buckets, then inside one bucket
    def planned(df: DataFrame) -> DataFrame:
        return df.join(plan, F.col("mix_members").eqNullSafe(F.col("mix_p_members")), "left")

    bucket = F.substring("mix_key", 1, BUCKET_DIGITS)
    by_bucket = Window.partitionBy("mix_members").orderBy("bucket")
    edge = (
        planned(narrow.groupBy("mix_members", bucket.alias("bucket")).agg(F.sum("mix_size").alias("words")))
        .withColumn("upto", F.sum("words").over(by_bucket))
        .filter("upto > mix_p_rest")
        .groupBy(F.col("mix_members").alias("mix_e_members"))
        .agg(F.min(F.struct("bucket", (F.col("mix_p_rest") - F.col("upto") + F.col("words")).alias("room"))).alias("e"))
        .select("mix_e_members", "e.bucket", "e.room")
    )
    inside = narrow.join(
        small(edge), F.col("mix_members").eqNullSafe(F.col("mix_e_members")) & (bucket == F.col("bucket"))
    )
    # equal keys go together; the key at the edge is taken if that comes nearer to the room left
    by_key = Window.partitionBy("mix_e_members", "bucket", "room").orderBy("mix_key")
    last = (
        inside.groupBy("mix_e_members", "bucket", "room", "mix_key")
        .agg(F.sum("mix_size").alias("words"))
        .withColumn("upto", F.sum("words").over(by_key))
        .groupBy("mix_e_members", "bucket")
        .agg(F.max(F.when(2 * F.col("upto") - F.col("words") <= 2 * F.col("room"), F.col("mix_key"))).alias("mix_e_last"))
        .select("mix_e_members", F.coalesce("mix_e_last", "bucket").alias("mix_e_last"))
    )
    stops = small(cut_lineage(last))  # at most one row per pattern
    once_more = F.coalesce(F.col("mix_key") <= F.col("mix_e_last"), F.lit(True)).cast("long")
    return (
        planned(sized)
        .join(stops, F.col("mix_members").eqNullSafe(F.col("mix_e_members")), "left")
        .withColumns(
            {
                "mix_source_size": F.col("mix_p_source_size"),
                "mix_target": F.col("mix_p_target"),
                "mix_taken": F.col("mix_size")
                * F.when(F.col("mix_p_rest") == 0, F.col("mix_p_passes")).otherwise(F.col("mix_p_passes") + once_more),
            }
        )
        .select(*[docs[c] for c in docs.columns], "mix_size", "mix_source_size", "mix_target", "mix_taken")
    )
