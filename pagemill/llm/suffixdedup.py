"""Exact substring dedup with enhanced suffix arrays and their common-prefix interval trees.

A repeated string of LENGTH bytes holds a content-defined anchor: the ANCHOR-byte string with the least hash
among those that begin in it. Equal strings have it at the same place, so repeats meet under the hash of
their anchor and only about every seventieth byte is shuffled. The suffixes that begin at one anchor are the
part of the suffix array that their group needs: sorted by what follows, with the lengths of common prefixes
beside them, a stack scan gives the tree of common-prefix intervals. Each interval is a repeat with all its
occurrences; the bytes before them, sorted from right to left, tell how far it goes to the left and whether
the left extensions differ, that is where it is maximal.

Anchors whose whole surroundings occur twice are settled by counting, without looking at the text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import whole, whole_text_batches

#: Bytes of a repeat that is removed.
LENGTH = 200
#: Bytes of an anchor.
ANCHOR = 56
#: Bytes of a text looked at together when anchors are chosen.
CHUNK = 1 << 18
#: Anchors with more different surroundings are settled by hashes of all their strings instead of one suffix array.
LARGE_GROUP = 50_000

_MULTIPLY = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 20) - 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"] = np.cumprod(np.full(n, _MULTIPLY, dtype=np.uint64))
        _POWERS["down"] = np.cumprod(np.full(n, pow(_MULTIPLY, -1, 1 << 64), dtype=np.uint64))
    return _POWERS["up"], _POWERS["down"]


def _least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: running minima from either end of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors_of(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Positions of the anchors, their hashes, the hashes of their surroundings, bytes before and behind them.

    The surroundings reach ``length - anchor`` bytes to either side, less at the ends of the text.
    """
    n, reach = len(data), length - anchor
    found, last = [], -1
    for c in range(0, n - length + 1, CHUNK):
        starts = min(CHUNK, n - length + 1 - c)
        a, b = max(0, c - reach), min(n, c + starts - 1 + length + reach)
        up, down = _powers(b - a + 1)
        x = np.frombuffer(data, dtype=np.uint8, count=b - a, offset=a).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        first = c - a
        m = starts + reach
        hashes = (sums[first + anchor : first + anchor + m] - sums[first : first + m]) * down[first : first + m]
        mixed = hashes * _MIX
        mixed ^= mixed >> np.uint64(29)
        order = (mixed & ~_LOW) | np.arange(m, dtype=np.uint64)
        p = np.unique((_least_of_each(order, reach + 1) & _LOW).astype(np.int64))
        p = p[p + c > last]
        if not len(p):
            continue
        last = int(p[-1]) + c
        before, behind = np.minimum(reach, p + c), np.minimum(reach, n - (p + c) - anchor)
        lo, hi = first + p - before, first + p + anchor + behind
        around = (sums[hi] - sums[lo]) * down[lo]
        around = (around ^ (before * 1024 + behind).astype(np.uint64)) * _MIX
        around ^= around >> np.uint64(31)
        found.append((p + c, hashes[p], around, before, behind))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def interval_tree(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, end) of every interval of a suffix array, children before parents.

    ``prefixes[i]`` is the common prefix of the suffixes i and i + 1. One scan with a stack of open intervals.
    """
    stack = [(0, 0)]
    for i, h in enumerate([*prefixes, -1]):
        start = i
        while stack and h < stack[-1][0]:
            depth, start = stack.pop()
            yield depth, start, i + 1
        if h >= 0 and (not stack or stack[-1][0] < h):
            stack.append((h, start))
    for depth, start in reversed(stack):
        if len(prefixes):
            yield depth, start, len(prefixes) + 1


def repeats_of(befores: list[bytes], behinds: list[bytes], length: int, anchor: int) -> list[set[tuple[int, int]]]:
    """For every occurrence of an anchor, the (bytes to the left, bytes to the right) of its maximal repeats.

    ``befores`` are the bytes before the anchor from right to left, ``behinds`` those behind it.
    """
    order = sorted(range(len(behinds)), key=behinds.__getitem__)
    prefixes = [common_prefix(behinds[x], behinds[y]) for x, y in zip(order, order[1:])]
    found: list[set[tuple[int, int]]] = [set() for _ in behinds]
    seen = set()
    for right, start, end in interval_tree(prefixes):
        if (start, end) in seen:
            continue
        seen.add((start, end))
        members = sorted(order[start:end], key=befores.__getitem__)
        # left extensions: the longest that a member shares with any other is one it shares with a neighbour
        shared = [common_prefix(befores[x], befores[y]) for x, y in zip(members, members[1:])]
        for at, who in enumerate(members):
            left = max(shared[at - 1] if at else -1, shared[at] if at < len(shared) else -1)
            if left + anchor + right >= length:
                found[who].add((left, right))
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, large: int = LARGE_GROUP) -> DataFrame:
    """(row, spans) of documents with repeats: hash over doc_id and text, byte ranges that may overlap."""
    whole_text_batches(docs)
    reach = length - anchor
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), whole("text").alias("text"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for row, text in [*zip(batch["row"], batch["text"]), (None, None)]:
                if text is not None:
                    at, key, around, before, behind = anchors_of(text.encode(), length, anchor)
                    if len(at):
                        place = (at << 20) | (before << 10) | behind
                        rows.append((np.full(len(at), row), place, key.view(np.int64), around.view(np.int64)))
                        size += len(at)
                if rows and (text is None or size > 200_000):
                    parts = [np.concatenate(x) for x in zip(*rows)]
                    yield pd.DataFrame(dict(zip(("row", "place", "key", "around"), parts)))
                    rows, size = [], 0

    anchors = texts.mapInPandas(find, "row long, place long, key long, around long")
    # counts are tables of their own, so that a join with a frequent key can be split
    again = cut_lineage(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    repeated = cut_lineage(anchors.join(again, "key"))
    surroundings = cut_lineage(
        repeated.groupBy("key", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("one"))
    )
    place = F.col("place")
    at, before, behind = F.shiftright(place, 20), F.shiftright(place, 10).bitwiseAND(1023), place.bitwiseAND(1023)
    whole_span = F.struct((at - before).alias("s"), (at + anchor + behind).alias("e"))
    counted = repeated.join(surroundings.filter("n > 1").select("key", "around"), ["key", "around"], "left_semi")
    spans = counted.filter(before + behind + anchor >= length).select("row", whole_span.alias("span"))

    # the others, one of each surroundings: what is around them comes from the text
    many = surroundings.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    asked = surroundings.join(many, "key").groupBy(F.col("one.row").alias("row")).agg(
        F.collect_list(F.struct(F.col("one.place").alias("place"), "key", (F.col("n") == 1).alias("open"), (F.col("kinds") > large).alias("large"))).alias("asked")
    )

    def surround(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for row, text, wanted in [*zip(batch["row"], batch["text"], batch["asked"]), (None, None, ())]:
                data = text.encode() if text is not None else b""
                for w in wanted:
                    here = w["place"] >> 20
                    rows.append(
                        (w["key"], row, here, w["open"], w["large"], data[max(0, here - reach) : here][::-1], data[here + anchor : here + anchor + reach])
                    )
                    size += 1
                if rows and (text is None or size > 20_000):
                    yield pd.DataFrame(rows, columns=["key", "row", "at", "open", "large", "before", "behind"])
                    rows, size = [], 0

    around = texts.join(asked, "row").select("row", "doc_id", "text", "asked").mapInPandas(
        surround, "key long, row long, at long, open boolean, large boolean, before binary, behind binary"
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups follow one another; the last one of a batch may go on in the next."""
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch])
            key = rows["key"].to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            end = int(cuts[-1]) if len(cuts) else 0
            yield from solve(rows.iloc[:end], [0, *cuts])
            rest = rows.iloc[end:]
        if rest is not None and len(rest):
            yield from solve(rest, [0, len(rest)])

    def solve(rows: pd.DataFrame, cuts: list) -> Iterator[pd.DataFrame]:
        out = []
        row, at, opened = rows["row"].tolist(), rows["at"].tolist(), rows["open"].tolist()
        befores, behinds = rows["before"].tolist(), rows["behind"].tolist()
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2 or not any(opened[a:b]):
                continue
            for i, repeats in enumerate(repeats_of(befores[a:b], behinds[a:b], length, anchor), a):
                if opened[i]:
                    out.extend((row[i], (at[i] - left, at[i] + anchor + right)) for left, right in repeats)
        if out:
            yield pd.DataFrame(out, columns=["row", "span"])

    kind = "row long, span struct<s:long,e:long>"
    from_trees = around.filter("NOT large").repartition("key").sortWithinPartitions("key").mapInPandas(scan, kind)

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, row, here, opened, before, behind in zip(*(batch[c] for c in ("key", "row", "at", "open", "before", "behind"))):
                left = before[::-1]
                parts = [
                    (key, row, here - j, opened, j, left[len(left) - j :] + behind[: reach - j])
                    for j in range(max(0, reach - len(behind)), min(reach, len(left)) + 1)
                ]
                if parts:
                    yield pd.DataFrame(parts, columns=["key", "row", "s", "open", "j", "string"])

    whole_strings = around.filter("large").mapInPandas(strings, "key long, row long, s long, open boolean, j int, string binary").select(
        "key", "row", "s", "open", "j", F.xxhash64("string").alias("h")
    )
    twice = whole_strings.groupBy("key", "j", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "j", "h")
    from_strings = whole_strings.filter("open").join(twice, ["key", "j", "h"], "left_semi").select(
        "row", F.struct("s", (F.col("s") + length).alias("e")).alias("span")
    )
    every = spans.unionByName(from_trees).unionByName(from_strings)
    return every.groupBy("row").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, large: int = LARGE_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and ``kept`` (binary) for every row.

    Removed is every byte of a ``length``-byte string that starts more than once, in the same document or
    another; all occurrences go. Texts are UTF-8 bytes (null: none), so what is left may break a character.
    Rows equal in doc_id and text are two documents and repeat each other. An empty table stays empty. Of
    the input only doc_id and text are read.
    """
    found = repeated_spans(docs, length, anchor, large)
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), whole("text").alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
                data = text.encode()
                gone = _merged([(x["s"], x["e"]) for x in spans]) if spans is not None else []
                ends = [0, *(p for span in gone for p in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                rows.append((doc_id, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return texts.join(found, "row", "left").select("doc_id", "text", "spans").mapInPandas(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
