"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a seed of a few tokens are compared: the longest common token run that
overlaps no tile becomes a tile, again and again, with Karp-Rabin hashes finding the runs. The share of an
item's tokens that tiles cover does not depend on the order of its passages in the document.

The items go to the documents: blocks of items of a bounded size are shared with all tasks, one pass over
the documents for each block, so nothing of the documents is shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text_batches

#: Tokens of a seed, which is also the shortest tile.
SEED_TOKENS = 5
#: Share of an item's tokens that tiles must cover.
MIN_COVERAGE = 0.6
#: Characters of test items shared with the tasks at a time.
BLOCK_CHARS = 8_000_000

_TOKEN = re.compile(r"\w+")
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def equal_runs(seeds: list[tuple[int, np.ndarray]], n: int, m: int, least: int) -> list[tuple[int, int, int]]:
    """Maximal runs (start in item, start in document, tokens) of the seeds of an item of n and a document of m tokens.

    ``seeds`` gives for positions in the item all positions in the document where the same ``least`` tokens
    begin. A run is a stretch of one diagonal; only where diagonals begin and end anything is kept.
    """
    runs: list[tuple[int, int, int]] = []
    begun, on, now = np.zeros(n + m + 1, dtype=np.int64), np.zeros(n + m + 1, dtype=bool), np.zeros(n + m + 1, dtype=bool)
    held, last = np.zeros(0, dtype=np.int64), -2

    def end(diagonals: np.ndarray) -> None:
        starts = begun[diagonals]
        runs.extend(zip(starts.tolist(), (starts + diagonals - n).tolist(), (last - starts + least).tolist()))

    for at, places in sorted(seeds, key=lambda s: s[0]):
        here = places - at + n
        now[here] = True
        end(held[~now[held]] if at == last + 1 else held)
        if at != last + 1:
            on[held] = False
        begun[here[~on[here]]] = at
        on[held], now[here] = False, False
        on[here] = True
        held, last = here, at
    end(held)
    return runs


def tile(item: list[int], doc: list[int], runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length) of two token lists.

    ``runs`` are the maximal equal runs of ``least`` tokens or more. The longest comes first, in item then
    document order; what tiles have marked cuts a run, and its pieces wait for their turn.
    """
    marked_item, marked_doc = bytearray(len(item)), bytearray(len(doc))
    tiles: list[tuple[int, int, int]] = []
    waiting = [(-k, a, b) for a, b, k in runs]
    heapq.heapify(waiting)
    free = len(item)
    while waiting and free >= least:
        k, a, b = heapq.heappop(waiting)
        k = -k
        clear = marked_item.find(1, a, a + k) < 0 and marked_doc.find(1, b, b + k) < 0
        if clear and item[a : a + k] == doc[b : b + k]:
            marked_item[a : a + k] = marked_doc[b : b + k] = b"\1" * k
            tiles.append((a, b, k))
            free -= k
            continue
        start = 0
        for i in range(k + 1):
            if i == k or marked_item[a + i] or marked_doc[b + i] or item[a + i] != doc[b + i]:
                if least <= i - start < k:
                    heapq.heappush(waiting, (start - i, a + start, b + start))
                start = i + 1
    return sorted(tiles)


class ItemBlock:
    """Test items with their tokens as numbers and the Karp-Rabin hashes of their seeds."""

    def __init__(self, items: list[tuple], least: int):
        self.least, self.number, self.items = least, {}, []
        #: hash of a seed to the items that have it, with its positions
        self.seeds: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        #: items shorter than a seed, by their tokens
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item_id, text in items:
            tokens = [self.number.setdefault(t, len(self.number) + 1) for t in tokens_of(text)]
            if tokens:
                self.items.append((item_id, tokens))
        for k, (_, tokens) in enumerate(self.items):
            if len(tokens) < least:
                self.short[tuple(tokens)].append(k)
            for at, h in self._hashes(tokens, least):
                self.seeds[h][k].append(at)

    @staticmethod
    def _hashes(tokens: list[int], n: int) -> Iterator[tuple[int, int]]:
        """Rolling hashes of all runs of ``n`` tokens without a 0; runs of other lengths never meet in a hash."""
        lead, h, clear = pow(_BASE, n, _PRIME), 0, 0
        for i, t in enumerate(tokens):
            h = (h * _BASE + t) % _PRIME
            if i >= n:
                h = (h - tokens[i - n] * lead) % _PRIME
            clear = clear + 1 if t else 0
            if clear >= n:
                yield i - n + 1, h * 64 + min(n, 63)

    def matches(self, text: str | None) -> Iterator[tuple]:
        """(item_id, item tokens, covered tokens, tiles) of every item that shares a seed, or a whole line, with the text."""
        numbers = [self.number.get(t, 0) for t in tokens_of(text)]
        places: dict[int, list[int]] = defaultdict(list)
        for at, h in self._hashes(numbers, self.least):
            if h in self.seeds:
                places[h].append(at)
        shared: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for h, found in places.items():
            where = np.array(found, dtype=np.int64)
            for k, starts in self.seeds[h].items():
                shared[k].extend((a, where) for a in starts)
        for k, seeds in shared.items():
            item_id, tokens = self.items[k]
            tiles = tile(tokens, numbers, equal_runs(seeds, len(tokens), len(numbers), self.least), self.least)
            yield item_id, len(tokens), sum(t[2] for t in tiles), tiles
        if self.short and text:
            at, seen = 0, set()
            for line in text.split("\n"):
                said = tokens_of(line)
                if len(said) < self.least:
                    for k in self.short.get(tuple(self.number.get(t, 0) for t in said), ()):
                        if k not in seen:
                            seen.add(k)
                            yield self.items[k][0], len(said), len(said), [(0, at, len(said))]
                at += len(said)


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items in lists of about ``block_chars`` characters, streamed one partition at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated_pairs(
    docs: DataFrame,
    items: DataFrame,
    least: int = SEED_TOKENS,
    min_coverage: float = MIN_COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and item whose tiles cover at least ``min_coverage`` of the item's tokens.

    Columns: doc_id, item_id, item_tokens, covered_tokens, coverage, tiles (start in the item, start in the
    document, length; in tokens). An item shorter than ``least`` tokens says nothing inside a sentence: it counts
    only where it is a whole line of the document. Null and empty texts
    match nothing; equal rows give equal rows; an empty table on either side gives an empty result. Of the
    inputs only doc_id, text and item_id, text are read.
    """
    whole_text_batches(docs)
    session = docs.sparkSession
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = (
        f"doc_id {kinds[0]}, item_id {kinds[1]}, item_tokens int, covered_tokens int, coverage double, "
        "tiles array<struct<item_start:int,doc_start:int,tokens:int>>"
    )
    read = items.select("item_id", "text").filter(F.col("text").isNotNull())
    found = None
    for block in _blocks(read, block_chars):
        shared = session.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = ItemBlock(shared.value, least)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    for item_id, n, covered, tiles in held.matches(text):
                        if covered >= min_coverage * n:
                            rows.append((doc_id, item_id, n, covered, covered / n, tiles))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_tokens", "covered_tokens", "coverage", "tiles"])

        part = docs.select("doc_id", "text").mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    return session.createDataFrame([], schema) if found is None else found
