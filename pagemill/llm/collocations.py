"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, then exact counts.

A phrase can only be frequent if its words are, and one of three or four words only if its pairs are. Each
pass hashes the words of all texts, keeps what such a filter lets through and hands counts per text chunk to
the hash partition of each n-gram. There a Misra-Gries summary with more counters than the mass of the
partition divided by the threshold takes them in; what it lost of any n-gram stays below the threshold, so
every frequent one survives. Survivors go back to the texts as a bitmap of fixed size: it can only let too
much through, never too little. The last pass counts survivors as strings, exactly; their words were counted in
the first one, told apart by two hashes of 64 bits.

Four passes over the texts, which are never shuffled: words and masses, pairs, longer phrases, strings.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import whole

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
#: Percent of a phrase's count from which a longer one that holds it replaces it.
HELD_PERCENT = 80
SCORE_UNIT = 2_000_000
#: Bits of the bitmap of survivors: 16 MB, whatever the corpus is. A fuller one only lets more n-grams be counted.
FILTER_BITS = 27
#: Bytes of text that are hashed and counted together; whole pieces, so one long piece may be more.
CHUNK_BYTES = 2 << 20
#: Mass a summary takes at most on average; the partitions of the n-grams follow from it.
PARTITION_MASS = 1 << 24
MASS_BUCKET_BITS = 12

# --- fixed values: the bytes that end a piece, those that end a word, and upper case letters ---
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
# --- end of fixed values ---

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(UPPER)] = list(LOWER)
_IS_BREAK, _IS_WORD = np.zeros(256, dtype=bool), np.ones(256, dtype=bool)
_IS_BREAK[list(BREAKS)] = True
_IS_WORD[list(BREAKS + BLANKS)] = False
#: Odd multipliers of the two independent hashes: for bytes in a word and words in a phrase.
_BYTE_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_WORD_BASE = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_SPAN = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all of them."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of a multiplier and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b)]), dtype=np.uint64) for b in (self.base, self.inverse))


def _word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hashes of all words, from one running sum for each span of the text."""
    out, at = np.zeros(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        first = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, first + _SPAN, "right")))
        last = int(ends[end - 1])
        powers.reach(last - first)
        run = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum((text[first:last].astype(np.uint64) + np.uint64(1)) * powers.up[: last - first], out=run[1:])
        out[at:end] = (run[ends[at:end] - first] - run[starts[at:end] - first]) * powers.down[starts[at:end] - first]
        at = end
    return _mix(out)


class Chunk:
    """Words of a stretch of text: where they are, the language of each, and hashes of phrases by language."""

    def __init__(self, text: np.ndarray, language: Callable[[np.ndarray], np.ndarray], tags: np.ndarray, powers: tuple[_Powers, ...]):
        self.text, self.tags, self.powers = text, tags, powers
        edge = np.flatnonzero(np.diff(_IS_WORD[text].view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edge[::2], edge[1::2]
        piece = np.searchsorted(np.flatnonzero(_IS_BREAK[text]), self.starts)
        self.language = language(self.starts)
        self._made: list[list[np.ndarray]] = [[] for _ in powers]
        #: inside[n - 1]: the n words from each word on lie in one piece
        self.inside = [piece[n:] == piece[: len(piece) - n] if len(piece) > n else np.zeros(0, dtype=bool) for n in range(MAX_WORDS)]

    def hashes(self, n: int, which: int = 0) -> np.ndarray:
        """Of the phrase of n words that begins at each word, by the first or the second of two independent hashes."""
        made = self._made[which]
        while len(made) < n:
            if not made:
                made.append(_mix(_word_hashes(self.text, self.starts, self.ends, self.powers[which]) ^ self.tags[self.language]))
            else:
                k = len(made)
                made.append(_mix(made[-1][:-1] * _WORD_BASE[which] + made[0][k:]) if len(made[0]) > k else made[0][:0])
        return made[n - 1]

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.text[a:b].tobytes() for a, b in zip(self.starts[at : at + n], self.ends[at : at + n])).decode()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, list[str]]]:
    """Chunks of about CHUNK_BYTES with the languages they number; batches have text, lang and the hash of lang."""
    powers = tuple(_Powers(b) for b in _BYTE_BASE)
    texts, names, tags, size = [], [], [], 0

    def cut() -> Iterator[tuple[Chunk, list[str]]]:
        # a line feed between texts: no piece reaches from one into the next
        text = _LOWER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        known = sorted(set(names))
        place, tag_of = {x: k for k, x in enumerate(known)}, dict(zip(names, tags))
        number = np.array([place[x] for x in names])
        tag = np.array([tag_of[x] for x in known], dtype=np.int64).view(np.uint64)
        at = 0
        while at < len(text):
            end = min(len(text), at + CHUNK_BYTES)
            if end < len(text):
                stop = np.flatnonzero(_IS_BREAK[text[at:end]])
                while not len(stop) and end < len(text):
                    at_next = min(len(text), end + CHUNK_BYTES)
                    stop = np.flatnonzero(_IS_BREAK[text[end:at_next]]) + (end - at)
                    end = at_next
                if len(stop):
                    end = at + int(stop[-1]) + 1
            yield Chunk(text[at:end], lambda s, at=at: number[np.searchsorted(begins, s + at, "right") - 1], tag, powers), known
            at = end

    for batch in batches:
        for text, lang, tag in zip(*(batch.column(k).to_pylist() for k in range(3))):
            texts.append(text)
            names.append(lang)
            tags.append(tag)
            size += len(text) + 1
            if size >= CHUNK_BYTES:
                yield from cut()
                texts, names, tags, size = [], [], [], 0
    if texts:
        yield from cut()


class Survivors:
    """A bitmap of hashes, two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __reduce__(self):
        # packed on its way to the tasks: what is sent follows the survivors, not the size of the bitmap
        return Survivors._unpacked, (zlib.compress(self.bits.tobytes(), 1),)

    @staticmethod
    def _unpacked(packed: bytes) -> Survivors:
        return Survivors(np.frombuffer(zlib.decompress(packed), dtype=np.uint8))

    @staticmethod
    def spots(h: Column) -> Column:
        """Numbers of its bits, from 1."""
        mask = F.lit((1 << FILTER_BITS) - 1)
        return F.array(h.bitwiseAND(mask) + 1, F.shiftrightunsigned(h, 32).bitwiseAND(mask) + 1)

    @classmethod
    def of(cls, hashes: DataFrame) -> Survivors:
        """From a column ``h``; at most 2^FILTER_BITS / 8 bytes come to the driver."""
        spot = hashes.select(F.explode(cls.spots(F.col("h"))).alias("s"))
        parts = spot.groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("b"))
        bits = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
        for k, b in parts.toLocalIterator():
            bits[(k - 1) * len(b) : k * len(b)] = np.frombuffer(b, dtype=np.uint8)
        return cls(bits)

    def have(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for shift in (0, 32):
            spot = (h >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
            found &= (self.bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(h, return_counts=True)
    return keys.view(np.int64), n


def _told_apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal hash pairs: one row of each and how many it has. A pair may come in several groups."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    cut = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else order
    return order[cut], np.diff(np.append(cut, len(x)))


class MisraGries:
    """Counters of the heaviest keys; ``lost`` bounds what any key's count may be short of."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Merge another summary's counters, or exact counts."""
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > self.capacity:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            # every counter gives as much as the first one beyond the capacity has
            least = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            self.lost += int(least)
            keys, counts = keys[counts > least], counts[counts > least] - least
        self.keys, self.counts = keys, counts

    def at_least(self, threshold: int) -> np.ndarray:
        """Every key that can have ``threshold``: all that do, and no key that certainly does not."""
        self.settle()
        return self.keys[self.counts + self.lost >= threshold]


def _survivors(counted: DataFrame, masses: dict[int, int], min_count: int) -> Survivors:
    """``counted`` has hashes h and counts n of text chunks; ``masses`` bounds the sum of n by the top bits of h."""
    spark = counted.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(masses.values()) // PARTITION_MASS))
    parts = min(parts, 1 << MASS_BUCKET_BITS)

    def part_of(bucket):
        return bucket * parts >> MASS_BUCKET_BITS

    mass: dict[int, int] = {}
    for bucket, n in masses.items():
        mass[part_of(bucket)] = mass.get(part_of(bucket), 0) + n

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries: dict[int, MisraGries] = {}
        for batch in batches:
            h, n, part = (batch.column(k).to_numpy() for k in range(3))
            for p in np.unique(part):
                summary = summaries.setdefault(int(p), MisraGries(mass[int(p)] // min_count + 1))
                summary.add(h[part == p], n[part == p])
        for summary in summaries.values():
            yield pa.RecordBatch.from_pydict({"h": pa.array(summary.at_least(min_count))})

    bucket = F.shiftrightunsigned("h", 64 - MASS_BUCKET_BITS)
    part = F.shiftright(bucket * parts, MASS_BUCKET_BITS).cast("int")
    dealt = counted.select("h", "n", part.alias("part")).repartitionById(parts, F.col("part"))
    return Survivors.of(dealt.mapInArrow(summarise, "h long"))


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.split())


def _words_and_masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 1: words by both hashes; 0: words of a language; 2 and 3: occurrences of pairs and of longer phrases by top bits."""
    none = np.zeros(0, dtype=np.int64)
    for chunk, names in _chunks(batches):
        first, times = _told_apart(chunk.hashes(1), chunk.hashes(1, 1))
        rows = [(1, chunk.hashes(1)[first].view(np.int64), chunk.hashes(1, 1)[first].view(np.int64), times)]
        top = np.uint64(64 - MASS_BUCKET_BITS)
        for kind, sizes in ((2, (2,)), (3, range(3, MAX_WORDS + 1))):
            n = sum(np.bincount((chunk.hashes(k)[chunk.inside[k - 1]] >> top).astype(np.int64), minlength=1 << MASS_BUCKET_BITS) for k in sizes)
            rows.append((kind, np.flatnonzero(n), none, n[n > 0]))
        for kind, h, h2, n in rows:
            h2 = h2 if len(h2) == len(h) else np.zeros(len(h), np.int64)
            yield _batch("kind h h2 lang n", np.full(len(h), kind, np.int32), h, h2, pa.nulls(len(h), pa.string()), n.astype(np.int64))
        total, zeros = np.bincount(chunk.language, minlength=len(names)), np.zeros(len(names), np.int64)
        yield _batch("kind h h2 lang n", zeros.astype(np.int32), zeros, zeros, names, total.astype(np.int64))


def _word_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both hashes of texts that are one word each."""
    for chunk, names in _chunks(batches):
        said = [chunk.phrase(i, 1) for i in range(len(chunk.starts))]
        yield _batch("lang phrase h h2", [names[k] for k in chunk.language], said, chunk.hashes(1).view(np.int64), chunk.hashes(1, 1).view(np.int64))


def _pairs(chunk: Chunk, words: Survivors, pairs: Survivors | None = None) -> np.ndarray:
    """Positions of pairs of frequent words, and frequent pairs only where they are known."""
    able = words.have(chunk.hashes(1))
    ok = chunk.inside[1] & able[:-1] & able[1:] if len(able) > 1 else np.zeros(0, dtype=bool)
    if pairs is not None:
        at = np.flatnonzero(ok)
        ok[at] = pairs.have(chunk.hashes(2)[at])
    return ok


def _longer(ok: np.ndarray, chunk: Chunk, n: int) -> np.ndarray:
    """Positions of phrases of n words, all of whose pairs are frequent."""
    found = chunk.inside[n - 1].copy()
    for k in range(n - 1):
        found &= ok[k : k + len(found)]
    return found


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of every phrase of 2 to MAX_WORDS words with ``min_count`` occurrences and of their words, and (lang, n).

    A null language is ``und``, a null text empty.
    """
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    read = docs.select(F.col("text"), lang.alias("lang")).select(
        whole("text").cast("binary").alias("text"), "lang", F.xxhash64("lang").alias("tag")
    )
    first = cut_lineage(
        read.mapInArrow(_words_and_masses, "kind int, h long, h2 long, lang string, n long")
        .groupBy("kind", "h", "h2", "lang").agg(F.sum("n").alias("n")).filter(f"kind <> 1 OR n >= {min_count}")
    )
    totals = first.filter("kind = 0").select("lang", "n")
    masses: dict[int, dict[int, int]] = {2: {}, 3: {}}
    for kind, h, n in first.filter("kind > 1").select("kind", "h", "n").collect():  # at most twice 2^MASS_BUCKET_BITS rows
        masses[kind][h] = n
    words = Survivors.of(first.filter("kind = 1").select("h"))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _chunks(batches):
            yield _batch("h n", *_counted(chunk.hashes(2)[_pairs(chunk, words)]))

    pairs = _survivors(read.mapInArrow(count_pairs, "h long, n long"), masses[2], min_count)

    def count_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in _chunks(batches):
            ok = _pairs(chunk, words, pairs)
            for n in range(3, MAX_WORDS + 1):
                yield _batch("h n", *_counted(chunk.hashes(n)[_longer(ok, chunk, n)]))

    longer = _survivors(read.mapInArrow(count_longer, "h long, n long"), masses[3], min_count)

    def count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, names in _chunks(batches):
            ok = _pairs(chunk, words, pairs)
            for n in range(2, MAX_WORDS + 1):
                at = np.flatnonzero(ok if n == 2 else _longer(ok, chunk, n))
                if n > 2:
                    at = at[longer.have(chunk.hashes(n)[at])]
                first, times = _told_apart(chunk.hashes(n)[at], chunk.hashes(n, 1)[at])
                some = at[first]
                yield _batch(
                    "lang phrase k n", pa.array([names[k] for k in chunk.language[some].tolist()], pa.string()),
                    pa.array([chunk.phrase(i, n) for i in some.tolist()], pa.string()), np.full(len(some), n, np.int32), times.astype(np.int64),
                )

    strings = read.mapInArrow(count_strings, "lang string, phrase string, k int, n long")
    several = cut_lineage(strings.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count))
    # the words of these phrases were all counted in the first pass, by both hashes
    used = several.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    named = used.select(F.col("phrase").cast("binary").alias("text"), "lang", F.xxhash64("lang").alias("tag")).mapInArrow(
        _word_names, "lang string, phrase string, h long, h2 long"
    )
    single = named.join(first.filter("kind = 1").select("h", "h2", F.col("n").alias("f")), ["h", "h2"]).select(
        "lang", "phrase", F.lit(1).alias("k"), "f"
    )
    return several.unionByName(single), totals


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(30,0)")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, held_percent: int = HELD_PERCENT) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a is the count of the phrase, l and r those of its parts at the cut with the lowest score (then the shortest
    first part), n the words of the language, score floor(2000000 a / (l + r)). Phrases whose words lie inside
    a longer candidate with ``held_percent`` of their count or more are left out. Null texts are empty, a null
    language is ``und``; equal rows count as often as they occur; a language with no such phrase has no row;
    an empty table gives an empty result. Only text and lang are read.
    """
    counts, totals = frequent_phrases(docs, min_count)
    several = counts.filter("k > 1")
    part = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("p"))
    cuts = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "cut",
        F.expr("substring_index(phrase, ' ', cut)").alias("left_part"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right_part"),
    )
    joined = cuts.join(part.withColumnsRenamed({"part": "left_part", "p": "l"}), ["lang", "left_part"]).join(
        part.withColumnsRenamed({"part": "right_part", "p": "r"}), ["lang", "right_part"]
    )
    scored = joined.select(
        "lang", "phrase", "a", "cut", "l", "r",
        F.expr(f"CAST({SCORE_UNIT} AS decimal(7,0)) * CAST(a AS decimal(19,0)) div (CAST(l AS decimal(19,0)) + CAST(r AS decimal(19,0)))").alias("score"),
    )
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    # contiguous parts of two words or more of every longer phrase, with the highest count that holds them
    held = (
        several.filter("k > 2").withColumn("w", F.split("phrase", " ")).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
        .groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("f").alias("holder"))
    )
    free = best.join(held, ["lang", "phrase"], "left").filter(
        F.col("holder").isNull() | (_big("holder") * 100 < _big("a") * held_percent)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), F.asc("phrase"))
    ranked = free.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n",
        F.col("b.score").alias("score"),
    )
