"""Language identification with a bit-sliced Bloom filter of character n-grams.

One table of slots holds a bit for every language: an n-gram typical of a language sets that language's bit
in its slots, so one look-up returns all languages that have the n-gram. A text counts the n-grams per
language, corrects the counts for the filter's false positives and takes the language with the highest one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import whole_text_batches

#: Bound of the labelled sample: so many training documents per language at most, whole texts.
TRAIN_DOCUMENTS = 500
#: Most different labels; more raise an error.
MAX_LANGUAGES = 1024
#: Slots of the filter; the model is 8 bytes a slot for every 64 languages.
SLOTS = 1 << 20
HASHES = 2
SIZES = (2, 3, 4)
#: An n-gram belongs to a language with at least this share of the rate of the language that uses it most.
MIN_SHARE = 0.2
#: ... and with at least so many occurrences in its sample.
MIN_COUNT = 3
#: N-grams of the sample counted in a task before they are handed on.
FLUSH = 1 << 22
#: Characters of a text hashed at a time.
CHUNK = 1 << 18

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


_OTHER = re.compile(r"[\W\d_]+")


def _letters(text: str) -> str:
    """Lower case letters, one space for every run of anything else, a space at either end; empty without a letter."""
    clean = _OTHER.sub(" ", text.lower()).strip()
    return f" {clean} " if any(map(str.isalpha, clean)) else ""


def _grams(clean: str) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a cleaned text, chunk by chunk."""
    longest = max(SIZES)
    for at in range(0, len(clean), CHUNK):
        codes = np.frombuffer(clean[at : at + CHUNK + longest - 1].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        final = at + CHUNK >= len(clean)
        rolled = codes.copy()
        for n in range(1, longest + 1):
            if n > 1:
                rolled = rolled[: len(codes) - n + 1] * _MULTIPLY + codes[n - 1 :]
            if n in SIZES and len(rolled):
                starts = rolled if final else rolled[:CHUNK]
                mixed = (starts + np.uint64(n)) * _MIX
                mixed ^= mixed >> np.uint64(32)
                yield mixed * _MULTIPLY


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    return [((grams >> np.uint64(shift)) % np.uint64(SLOTS)).astype(np.int64) for shift in (0, 32)][:HASHES]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """Up to ``per_language`` documents of each of at most MAX_LANGUAGES languages, the first in a hash order.

    Ranks are taken of narrow rows; the chosen ones are few enough to go to the texts.
    """
    order = F.xxhash64(F.lit("language"), "doc_id", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    narrow = labelled.select("lang", "doc_id", order.alias("order"))
    chosen = narrow.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "order").distinct()
    return labelled.withColumn("order", order).join(F.broadcast(chosen), ["lang", "order"], "left_semi").select("lang", "text")


class LanguageFilter:
    """The slots with their language bits, and each language's false positive rate."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages, self.slots = languages, slots  # slots: one row of words per 64 languages
        filled = [float((slots[i >> 6] >> np.uint64(i & 63) & np.uint64(1)).mean()) for i in range(len(languages))]
        self.false_rate = np.array([f**HASHES for f in filled])

    def predict(self, text: str | None) -> tuple[str, float]:
        clean = _letters(text) if isinstance(text, str) else ""
        if not clean or not self.languages:
            return "und", 0.0
        hits, total = np.zeros(len(self.languages)), 0
        for grams in _grams(clean):
            total += len(grams)
            for w, words in enumerate(self.slots):
                found = np.full(len(grams), ~np.uint64(0))
                for slot in _slots(grams):
                    found &= words[slot]
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    hits[i] += np.count_nonzero(found & np.uint64(1 << (i & 63)))
        true = np.maximum(0.0, (hits - total * self.false_rate) / np.maximum(1e-9, 1.0 - self.false_rate))
        best = int(true.argmax())  # the first language of a tie
        every = float(true.sum())
        return self.languages[best], float(true[best] / every) if every else 1.0 / len(self.languages)


def train_filter(docs: DataFrame, per_language: int = TRAIN_DOCUMENTS, max_languages: int = MAX_LANGUAGES) -> LanguageFilter:
    """The filter of a bounded sample of ``docs`` (text, lang); the driver receives its slots, never the grams.

    The sample has at most ``per_language`` documents of each of the ``max_languages`` labels with the most
    documents (equally frequent ones in code point order); rarer labels are not learned.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    languages = sorted(r["lang"] for r in most.collect())
    if len(languages) == max_languages:
        labelled = labelled.filter(F.col("lang").isin(languages))
    sample = _sample(labelled, per_language)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                held, size = [], 0
                for text in [*rows["text"], None]:
                    for grams in _grams(_letters(text)) if text is not None else ():
                        held.append(grams)
                        size += len(grams)
                    if held and (size > FLUSH or text is None):
                        gram, n = np.unique(np.concatenate(held), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})
                        held, size = [], 0

    counted = cut_lineage(
        sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    every = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    by_gram = Window.partitionBy("gram")
    rate = F.col("n") / F.col("total")
    typical = (
        counted.join(F.broadcast(every), "lang")  # a row per language
        .withColumn("rate", rate)
        .withColumn("most", F.max("rate").over(by_gram))
        .filter((F.col("rate") >= MIN_SHARE * F.col("most")) & (F.col("n") >= MIN_COUNT))
        .select("lang", "gram")
    )

    place_of = {lang: i for i, lang in enumerate(languages)}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            i = batch["lang"].map(place_of).to_numpy(dtype=np.int64)
            bit = (np.uint64(1) << (i & 63).astype(np.uint64)).view(np.int64)
            for slot in _slots(batch["gram"].to_numpy().view(np.uint64)):
                yield pd.DataFrame({"word": i >> 6, "slot": slot, "bit": bit})

    bits = typical.mapInPandas(place, "word long, slot long, bit long").groupBy("word", "slot").agg(F.bit_or("bit").alias("bits"))
    slots = np.zeros((max(1, (len(languages) + 63) // 64), SLOTS), dtype=np.uint64)
    filled = bits.toPandas()  # at most SLOTS rows for every 64 languages
    slots[filled["word"].to_numpy(dtype=np.int64), filled["slot"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return LanguageFilter(languages, slots)


def identify_language(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score for every row; the whole text is read, in chunks.

    Null text and text without a letter give ``und`` and score 0, as does a model without languages. Ties
    go to the first language by code point. Equal rows get equal results, an empty table an empty one.
    """
    whole_text_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = LanguageFilter(*shared.value)
        for batch in batches:
            said = [held.predict(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in said], "score": [x[1] for x in said]})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")
