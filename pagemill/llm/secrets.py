"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Only DataFrame functions. Two first-order models are counted from labelled strings: random ones (values of
the fixed patterns and seeded digests in base64) and ordinary ones (the other tokens of the sample). A long
token is a secret when its log-likelihood ratio per character favours the random model.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

# --- fixed values: the base patterns ---
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
# --- end of fixed values ---
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
#: Tokens shorter than this are never judged by the models.
MIN_TOKEN = 20
#: Mean log-likelihood ratio per character pair (natural logarithm) from which a token is a secret.
MIN_RATIO = 0.7
#: Bound of the labelled sample: about so many documents are read for it, and so many digests made.
TRAIN_DOCUMENTS = 4000
TRAIN_DIGESTS = 4000

_SPAN = "array<struct<s:int,kind:int,e:int>>"


def _all_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost matches, in code points: the texts between matches give the offsets."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("m"), values.alias("v"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = (start + F.length(x["m"])).cast("int")
        span = F.struct(start.cast("int").alias("s"), F.lit(kind).alias("kind"), end.alias("e"))
        keep = F.when(F.length(x["v"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start.cast("int")).alias("at"), keep.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    found = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "assign": _all_spans(text, ASSIGN, 0, 2, 8),
        "access": _all_spans(text, ACCESS, 1),
        "hex": _all_spans(text, HEX, 2),
    }


def train_model(docs: DataFrame, max_documents: int = TRAIN_DOCUMENTS, digests: int = TRAIN_DIGESTS) -> list[float]:
    """Log ratios of the transition probabilities, one for each pair of characters (row = first character).

    Trained from about ``max_documents`` documents (all, if there are fewer) chosen by a hash, and from
    ``digests`` seeded digests. Nothing but pair counts comes to the driver.
    """
    total = docs.count()
    share = min(1.0, max_documents / total) if total else 1.0
    drawn = (F.xxhash64(F.lit("secrets"), "doc_id", "text") / F.lit(2.0**64) + 0.5) < share
    sample = docs.filter(drawn).select(whole("text").alias("text"))
    values = F.concat(
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    found = sample.select(F.explode(values).alias("token"), F.lit(True).alias("random")).filter(F.length("token") >= 8)
    plain = sample.select(
        F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(TOKEN + "{3,}"), F.lit(0)))).alias("token"),
        F.lit(False).alias("random"),
    )
    digest = F.base64(F.unhex(F.sha2(F.concat(F.lit("digest-"), F.col("id").cast("string")), 256)))
    made = docs.sparkSession.range(digests).select(digest.alias("token"), F.lit(True).alias("random"))
    pairs = (
        found.unionByName(made).unionByName(plain)
        .distinct()
        .select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substr("token", i, F.lit(2)))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()  # at most two rows for each pair of characters
    )
    k = len(ALPHABET)
    log = {}
    for label in (True, False):
        counts = [[0] * k for _ in range(k)]
        for row in pairs:
            a, b = ALPHABET.find(row["pair"][0]), ALPHABET.find(row["pair"][1])
            if row["random"] == label and a >= 0 and b >= 0:
                counts[a][b] += row["count"]
        # a rare first character falls back on how often the second one follows at all
        follows = [1 + sum(column) for column in zip(*counts)]
        every = sum(follows)
        log[label] = [[math.log((n + k * follows[b] / every) / (sum(r) + k)) for b, n in enumerate(r)] for r in counts]
    return [log[True][a][b] - log[False][a][b] for a in range(k) for b in range(k)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character pair of a token over the alphabet."""
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    k = len(ALPHABET)

    def mean(c: Column) -> Column:
        n = F.size(c)
        total = F.aggregate(
            F.sequence(F.lit(0), n - 2), F.lit(0.0), lambda acc, i: acc + F.get(weights, F.get(c, i) * k + F.get(c, i + 1))
        )
        return total / (n - 1)

    return F.get(F.transform(F.array(codes), mean), F.lit(0))


def scan_secrets(docs: DataFrame, model: list[float] | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, counts of the base kinds, ``base_sha256``, ``spans`` and ``n_markov`` for every row.

    Base spans are those of the three fixed patterns. The models add each token of ``MIN_TOKEN`` characters
    or more with a digit that lies in no base span and whose ratio is at least ``min_ratio``. Null text is empty: no
    spans, the hash of an empty string. Equal rows get equal results, an empty table an empty result. Of the
    input only doc_id and text are read.
    """
    model = train_model(docs) if model is None else model
    long_token = f"(?<!{TOKEN}){TOKEN}{{{MIN_TOKEN},}}"
    read = docs.select("doc_id", whole("text").alias("text"))
    based = read.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    base = F.sort_array(F.concat("assign", "access", "hex"))

    def judged(base_list: Column) -> Column:
        def secret(x: Column) -> Column:
            inside = F.exists(base_list, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
            token = F.substr("text", x["s"] + 1, x["e"] - x["s"])
            return ~inside & token.rlike("[0-9]") & (log_ratio(token, model) >= min_ratio)

        return F.filter(_all_spans(F.col("text"), long_token, 3), secret)

    added = F.get(F.transform(F.array(base), judged), F.lit(0))
    done = based.select("doc_id", "assign", "access", "hex", base.alias("base"), added.alias("markov"))

    def listed(spans: Column) -> Column:
        line = lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["s"], x["e"])
        return F.array_join(F.transform(spans, line), ",")

    return done.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "markov"))).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )
