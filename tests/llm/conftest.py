import pytest

EXTRA = {"_row": "x", "n_words": 1, "_lines": "y", "mix_size": "z", "h": 2, "_gone": "g", "fp": 3, "root": 4}


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, lang, source]) rows; ``extra`` adds columns with clashing names."""

    def build(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s") for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        df = df.selectExpr("*", "cast(length(text) as long) as n_chars")
        if extra:
            from pyspark.sql import functions as F

            for name, value in EXTRA.items():
                df = df.withColumn(name, F.lit(value))
        return df

    return build


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


LONG = " ".join(f"wort{i % 997}" for i in range(60_000))
#: null, empty, blank, one word, a tie, equal rows, very long, rows without an id
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "word", "de", "b"), (5, "same text here", "en", "a"),
    (6, "same text here", "en", "a"), (7, "equal row", "fr", "b"), (7, "equal row", "fr", "b"), (8, LONG, "de", "a"),
    (None, "no id here", "en", "c"), (None, None, None, None), (9, "é" * 300, "fr", "ü"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD, extra=True)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
