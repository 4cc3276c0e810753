"""Documents with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

from tidepanel.llm.workers import ship_package

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


def odd_rows():
    rng = random.Random(7)
    words = "alpha beta gamma delta über naïve don't 42 x".split()

    def prose(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words) + r.choice(["", "", ",", ".\n"]) for _ in range(n))

    base = prose(120, 1)
    long = " ".join(f"{rng.choice(words)}{rng.randrange(999)}" for _ in range(20_000))
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, None, "de", "b"), (None, base, "en", None), (4, "", None, "b"),
        (5, "  \t ", None, None), (5, "  \t ", None, None), (6, "...!? 123", "en", "c"), (7, long, "en", "c"), (7, long + " tail", "de", "a"),
        (8, base + " one more word", "en", "b"), (9, "ab" * 600, "xx", "b"), (10, "É é ß", "de", None), (None, None, None, None),
        (11, prose(60, 3) + "\n\n" + prose(90, 1), "en", "a"), (12, "two  spaces\n \nand\tтест 中文 <|endoftext|>", "ru", "a"), (13, "word", None, "b"), (14, "word", None, "b"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string").repartition(3)
    for name in ("n", "key", "name", "_row", "size", "gram", "fp", "pattern", "first", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
