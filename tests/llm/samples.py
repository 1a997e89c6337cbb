"""Small tables for the training-data operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"

#: Nulls, empty texts, ties and repeated rows, texts of one very long word and of many words, odd characters.
ODD = [
    (1, None), (2, ""), (3, "one two three"), (4, "one two three"), (4, "one two three"), (None, "no id here"), (5, " \n\t "), (6, "x" * 50_000),
    (7, "a b c " * 5_000), (8, "\U0001f600 emoji \u2581 \ufb01 \u0130 \u03a3\u03a3 \u00e9\u0301"), (9, "\x1cab\x85c \u00a0 d"), (-3, "Token = \"0123456789abcdef0123456789abcdef\" end"),
]


def odd(spark: SparkSession) -> DataFrame:
    """The odd rows, with more columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src", len(t or ""), 1.5, True, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, fp string")


def empty(spark: SparkSession) -> DataFrame:
    return odd(spark).where("false")


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ba", "ke", "lo", "mi", "tu", "sha")) for _ in range(r.randint(1, 3))) for _ in range(n))
