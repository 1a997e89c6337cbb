"""Draws of a seeded generator, made in tasks: the same numbers as ``numpy.random.default_rng(seed).integers(0, n, size)``.

That stream takes 32-bit words, two from each step of the generator (the low half first), and turns a word w into the number
w * n >> 32, unless the low half of that product is below 2^32 mod n: such words are rejected, so that all numbers are
equally likely (Lemire, 2019). Whether a word counts depends on the word alone. So each task jumps to its own stretch of
words and counts those that stand; a prefix over these counts (one a stretch) says which draw each stretch begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ship

#: Words in a stretch; even, since steps make two.
STRETCH = 1 << 18


def words(seed: int, start: int, n: int) -> np.ndarray:
    """``n`` words of the stream from an even place on."""
    generator = np.random.PCG64(seed)
    generator.advance(start // 2)
    return generator.random_raw(-(-n // 2)).astype("<u8").view("<u4")[:n]


def accepted(w: np.ndarray, n: int) -> np.ndarray:
    """The numbers below ``n`` (2^32 at most) that these words stand for, without rejected words."""
    product = w.astype(np.uint64) * np.uint64(n)
    return (product >> np.uint64(32)).astype(np.int64)[(product & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)]


def _stretches(spark: SparkSession, a: int, z: int) -> DataFrame:
    return spark.range(a, z, 1, max(1, min(z - a, 4 * spark.sparkContext.defaultParallelism)))


def counted(spark: SparkSession, seed: int, n: int, total: int, stretch: int = STRETCH) -> list[int]:
    """Where each stretch begins in the draws, for stretches enough to hold ``total`` of them, and where the last one ends."""
    if not (1 << 32) % n:  # no word is rejected
        return [i * stretch for i in range(-(-total // stretch) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_pylist()
            sizes = [len(accepted(words(seed, i * stretch, stretch), n)) for i in at]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["id", "n"])

    begin = [0]
    while begin[-1] < total:
        left = (total - begin[-1]) / (1 - ((1 << 32) % n) / (1 << 32))
        a = len(begin) - 1
        rows = _stretches(spark, a, a + int(left // stretch) + 1).mapInArrow(run, "id long, n long").collect()  # one number a stretch
        for r in sorted(rows, key=lambda r: r["id"]):
            begin.append(begin[-1] + r["n"])
    return begin


def times(spark: SparkSession, n: int, repetitions: int, seed: int, stretch: int = STRETCH) -> DataFrame:
    """(repetition, place, times): how often each of ``n`` places is drawn in each repetition of ``n`` draws. A repetition that
    two stretches share has rows of both."""
    if n == 1:  # a single place takes no words
        return spark.range(repetitions).select(F.col("id").alias("repetition"), F.lit(0).cast("long").alias("place"), F.lit(1).cast("long").alias("times"))
    ship(spark)
    total = n * repetitions
    begin = counted(spark, seed, n, total, stretch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                place = accepted(words(seed, i * stretch, stretch), n)[: max(0, total - begin[i])]
                repetition = (begin[i] + np.arange(len(place))) // n
                at, often = np.unique(repetition * n + place, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at // n), pa.array(at % n), pa.array(often.astype(np.int64))], names=["repetition", "place", "times"])

    return _stretches(spark, 0, len(begin) - 1).mapInArrow(run, "repetition long, place long, times long")
