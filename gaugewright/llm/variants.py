"""Spelling variants by full neighbourhood generation.

Words are maximal runs of letters (A-Z in lower case), counted over whole texts. Every word emits all its different
neighbours, that is every deletion, every replacement and every insertion over the letters observed, and an equi-join of
these candidates with the vocabulary finds those that are words. Candidates are at distance one by construction, so nothing
is verified. Neighbours are different by construction too: of equal letters in a row only the first is deleted, a letter is
inserted before its equals only, and never replaced by itself.

A word of ten letters has some nine hundred candidates, of which few are words. Their hashes (polynomials of the word's
letters, of which each edit changes one term) are made by numpy, and a Bloom filter of the vocabulary, FILTER_BYTES at most,
drops nearly all that are no words before any text is made or shuffled. It never drops a word, and what it lets through is
settled by the join, so its size changes only the work. Candidates of a key are bounded by the key's own neighbourhood, and a
word's counts are summed before each shuffle.

A word's form is its near word of largest count (ties: the first in code-point order) if that is at least RATIO times its own;
the root follows forms to the last. Each form has RATIO times the count at least, so paths are short and doubling them a few
times, as many as the largest count allows, reaches every root.

Defined results: null and empty texts have no words; a null id reads as empty; repeated rows count each; very long texts and
words are read whole; an empty table or too few occurrences give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, removed, spread, written

#: Code points in a word, its occurrences, and how much more often its form must occur.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many (document, run) pairs loses a letter, by its checksum; 0 leaves all as they are.
SLIP = 199
#: Largest filter that is sent to the tasks, and its bits a word while it is smaller than that.
FILTER_BYTES, FILTER_BITS = 32 << 20, 24
#: Words that a task counts before it hands their counts on, and candidates that are made at once.
_COUNTED, _SLAB = 400_000, 1 << 17

# Letters of runs are code points below 256, so a text's runs are found in its Latin-1 bytes, where others become "?";
# bytes.lower() changes A-Z alone.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def slipped(head: int, run: bytes, slip: int) -> bytes:
    """A run (Latin-1, lower case) as it counts in a document; ``head``: checksum of the id and a colon."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
    if slip and h % slip == 0:
        k = h % len(run)
        return run[:k] + run[k + 1 :]
    return run


def vocabulary(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Words of the texts (doc_id, text) and their occurrences: word, n."""
    rows = spread(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t")))
    runs_of = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                if (t := t.as_py()) is None:
                    continue
                head = zlib.crc32(f"{i.as_py()}:".encode())
                own: dict[bytes, int] = {}
                for m in runs_of.finditer(t.encode("latin-1", "replace").lower()):
                    own[m[0]] = own.get(m[0], 0) + 1
                for r, n in own.items():
                    w = slipped(head, r, slip)
                    if len(w) >= least_length:
                        counts[w] = counts.get(w, 0) + n
                if len(counts) >= _COUNTED:
                    yield _counted(counts)
                    counts = {}
        yield _counted(counts)

    return mapped(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _powers(n: int) -> np.ndarray:
    """1, b, b^2 ... modulo 2^64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))


def letters(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of each length: their numbers, and their letters as a matrix."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer("".join(words[i] for i in at).encode("latin-1"), np.uint8).reshape(len(at), n)


def hashes(grid: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words of one length."""
    n = grid.shape[1]
    return ((grid.astype(np.uint64) + np.uint64(1)) * _powers(n)[n - 1 :: -1][:n]).sum(1, dtype=np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a hash's independent numbers."""
    h = (h + np.uint64(k)) * _STEPS[0]
    h ^= h >> np.uint64(29)
    h *= _STEPS[1]
    return h ^ (h >> np.uint64(32))


class Filter:
    """A Bloom filter of hashes: slices of bits, each word's bits in one slice."""

    SLICES = 256

    def __init__(self, n: int, most: int = FILTER_BYTES, bits: int = FILTER_BITS):
        self.width = max(8, min(most, n * bits // 8 + 1) // self.SLICES * 8)  # bits of a slice
        self.probes = max(1, min(12, round(0.69 * self.width * self.SLICES / max(n, 1))))
        self.bits = np.zeros(0, np.uint8)

    def slice_of(self, h: np.ndarray) -> np.ndarray:
        return (mixed(h, 0) >> np.uint64(56)).astype(np.int64)

    def places(self, h: np.ndarray, k: int) -> np.ndarray:
        return (((mixed(h, k + 1) >> np.uint64(32)) * np.uint64(self.width)) >> np.uint64(32)).astype(np.int64)

    def slice(self, h: np.ndarray) -> bytes:
        """Bits of the slice that these hashes, all of one slice, make."""
        on = np.zeros(self.width, np.uint8)
        for k in range(self.probes):
            on[self.places(h, k)] = 1
        return np.packbits(on).tobytes()

    def holding(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the hashes that may be in it."""
        left = np.arange(len(h))
        base = self.slice_of(h) * self.width
        for k in range(self.probes):
            bit = base[left] + self.places(h[left], k)
            left = left[(self.bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1]
        return left


def filter_of(words: DataFrame, n: int, most: int = FILTER_BYTES, bits: int = FILTER_BITS) -> Filter:
    """The filter of a vocabulary of ``n`` words. Each slice is made by one task and fetched as bits: FILTER_BYTES in all."""
    made = Filter(n, most, bits)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            for _, grid in letters(own):
                h = hashes(grid)
                yield pa.RecordBatch.from_arrays([pa.array(made.slice_of(h)), pa.array(h.view(np.int64))], ["slice", "h"])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for s in np.unique(at).tolist():
                bits = np.frombuffer(made.slice(h[at == s]), np.uint8)
                held[s] = bits | held[s] if s in held else bits
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "bits"])

    rows = mapped(mapped(words.select("word"), hashed, "slice long, h long").repartition("slice"), sliced, "slice long, bits binary").collect()
    whole = np.zeros((Filter.SLICES, made.width // 8), np.uint8)
    for r in rows:
        whole[r["slice"]] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    made.bits = whole.reshape(-1)
    return made


def neighbours(grid: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Neighbours of words of one length by parts: kind ("-", "=" or "+"), first place, hashes by (word, place, letter), and
    which of them repeat the word itself or another neighbour.

    A hash is that of the word with one term changed, or of the parts before and after a place, one power apart.
    """
    m, n = grid.shape
    power = _powers(n + 1)
    one, code = np.uint64(1), alphabet.astype(np.uint64) + np.uint64(1)
    terms = (grid.astype(np.uint64) + one) * power[n - 1 :: -1][:n]
    after = np.concatenate([np.cumsum(terms[:, ::-1], 1, dtype=np.uint64)[:, ::-1], np.zeros((m, 1), np.uint64)], 1)  # of what begins at a place
    whole = after[:, :1]
    before = whole - after  # of what ends before it, with its powers in the word
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    previous = np.concatenate([np.zeros((m, 1), np.uint8), grid], 1)  # no letter is 0
    yield "-", 0, (before[:, :n] * inverse + after[:, 1:])[:, :, None], (grid == previous[:, :n])[:, :, None]
    step = max(1, _SLAB // (m * max(1, len(alphabet))))
    for p in range(0, n, step):
        z = min(n, p + step)
        yield "=", p, (whole - terms[:, p:z])[:, :, None] + (code * power[n - z : n - p][::-1, None])[None], grid[:, p:z, None] == alphabet
    for p in range(0, n + 1, step):
        z = min(n + 1, p + step)
        yield "+", p, (before[:, p:z] * _BASE + after[:, p:z])[:, :, None] + (code * power[n + 1 - z : n + 1 - p][::-1, None])[None], previous[:, p:z, None] == alphabet


def edited(word: str, place: int, letter: str, kind: str) -> str:
    return word[:place] + ("" if kind == "-" else letter) + word[place + (kind != "+") :]


def candidates(words: DataFrame, alphabet: bytes, bloom: Filter) -> DataFrame:
    """(candidate, word) for every neighbour of every word that the filter doesn't drop."""
    box = words.sparkSession.sparkContext.broadcast(bloom)
    signs = np.frombuffer(alphabet, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = box.value
        for b in batches:
            own = b.column(0).to_pylist()
            for at, grid in letters(own):
                step = max(1, _SLAB // (grid.shape[1] * max(1, len(signs))))
                for s in range(0, len(at), step):
                    made: list[tuple[str, str]] = []
                    for kind, base, h, repeats in neighbours(grid[s : s + step], signs):
                        kept = bloom.holding(h.ravel())
                        kept = kept[~repeats.ravel()[kept]]
                        w, p, c = np.unravel_index(kept, h.shape)
                        for i, place, letter in zip(at[w + s].tolist(), (p + base).tolist(), c.tolist(), strict=True):
                            made.append((edited(own[i], place, chr(signs[letter]), kind), own[i]))
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.string()) for k in (0, 1)], ["candidate", "word"])

    return mapped(words.select("word"), run, "candidate string, word string")


def near(words: DataFrame) -> DataFrame:
    """Pairs of near words: word, near, near_n (the near word's count). ``words``: word, n, as :func:`vocabulary` has them."""
    signs = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()  # as many as there are letters: 90 at most
    alphabet = bytes(sorted(ord(r.c) for r in signs if r.c))
    made = candidates(words, alphabet, filter_of(words, words.count()))
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), F.col("candidate") == F.col("near")).select("word", "near", "near_n")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word with its near words' number and its form: word, n, n_near, form, form_n (null without one)."""
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w"))))
    none = words.select("word", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"), "n")
    rows = near(words).withColumn("n", F.lit(None).cast("long")).unionByName(none).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("b"))
    taken = -F.col("b.k") >= F.lit(ratio) * F.col("n")
    return rows.select("word", "n", "n_near", F.when(taken, F.col("b.w")).alias("form"), F.when(taken, -F.col("b.k")).alias("form_n"))


def rooted(formed: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Adds ``root``: the last word that forms lead to. Rounds double the steps taken; the largest count bounds them."""
    most = formed.agg(F.max("n")).first()[0] or 1
    steps = max(1, int(math.log(most, ratio)) + 1)
    at = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    path = None
    for _ in range(math.ceil(math.log2(steps))):
        far = at.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        was = path
        at, path = written(at.join(far, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root")), "roots")
        if was:
            removed(at.sparkSession, was)
    return formed.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """Every word with its count, near words, form and root: word, n, n_near, form, form_n, root."""
    words, _ = written(vocabulary(docs, slip, least_length, least_count), "vocabulary")
    formed, _ = written(forms(words, ratio), "forms")
    return rooted(formed, ratio)
