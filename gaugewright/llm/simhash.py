"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within ``distance`` bits agree on at least one of ``distance + 1`` blocks of bits, so each distinct
fingerprint goes to one bucket per block; a bucket that is too full is dealt to finer ones by the same argument over the
bits that are still free, as often as needed, so no link is lost and no task gets an unbounded group. In a bucket the
fingerprints are sorted by Gray rank; runs of them become leaves, runs of leaves upper nodes. A node holds the bits that
all below it share and its parent does not have yet; a search goes down level by level, adds up the differing bits and
leaves a whole group as soon as they exceed the distance.

Equal fingerprints are merged before that, and a bucket hands on links to one member of each group it finds (as many as
it has fingerprints, not their pairs). Components follow in :mod:`.components`.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; with fewer words than a
shingle the whole sequence is hashed; repeated rows have the same fingerprint; null ids form no component with others
than by their fingerprint; very long texts are hashed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, mapped, removed, ship, spread, texts, written
from .components import components

WIDTH = 3
DISTANCE = 3
#: Fingerprints of a bucket that are searched together; fuller buckets are divided.
FULL = 4096
_LEAF, _FAN = 8, 8


def fingerprint(found: list[bytes], width: int = WIDTH, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles, repeats included; ties are 0."""
    if not found:
        return 0
    n = max(1, len(found) - width + 1)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(width, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [fingerprint(words_of(t)) for t in texts(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["doc_id", "fp"])


def words_of(text: str) -> list[bytes]:
    return lower_ascii(text.encode("utf-8", "surrogatepass")).split()


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint's 64 bits as a signed long. No shuffle."""
    slim = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return mapped(spread(slim), _fingerprints, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The hierarchical index over distinct fingerprints (uint64)."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints[np.argsort(gray_rank(prints), kind="stable")]
        ones, zeros = self.prints, ~self.prints  # bits that all below have set, or clear
        self.levels = []  # from the leaves up: (shared bits, their pattern, first child)
        step = _LEAF
        while True:
            first = np.arange(0, len(ones), step)
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            self.levels.append((ones | zeros, ones, first))
            if len(ones) == 1:
                break
            step = _FAN
        # what the parent shares is factored out of its children
        for i in range(len(self.levels) - 1):
            mask, ones, first = self.levels[i]
            above = np.repeat(self.levels[i + 1][0], np.diff(np.append(self.levels[i + 1][2], len(mask))))
            self.levels[i] = (mask & ~above, ones, first)
        self.top = self.levels[-1][0]

    def pairs(self, distance: int = DISTANCE, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, of fingerprints that differ in at most ``distance`` bits; in blocks of searches."""
        n = len(self.prints)
        sizes = [len(level[0]) for level in self.levels]
        for at in range(0, n, block):
            query = np.arange(at, min(n, at + block))
            node, differ = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                mask, pattern, first = self.levels[depth]
                differ = differ + np.bitwise_count((self.prints[query] ^ pattern[node]) & mask[node])
                keep = differ <= distance
                query, node, differ = query[keep], node[keep], differ[keep]
                below = sizes[depth - 1] if depth else n
                start, stop = first[node], np.minimum(first[node] + (_FAN if depth else _LEAF), below)
                count = stop - start
                query, differ = np.repeat(query, count), np.repeat(differ, count)
                node = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
                if depth:  # only to the right of the search itself
                    last = np.append(self._last(depth - 1), n)
                    keep = last[node] > query
                    query, node, differ = query[keep], node[keep], differ[keep]
            keep = (node > query) & (np.bitwise_count(self.prints[query] ^ self.prints[node]) <= distance)
            yield query[keep], node[keep]

    def _last(self, depth: int) -> np.ndarray:
        """One past the last fingerprint below each node of a level."""
        width = _LEAF * _FAN**depth
        return np.minimum((np.arange(len(self.levels[depth][0])) + 1) * width, len(self.prints))


def linked(prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) of the groups that a bucket's fingerprints form; as many as members at most."""
    index = GrayIndex(prints)
    root = np.arange(len(index.prints))
    for a, b in index.pairs(distance):
        while True:  # hooking and jumping until the block's pairs agree
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while (jump := root[root]).tobytes() != root.tobytes():
                root = jump
    moved = np.flatnonzero(root != np.arange(len(root)))
    return index.prints[moved], index.prints[root[moved]]


def _blocks(free: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(free, int), parts)]


def _bits(column: str, bits: list[int]):
    """The given bits of a long column, as a masked pattern."""
    mask = sum(1 << b for b in bits)
    return F.col(column).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _searched(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def close() -> pa.RecordBatch | None:
            if not held:
                return None
            a, b = linked(np.concatenate(held).view(np.uint64), distance)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]) if len(a) else None

        for batch in batches:
            block, key, fp = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(key) != 0)) + 1
            for start, stop in zip(np.append(0, cuts), np.append(cuts, len(fp)), strict=True):
                if start == stop:
                    continue
                if (own := (block[start], key[start])) != now:
                    if (made := close()) is not None:
                        yield made
                    now = own
                held.append(fp[start:stop])
        if (made := close()) is not None:
            yield made

    return run


def links(prints: DataFrame, distance: int = DISTANCE, full: int = FULL) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the distance; ``prints``: distinct longs, column fp."""
    spark = prints.sparkSession
    n = distance + 1
    found: list[DataFrame] = []
    # a level's rows: (path, fp); path numbers the blocks chosen so far
    rows = prints.select(F.lit(0).cast("long").alias("path"), "fp")
    chosen: dict[int, list[int]] = {0: []}
    while True:
        after, divided = {}, []
        for path, fixed in chosen.items():
            free = [b for b in range(64) if b not in fixed]
            for i, bits in enumerate(_blocks(free, n)):
                after[path * n + i + 1] = fixed + bits
        options = []
        for path in after:
            options.append(F.when(F.col("path") == (path - 1) // n, F.struct(F.lit(path).cast("long").alias("path"), _bits("fp", after[path]).alias("key"))))
        deeper = rows.select("fp", F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("o")).select("o.path", "o.key", "fp").distinct()
        dealt, at = written(deeper, "buckets")
        sizes = dealt.groupBy("path", "key").count()
        single = {p for p, fixed in after.items() if len(fixed) >= 64 - distance}
        over = sizes.where((F.col("count") > full) & ~F.col("path").isin(*single) if single else F.col("count") > full)
        over, over_at = written(over.select("path", "key"), "full")
        paths = [r[0] for r in over.select("path").distinct().collect()]  # at most 4 ** depth numbers
        fit = dealt.join(over, ["path", "key"], "left_anti") if paths else dealt
        held = fit.repartition("path", "key").sortWithinPartitions("path", "key")
        part, _ = written(mapped(held, _searched(distance), "a long, b long").distinct(), "bucket-links")
        found.append(part)
        rows = None
        if paths:
            rows, _ = written(dealt.join(over, ["path", "key"], "left_semi").select("path", "fp").distinct(), "divided")
        removed(spark, at)
        removed(spark, over_at)
        if not paths:
            break
        chosen = {p: after[p] for p in paths}
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = DISTANCE, with_bits: bool = False) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links; per input row."""
    docs, _ = written(fingerprints(df, id_column, text_column), "fingerprints")
    first, _ = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots, _ = written(components(links(first.select("fp"), distance)), "components")
    labelled = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled, _ = written(labelled, "roots")
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.where("root != fp").join(ids, "root").select("fp", "component_id")
    alone = labelled.where("root = fp").join(ids, "root").select("fp", "component_id")
    rows = docs.join(named.union(alone), "fp", "left")
    return rows.select("doc_id", *(["fp"] if with_bits else []), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay: of each group of near-duplicates the one with the smallest id; all columns.

    Rows are found again by id and fingerprint together, so that rows without an id, or with the same id and another
    fingerprint, are told apart. Of rows that share both, the one whose text comes first in code-point order stays (texts
    that differ in the case of letters have one fingerprint); exact repeats of a row count once.
    """
    ship(df.sparkSession)
    found = near_duplicates(df, id_column, text_column, with_bits=True)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"))
    stay, _ = written(stay, "stay")

    @F.arrow_udf("long")
    def prints(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(words_of(t)) for t in texts(column)], np.uint64).view(np.int64))

    rows = spread(df).withColumn("__fp", prints(F.col(text_column).cast("string"))).withColumn("__id", F.col(id_column).cast("long"))
    kept = rows.alias("d").join(stay.alias("s"), F.col("d.__id").eqNullSafe(F.col("s.__id")) & (F.col("d.__fp") == F.col("s.__fp")), "left_semi")
    alike = Window.partitionBy("__id", "__fp").orderBy(F.col(text_column).cast("string"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return kept.withColumn("__nth", F.row_number().over(alike)).where("__nth = 1").select(*[f"`{c}`" for c in df.columns])
