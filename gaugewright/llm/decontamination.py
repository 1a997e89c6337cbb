"""Benchmark decontamination by suffix arrays of the training texts.

Words are runs of letters a-z (A-Z in lower case), digits and characters beyond ASCII. A window is ten consecutive words of
a test item; an item of fewer words, but not none, is one window. A document's word is hit if it lies inside any occurrence
of any window.

Each task cuts its documents into shards of SHARD_WORDS words (a longer document is a shard of its own), builds a shard's
suffix array over word numbers by doubling, and binary-searches every test suffix that holds a window in it: the range that
is left after a window's words holds all places where the window stands, and reading on from such a place gives the longest
verbatim match (:func:`matches`). Words that no test item has end a suffix, so suffixes that could never match are not
sorted. Nothing is shuffled: a document stays in its task, and a hot source or a group of copies is spread as its rows are.

What is sent to all tasks is one block of test items after another, of TEST_BYTES of text each; larger test sets take more
blocks, whose steps are chained over the same rows, each adding to what those before have found.

Defined results: null and empty texts have no words, are kept, and hit nothing; items without words have no windows; an
item id that is null reads as the empty text; rows of one item id are one item; repeated documents are told for each row;
very long texts are read whole; without items nothing is hit; an empty table gives an empty one; other columns pass through
(:func:`decontaminated`) or are ignored. Places count words from 0.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import mapped, spread

#: Words of an item that count as a leak where they stand together.
WINDOW = 10
#: Words of training text in one suffix array.
SHARD_WORDS = 1 << 20
#: Bytes of test items that are sent to the tasks at once.
TEST_BYTES = 4 << 20
#: Pairs of places that are compared at once.
_PAIRS = 1 << 20

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of a text, as UTF-8."""
    return text.translate(_WORD_BYTES).split() if text else []


class Tests:
    """A block of test items: their words as numbers from 1, a 0 after each item, and their different windows."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        text: list[int] = []
        seen: dict[tuple, int] = {}
        self.first: list[int] = []  # of each window: a place where it stands in the items
        self.sizes: list[int] = []
        self.places: list[list[tuple[int, int, int]]] = []  # of each window: (item, place in the item, place in all items)
        for i, t in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)]
            base = len(text)
            text += [*own, 0]
            size = min(window, len(own))
            for k in range(len(own) - size + 1) if own else ():
                w = seen.setdefault(tuple(own[k : k + size]), len(seen))
                if w == len(self.first):
                    self.first.append(base + k)
                    self.sizes.append(size)
                    self.places.append([])
                self.places[w].append((number[i], k, base + k))
        self.items = [np.unique([p[0] for p in at]) for at in self.places]
        self.text = np.array(text, np.int32)
        self.first, self.sizes = np.array(self.first, np.int64), np.array(self.sizes, np.int64)
        self.deepest = int(max((np.diff(np.flatnonzero(np.append([0], self.text) == 0))), default=0))

    def numbers(self, text: bytes | None) -> np.ndarray:
        """A text's words as numbers, 0 for those that no item has."""
        own = words(text)
        return np.fromiter(map(self.vocabulary.get, own, itertools.repeat(0)), np.int32, len(own))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` that hold no 0, in the order of what follows them up to the next 0 or ``depth`` numbers.

    By doubling; only suffixes whose order is still open are sorted again. ``text`` ends with a 0.
    """
    at = np.flatnonzero(text)
    if not len(at):
        return at
    n, most = len(text), int(text.max()) + 1
    key = text[at].astype(np.int64) * most + text[at + 1]
    turn = np.argsort(key, kind="stable")
    order, key = at[turn], key[turn]
    rank = np.zeros(n + 1, np.int64)
    border = np.where(text == 0, np.arange(n), n)
    border = np.minimum.accumulate(border[::-1])[::-1]  # the next 0
    open_at, reach = np.arange(len(order)), 2  # slots of the order whose suffixes may be equal so far

    def settle(slots: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ranks of sorted slots, equal where their keys are; returns the slots that have equals and go on."""
        new = np.append(True, key[1:] != key[:-1])
        heads = slots[new]
        size = np.diff(np.append(np.flatnonzero(new), len(slots)))
        rank[order[slots]] = np.repeat(heads, size) + 1
        return slots[np.repeat(size, size) > 1]

    open_at = settle(open_at, key)
    while reach < depth:
        open_at = open_at[border[order[open_at]] - order[open_at] >= reach]  # those that end just there come first
        if not len(open_at):
            break
        own = order[open_at]
        key = rank[own] * (n + 1) + rank[own + reach]
        turn = np.argsort(key, kind="stable")
        order[open_at] = own[turn]
        open_at = settle(open_at, key[turn])
        reach *= 2
    return order


def _bound(text: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, step: int, above: bool) -> np.ndarray:
    """In each range of the order, whose suffixes share ``step`` numbers: the first place whose next one is not below
    (or is above) the wanted one."""
    low, high = low.copy(), high.copy()
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) >> 1
        found = text[order[middle] + step]
        right = found <= wanted[live] if above else found < wanted[live]
        low[live[right]] = middle[right] + 1
        high[live[~right]] = middle[~right]


def ranges(text: np.ndarray, order: np.ndarray, sought: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of a suffix array whose suffixes begin with the ``sizes`` numbers at ``starts`` of ``sought``."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    for step in range(int(sizes.max(initial=0))):
        live = np.flatnonzero((sizes > step) & (low < high))
        if not len(live):
            break
        wanted = sought[starts[live] + step]
        a = _bound(text, order, low[live], high[live], wanted, step, False)
        low[live], high[live] = a, _bound(text, order, a, high[live], wanted, step, True)
    return low, high


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range and place in the order, for all places of all ranges."""
    size = np.maximum(high - low, 0)
    of = np.repeat(np.arange(len(low)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


class Shard:
    """Some documents' words in one suffix array."""

    def __init__(self, documents: list[np.ndarray], tests: Tests):
        self.tests = tests
        self.starts = np.cumsum([0, *(len(d) + 1 for d in documents)])
        gap = np.zeros(1, np.int32)
        self.text = np.concatenate([x for d in documents for x in (d, gap)] + [gap])
        self.order = suffix_array(self.text, tests.deepest)
        self.low, self.high = ranges(self.text, self.order, tests.text, tests.first, tests.sizes)

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
        """Per document: runs of hit words as (start, end), and numbers of the items with windows in it."""
        n = len(self.starts) - 1
        runs, items = [[] for _ in range(n)], [[] for _ in range(n)]
        window, at = _expanded(self.low, self.high)
        if not len(at):
            return runs, items
        at = self.order[at]
        size = len(self.text) + 1
        cover = np.cumsum(np.bincount(at, minlength=size) - np.bincount(at + self.tests.sizes[window], minlength=size)) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            d = int(np.searchsorted(self.starts, a, "right")) - 1
            runs[d].append((a - int(self.starts[d]), z - int(self.starts[d])))
        document = np.searchsorted(self.starts, at, "right") - 1
        pairs = np.unique(document * len(self.low) + window)
        for d, w in zip((pairs // len(self.low)).tolist(), (pairs % len(self.low)).tolist(), strict=True):
            items[d].append(w)
        return runs, [np.unique(np.concatenate([self.tests.items[w] for w in ws])).tolist() if ws else [] for ws in items]

    def longest(self) -> list[tuple[int, int, int, int, int]]:
        """(document, item, length, place in the document, place in the item) of the longest verbatim match of each item with a
        window in a document; the first in the document, then in the item, among equals."""
        t = self.tests
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        places = [(w, *p) for w in np.flatnonzero(self.high > self.low).tolist() for p in t.places[w]]
        i = 0
        while i < len(places):
            some, total = [], 0  # as many places as there is room for; one place's pairs are at most the shard's words
            while i < len(places) and (not some or total + self.high[places[i][0]] - self.low[places[i][0]] <= _PAIRS):
                total += int(self.high[places[i][0]] - self.low[places[i][0]])
                some.append(places[i])
                i += 1
            w, item, start, sought = (np.array(x, np.int64) for x in zip(*some, strict=True))
            of, at = _expanded(self.low[w], self.high[w])
            at = self.order[at]
            before = np.where(at > 0, self.text[at - 1], 0)
            first = (before == 0) | (sought[of] == 0) | (before != t.text[np.maximum(sought[of] - 1, 0)])  # no match begins further left
            of, at = of[first], at[first]
            size = t.sizes[w[of]].copy()
            live = np.arange(len(of))
            while len(live):
                here, there = self.text[at[live] + size[live]], t.text[sought[of[live]] + size[live]]
                live = live[(here == there) & (here != 0)]
                size[live] += 1
            document = np.searchsorted(self.starts, at, "right") - 1
            for d, k, n, p, q in zip(document.tolist(), item[of].tolist(), size.tolist(), (at - self.starts[document]).tolist(), start[of].tolist(), strict=True):
                now = best.get((d, k))
                if now is None or (-n, p, q) < (-now[0], now[1], now[2]):
                    best[d, k] = (n, p, q)
        return [(d, k, *v) for (d, k), v in sorted(best.items())]


def shards(texts: list[bytes | None], tests: Tests, most: int) -> Iterator[tuple[int, list[np.ndarray], Shard]]:
    """Texts in shards of about ``most`` words: number of the first text, their word numbers, and the shard."""
    held: list[np.ndarray] = []
    begin = size = 0
    for i, t in enumerate(texts):
        numbers = tests.numbers(t)
        if held and size + len(numbers) > most:
            yield begin, held, Shard(held, tests)
            begin, held, size = i, [], 0
        held.append(numbers)
        size += len(numbers)
    if held:
        yield begin, held, Shard(held, tests)


def blocks(tests: DataFrame, window: int = WINDOW, most: int = TEST_BYTES) -> Iterator[Tests]:
    """Test items (item_id, text) by blocks of about ``most`` bytes of text, chosen by id."""
    items = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").cast("binary").alias("t"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 64)).first()[0] or 0
    n = math.ceil(total / most)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b).sort("i", "t").collect()  # a block, bounded by ``most``
        if rows:
            yield Tests([(r.i, bytes(r.t) if r.t is not None else None) for r in rows], window)


def _joined(a: list[dict], b: list[tuple[int, int]]) -> list[dict]:
    """Runs of both lists, overlapping and touching ones as one."""
    out: list[list[int]] = []
    for s, e in sorted([*((x["start"], x["end"]) for x in a), *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"start": s, "end": e} for s, e in out]


_KINDS = [("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]


def _step(rows: DataFrame, tests: Tests, most: int) -> DataFrame:
    """Adds what one block of items hits to the columns text, n_words, runs and items, the last four."""
    box = rows.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, names = b.num_columns - 4, b.schema.names
            for begin, held, shard in shards(b.column(kept).to_pylist(), box.value, most):
                part = b.slice(begin, len(held))
                runs, found = shard.hits()
                was_runs, was_items = part.column(kept + 2).to_pylist(), part.column(kept + 3).to_pylist()
                ids = box.value.ids
                new = [
                    [len(x) for x in held],
                    [_joined(a, r) if r else a for a, r in zip(was_runs, runs, strict=True)],
                    [sorted({*a, *(ids[k] for k in f)}) if f else a for a, f in zip(was_items, found, strict=True)],
                ]
                arrays = [pa.array(x, kind) for x, (_, kind) in zip(new, _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: kept + 1], *arrays], names=names)

    return mapped(rows, run, rows.schema)


def _found(docs: DataFrame, tests: DataFrame, window: int, most: int) -> tuple[DataFrame, list[str]]:
    """The documents' columns as c0.., then text (binary), n_words, runs and items."""
    text = F.col("text").cast("string").cast("binary")
    cols = [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    none = [F.lit(None).cast("long").alias("n_words"), F.array().cast("array<struct<start: long, end: long>>").alias("runs"), F.array().cast("array<string>").alias("items")]
    rows = spread(docs.select(*cols, text.alias("__text"))).select("*", *none)
    given = list(blocks(tests, window)) or [Tests([], window)]
    for block in given:
        rows = _step(rows, block, most)
    return rows, docs.columns


def contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document (docs: doc_id, text; tests: item_id, text): doc_id, n_words, runs of hit words (start, end), n_hit, and the
    sorted ids of the items with windows in it."""
    rows, names = _found(docs.select("doc_id", "text"), tests, window, shard_words)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return rows.select(F.col("c0").alias("doc_id"), "n_words", "runs", hit.alias("n_hit"), "items")


def decontaminated(docs: DataFrame, tests: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents that no window stands in, with all their columns."""
    rows, names = _found(docs, tests, window, shard_words)
    return rows.where(F.size("runs") == 0).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def matches(docs: DataFrame, tests: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The longest verbatim match of each item with a window in a document: doc_id, item_id (as text), n_words, doc_start,
    item_start; rows per document, item and block of items."""
    rows = spread(docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")))
    names = ["item_id", "n_words", "doc_start", "item_start"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    schema = StructType([rows.schema["doc_id"], *StructType.fromDDL("item_id string, n_words long, doc_start long, item_start long").fields])
    out = None
    for block in list(blocks(tests, window)) or [Tests([], window)]:
        box = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], box=box) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for begin, held, shard in shards(b.column(1).to_pylist(), box.value, shard_words):
                    found = shard.longest()
                    ids = b.column(0).slice(begin, len(held)).take(pa.array([f[0] for f in found], pa.int64()))
                    cells = [(box.value.ids[k], n, p, q) for _, k, n, p, q in found]
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array([c[i] for c in cells], kind) for i, kind in enumerate(kinds)]], names=["doc_id", *names])

        one = mapped(rows, run, schema)
        out = one if out is None else out.union(one)
    return out
