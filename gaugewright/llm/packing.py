"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids (and an end id) are cut into full windows and one rest; a very long text is cut like any other. Rests of many documents are dealt to windows by
the largest differencing method: partial partitions wait in a heap by their imbalance (largest minus smallest window);
the two with the largest are merged, the fullest window of one with the emptiest of the other; what is left at the end
has near-equal windows. While a window exceeds the capacity, the number of windows rises and the rests are dealt anew. As cutting is free, :func:`topped_up` then fills the little that is missing from windows that it takes apart,
and the last tokens go to windows whose lengths are powers of two, which need no padding.

Each task packs what it reads in groups of bounded size: no shuffle, and nothing that grows with the table in memory.
Sequence ids are unique: the partition's number, then a count. Defined results: a null or empty text is the end id
alone; repeated rows are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, spread, tokenizer_file

CAPACITY = 2048
END_ID = 1
#: Rests that are dealt together, and tokens that a task holds at most before it deals (beside one document).
GROUP = 4096
HELD_TOKENS = 4_000_000


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows of near-equal sums. Deterministic; ties go to the smaller index.

    A partial partition holds its non-empty windows only; the others count as zero. Each sum is stored above the
    partition's smallest window, which is what differencing leaves of it.
    """
    if k <= 1:
        return [list(range(len(sizes)))] if k else []
    # entry: (-imbalance, number, windows, fullest), windows = heap of [sum, tie, indices]
    heap = [(-s, i, [[s, i, [i]]], s) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a, high = heapq.heappop(heap)
        _, _, b, other = heapq.heappop(heap)
        if len(a) < len(b):
            a, b, high, other = b, a, other, high
        if len(a) + len(b) <= k:
            for w in b:
                heapq.heappush(a, w)
            high = max(high, other)
        elif len(b) == 1:  # one window: it joins the emptiest of the other
            small = a[0] if len(a) == k else [0, number, []]
            joined = [small[0] + b[0][0], small[1], small[2] + b[0][2]]
            (heapq.heapreplace if len(a) == k else heapq.heappush)(a, joined)
            high = max(high, joined[0])
        else:  # the fullest of b meet the windows of a that are empty, then its emptiest, and so on
            a.sort()
            b.sort(reverse=True)
            free = k - len(a)
            for w, more in zip(a, b[free:], strict=False):
                w[0] += more[0]
                w[2] = w[2] + more[2]
            a = a + b[:free]
            heapq.heapify(a)
            high = max(a)[0]
        low = a[0][0] if len(a) == k else 0
        if low:
            for w in a:
                w[0] -= low
        heapq.heappush(heap, (low - high, number, a, high - low))
        number += 1
    out = [sorted(w[2]) for w in heap[0][2]] if heap else []
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows none of which exceeds the capacity (each size must fit); their number rises (by a 64th, by one at
    least) until that holds. No two sizes over half the capacity share a window, so there are at least as many."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    while True:
        dealt = differenced(sizes, k)
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return [w for w in dealt if w]
        k += max(1, k // 64)


Piece = tuple[int, int, int]  # (item, start, length)


def topped_up(dealt: list[list[int]], sizes: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Windows filled to the capacity with cuts of a few that are taken apart; the last tokens at powers of two."""
    full = [[(i, 0, sizes[i]) for i in w] for w in dealt]
    total = sum(sizes)
    keep = total // capacity
    full.sort(key=lambda w: -sum(p[2] for p in w))
    loose = [p for w in full[keep:] for p in w]
    out = []
    for w in full[:keep]:
        gap = capacity - sum(p[2] for p in w)
        while gap:
            item, start, length = loose.pop()
            take = min(gap, length)
            w.append((item, start, take))
            if take < length:
                loose.append((item, start + take, length - take))
            gap -= take
        out.append(w)
    rest = total - keep * capacity
    size = capacity
    while rest:
        while size > rest:
            size //= 2
        w, gap = [], size
        while gap:
            item, start, length = loose.pop()
            take = min(gap, length)
            w.append((item, start, take))
            if take < length:
                loose.append((item, start + take, length - take))
            gap -= take
        out.append(w)
        rest -= size
    return out


#: Fixed value: the public tokenizer's words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of letters that need no normal form but lower case, with marks after them, is one token run each.
_PLAIN = "^(?P<core>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,200})(?P<marks>[.,;:!?#*$%&|]*)$"
#: Words whose ids a worker keeps, and bytes of text that it takes apart at once (or one document).
KEPT_WORDS = 400_000
PART_BYTES = 8 << 20


def checked(spec: dict) -> None:
    """Refuse a tokenizer whose ids of a word could depend on its neighbours, on its case or on the marks after it."""
    normaliser = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    blanks = [n for n in (spec.get("normalizer") or {}).get("normalizers", []) if n["type"] == "Replace"]
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    ok = (
        sorted(normaliser) == ["Lowercase", "NFC", "Replace"]
        and blanks[0]["pattern"] == {"Regex": "\\s+"}
        and blanks[0]["content"] == " "
        and first.get("pattern") == {"Regex": _WORDS}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and spec["model"]["type"] == "BPE"
        and spec["model"].get("end_of_word_suffix") == "</w>"
        and spec["model"].get("dropout") is None
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    )
    if not ok:
        raise ValueError("only tokenizers that lower-case and split texts into words, numbers and marks are supported")


class Encoder:
    """Ids of texts, as ``tokenizers`` gives them, word by word: this tokenizer drops white space and never joins
    across it, so a word's ids do not depend on its neighbours. Different words of many texts are found at once; words of
    letters are looked up in lower case and without the marks after them. Ids are kept, up to a bound."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        checked(json.loads(spec))
        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}  # whole words have a NUL before them

    def _each(self, some: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(some), 8192):
            out += [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some[at : at + 8192], add_special_tokens=False)]
        return out

    def _together(self, some: list[str]) -> list[bytes]:
        """Ids of words of letters: each ends with the first piece that ends a word."""
        out: list[bytes] = []
        for at in range(0, len(some), 1024):
            part = some[at : at + 1024]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.is_end[ids]) + 1) * 4
            if len(ends) != len(part):
                out += self._each(part)
                continue
            raw, begin = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[begin:end])
                begin = end
        return out

    def _learnt(self, keys: list[str]) -> list[bytes]:
        """Ids of lower-case cores, marks, and (after a NUL) whole words."""
        known = self.known
        fresh = [k for k in keys if k not in known]
        if len(known) + len(fresh) > KEPT_WORDS:
            known.clear()
            fresh = keys
        core = [k for k in fresh if k.isalpha()]
        known.update(zip(core, self._together(core), strict=True))
        other = [k for k in fresh if not k.isalpha()]
        known.update(zip(other, self._each([k.removeprefix("\0") for k in other]), strict=True))
        return list(map(known.__getitem__, keys))

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column in a row, and where each text's begin (one more place than texts)."""
        split = pc.ascii_split_whitespace(column)
        coded = split.flatten().dictionary_encode()
        different, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        found = pc.extract_regex(different, _PLAIN)
        plain = found.is_valid()
        core = pc.if_else(plain, pc.utf8_lower(pc.struct_field(found, "core")), pc.binary_join_element_wise("\0", different, ""))
        marks = pc.if_else(plain, pc.struct_field(found, "marks"), "")
        core, marks = core.dictionary_encode(), marks.dictionary_encode()
        pieces = self._learnt(core.dictionary.to_pylist() + marks.dictionary.to_pylist())
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        begin, raw = np.cumsum(size) - size, np.frombuffer(b"".join(pieces), "<u4")
        part = np.empty((len(word), 2), np.int64)
        part[:, 0] = core.indices.to_numpy(zero_copy_only=False)[word]
        part[:, 1] = len(core.dictionary) + marks.indices.to_numpy(zero_copy_only=False)[word]
        part = part.ravel()
        count = size[part]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = raw[np.repeat(begin[part] - ends[:-1], count) + np.arange(ends[-1])]
        offsets = split.offsets.to_numpy()
        return ids, ends[2 * (offsets - offsets[0])]


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder of a tokenizer; it outlives a task (the words it knows do not)."""
    at = zlib.crc32(spec.encode())
    if at not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[at] = Encoder(spec)
    return _ENCODERS[at]


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packer(spec_box, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(spec_box.value)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        rows: list[tuple] = []
        rests: list[tuple] = []  # (doc_id, ids, start of the rest)
        held = 0

        def place(window: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for doc, ids, start, length in window:
                piece = ids[start : start + length]
                rows.append((doc, start, length, zlib.crc32(piece.tobytes()), len(ids), sequence, at, piece.tolist() if with_ids else None))
                at += length
            sequence += 1

        def deal() -> None:
            nonlocal rests, held
            sizes = [len(ids) - start for _, ids, start in rests]
            for w in topped_up(windows(sizes, capacity), sizes, capacity):
                place([(rests[i][0], rests[i][1], rests[i][2] + start, length) for i, start, length in w])
            rests, held = [], 0

        def out() -> pa.RecordBatch:
            nonlocal rows
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array([r[7] for r in rows], pa.list_(pa.int64()))]
            rows = []
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            column = pc.fill_null(b.column(1), "")
            reach = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PART_BYTES, "right")))
                every, places = words.ids(column.slice(at, stop - at))
                for i, doc in enumerate(b.column(0).slice(at, stop - at).to_pylist()):
                    ids = np.append(every[places[i] : places[i + 1]], np.uint32(end_id)).astype("<u4")
                    whole = len(ids) // capacity * capacity
                    for start in range(0, whole, capacity):
                        place([(doc, ids, start, capacity)])
                    if whole < len(ids):
                        rests.append((doc, ids, whole))
                        held += len(ids)
                    if len(rests) >= GROUP or held >= HELD_TOKENS:
                        deal()
                at = stop
                if rows:
                    yield out()
        if rests:
            deal()
        if rows:
            yield out()
        words.known.clear()

    return run


def pack(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: where in its document, where in which sequence; ``with_ids`` adds the ids themselves."""
    with open(tokenizer or tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: 2 MB
    slim = spread(df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")))
    return mapped(slim, _packer(spec, capacity, end_id, with_ids), COLUMNS + (", ids array<long>" if with_ids else ""))
