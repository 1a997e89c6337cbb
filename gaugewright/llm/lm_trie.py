"""Language-model scores from an Elias-Fano n-gram trie.

The model: words, pairs and triples of words of all training documents, with interpolated absolute discounting. With h
for the one or two words before w, and h' for h without its first word,
P(w|h) = max(c(hw) - D, 0) / c(h) + D T(h) / c(h) P(w|h'), and P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); c(h) counts how
often anything follows h, T(h) the different words after h. A text begins after one start mark and closes with an end
token, so its first word has a context of one.

The trie has three levels. The first holds the words' keys, the sums of their counts and the pointers to their
successors, each a monotone sequence in Elias-Fano code, and quantised log-probabilities and back-off weights. The second
holds the successors of all words, relative to their context (its rank, then the successor's code), with pointers to
their own successors, the third the successors of all pairs, relative to the pair's rank; all again in Elias-Fano code,
with quantised discounted probabilities and the pairs' back-off weights. Levels lie in an unlinked temporary file of the
task that builds and uses them, which is memory-mapped. A pair or triple is found by a successor search within its
context's range.

The model grows with the corpus, so no task holds all of it. Documents are read in batches, which are written to the shared
folder once, as numbers, so that whatever is done again reads the same batches; a batch's different words, pairs and
triples, with their counts, go to shards by their first word (one row per batch and shard that it has anything for, so at
most one per different pair). A shard adds the counts up, builds its part of the trie, and answers each batch's row from it; answers go back to
the batch, which adds up its documents' scores. Contexts that a bounded sample shows to be very frequent are dealt to all
shards by successor, so that none gets a hot one alone (a pair's successors stay together); that changes where pairs are counted, not what is counted. A batch
whose answers do not match it raises an error.

Keys are 64-bit hashes (XXH64), successors 40 bits of theirs. Defined results: a null or empty text is the end token
alone; without training documents N and V are 0 and every token is unknown; repeated rows count and are scored each; an
empty table gives no rows; very long texts are read whole, a batch holds one at least; other columns, also ones named like
the result's, are ignored.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, mapped, spread, written

DISCOUNT = 0.75
#: Tokens of a batch, and bytes of text per shard, about.
BATCH_TOKENS = 2_000_000
SHARD_BYTES = 16 << 20
#: Documents, and most contexts, of the list of very frequent contexts; a share of a shard's size from which one is.
HOT_SAMPLE, HOT_MOST, HOT_SHARE = 3000, 1024, 0.5
CODE_BITS = 40
#: Searches in a trie that are made at once.
SEARCHED = 1 << 17
#: Quantisation: log10 values from LOWEST up to HIGHEST in 65,534 steps; code 0 means absent.
LOWEST, HIGHEST = -14.0, 14.0
_STEP = (HIGHEST - LOWEST) / 65_533

END, START = b"", b" "  # no word is empty or holds a space


def key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def quantised(log10: np.ndarray) -> np.ndarray:
    return (np.rint((np.clip(log10, LOWEST, HIGHEST) - LOWEST) / _STEP) + 1).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    """10 to the power of the quantised value; 0 where absent."""
    return np.where(code == 0, 0.0, 10.0 ** ((code.astype(np.float64) - 1) * _STEP + LOWEST))


# --- Elias-Fano -----------------------------------------------------------------------------------------------------
_IN_BYTE = np.zeros((256, 8), np.int64)  # place of the r-th one of a byte
for _b in range(256):
    for _r, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _IN_BYTE[_b, _r] = _p


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values: low bits packed, high parts as gaps of a bit vector."""

    def __init__(self, values: np.ndarray, bits: int):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        self.low_bits = low = int(min(56, max(0, bits - max(0, n - 1).bit_length()))) if n else 0
        highs = (values >> np.uint64(low)).astype(np.int64)
        self.high_parts = int(highs[-1]) + 1 if n else 1
        ones = np.zeros((n + self.high_parts + 64) // 64 * 64, np.uint8)
        ones[highs + np.arange(n)] = 1
        self.words = np.packbits(ones, bitorder="little").view("<u8")
        self.lows = self._packed(values & np.uint64((1 << low) - 1), low)
        per_word = np.bitwise_count(self.words).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(per_word)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @staticmethod
    def _packed(values: np.ndarray, width: int) -> np.ndarray:
        out = []
        for at in range(0, len(values), 1 << 16):  # a multiple of 8 values each, so bytes join
            some = values[at : at + (1 << 16)]
            if width:
                bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
                out.append(np.packbits(bits.ravel(), bitorder="little"))
        return np.concatenate([*out, np.zeros(8, np.uint8)])

    def arrays(self) -> list[str]:
        return ["words", "lows", "ones", "zeros"]

    def _select(self, counts: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (or zero) of the bit vector."""
        at = np.searchsorted(counts, k, side="right") - 1
        rest = k - counts[at]
        x = np.asarray(self.words)[at]
        x = ~x if flip else x
        place = at * 64
        for shift in (32, 16, 8):
            half = x & np.uint64((1 << shift) - 1)
            count = np.bitwise_count(half).astype(np.int64)
            go = rest >= count
            rest = rest - count * go
            x = np.where(go, x >> np.uint64(shift), half)
            place = place + go * shift
        return place + _IN_BYTE[(x & np.uint64(255)).astype(np.int64), rest]

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        byte, off = at >> 3, (at & 7).astype(np.uint64)
        lows = np.asarray(self.lows)
        x = np.zeros(len(i), np.uint64)
        for k in range(8):
            x |= lows[np.minimum(byte + k, len(lows) - 1)].astype(np.uint64) << np.uint64(8 * k)
        return (x >> off) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        if not len(i):
            return np.zeros(0, np.uint64)
        high = self._select(self.ones, i, False) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.low(i)

    def successor(self, x: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Places of the first values that are not below x, within [start, stop)."""
        n = self.n
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        inside = (high >= 0) & (high < self.high_parts)
        h = np.where(inside, high, 0)
        lo = np.where(h > 0, self._select(self.zeros, np.maximum(h - 1, 0), True) - (h - 1), 0) if len(x) else np.zeros(0, np.int64)
        hi = self._select(self.zeros, h, True) - h if len(x) else np.zeros(0, np.int64)
        lo, hi = np.where(inside, lo, n), np.where(inside, hi, n)
        if start is not None:
            lo, hi = np.clip(lo, start, stop), np.clip(hi, start, stop)
        want = x & np.uint64((1 << self.low_bits) - 1)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            below = open_ & (self.low(np.minimum(mid, max(n - 1, 0))) < want)
            lo = np.where(below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)
        return lo


def mapped_to_file(parts: list[tuple[object, str]]) -> None:
    """Put arrays (owner, attribute) into one unlinked temporary file and map them from there."""
    f = tempfile.TemporaryFile()  # noqa: SIM115  open as long as its maps
    places = []
    for owner, name in parts:
        a = np.ascontiguousarray(getattr(owner, name))
        f.write(b"\0" * (-f.tell() % 8))
        places.append((f.tell(), a.dtype, a.shape))
        f.write(a.tobytes())
    f.flush()
    for (owner, name), (at, kind, shape) in zip(parts, places, strict=True):
        if np.prod(shape):
            setattr(owner, name, np.memmap(f, kind, "r", at, shape))


class Trie:
    """A shard's part: ``keys`` (sorted) with counts; pairs (rank of the context << 40 | code, sorted) with counts; triples
    (rank of the pair << 40 | code, sorted) with counts.

    ``hot``: contexts whose successors lie in several shards; their pairs keep log10(c - D), not divided by c(h), and
    their back-off weight is added up elsewhere.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray, hot: np.ndarray):
        n = len(keys)
        self.keys = EliasFano(keys, 64)
        self.sums = EliasFano(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64), 64)
        context = (pairs >> np.uint64(CODE_BITS)).astype(np.int64)
        kinds = np.bincount(context, minlength=n) if n else np.zeros(0, np.int64)
        held = np.bincount(context, weights=pair_counts, minlength=n) if n else np.zeros(0)
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(kinds)]).astype(np.uint64), 64)
        is_hot = np.isin(keys, hot)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.loose = np.where((held > 0) & ~is_hot, quantised(np.log10(DISCOUNT * kinds / held)), 0).astype(np.uint16)
            self.words = quantised(np.log10(counts + 0.5))
            below = np.where(is_hot[context], 1.0, held[context]) if len(pairs) else np.zeros(0)
            self.codes = quantised(np.log10((pair_counts - DISCOUNT) / below)) if len(pairs) else np.zeros(0, np.uint16)
        self.pairs = EliasFano(pairs, CODE_BITS + max(1, int(n).bit_length()))
        context = (triples >> np.uint64(CODE_BITS)).astype(np.int64)
        kinds_of_pair = np.bincount(context, minlength=len(pairs))
        held = np.bincount(context, weights=triple_counts, minlength=len(pairs))
        self.pair_pointers = EliasFano(np.concatenate([[0], np.cumsum(kinds_of_pair)]).astype(np.uint64), 64)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.pair_loose = np.where(held > 0, quantised(np.log10(DISCOUNT * kinds_of_pair / held)), 0).astype(np.uint16)
            self.triple_codes = quantised(np.log10((triple_counts - DISCOUNT) / held[context]))
        self.triples = EliasFano(triples, CODE_BITS + max(1, len(pairs).bit_length()))
        self.kinds_of_hot = [(int(k), int(kinds[i])) for i, k in enumerate(keys) if is_hot[i]] if is_hot.any() else []
        levels = [self.keys, self.sums, self.pointers, self.pairs, self.pair_pointers, self.triples]
        mapped_to_file([(e, a) for e in levels for a in e.arrays()] + [(self, a) for a in ("loose", "words", "codes", "pair_loose", "triple_codes")])

    def word(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rank (-1: unknown), count, word code and back-off code of each key."""
        if not self.keys.n:
            zero = np.zeros(len(keys), np.int64)
            return zero - 1, zero.astype(np.uint64), zero.astype(np.uint16), zero.astype(np.uint16)
        at = self.keys.successor(keys)
        safe = np.minimum(at, self.keys.n - 1)
        known = (at < self.keys.n) & (self.keys.get(safe) == keys)
        count = self.sums.get(safe + 1) - self.sums.get(safe)
        z16 = np.uint16(0)
        return np.where(known, at, -1), np.where(known, count, np.uint64(0)), np.where(known, np.asarray(self.words)[safe], z16), np.where(known, np.asarray(self.loose)[safe], z16)

    @staticmethod
    def _below(pointers: EliasFano, level: EliasFano, rank: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Ranks, in their level, of successors (40-bit codes) of contexts (ranks in the level above); -1: not there."""
        out = np.full(len(rank), -1, np.int64)
        ok = np.flatnonzero(rank >= 0)
        if not len(ok) or not level.n:
            return out
        r = rank[ok]
        start, stop = pointers.get(r).astype(np.int64), pointers.get(r + 1).astype(np.int64)
        x = (r.astype(np.uint64) << np.uint64(CODE_BITS)) | code[ok]
        at = level.successor(x, start, stop)
        found = (at < stop) & (level.get(np.minimum(at, level.n - 1)) == x)
        out[ok] = np.where(found, at, -1)
        return out

    def pair(self, rank: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank, quantised probability and back-off weight of successors of words (ranks); -1 and 0: not in the trie."""
        at = self._below(self.pointers, self.pairs, rank, code)
        return at, _taken(self.codes, at), _taken(self.pair_loose, at)

    def triple(self, rank: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Quantised probability of successors of pairs (ranks); 0: not in the trie."""
        return _taken(self.triple_codes, self._below(self.pair_pointers, self.triples, rank, code))


def _taken(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint16)
    ok = at >= 0
    out[ok] = np.asarray(codes)[at[ok]]
    return out


def relative(context: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Successors' codes after their contexts' places, as they are sorted."""
    if len(context) and int(context.max()) >> (64 - CODE_BITS):
        raise ValueError("more contexts in a shard than places for them")
    return (context.astype(np.uint64) << np.uint64(CODE_BITS)) | code


# --- batches --------------------------------------------------------------------------------------------------------
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, by planes and compressed; sorted unsigned ones as their gaps."""
    out = []
    for a in arrays:
        kind = a.dtype.str
        gaps = kind in ("<u8", "<u4") and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        raw = np.concatenate([a[:1], np.diff(a)]) if gaps else a
        planes = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes() if len(raw) else b""
        data = _ZIP.compress(planes)
        out.append(f"{kind},{len(a)},{int(gaps)},{len(data)};".encode() + data)
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        end = data.index(b";", at)
        kind, n, gaps, size = data[at:end].decode().split(",")
        n, size, at = int(n), int(size), end + 1
        planes = _UNZIP.decompress(data[at : at + size])
        at += size
        a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind)
        out.append(np.cumsum(a, dtype=a.dtype) if gaps == "1" else a)
    return out


def _packed_request(keys: np.ndarray, counts: np.ndarray, *levels: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """Words with counts, then for each level its contexts' places, successors' codes and counts. Codes are sent once and
    numbered: a number takes far fewer bytes than a code."""
    codes, number = np.unique(np.concatenate([code for _, code, _ in levels]), return_inverse=True)
    out, at = [keys, counts.astype("<u8"), codes], 0
    for place, code, n in levels:
        out += [place.astype("<u4"), number[at : at + len(code)].astype("<u4"), n]
        at += len(code)
    return _pack(*out)


def _request(data: bytes) -> tuple[np.ndarray, ...]:
    """Words, their counts, then for each level the successors relative to their contexts, and counts."""
    keys, counts, codes, *levels = _unpack(data)
    out = [keys, counts]
    for i in range(0, len(levels), 3):
        out += [relative(levels[i], codes[levels[i + 1]]), levels[i + 2]]
    return tuple(out)


@dataclass
class Batch:
    """Documents as numbers: ``ids`` of tokens (by ``keys``), documents' lengths, which are for training."""

    doc_ids: np.ndarray
    null_ids: np.ndarray
    train: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray
    keys: np.ndarray

    def prepared(self, shards: int, hot: np.ndarray) -> None:
        n = len(self.keys)
        starts = np.cumsum(self.lengths) - self.lengths
        context = np.empty_like(self.ids)
        context[1:] = self.ids[:-1]
        context[starts] = 1  # the start mark
        self.pair_ids, inverse = np.unique(context.astype(np.int64) * n + self.ids, return_inverse=True)
        self.inverse = inverse.astype(np.int32)
        del context, inverse
        weight = np.repeat(self.train.astype(np.uint8), self.lengths)
        self.counts = np.bincount(self.ids, weights=weight, minlength=n).astype(np.uint64)
        self.counts[1] = self.train.sum()
        self.pair_counts = np.bincount(self.inverse, weights=weight, minlength=len(self.pair_ids)).astype("<u4")
        self.context, word = self.pair_ids // n, self.pair_ids % n
        self.codes = self.keys[word] >> np.uint64(64 - CODE_BITS)
        s = np.uint64(shards)
        self.own = (self.keys % s).astype(np.int64)
        self.hot = np.isin(self.keys, hot)
        self.of_pair = np.where(self.hot[self.context], (self.codes % s).astype(np.int64), self.own[self.context])
        later = np.ones(len(self.ids), bool)
        later[starts] = False
        self.later = later  # tokens with two before them, the start mark included
        lower = self.inverse[later]
        triples = np.empty(len(lower), np.int64)
        triples[:] = self.inverse[np.flatnonzero(later) - 1]
        triples *= n
        triples += self.ids[later]
        ids, inverse = np.unique(triples, return_inverse=True)
        self.triple_inverse = inverse.astype(np.int32)
        del triples, inverse
        self.triple_counts = np.bincount(self.triple_inverse, weights=weight[later], minlength=len(ids)).astype("<u4")
        self.triple_context = (ids // n).astype(np.int32)  # a pair
        self.triple_lower = np.empty(len(ids), np.int32)  # the pair without the first word
        self.triple_lower[self.triple_inverse] = lower
        self.triple_codes = self.codes[self.triple_lower]

    def by_shard(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per shard: its words (numbers sorted by key, contexts of foreign shards included), its pairs and its triples (both
        sorted), and the places of the triples' contexts among these pairs."""
        parts = list(self._words_and_pairs())
        place = np.zeros(len(self.pair_ids), np.int64)
        for start, (_, _, pairs) in zip(np.cumsum([0] + [len(p) for _, _, p in parts]).tolist(), parts, strict=False):
            place[pairs] = np.arange(start, start + len(pairs))
        at = place[self.triple_context]
        if len(place) >> (64 - CODE_BITS):
            triples = np.lexsort((self.triple_codes, at))
        else:
            triples = np.argsort(relative(at, self.triple_codes))
        at, start = at[triples], 0
        for shard, words, pairs in parts:
            lo, hi = np.searchsorted(at, [start, start + len(pairs)])
            yield shard, words, pairs, triples[lo:hi], at[lo:hi] - start
            start += len(pairs)

    def _words_and_pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        order = np.argsort(self.of_pair, kind="stable")
        top = max(int(self.own.max(initial=-1)), int(self.of_pair.max(initial=-1))) + 1
        cuts = np.searchsorted(self.of_pair[order], np.arange(top + 1))
        by_own = np.argsort(self.own, kind="stable")
        own_cuts = np.searchsorted(self.own[by_own], np.arange(top + 1))
        for shard in range(top):
            pairs = order[cuts[shard] : cuts[shard + 1]]
            words = by_own[own_cuts[shard] : own_cuts[shard + 1]]
            if len(foreign := self.context[pairs[self.hot[self.context[pairs]]]]):
                words = np.union1d(words, foreign)
            if not len(words):
                continue
            words = words[np.argsort(self.keys[words])]
            if len(pairs):
                place = np.searchsorted(self.keys[words], self.keys[self.context[pairs]])
                pairs = pairs[np.lexsort((self.codes[pairs], place))]
            yield shard, words, pairs

    def requests(self, shards: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
        self.prepared(shards, hot)
        for shard, words, pairs, triples, above in self.by_shard():
            keys = self.keys[words]
            counts = np.where(self.own[words] == shard, self.counts[words], np.uint64(0))
            place = np.searchsorted(keys, self.keys[self.context[pairs]])
            yield shard, _packed_request(keys, counts, (place, self.codes[pairs], self.pair_counts[pairs]), (above, self.triple_codes[triples], self.triple_counts[triples]))

    def digest(self) -> int:
        h = xxhash.xxh64(self.keys.tobytes())
        h.update(self.ids.tobytes())
        return h.intdigest() >> 1

    def packed(self) -> bytes:
        return _pack(self.doc_ids.astype("<i8"), self.null_ids.astype("|u1"), self.train.astype("|u1"), self.lengths.astype("<i8"), self.ids.astype("<i4"), self.keys)

    @staticmethod
    def unpacked(data: bytes) -> Batch:
        doc_ids, null_ids, train, lengths, ids, keys = _unpack(data)
        return Batch(doc_ids, null_ids.astype(bool), train.astype(np.int64), lengths, ids, keys)

    def scores(self, answers: list[tuple[int, bytes]], shards: int, hot: np.ndarray, hot_kinds: dict[int, int], n_tokens: int, n_words: int) -> dict[str, np.ndarray]:
        """Per document: tokens, known tokens, base score and the model's score."""
        self.prepared(shards, hot)
        got = dict(answers)
        n = len(self.keys)
        count, word_code, loose_code = np.zeros(n, np.uint64), np.zeros(n, np.uint16), np.zeros(n, np.uint16)
        pair_code, pair_loose = np.zeros((2, len(self.pair_ids)), np.uint16)
        triple_code = np.zeros(len(self.triple_context), np.uint16)
        for shard, words, pairs, triples, _ in self.by_shard():
            c, w, g, p, b, t = _unpack(got[shard])
            if len(c) != len(words) or len(p) != len(pairs) or len(t) != len(triples):
                raise ValueError("a batch's answers do not match it")
            own = self.own[words] == shard
            count[words[own]], word_code[words[own]], loose_code[words[own]] = c[own], w[own], g[own]
            pair_code[pairs], pair_loose[pairs], triple_code[triples] = p, b, t
        c = count.astype(np.float64)
        total = n_tokens + 0.5 * (n_words + 1)
        base = np.log10((c + 0.5) / total)
        word = np.where(word_code == 0, 0.5, restored(word_code)) / total
        loose = np.where(c > 0, restored(loose_code), 1.0)
        for i in np.flatnonzero(self.hot & (count > 0)):
            loose[i] = DISCOUNT * hot_kinds.get(int(self.keys[i]), 0) / c[i]
        # the end token is counted like a word but nothing follows it
        own = restored(pair_code)
        is_hot = self.hot[self.context]
        own = np.where(is_hot, own / np.maximum(c[self.context], 1), own)
        second = own + np.where(loose[self.context] > 0, loose[self.context], 1.0) * word[self.pair_ids % n]
        # a pair that nothing followed in training gives all to the shorter context
        above = pair_loose[self.triple_context]
        third = restored(triple_code) + np.where(above > 0, restored(above), 1.0) * second[self.triple_lower]
        logs = np.log10(second)[self.inverse]
        logs[self.later] = np.log10(third)[self.triple_inverse]
        ends = np.cumsum(self.lengths)

        def per_doc(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, ends - self.lengths)

        return {"n_tokens": self.lengths, "n_known": per_doc((count[self.ids] > 0).astype(np.int64)), "base_score": per_doc(base[self.ids]), "score": per_doc(logs)}


def batches_of(rows: Iterator[pa.RecordBatch], tokens: int = BATCH_TOKENS) -> Iterator[tuple[str, Batch]]:
    """Batches (name, batch) of rows (doc_id, text, train); the same rows always give the same batches."""
    context = TaskContext.get()
    part, number = (context.partitionId() if context else 0), 0
    seen: dict[bytes, int] = {END: 0, START: 1}
    doc_ids: list = []
    train: list = []
    lengths: list = []
    ids: list[np.ndarray] = []
    held = 0

    def close() -> tuple[str, Batch]:
        nonlocal seen, doc_ids, train, lengths, ids, held, number
        keys = np.fromiter(map(key, seen), np.uint64, len(seen))
        b = Batch(np.array([d or 0 for d in doc_ids], np.int64), np.array([d is None for d in doc_ids]), np.array(train, np.int64), np.array(lengths, np.int64), np.concatenate(ids).astype(np.int32), keys)
        seen, doc_ids, train, lengths, ids, held = {END: 0, START: 1}, [], [], [], [], 0
        number += 1
        return f"{part}-{number}-{b.digest()}", b

    for batch in rows:
        for doc, text, use in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = lower_ascii((text or "").encode("utf-8", "surrogatepass")).split()
            one = np.zeros(len(found) + 1, np.int32)
            one[:-1] = [seen.setdefault(w, len(seen)) for w in found]
            doc_ids.append(doc)
            train.append(int(use))
            lengths.append(len(one))
            ids.append(one)
            held += len(one)
            if held >= tokens:
                yield close()
    if held:
        yield close()


_ROWS = "kind int, batch string, shard int, payload binary"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "batch", "shard", "payload"])


def _asking(shards: int, hot: np.ndarray):
    """Rows of batches: what each asks of each shard."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for name, data in zip(b.column(1).to_pylist(), b.column(3), strict=True):
                asked = Batch.unpacked(data.as_py()).requests(shards, hot)
                yield _record([(0, name, shard, payload) for shard, payload in asked])

    return run


def _documents(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, b in batches_of(rows):
        yield _record([(1, name, -1, b.packed())])


def _shares(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(x.astype(np.int32), np.cumsum(sizes)[:-1])


def _searched(search, *asked: np.ndarray) -> tuple[np.ndarray, ...]:
    """Results of a search for arrays, some at a time: what it needs beside them stays small."""
    parts = [search(*(a[at : at + SEARCHED] for a in asked)) for at in range(0, max(1, len(asked[0])), SEARCHED)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _answering(hot: np.ndarray):
    """Rows of a shard: add up, build its trie, answer each row; statistics go along as a row of kind 2."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in rows:
            for shard, name, data in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if shard != now:
                    yield from answered(now, held)
                    now, held = shard, []
                held.append((name, data.as_py()))
        yield from answered(now, held)

    def answered(shard: int, held: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        names, asked = [name for name, _ in held], [_request(data) for _, data in held]
        held.clear()
        low, up = np.uint64((1 << CODE_BITS) - 1), np.uint64(CODE_BITS)
        # different words, pairs and triples of all batches, each with its sum; the trie holds and answers for each once
        keys, of_key = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        counts = np.zeros(len(keys), np.uint64)
        np.add.at(counts, of_key, np.concatenate([a[1] for a in asked]))
        by_key = _shares(of_key, [len(a[0]) for a in asked])
        every, of_pair = np.unique(np.concatenate([relative(k[(a[2] >> up).astype(np.int64)], a[2] & low) for k, a in zip(by_key, asked, strict=True)]), return_inverse=True)
        total = np.bincount(of_pair, weights=np.concatenate([a[3] for a in asked]), minlength=len(every))
        by_pair = _shares(of_pair, [len(a[2]) for a in asked])
        after, of_triple = np.unique(np.concatenate([relative(p[(a[4] >> up).astype(np.int64)], a[4] & low) for p, a in zip(by_pair, asked, strict=True)]), return_inverse=True)
        after_total = np.bincount(of_triple, weights=np.concatenate([a[5] for a in asked]), minlength=len(after))
        by_triple = _shares(of_triple, [len(a[4]) for a in asked])
        del asked, of_key, of_pair, of_triple
        pair_above, triple_above = (every >> up).astype(np.int64), (after >> up).astype(np.int64)
        every &= low
        after &= low
        used, after_used = total > 0, after_total > 0
        # only words seen in training (or contexts dealt here) stay, and ranks follow
        stay = counts > 0
        stay[pair_above[used]] = True
        rank, pair_rank = np.cumsum(stay) - 1, np.cumsum(used) - 1
        trie = Trie(
            keys[stay], counts[stay], relative(rank[pair_above[used]], every[used]), total[used],
            relative(pair_rank[triple_above[after_used]], after[after_used]), after_total[after_used], hot,
        )
        del total, used, after_total, after_used
        words = (counts > 0) & (keys != np.uint64(key(START)))
        hot_kinds = np.array(trie.kinds_of_hot, np.uint64).reshape(-1, 2)
        yield _record([(2, f"{int(counts[words].sum())},{int(words.sum())}", shard, _pack(hot_kinds[:, 0].copy(), hot_kinds[:, 1].copy()))])
        r, c, w, g = _searched(trie.word, keys)
        at, codes, loose = _searched(trie.pair, r[pair_above], every)
        (longer,) = _searched(lambda *x: (trie.triple(*x),), at[triple_above], after)
        for name, k, p, t in zip(names, by_key, by_pair, by_triple, strict=True):
            yield _record([(0, name, shard, _pack(c[k].astype("<u8"), w[k], g[k], codes[p], loose[p], longer[t]))])

    return run


def _adding(shards: int, hot: np.ndarray, hot_kinds: dict[int, int], n_tokens: int, n_words: int):
    """Rows of a batch, its documents first: its documents' scores."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, answers = None, None, []
        for b in rows:
            for kind, name, shard, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if name != now:
                    if own is not None:
                        yield done(own, answers)
                    now, own, answers = name, None, []
                if kind == 1:
                    own = data
                else:
                    answers.append((shard, data))
        if own is not None:
            yield done(own, answers)

    def done(own: bytes, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        b = Batch.unpacked(own)
        s = b.scores(answers, shards, hot, hot_kinds, n_tokens, n_words)
        return pa.RecordBatch.from_arrays(
            [pa.array(b.doc_ids, mask=b.null_ids), pa.array(b.train == 0), pa.array(s["n_tokens"]), pa.array(s["n_known"]), pa.array(np.full(len(b.doc_ids), n_tokens)), pa.array(s["base_score"]), pa.array(s["score"])],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def hot_contexts(docs: DataFrame, shards: int) -> np.ndarray:
    """Keys of the contexts that a bounded sample shows to be very frequent. This only guides where pairs are counted."""
    n = docs.count()
    if not n:
        return np.zeros(0, np.uint64)
    some = docs.select("text").where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, HOT_SAMPLE / n)) + 1)

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()
        for b in rows:
            for t in b.column(0).to_pylist():
                known.update(lower_ascii((t or "").encode("utf-8", "surrogatepass")).split())
        total = sum(known.values())
        top = known.most_common(4 * HOT_MOST)
        keys = np.array([key(w) for w, _ in top] + [0], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([c for _, c in top] + [total], pa.int64()), pa.array([False] * len(top) + [True])], ["k", "n", "is_total"])

    rows = mapped(some, count, "k long, n long, is_total boolean").groupBy("is_total", "k").agg(F.sum("n").alias("n")).orderBy(F.desc("is_total"), F.desc("n"), "k").limit(HOT_MOST + 1).collect()
    if not rows or not rows[0]["n"]:
        return np.zeros(0, np.uint64)
    least = HOT_SHARE / shards * rows[0]["n"]
    return np.array([r["k"] for r in rows[1:] if r["n"] > least], np.int64).view(np.uint64)


def scores(df: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; ``training``: a boolean
    column, true for the rows that the model learns from."""
    spark = df.sparkSession
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    hot = hot_contexts(docs, shards)
    batches, _ = written(mapped(spread(docs), _documents, _ROWS), "batches")
    asked = mapped(batches, _asking(shards, hot), _ROWS).repartitionById(shards, "shard").sortWithinPartitions("shard", "batch")
    answers, _ = written(mapped(asked, _answering(hot), _ROWS), "answers")
    told = answers.where("kind = 2")
    totals = told.agg(F.sum(F.split("batch", ",")[0].cast("long")), F.sum(F.split("batch", ",")[1].cast("long"))).first()
    n_tokens, n_words = totals[0] or 0, totals[1] or 0

    def kinds(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            parts = [_unpack(d) for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *(p[i] for p in parts)]).view(np.int64)) for i in (0, 1)], ["k", "n"])

    hot_kinds: dict[int, int] = {}
    if len(hot):  # at most HOT_MOST rows
        hot_kinds = {r["k"] % (1 << 64): r["n"] for r in mapped(told.select("payload"), kinds, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    both = batches.union(answers.where("kind = 0"))
    rows = both.repartition("batch").sortWithinPartitions("batch", F.desc("kind"))
    return mapped(rows, _adding(shards, hot, hot_kinds, n_tokens, n_words), _SCORES)
