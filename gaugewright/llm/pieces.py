"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

One pass over a text runs the automaton of all pieces; at each position its output links give every piece that ends
there, and each relaxes the position's best path: Viterbi over the lattice of pieces. What a path is worth depends on the
model's kind:

* unigram: the sum of the pieces' scores; a character that no piece covers costs the smallest score less 10. Ties go to
  the longer last piece, as the lattice's forward order has it.
* BPE: pieces have no sum to maximise; a path is worth nothing if two neighbours are not what merging makes of their
  joined characters, and exactly one path of every prefix has no such neighbours: the one that merging gives. So the best
  path is the library's own encoding, found without merging the text. Verdicts on neighbours are kept.

Characters that no piece covers become byte pieces. Pieces hold the space mark only at their start, so a text falls apart
before each run of marks, and the ids of frequent chunks are kept. A model that normalises texts otherwise, has marks
elsewhere or user-defined pieces is refused. Decoding joins pieces and bytes, and takes off the
mark that encoding put first.

Defined results: a null or empty text has no ids and decodes to the empty text; a text's own U+2581 is a space, as in the
library; very long texts are encoded whole, chunk by chunk; repeated rows are each encoded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, mapped, spread, tokenizer_file

SPACE = "\u2581"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_UNKNOWN_PENALTY = 10
_BYTE = re.compile(r"<0x([0-9A-F]{2})>$")
#: Verdicts on neighbours that a worker keeps.
KEPT_PAIRS = 500_000
_UNIGRAM, _BPE = 1, 2
_LOST, _OPEN = -1, -2  # instead of an id: a character that no piece covers; a prefix that no path has reached


class Pieces:
    """The vocabulary of a model file's bytes, with its automaton."""

    def __init__(self, model: bytes, kind: int | None = None):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind = kind or proto.trainer_spec.model_type
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models have pieces to search for")
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("the model normalises texts: only a mark before the text and for each space is supported")
        if proto.trainer_spec.treat_whitespace_as_suffix or any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type == p.NORMAL):
            raise ValueError("only models whose pieces hold the space mark at their start are supported")
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        sp = SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id: dict[int, int] = {}
        self.unknown = sp.unk_id()
        self.score: dict[str, float] = {}
        automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(_BYTE.match(piece)[1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                score = sp.get_score(i)
                self.score[piece] = score = int(score) if score == int(score) else score
                automaton.add_word(piece, (len(piece), i, score))
        automaton.make_automaton()
        self.automaton = automaton
        self.lost = min(self.score.values(), default=0) - _UNKNOWN_PENALTY
        self.single = frozenset(p for p in self.score if len(p) == 1)
        self.of_byte = {i: bytes([b]) for b, i in self.byte_id.items()}
        # bytes below 128 are characters, those above only parts of some
        self.texts = [self.of_byte[i].decode("ascii") if i in self.of_byte and self.of_byte[i] < b"\x80" else p for i, p in enumerate(self.pieces)]
        self.is_part = np.zeros(len(self.pieces), bool)
        self.is_part[[i for i, b in self.of_byte.items() if b >= b"\x80"]] = True
        self.pairs: dict[int, bool] = {}
        self.chunks = Memo(self._chunk, 400_000)

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: join the best-scored neighbours, the leftmost first, as long as there are any."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b as they are side by side (a may be lost, or the text's start)."""
        k = (a + 1) * len(self.pieces) + b
        known = self.pairs.get(k)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            want = [self.pieces[b]] if a < 0 else [self.pieces[a], self.pieces[b]]
            known = self.pairs[k] = self.merged("".join(want)) == want
        return known

    def segments(self, text: str) -> list[tuple[int, int, int]]:
        """The best path over a text with marks: (start, end, id)."""
        n = len(text)
        id_of, start_of = self._merged_path(text) if self.kind == _BPE else self._scored_path(text)
        out = []
        while n:
            out.append((start_of[n], n, id_of[n]))
            n = start_of[n]
        return out[::-1]

    def _merged_path(self, text: str) -> tuple[list[int], list[int]]:
        """Last piece of each prefix, and where it starts, as merging has them."""
        n, size, pairs = len(text), len(self.pieces), self.pairs
        id_of, start_of = [_OPEN] * (n + 1), [0] * (n + 1)
        id_of[0] = _LOST
        if not self.single.issuperset(text):
            for at, c in enumerate(text):
                if c not in self.single:
                    id_of[at + 1], start_of[at + 1] = _LOST, at
        for last, (length, i, _) in self.automaton.iter(text):
            end = last + 1
            if id_of[end] != _OPEN:
                continue
            start = end - length
            before = id_of[start]
            fits = pairs.get((before + 1) * size + i)
            if self.neighbours(before, i) if fits is None else fits:
                id_of[end], start_of[end] = i, start
        return id_of, start_of

    def _scored_path(self, text: str) -> tuple[list[int], list[int]]:
        """Last piece of each prefix's path with the largest sum, and where it starts."""
        n, at = len(text), 0
        id_of, start_of, best = [_OPEN] * (n + 1), [0] * (n + 1), [0] * (n + 1)

        def uncovered(upto: int) -> None:
            nonlocal at
            while at < upto:
                value = best[at] + self.lost
                if text[at] not in self.single and (id_of[at + 1] == _OPEN or value > best[at + 1]):
                    id_of[at + 1], start_of[at + 1], best[at + 1] = _LOST, at, value
                at += 1

        for last, (length, i, score) in self.automaton.iter(text):
            end = last + 1
            uncovered(last)
            start = end - length
            value = best[start] + score
            if id_of[end] == _OPEN or value > best[end] or (value == best[end] and start < start_of[end]):
                id_of[end], start_of[end], best[end] = i, start, value
        uncovered(n)
        return id_of, start_of

    def _chunk(self, chunk: str) -> bytes:
        n = len(chunk)
        id_of, start_of = self._merged_path(chunk) if self.kind == _BPE else self._scored_path(chunk)
        ids: list[int] = []  # from the end
        while n:
            i, start = id_of[n], start_of[n]
            if i >= 0:
                ids.append(i)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in reversed(chunk[start:n].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(self.unknown)
            n = start
        ids.reverse()
        return array("I", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        marked = SPACE + text.replace(" ", SPACE)
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, _CHUNK.findall(marked))), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        if not self.is_part[ids].any():  # every id is a text of its own
            return "".join(map(self.texts.__getitem__, ids.tolist())).removeprefix(SPACE).replace(SPACE, " ")
        parts, texts, of_byte = [], self.texts, self.of_byte
        raw = bytearray()

        def flush() -> None:
            if raw:
                parts.append(raw.decode("utf-8", "surrogatepass" if b"\xed" in raw else "replace"))
                raw.clear()

        for i in ids.tolist():
            b = of_byte.get(i)
            if b is not None:
                raw += b
                continue
            flush()
            parts.append(texts[i])
        flush()
        return "".join(parts).removeprefix(SPACE).replace(SPACE, " ")


_LOADED: dict[int, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The worker's vocabulary of a model; it outlives a task, as do its verdicts (the chunks it knows do not)."""
    at = zlib.crc32(model)
    if at not in _LOADED:
        _LOADED.clear()
        _LOADED[at] = Pieces(model)
    return _LOADED[at]


def _coded(box, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(box.value)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                ids = pieces.encode(text or "")
                back = pieces.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), len(back), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or "").replace(SPACE, " "), ids.tolist() if with_ids else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64())][: 6 if with_ids else 5]
            names = ["n_pieces", "ids_sha256", "decoded_chars", "decoded_sha256", "same_text", "ids"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])
        pieces.chunks.clear()

    return run


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per row: number and digest of its ids (little-endian unsigned 32-bit), length and digest of the text decoded from
    them, whether that is the text again, and the ids. No shuffle."""
    with open(model or tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        box = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: half a MB
    slim = spread(df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")))
    schema = "doc_id long, n_pieces long, ids_sha256 string, decoded_chars long, decoded_sha256 string, same_text boolean"
    return mapped(slim, _coded(box, with_ids), schema + (", ids array<long>" if with_ids else ""))


def decode(df: DataFrame, ids_column: str = "ids", model: str | None = None) -> DataFrame:
    """The rows with ``decoded``, the text of their ids (null ids: the empty text)."""
    with open(model or tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        box = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = loaded(box.value)
        for column in batches:
            yield pa.array([pieces.decode(np.array(ids or [], "<u4")) for ids in column.to_pylist()], pa.string())

    return df.withColumn("decoded", text(F.col(ids_column)))
