"""CSV files cut at byte ranges, with quoted newlines, and with absent cells told from empty ones.

Spark's text source cuts a file into blocks at line ends, but a line end may lie within a quoted cell. So

1. every block says in which state it ends, inside a quoted cell or not, for each state in which it may begin; only lines
   with a quote can change that, and no others leave the JVM. A quote mostly turns the state, so parities of whole batches
   tell it; only lines with quotes in other places are read letter by letter. Files of one block each need no such pass;
2. a prefix over the blocks of each file (one row a block) gives the state in which each begins;
3. every block is cut into records at the line ends outside quotes and read; what a block begins with of an earlier record,
   or ends with of an unfinished one, is put together across blocks and read like the others.

Cells are as Python's csv module reads them: quotes count at a cell's start, doubled ones within it; a quote further on is a
character; lines without any cell are no rows. A cell that a short row lacks is null, an empty one the empty text; cells
beyond the header are dropped. Arrow's parser reads them so too, where all rows are as long as the header; batches with others
go through the csv module. FILE is a file's number in the order of paths, so that no path travels with every line and row.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import zip_longest
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship

FILE, BLOCK, PLACE = "__file", "__block", "__place"
KEY = "__key"  # of a file: its path's hash


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends within a quoted cell; ``inside``: whether it begins in one."""
    at, n, start = 0, len(line), not inside
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            at, inside = at + 1, False
        elif start:
            start = False
            if line.startswith('"', at):
                at, inside = at + 1, True
                continue
        ends = [e for e in (line.find(",", at), line.find("\r", at)) if e >= 0]
        if not ends:
            return False
        at, start = min(ends) + 1, True
        if at >= n:
            return False


class Lines(NamedTuple):
    """Lines as one text, each with its line end, and where they begin (and the text ends)."""

    text: memoryview
    starts: np.ndarray

    @classmethod
    def of(cls, lines: pa.Array) -> Lines:
        sizes = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines.cast(pa.binary())), b"\n")
        return cls(memoryview(joined[0].as_buffer().to_pybytes() + b"\n"), np.concatenate([[0], np.cumsum(sizes)]))

    def line(self, i: int) -> str:
        return str(self.text[self.starts[i] : self.starts[i + 1] - 1], "utf-8")

    def between(self, a: int, z: int) -> memoryview:
        return self.text[self.starts[a] : self.starts[z]]


class Quotes:
    """Where the quotes of lines are, to tell in which states the lines end."""

    def __init__(self, lines: Lines):
        self.lines, n = lines, len(lines.starts) - 1
        data = np.frombuffer(lines.text, np.uint8)
        at = np.flatnonzero(data == ord('"'))
        line = np.searchsorted(lines.starts, at, side="right") - 1
        count = np.bincount(line, minlength=n)
        second = (np.arange(len(at)) - (np.cumsum(count) - count)[line]) % 2 == 1  # of its line: closes what begins outside
        begins = np.isin(np.where(at > 0, data[at - 1], ord("\n")), np.frombuffer(b'\n\r,"', np.uint8))  # may open a cell, or is doubled
        self.turned = np.concatenate([[False], np.cumsum(count) % 2 == 1])  # by all quotes before a line
        self.odd_outside = np.bincount(line[~begins & ~second], minlength=n) > 0  # parity may be wrong for a line that begins outside
        self.odd_inside = np.bincount(line[~begins & second], minlength=n) > 0

    def ends(self, inside: bool) -> np.ndarray:
        """Whether each line ends within a quoted cell, if the first begins so or not."""
        before, after = self.turned[:-1] ^ inside, self.turned[1:] ^ inside
        odd = [np.flatnonzero(np.where(b, self.odd_inside, self.odd_outside)) for b in (before, ~before)]
        off, i, ends = 0, 0, after.copy()  # off: the states are not as parities say from here on
        while (k := np.searchsorted(odd[off], i)) < len(odd[off]):
            at = odd[off][k]
            ends[i:at] ^= bool(off)
            ends[at] = ends_inside(self.lines.line(at), bool(before[at]) ^ bool(off))
            off, i = int(ends[at] != after[at]), at + 1
        ends[i:] ^= bool(off)
        return ends


def records(text: str) -> list[list[str]]:
    """Records of whole lines of text, without those that have no cell."""
    csv.field_size_limit(1 << 31)
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def columns(text: bytes | memoryview, n: int) -> list[pa.Array]:
    """The first ``n`` cells of the records of whole lines of text."""
    if 0 < len(text) < 1 << 30 and not bytes(text[:3]) == b"\xef\xbb\xbf":  # Arrow skips that mark, which is text here
        names = [f"c{i}" for i in range(n)]
        try:
            found = pacsv.read_csv(
                pa.BufferReader(pa.py_buffer(text)),
                pacsv.ReadOptions(use_threads=False, column_names=names, block_size=len(text) + 1),
                pacsv.ParseOptions(newlines_in_values=True),
                pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
            )
            return [pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0) for c in found.columns] if found.num_rows else [pa.array([], pa.string())] * n
        except pa.ArrowInvalid:  # rows of several lengths
            pass
    return _columns(records(str(text, "utf-8")), n)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    file = F.col("_metadata.file_path")
    return rows.select(file.alias(FILE), F.xxhash64(file).alias(KEY), F.col("_metadata.file_block_start").alias(BLOCK), F.col("value").alias("line"))


class Scan(NamedTuple):
    """The blocks of a file or a folder of files: per file, in order, its path, the key by which lines name it, and where its
    blocks begin."""

    path: str
    files: list[tuple[str, int, list[int]]]

    def numbers(self) -> dict[int, int]:
        """A file's number by its key."""
        return {key: i for i, (_, key, _) in enumerate(self.files)}


def scan(spark: SparkSession, path: str) -> Scan:
    """Finds the blocks, in one pass that stays in the JVM."""
    files: dict[tuple[str, int], list[int]] = {}
    for r in _lines(spark, path).select(FILE, KEY, BLOCK).distinct().collect():  # one row a block
        files.setdefault((r[FILE], r[KEY]), []).append(r[BLOCK])
    if len({key for _, key in files}) < len(files):
        raise ValueError(f"two files of {path} have one key")
    return Scan(path, [(*f, sorted(blocks)) for f, blocks in sorted(files.items())])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """A batch's lines by block (the file's key, where it begins); a task may read several."""
    if not batch.num_rows:
        return
    keys, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    new = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, z in zip([0, *new.tolist()], [*new.tolist(), len(blocks)], strict=True):
        yield (int(keys[a]), int(blocks[a])), batch.column(2).slice(a, z - a)


def _quoted_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: the state in which it ends, from outside and from inside quotes, and whether what is open at its beginning
    is closed at one of its line ends."""
    ends: dict[tuple[int, int], tuple[bool, bool, bool]] = {}
    for b in batches:
        for at, lines in _runs(b):
            outside, inside, closed = ends.get(at, (False, True, False))
            quotes = Quotes(Lines.of(lines))
            from_inside = quotes.ends(inside)
            from_outside = from_inside if outside == inside else quotes.ends(outside)
            ends[at] = (bool(from_outside[-1]), bool(from_inside[-1]), closed or not from_inside.all())
    keys = list(ends)
    states = [pa.array([ends[k][i] for k in keys], pa.bool_()) for i in range(3)]
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *states], names=[KEY, BLOCK, "outside", "inside", "closed"])


def _begun_inside(lines: DataFrame, blocks: Scan) -> dict[tuple[int, int], int] | None:
    """Blocks that begin within a quoted cell, and the block in which its record begins; None if none does, as in files of one
    block each."""
    if all(len(starts) == 1 for _, _, starts in blocks.files):
        return None
    found = lines.where(F.col("line").contains('"')).mapInArrow(_quoted_ends, f"{KEY} long, {BLOCK} long, outside boolean, inside boolean, closed boolean").collect()  # one row a block
    ends = {(r[KEY], r[BLOCK]): (r["outside"], r["inside"], r["closed"]) for r in found}
    begun: dict[tuple[int, int], int] = {}
    for _, key, starts in blocks.files:
        open_at = None  # where the record that is open began
        for block in starts:
            outside, inside, closed = ends.get((key, block), (False, True, False))
            if open_at is not None:
                begun[key, block] = open_at
                if not closed:
                    continue
                outside = inside
            open_at = block if outside else None
    return begun or None


def _columns(rows: list[list[str]], n: int) -> list[pa.Array]:
    held = list(zip_longest(*rows, fillvalue=None))[:n]
    return [pa.array(c, pa.string()) for c in held] + [pa.nulls(len(rows), pa.string())] * (n - len(held))


class _Cutter:
    """Cuts the lines of a task's blocks into records."""

    def __init__(self, n: int, begun: dict[tuple[int, int], int] | None):
        self.n, self.begun = n, begun or {}
        self.at: tuple[int, int] | None = None
        self.parts: list[tuple[int, int, int, int | None, str]] = []  # file's key, block of the record, own block, place, text

    def _begin(self, at: tuple[int, int]) -> None:
        self.end()
        self.at, self.inside = at, at in self.begun
        self.head, self.pending = self.inside, []
        self.place = -1 if at[1] == 0 else 0  # the header's place is -1

    def end(self) -> None:
        """What a block leaves unfinished, as a part."""
        if self.at and self.pending:
            self._part()

    def _part(self) -> None:
        key, block = self.at
        text = str(b"".join(self.pending)[:-1], "utf-8")
        self.parts.append((key, self.begun[self.at] if self.head else block, block, None if self.head else self.place, text))
        self.head, self.pending = False, []

    def complete(self, at: tuple[int, int], some: pa.Array) -> list[pa.Array]:
        """Cells of the records that end in these lines of a block."""
        if at != self.at:
            self._begin(at)
        lines, n = Lines.of(some), len(some)
        ends = Quotes(lines).ends(self.inside)
        self.inside = bool(ends[-1])
        over = np.flatnonzero(~ends) + 1  # lines after which no record is open
        first, last = 0, int(over[-1]) if len(over) else 0
        if self.head and last:
            first = int(over[0])
            self.pending.append(bytes(lines.between(0, first)))
            self._part()
        whole: bytes | memoryview = b""
        if last > first:
            whole = b"".join([*self.pending, lines.between(first, last)]) if self.pending else lines.between(first, last)
            self.pending = []
        if last < n:
            self.pending.append(bytes(lines.between(last, n)))
        return columns(whole, self.n)


def rows(spark: SparkSession, blocks: Scan, n: int) -> DataFrame:
    """Rows of a file or a folder of files with a header each: FILE (a number), BLOCK and PLACE (of a record within its block),
    and cells c0.. up to ``n``."""
    ship(spark)
    lines = _lines(spark, blocks.path).select(KEY, BLOCK, "line")
    begun, numbers = _begun_inside(lines, blocks), blocks.numbers()
    cells = [f"c{i}" for i in range(n)]
    names = [FILE, BLOCK, PLACE, *cells]
    schema = f"{FILE} long, {BLOCK} long, {PLACE} long" + "".join(f", {c} string" for c in cells)

    def batch(key: int, block: int, place: int, found: list[pa.Array]) -> pa.RecordBatch:
        k = len(found[0])
        made = [pa.array(np.full(k, numbers[key])), pa.array(np.full(k, block)), pa.array(np.arange(place, place + k)), *found]
        made = pa.RecordBatch.from_arrays(made, names=names)
        return made.slice(1) if place < 0 else made

    def open_ends(cutter: _Cutter) -> Iterator[pa.RecordBatch]:
        for key, block, _, place, text in cutter.parts:
            yield batch(key, block, place, _columns(records(text), n))
        cutter.parts = []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(n, begun)
        for b in batches:
            for at, some in _runs(b):
                found = cutter.complete(at, some)
                if len(found[0]):
                    yield batch(*at, cutter.place, found)
                    cutter.place += len(found[0])
                if begun is None:
                    yield from open_ends(cutter)
        cutter.end()
        if begun is None:  # what is open can only be a file's last record
            yield from open_ends(cutter)

    if begun is None:
        return lines.mapInArrow(cut, schema)

    def unfinished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(n, begun)
        for b in batches:
            for at, some in _runs(b):
                found = cutter.complete(at, some)
                cutter.place += len(found[0])
        cutter.end()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in cutter.parts], k) for i, k in enumerate(kinds)], names=[KEY, BLOCK, "part", PLACE, "text"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, block, place, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                yield batch(key, block, place, _columns(records(text), n))

    parts = lines.mapInArrow(unfinished, f"{KEY} long, {BLOCK} long, part long, {PLACE} long, text string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "\n")
    across = parts.groupBy(KEY, BLOCK).agg(F.max(PLACE).alias(PLACE), whole.alias("text"))  # a record each
    return lines.mapInArrow(cut, schema).union(across.mapInArrow(joined, schema))


def header(spark: SparkSession, blocks: Scan) -> list[str]:
    """Cells of the first record of the first file; none of an empty file or of an empty first line."""
    if not blocks.files:
        return []
    lines = _lines(spark, blocks.path).where((F.col(FILE) == blocks.files[0][0]) & (F.col(BLOCK) == 0))
    n = 1
    while True:
        some = [r["line"] for r in lines.select("line").take(n)]
        inside, held = False, []
        for line in some:
            held.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                return next(iter(csv.reader(io.StringIO("\n".join(held) + "\n", newline=""))), [])
        if len(some) < n:
            return next(iter(csv.reader(io.StringIO("\n".join(held), newline=""))), [])
        n *= 8
