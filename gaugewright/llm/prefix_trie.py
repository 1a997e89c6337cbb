"""The prefix trie of conversations: each distinct sequence of first turns is a node.

**Rebuilding.** Conversation c takes the first h turns of conversation c - c%100 (the SQL remainder, which has the sign of c),
then its own turns after its first h; h is crc32(decimal c) % HEADS.

**Fingerprints.** Turn k of a conversation has the term H(role, text) * B^-k modulo 2^64, B odd; the sum of the first k terms
is the fingerprint of the first k turns. The sums are numpy scans over turns that lie sorted in ranges of (conv_id, turn), so
a hot conversation is many ranges; what it carries from range to range, two rows a range, is added afterwards. Sums subtract
and shift, so fingerprints of rebuilt conversations follow from those of the parts. There are two of 64 bits.

**Verification.** Conversations with equal depth and fingerprint make a group, whose representative is its smallest one. Their
last turns are held against the representative's, text by text. Equal last terms leave equal fingerprints one turn before, so
if all groups agree, all prefixes are equal, turn by turn. Where a group disagrees, it is split by its last texts, and so is
every later group of its members, by all such splits before it.

**Rollup.** A node belongs to its smallest member; the nodes of one conversation are the end of its path. What a conversation's
own nodes sum to is added to every prefix of it at once, as a SQL ROLLUP does, so that the work doesn't grow with the depth.

Defined results: turns are ordered by turn (null first), then role, then text; a null role or text is empty; repeated rows are
turns of their own; rows without conv_id take no part; a conversation without turns after rebuilding is a member of the root
only; an empty table has no nodes; very long texts are compared whole; other columns are ignored. Characters are code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, written

#: Turns that a conversation takes from another are fewer than this.
HEADS = 6
#: Depths in one block of a conversation's own nodes, when they are summed from their end.
BLOCK = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_B = 0x9E3779B97F4A7C15
_INVERSE = pow(_B, -1, 1 << 64)
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of a number modulo 2^64, by tables of low and high digits."""

    LOW = 1 << 12

    def __init__(self, base: int):
        self.base = base
        self.low = self._table(base, self.LOW)
        self.high = self.low[:1]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))

    def __call__(self, k: np.ndarray) -> np.ndarray:
        top = int(k.max(initial=0)) // self.LOW + 1
        if top > len(self.high):
            self.high = self._table(pow(self.base, self.LOW, 1 << 64), 2 * top)
        return self.low[k % self.LOW] * self.high[k // self.LOW]


def _lanes(bits: int) -> tuple[Column, Column]:
    """Two hashes of a turn; fewer ``bits`` only serve to test what happens when they collide."""
    mask = F.lit(_mask(bits)).cast("long")
    return F.xxhash64("role", "text").bitwiseAND(mask).alias("ha"), F.xxhash64(F.lit("b"), "text", "role").bitwiseAND(mask).alias("hb")


_SCANNED = "conv_id long, part int, place long, role string, text string, chars long, ta long, tb long, sa long, sb long, edge boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and their sums along each conversation's turns within this range, and two rows more: what the first and the
    last conversation of the range have come to (edge)."""
    power, part = _Powers(_INVERSE), TaskContext.get().partitionId()
    now, place, sums = None, 0, [np.uint64(0), np.uint64(0)]
    edges: dict[int, tuple] = {}
    first = None
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column(0).to_numpy()
        begin = np.append(True, conv[1:] != conv[:-1])
        start = np.maximum.accumulate(np.where(begin, np.arange(len(conv)), 0))
        k = np.arange(len(conv)) - start + 1
        goes_on = conv == now if now is not None else np.zeros(len(conv), bool)
        goes_on &= start == 0
        k = k + np.where(goes_on, place, 0)
        out = []
        for i in (0, 1):
            term = b.column(4 + i).to_numpy().view(np.uint64) * power(k)
            run = np.cumsum(term, dtype=np.uint64)
            run -= (run - term)[start]  # what stood before the conversation
            run[goes_on] += sums[i]
            out.append((term, run))
        if first is None:
            first = int(conv[0])
        ends = np.flatnonzero(np.append(begin[1:], True))
        for e in {int(ends[0]), int(ends[-1])}:
            c = int(conv[e])
            if c == first or e == ends[-1]:
                edges[c] = (int(k[e]), int(out[0][1][e]), int(out[1][1][e]))
        now, place, sums = int(conv[-1]), int(k[-1]), [out[0][1][-1], out[1][1][-1]]
        for c in [c for c in edges if c not in (first, now)]:
            del edges[c]
        n = len(conv)
        signed = [pa.array(x.view(np.int64)) for x in (out[0][0], out[1][0], out[0][1], out[1][1])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(n, part, np.int32)), pa.array(k), b.column(1), b.column(2), b.column(3), *signed, pa.array(np.zeros(n, bool))], names=_names(_SCANNED))
    rows = [(c, part, n, None, None, 0, 0, 0, _signed(a), _signed(z), True) for c, (n, a, z) in edges.items()]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=_names(_SCANNED))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def scanned(rows: DataFrame, bits: int = 64) -> tuple[DataFrame, dict[int, tuple[int, int, int, int]]]:
    """Turns (conv_id, turn, role, text) with their place and fingerprint within their range, written once, and by range the
    conversation that goes on there from earlier ranges (its first one, if any), with what that has come to."""
    spark = rows.sparkSession
    clean = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    clean = clean.select("*", F.length("text").cast("long").alias("chars"), *_lanes(bits), F.monotonically_increasing_id().alias("given"))
    keys = ["conv_id", "turn", "role", "text", "given"]  # the last one parts rows that are all alike
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = clean.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conv_id", "role", "text", "chars", "ha", "hb")
    out, _ = written(mapped(dealt, _scan, _SCANNED), "turns")
    before: dict[int, tuple[int, int, int, int]] = {}
    held: dict[int, tuple[int, int, int]] = {}
    for e in sorted(out.where("edge").select("conv_id", "part", "place", "sa", "sb").collect(), key=lambda e: e.part):  # two a range at most
        so_far = held.get(e.conv_id)
        if so_far:
            before[e.part] = (e.conv_id, *so_far)
        n, a, b = so_far or (0, 0, 0)
        move = pow(_INVERSE, n, 1 << 64)
        held[e.conv_id] = (n + e.place, (a + move * e.sa) & _MASK, (b + move * e.sb) & _MASK)
    return out.where("NOT edge").drop("edge"), before


def _carried(conv: np.ndarray, part: np.ndarray, before: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: turns before its range, the power that moves its terms, and the two sums before."""
    n, move = np.zeros(len(conv), np.int64), np.ones(len(conv), np.uint64)
    sums = [np.zeros(len(conv), np.uint64), np.zeros(len(conv), np.uint64)]
    for p in np.unique(part).tolist():
        if p in before:
            c, k, a, b = before[p]
            at = (conv == c) & (part == p)
            n[at], move[at] = k, pow(_INVERSE, k, 1 << 64)
            sums[0][at], sums[1][at] = a, b
    return n, move, *sums


def _whole(b: pa.RecordBatch, before: dict) -> list[np.ndarray]:
    """place, term a, term b, sum a, sum b along whole conversations, of a batch that begins with conv_id, part, place, ta, tb,
    sa, sb."""
    conv, part, place = (b.column(i).to_numpy() for i in range(3))
    ta, tb, sa, sb = (b.column(i).to_numpy().view(np.uint64) for i in range(3, 7))
    n, move, a, c = _carried(conv, part, before)
    return [place + n, ta * move, tb * move, sa * move + a, sb * move + c]


_LOCAL = ["conv_id", "part", "place", "ta", "tb", "sa", "sb"]


def conversations(turns: DataFrame, before: dict) -> DataFrame:
    """Per conversation: conv_id, n, and its first turns (place, characters, fingerprint), HEADS - 1 at most."""
    spark = turns.sparkSession
    box = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, _, _, sa, sb = _whole(b, box.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place), b.column(7), pa.array(sa.view(np.int64)), pa.array(sb.view(np.int64))], ["conv_id", "place", "chars", "fa", "fb"])

    rows = mapped(turns.select(*_LOCAL, "chars"), run, "conv_id long, place long, chars long, fa long, fb long")
    early = F.when(F.col("place") < HEADS, F.struct("place", "chars", "fa", "fb"))
    return rows.groupBy("conv_id").agg(F.max("place").alias("n"), F.sort_array(F.collect_list(early)).alias("heads"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Per conversation: h, the turns ``m`` it takes from its base, its length, and the fingerprints that its own first turns
    (oa, ob) and its base's (na, nb) have come to."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    base = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    rows = convs.select("conv_id", "n", "heads", h.cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base")).join(base, "base", "left")
    rows = rows.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    rows = rows.withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long")))
    at = lambda heads, k, lane: F.coalesce(F.get(heads, (k - 1).cast("int"))[lane], F.lit(0).cast("long"))
    own = F.least("h", "n")
    return rows.select(
        "conv_id", "h", "m", "length", "base_heads",
        at(F.col("heads"), own, "fa").alias("oa"), at(F.col("heads"), own, "fb").alias("ob"),
        at(F.col("base_heads"), F.col("m"), "fa").alias("na"), at(F.col("base_heads"), F.col("m"), "fb").alias("nb"),
    )


_PREFIX = "conv_id long, depth long, fa long, fb long, pa long, pb long, chars long, is_end boolean"
_KEY = ["depth", "fa", "fb", "split"]


def _mask(bits: int) -> int:
    return (1 << (bits - 1)) - 1 if bits < 64 else -1


def own_turns(turns: DataFrame, before: dict, convs: DataFrame, bits: int = 64) -> DataFrame:
    """Turns that stay in their own conversation, as the prefixes that end with them, with role and text: those after the first
    h, and all turns of bases, which are rebuilt as they are."""
    box = turns.sparkSession.sparkContext.broadcast(before)
    mask = np.uint64(_mask(bits) & _MASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = _Powers(_B)
        for b in batches:
            place, ta, tb, sa, sb = _whole(b, box.value)
            h, m, length, *given = (b.column(i).to_numpy() for i in range(10, 17))
            oa, ob, na, nb = (x.view(np.uint64) for x in given)
            first = place <= h
            depth = np.where(first, place, place - h + m)
            move = up(np.where(first, 0, h - m))
            out = []
            for s, t, o, n in ((sa, ta, oa, na), (sb, tb, ob, nb)):
                whole = np.where(first, s, (s - o) * move + n)
                out += [whole & mask, (whole - t * move) & mask]
            signed = [pa.array(out[i].view(np.int64)) for i in (0, 2, 1, 3)]
            made = pa.RecordBatch.from_arrays([b.column(0), pa.array(depth), *signed, b.column(7), pa.array(depth == length), b.column(8), b.column(9)], names=[*_names(_PREFIX), "role", "text"])
            yield made.filter(pa.array(~first | (b.column(0).to_numpy() % 100 == 0)))

    rows = turns.join(convs.select("conv_id", "h", "m", "length", "oa", "ob", "na", "nb"), "conv_id")
    cells = rows.select(*_LOCAL, "chars", "role", "text", "h", "m", "length", "oa", "ob", "na", "nb")
    return mapped(cells, run, f"{_PREFIX}, role string, text string")


def prefixes(own: DataFrame, convs: DataFrame, bits: int = 64) -> DataFrame:
    """All prefixes of rebuilt conversations, the empty ones too, without texts; ``source``: whose turn the last one is."""
    mask = F.lit(_mask(bits)).cast("long")
    zero = F.lit(0).cast("long")
    taken = convs.where("conv_id % 100 != 0 AND m > 0").select("conv_id", "length", F.col("base_heads").alias("b"), F.posexplode(F.slice("base_heads", 1, F.col("m").cast("int"))).alias("k", "t"))
    last = lambda lane: F.when(F.col("k") > 0, F.get("b", F.col("k") - 1)[lane]).otherwise(zero).bitwiseAND(mask)
    borrowed = taken.select(
        "conv_id", F.col("t.place").alias("depth"), F.col("t.fa").bitwiseAND(mask).alias("fa"), F.col("t.fb").bitwiseAND(mask).alias("fb"), last("fa").alias("pa"), last("fb").alias("pb"),
        F.col("t.chars").alias("chars"), (F.col("t.place") == F.col("length")).alias("is_end"), (F.col("conv_id") - F.col("conv_id") % 100).alias("source"),
    )
    none = F.lit(None).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("fa"), zero.alias("fb"), none.alias("pa"), none.alias("pb"), zero.alias("chars"), (F.col("length") == 0).alias("is_end"), none.alias("source"))
    return own.select(*_names(_PREFIX), F.col("conv_id").alias("source")).unionByName(borrowed).unionByName(roots)


def verified(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Prefixes with ``split`` (empty unless a group's last texts differ from its representative's) and that of their parent."""
    group = ["depth", "fa", "fb"]
    different = own.groupBy(*group, "role", "text").agg(F.min("conv_id").alias("first"))
    unequal = different.groupBy(*group).agg(F.count("*").alias("n"), F.min("first").alias("representative")).where("n > 1")
    if unequal.isEmpty():
        return rows.withColumns({"split": F.lit(""), "parent_split": F.lit("")})
    unequal, _ = written(unequal, "unequal")
    classes = different.join(unequal, group).where("first != representative").select(*group, "role", "text", "first")
    moved = own.join(classes, [*group, "role", "text"]).select(F.col("conv_id").alias("source"), "depth", "first")
    path = Window.partitionBy("conv_id").orderBy("depth")
    told = F.when(F.col("first").isNotNull(), F.concat_ws(":", "depth", "first"))
    joined = rows.join(moved, ["source", "depth"], "left")
    upto = lambda w: F.concat_ws(",", F.collect_list(told).over(w))
    return joined.withColumns({"split": upto(path.rowsBetween(Window.unboundedPreceding, 0)), "parent_split": upto(path.rowsBetween(Window.unboundedPreceding, -1))}).drop("first")


def _before(nodes: DataFrame) -> DataFrame:
    """Adds ``above``: the sum of ``weight`` over the same conversation's nodes at lesser depths. By blocks of depths, so that
    one long conversation is many tasks."""
    rows = nodes.withColumn("block", F.floor(F.col("depth") / BLOCK))
    inner = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "block").agg(F.sum("weight").alias("w")).withColumn("carried", F.sum("w").over(outer)).where("carried IS NOT NULL").drop("w")
    within = rows.withColumn("above", F.coalesce(F.sum("weight").over(inner), F.lit(0).cast("long")))
    return within.join(sums, ["conv_id", "block"], "left").withColumn("above", F.col("above") + F.coalesce("carried", F.lit(0).cast("long"))).drop("carried", "block")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's sorted ids; holds one state, not the ids."""
    now, state = None, None
    rows: list[tuple] = []

    def closed() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], [*_KEY, "sha"])
        rows.clear()
        return done

    for b in batches:
        *keys, ids = (b.column(i).to_pylist() for i in range(5))
        for key, i in zip(zip(*keys, strict=True), ids, strict=True):
            if key != now:
                if state:
                    rows.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(str(i).encode())
            else:
                state.update(f",{i}".encode())
        yield closed()
    if state:
        rows.append((*now, state.hexdigest()))
    yield closed()


def trie(rows: DataFrame, bits: int = 64) -> DataFrame:
    """The trie's nodes of conversations (conv_id, turn, role, text): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (characters that members share over the whole subtree), ends_sha256."""
    turns, before = scanned(rows, bits)
    convs, _ = written(rebuilt(conversations(turns, before)), "conversations")
    own, _ = written(own_turns(turns, before, convs, bits), "own")
    every, _ = written(verified(prefixes(own, convs, bits), own), "prefixes")
    nodes, _ = written(
        every.groupBy(*_KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
            F.min("parent_split").alias("ps"), F.count_if("is_end").alias("n_ends"), F.min(F.when(F.col("is_end"), F.col("conv_id"))).alias("end"),
        ).withColumn("weight", (F.col("n_convs") - 1) * F.col("chars")),
        "nodes",
    )
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb"), F.col("ps").alias("split")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    counted = _before(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    totals = counted.groupBy("conv_id").agg(F.sum("weight").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    rolled = every.join(totals, "conv_id").groupBy(*_KEY).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("split").alias("ps"), F.col("conv_id").alias("parent_conv_id"))
    shared = every.where("is_end").join(nodes.where("n_ends > 1").select(*_KEY), _KEY).select(*_KEY, "conv_id")
    ends = mapped(shared.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id"), _digested, "depth long, fa long, fb long, split string, sha string")
    sha = F.when(F.col("n_ends") == 0, F.lit(EMPTY_SHA)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256)).otherwise(F.col("sha"))
    return (
        counted.join(rolled, _KEY).join(parents, ["depth", "pa", "pb", "ps"], "left").join(ends, _KEY, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved") - F.col("above")).alias("saved_tokens"), sha.alias("ends_sha256"))
    )
