"""Quality rules as a bitmask ledger.

:func:`ledger` measures every text once and evaluates every rule once; what it stores per row is the measurements and
one integer whose bit *i* is set if rule *i* failed. A :class:`Policy` is a versioned choice of rules, applied to a
stored ledger by one bitwise AND, without reading texts again. :func:`ablation` tells what each rule costs, from the
counts of the distinct masks (there are at most 2**len(RULES) of them, whatever the input's size).

Defined results: a null or empty text has no words and fails ``too_few_words``; repeated rows are each measured; very
long texts are measured whole, in time linear in them; an empty table gives an empty ledger; other columns, also ones named like a measurement, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAKS, mapped, ship, spread, words

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_digits")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: A rule's place is its bit; rules are only ever appended, so that stored masks keep their meaning.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_density", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", "n_letters > 0 AND 10 * n_upper > 3 * n_letters"),
    Rule("mean_word_length", "word_chars > 25 * n_words OR 2 * word_chars < 3 * n_words"),
    Rule("digit_density", "2 * n_digits > word_chars AND word_chars > 0"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("strict-1", BASE.rules + ("symbol_density", "shouting")), Policy("strict-2", tuple(BIT)))}
DEFAULT = POLICIES["strict-2"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(WORD_BREAKS.encode())] = True


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    found = words(text)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    lines = [x for x in text.split("\n") if x.strip(WORD_BREAKS)]
    upper, lower = by_byte[65:91].sum(), by_byte[97:123].sum()
    return (
        len(found),
        len(text) - int(by_byte[_BREAK].sum()),
        int(by_byte[_SYMBOL].sum()),
        len(lines),
        len(lines) - len(set(lines)),
        repeated(found),
        int(upper + lower),
        int(upper),
        int(by_byte[48:58].sum()),
    )


def repeated(found: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more."""
    if len(found) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int64, len(found))
    key = ids[: len(ids) - width + 1]
    for i in range(1, width):  # pairs are renumbered before they grow, so that nothing overflows
        key = np.unique(key, return_inverse=True)[1] * len(seen) + ids[i : len(ids) - width + 1 + i]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.concatenate([count[inverse] > 1, np.zeros(width - 1, bool)])
    covered = twice.copy()
    for i in range(1, width):
        covered[i:] |= twice[:-i]
    return int(covered.sum())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t) for t in b.column(1).to_pylist()]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *MEASURES])


def mask(rules: tuple[Rule, ...] = RULES, within: str | None = None) -> Column:
    """The failure bits of a row of measurements, which lie in columns or in a struct column's fields (``within``)."""
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        fails = r.fails if within is None else re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"`{within}`.\1", r.fails)
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, the measurements and ``fail_bits``. No shuffle."""
    slim = spread(df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")))
    measured = mapped(slim, _measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("fail_bits", mask())


def apply_policy(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` of a policy to a ledger; a row that the base rules fail is never kept."""
    hit = lambda p: F.col("fail_bits").bitwiseAND(F.lit(p.mask)) != 0
    return rows.withColumns({"base_failed": hit(BASE), "kept": ~(hit(BASE) | hit(policy))})


def ablation(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per rule of a policy: rows it fails, rows that fail it alone (they come back if it goes), and rows that stay.

    Masks are counted first, so that what follows works on at most 2**len(RULES) rows.
    """
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])
    each = masks.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy("rule", "bit").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total(F.col("bits") == 0).alias("n_kept"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        F.sum("n").alias("n_rows"),
    )


def measured_struct(text: Column) -> Column:
    """The measurements of a text column as one struct, for filters that keep a row's own columns."""
    kind = pa.struct([(m, pa.int64()) for m in MEASURES])

    @F.arrow_udf(", ".join(f"{m} long" for m in MEASURES))
    def measures(column: pa.Array) -> pa.Array:
        rows = [measure(t) for t in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))], fields=list(kind))

    return measures(text)


def passing(df: DataFrame, policy: Policy = DEFAULT, text_column: str = "text") -> DataFrame:
    """The rows whose texts a policy keeps, with all their columns and no others."""
    ship(df.sparkSession)
    name = "__measured"
    while name in df.columns:
        name += "_"
    rows = spread(df).withColumn(name, measured_struct(F.col(text_column).cast("string")))
    return rows.where(mask(within=name).bitwiseAND(F.lit(policy.mask | BASE.mask)) == 0).select(*[f"`{c}`" for c in df.columns])
