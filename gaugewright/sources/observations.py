"""Observation tables: one row per paired sample, from CSV or Parquet, with their order kept.

A CSV's cells stay text and are parsed where they are used. Columns are bound by position, so that repeated names (the
last one counts), names that differ in case, and names with dots are told apart. A DataFrame has no order; every row
carries its file, the place of its block in that file, and its number within the block.

A CSV file is cut at byte ranges, quoted newlines or not (:mod:`.delimited`). Null is a cell that a row doesn't have; an empty
cell is the empty text.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from ..functions.columns import parsed, quoted, stripped
from . import delimited
from .delimited import BLOCK, FILE, PLACE


def at_scheme(path: str) -> bool:
    return "://" in path


@dataclass
class Observations:
    """Rows with their order; ``names`` as the header has them, ``at`` the column that holds each (the last of equals)."""

    spark: SparkSession
    label: str
    names: list[str]
    cells: DataFrame | None  # rows as they are, for what needs no order
    at: dict[str, str]
    kinds: dict[str, str]
    problem: str | None = None
    counted: bool = True  # PLACE counts rows within a block
    storage: StorageLevel | None = None  # where rows that are read several times are kept; none: they are read again
    ordering: Callable[[DataFrame], DataFrame] | None = None  # adds FILE, BLOCK and PLACE, where ``cells`` have none

    @cached_property
    def rows(self) -> DataFrame | None:
        """Rows with FILE, BLOCK and PLACE. Finding the blocks' borders can take a pass, which is only made if this is asked for."""
        return self.ordering(self.cells) if self.ordering else self.cells

    def only(self, names: list[str]) -> Observations:
        """The same rows with the columns that hold these names, and their order."""
        held = dict.fromkeys(self.at[n] for n in names if n in self.at)
        kept = self.rows.select(*[quoted(c) for c in held], *[c for c in (FILE, BLOCK, PLACE) if c not in held])
        return replace(self, cells=kept, ordering=None)

    def kept(self) -> Observations:
        """The same rows, kept in the block store where ``storage`` says so."""
        return replace(self, cells=self.rows.persist(self.storage), ordering=None) if self.storage and self.cells is not None else self

    def cell(self, name: str) -> Column:
        return quoted(self.at[name])

    def number(self, name: str) -> Column:
        return parsed(self.cell(name), self.kinds[self.at[name]])

    def text(self, name: str) -> Column:
        return stripped(self.cell(name))

    @property
    def order(self) -> list[Column]:
        return [F.col(FILE), F.col(BLOCK), F.col(PLACE)]

    def numbered(self, rows: DataFrame, wanted: DataFrame) -> dict[tuple, int]:
        """Row numbers (the first row is 2) of a few wanted rows: from the row counts of blocks, or, where columns order
        the rows, from the rows before each."""
        found = wanted.select(FILE, BLOCK, PLACE).collect()
        key = lambda r: (r[FILE], r[BLOCK], r[PLACE])
        if not self.counted:
            names = getattr(wanted.schema[PLACE].dataType, "names", None)
            place = lambda r: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r[PLACE], strict=True)]) if names else F.lit(r[PLACE])
            before = rows.agg(*[F.count_if(F.col(PLACE) < place(r)).alias(f"n{i}") for i, r in enumerate(found)]).first() if found else ()
            return {key(r): before[i] + 2 for i, r in enumerate(found)}
        blocks = rows.groupBy(FILE, BLOCK).agg(F.count("*").alias("n"), F.min(PLACE).alias("first")).orderBy(FILE, BLOCK).collect()
        before, at = 2, {}
        for b in blocks:  # as many as splits
            at[b[FILE], b[BLOCK]] = before - b["first"]
            before += b["n"]
        return {key(r): at[r[FILE], r[BLOCK]] + r[PLACE] for r in found}


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumns({FILE: F.col("_metadata.file_path"), BLOCK: F.col("_metadata.file_block_start"), PLACE: F.monotonically_increasing_id()})


def _missing(path: str) -> str | None:
    if at_scheme(path):
        return None
    try:
        with open(path, "rb"):
            return None
    except IsADirectoryError:
        return None
    except OSError as e:
        return str(e)


def read(spark: SparkSession, path: str | os.PathLike) -> Observations:
    """A CSV file (or folder of them), or Parquet where the name says so. Cells of a CSV are worth keeping once they are cut
    out; columns of a Parquet file are better read again."""
    path = str(path) if at_scheme(str(path)) else str(Path(path).expanduser().resolve())
    if problem := _missing(path):
        return Observations(spark, path, [], None, {}, {}, problem)
    if path.rstrip("/").endswith(".parquet"):
        return bound(spark.read.parquet(path), path, files=True)
    try:
        blocks = delimited.scan(spark, path)
        names = delimited.header(spark, blocks)
    except Exception as e:  # whatever the store says
        return Observations(spark, path, [], None, {}, {}, str(e).splitlines()[0])
    if not names:
        return Observations(spark, path, [], None, {}, {})
    held = [f"c{i}" for i in range(len(names))]
    rows = delimited.rows(spark, blocks, len(names))
    return Observations(spark, path, names, rows, dict(zip(names, held, strict=True)), dict.fromkeys(held, "string"), storage=StorageLevel.MEMORY_AND_DISK)


def bound(df: DataFrame, label: str = "dataframe", order: list[str] | None = None, files: bool = False) -> Observations:
    """A DataFrame as observations. ``order``: columns that order its rows, of which the first also deals them to blocks;
    without them, the order they are read in, which holds only as long as the DataFrame is read alike each time (as from
    files; not behind a shuffle)."""
    kinds = {n: "string" if k == "string" else k for n, k in df.dtypes}
    names = df.columns

    def ordering(rows: DataFrame) -> DataFrame:
        if order:
            place = quoted(order[0]) if len(order) == 1 else F.struct(*[quoted(c) for c in order])
            return rows.withColumns({FILE: F.lit(""), BLOCK: block_of(rows, order[0]), PLACE: place})
        if files:
            return _ordered(rows)
        return rows.withColumns({FILE: F.lit(""), BLOCK: F.spark_partition_id().cast("long"), PLACE: F.monotonically_increasing_id()})

    return Observations(df.sparkSession, label, names, df, {n: n for n in names}, kinds, counted=not order, ordering=ordering)


def block_of(df: DataFrame, column: str) -> Column:
    """The block of a row by its place in the order: ranges of the first ordering column with about as many rows each.

    Borders are chosen once, as the column's approximate quantiles, and are part of the plan, so every reading deals alike;
    where they lie changes no result. Rows with the same value share a block; columns that are no numbers, times or texts
    make one block.
    """
    blocks = min(1024, max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kind = df.schema[column].dataType
    if isinstance(kind, StringType):  # texts: borders from a sample by hash
        n = df.count()
        some = df.select(quoted(column).alias("v")).where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 16 * blocks / max(n, 1))) + 1)
        values = sorted(r["v"] for r in some.where("v IS NOT NULL").limit(64 * blocks).collect())
        ends = [values[i * len(values) // blocks] for i in range(1, blocks)] if values else []
        value = quoted(column)
    elif isinstance(kind, NumericType | DateType | TimestampType | TimestampNTZType):
        value = quoted(column) if isinstance(kind, NumericType) else F.unix_date(quoted(column)) if isinstance(kind, DateType) else F.unix_micros(quoted(column).cast("timestamp"))
        ends = df.agg(F.percentile_approx(value.cast("double"), F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), 4 * blocks)).first()[0] or []
        value = value.cast("double")
    else:
        return F.lit(0).cast("long")
    ends = sorted({e for e in ends if e == e})

    def between(low: int, high: int) -> Column:  # by halves: as many comparisons a row as the number of blocks has bits
        if low == high:
            return F.lit(low).cast("long")
        middle = (low + high) // 2
        return F.when(value < F.lit(ends[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return F.when(value.isNull(), F.lit(-1).cast("long")).otherwise(between(0, len(ends)))


def previous(rows: DataFrame, values: dict[str, str], scopes: list[str]) -> DataFrame:
    """Adds columns (by name: of which value) with the last non-null value before each row within its scope.

    First within each block of the input, then across blocks by their last values, so that neither one hot scope nor a
    table without scopes ends up in a single task. All values take one sort, one aggregation to a row per scope and
    block, and one join that keeps the window's partitioning.
    """
    keys = [*scopes, FILE, BLOCK]
    inner = Window.partitionBy(*keys).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(PLACE))).alias(f"__end_{n}") for n, v in values.items()])
    outer = Window.partitionBy(*scopes).orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, *[F.last(f"__end_{n}", ignorenulls=True).over(outer).alias(f"__carried_{n}") for n in values])
    within = rows.withColumns({n: F.last(v, ignorenulls=True).over(inner) for n, v in values.items()})
    joined = within.join(carried, keys, "left")
    return joined.withColumns({n: F.coalesce(n, f"__carried_{n}") for n in values}).drop(*[f"__carried_{n}" for n in values])
