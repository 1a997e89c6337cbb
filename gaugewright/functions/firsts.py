"""Counts by code together with the first rows of each code, in one pass that merges."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import ship


def _key(value):
    """Orders as Spark does, nulls first."""
    if isinstance(value, dict):
        return tuple(map(_key, value.values()))
    return (value is not None, value)


def firsts_and_counts(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """code, n (its rows) and ``firsts`` (its first ``limit`` rows by the columns ``order``, as structs of all other columns).

    Each task hands on one count and at most ``limit`` rows by code; merging sums the counts and sorts what was handed on.
    ``rows``: code and any columns.
    """
    ship(rows.sparkSession)
    others = [*order, *[c for c in rows.columns if c not in ("code", *order)]]
    cells = rows.select("code", *others)
    n_keys = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        held: dict[str, list[tuple]] = {}  # by code: (key, row), the first ones
        schema = None
        for b in batches:
            schema = b.schema
            codes = b.column(0).to_pylist()
            counts.update(codes)
            keys = list(zip(*(map(_key, b.column(1 + i).to_pylist()) for i in range(n_keys)), strict=True))
            worst = {c: some[-1][0] for c, some in held.items() if len(some) == limit}
            fresh: dict[str, list[tuple]] = {}
            for i, (c, k) in enumerate(zip(codes, keys, strict=True)):
                if c not in worst or k < worst[c]:
                    fresh.setdefault(c, []).append((k, i))
            for c, some in fresh.items():
                some = sorted(some)[:limit]
                at = b.take(pa.array([i for _, i in some]))
                held[c] = sorted([*held.get(c, []), *((k, at.slice(j, 1)) for j, (k, _) in enumerate(some))], key=lambda x: x[0])[:limit]
        if schema is None:
            return
        for c, n in counts.items():
            first = pa.concat_batches([r for _, r in held[c]]) if held[c] else None
            sizes = [n] + [0] * (len(held[c]) - 1)
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(sizes, pa.int64())], schema=schema.append(pa.field("__n", pa.int64())))

    parts = cells.mapInArrow(run, StructType([*cells.schema.fields, StructField("__n", LongType())]))
    return parts.groupBy("code").agg(F.sum("__n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct(*others))), 1, limit).alias("firsts"))
