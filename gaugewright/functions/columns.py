"""Column builders: parsing, checks, rotation, normalisation and region predicates. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers as Python's float() reads them, underscores between digits included; infinities and NaN are not finite anyway.
_BLANK = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
NUMBER = rf"^{_BLANK}[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?{_BLANK}$"


#: Texts whose numbers a cast reads as float() does.
PLAIN = r"^[0-9.eE+-]+\z"


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def finite(number: Column) -> Column:
    """A double if it is finite, else null."""
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def parsed(cell: Column, kind: str = "string") -> Column:
    """The finite number of a cell, or null. Cells that are numbers already only need to be finite."""
    if kind != "string":
        return finite(cell.cast("double"))
    text = F.regexp_replace(cell, r"[^0-9eE.+-]", "")
    return finite(F.when(cell.rlike(PLAIN), cell.try_cast("double")).when(cell.rlike(NUMBER), text.try_cast("double")))


def stripped(cell: Column) -> Column:
    """Text without the white space around it; null is the empty text."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    visible = F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)  # at both ends
    return F.when(visible, text).otherwise(F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def rotated(values: Sequence[Column], matrix: Sequence[Sequence[float]]) -> list[Column]:
    """matrix x values; terms are added from left to right."""
    return [reduce(lambda a, b: a + b, [F.lit(float(c)) * v for c, v in zip(row, values, strict=False)], F.lit(0.0)) for row in matrix]


def scaled(value: Column, low: float, width: float) -> Column:
    return (value - F.lit(float(low))) / F.lit(float(width))


def within(value: Column, low: float | None, high: float | None) -> Column:
    """Closed interval; a missing bound does not bind."""
    bounds = ([value >= F.lit(float(low))] if low is not None else []) + ([value <= F.lit(float(high))] if high is not None else [])
    return every(bounds)


def first_region(regions: Sequence, numbers: Mapping[str, Column], texts: Mapping[str, Column]) -> Column:
    """Id of the first excluded region that a point lies in, or null."""
    picked = []
    for r in regions:
        inside = [within(numbers[n], b.minimum, b.maximum) for n, b in r.continuous_bounds.items()]
        inside += [texts[n].isin(*values) if values else F.lit(False) for n, values in r.categorical_values.items()]
        picked.append(F.when(every(inside), F.lit(r.region_id)))
    return F.coalesce(*picked) if picked else F.lit(None).cast("string")


def is_close(a: Column, b: Column, relative: float, absolute: float) -> Column:
    """math.isclose on columns."""
    near = F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (near & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))))
