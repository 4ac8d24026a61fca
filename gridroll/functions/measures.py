"""Measures: additive cell values and the changes that are made to them.

A measure is an abelian group on a column: values are summed from input rows,
merged with what a cell holds, and subtracted in a backfill. Sums follow ANSI
rules, so an overflow is an error and does not wrap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """``update`` aggregates input rows, ``merge`` cell values of the same key, ``subtract`` takes one cell value from another.

    ``merge`` has to be associative and commutative, and subtract(merge(x, y),
    x) has to be y. A custom aggregate is any three such functions; a pandas
    grouped-aggregate UDF serves where Columns cannot say it.
    """

    name: str
    kind: str
    update: Callable[[], Column]
    merge: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    subtract: Callable[[Column, Column], Column]
    add_values: Callable[[Any, Any], Any] = lambda a, b: a + b

    def updated(self) -> Column:
        return self.update().cast(self.kind).alias(self.name)

    def merged(self) -> Column:
        return self.merge(F.col(self.name)).cast(self.kind).alias(self.name)


def _sum(name: str, kind: str, col: str | Column | Callable[[], Column] | None) -> Measure:
    source = lambda: col if isinstance(col, Column) else col() if callable(col) else F.col(col or name)
    return Measure(name, kind, lambda: F.sum(source().cast(kind)), F.sum, lambda a, b: (a + b).cast(kind), lambda a, b: (a - b).cast(kind))


def long_sum(name: str = "value", col: str | Column | Callable[[], Column] | None = None) -> Measure:
    return _sum(name, "bigint", col)


def int_sum(name: str = "value", col: str | Column | Callable[[], Column] | None = None) -> Measure:
    """32-bit: Spark sums in 64 bits, and the cast back raises where the sum does not fit."""
    return _sum(name, "int", col)


def double_sum(name: str = "value", col: str | Column | Callable[[], Column] | None = None) -> Measure:
    """IEEE doubles; the last bits depend on the order of summation."""
    return _sum(name, "double", col)


def count(name: str = "value") -> Measure:
    """One for each input row."""
    return Measure(name, "bigint", lambda: F.count(F.lit(1)), F.sum, lambda a, b: a + b, lambda a, b: a - b)
