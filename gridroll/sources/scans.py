"""Key-range scans over byte-keyed cells: which ranges a cube's prefix needs, and their predicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridroll.functions.codecs import value_column
from gridroll.spec import CubeSpec

#: Upper end of a prefix: so many bytes of 255 after it.
TAIL = 50


@dataclass(frozen=True)
class KeyRange:
    """Keys from ``start`` on and below ``stop``; an empty bound is open."""

    start: bytes = b""
    stop: bytes = b""

    def predicate(self, key: Column) -> Column:
        """As a condition that is pushed to the scan."""
        out = F.lit(True)
        if self.start:
            out = out & (key >= F.lit(bytearray(self.start)))
        return out & (key < F.lit(bytearray(self.stop))) if self.stop else out


def truncated(r: KeyRange, lo: bytes, hi: bytes) -> KeyRange | None:
    """The part of a range between ``lo`` and ``hi``; None if there is none."""
    start = max(r.start, lo)
    stop = min(r.stop, hi) if r.stop and hi else r.stop or hi
    return None if stop and start >= stop else KeyRange(start, stop)


def prefix_scans(prefix: bytes, splits: Sequence[bytes]) -> list[KeyRange]:
    """One range for each region that the table's split keys make, clipped to the keys that begin with ``prefix``."""
    bounds = [b"", *sorted(splits), b""]
    regions = [KeyRange(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    if not prefix:
        return regions
    hi = prefix + b"\xff" * TAIL
    return [r for x in regions if (r := truncated(x, prefix, hi))]


def scan(df: DataFrame, ranges: Sequence[KeyRange], key: str = "key") -> DataFrame:
    """Rows of ``df`` in any of the ranges."""
    out = F.lit(False)
    for r in ranges:
        out = out | r.predicate(F.col(key))
    return df.where(out)


def split_keys(df: DataFrame, n: int, key: str = "key") -> list[bytes]:
    """At most ``n`` - 1 keys that cut a table into ranges of about equal size.

    Range partitioning samples the keys; the least key of each partition but
    the first is a split. Only the keys are shuffled, and a row a partition
    comes back.
    """
    ranged = df.select(key).where(F.col(key).isNotNull()).repartitionByRange(n, key)
    least = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("least")).collect()
    return sorted({bytes(r["least"]) for r in least})[1:]


#: Makes the measures of a scanned row: from the spec to columns, by measure.
Parser = Callable[[CubeSpec], dict[str, Column]]


def single_column(value: str = "value") -> Parser:
    """The default parser: the only measure is the whole of one binary column."""

    def parse(spec: CubeSpec) -> dict[str, Column]:
        if len(spec.measures) != 1:
            raise ValueError("a cube of several measures needs a parser of its own")
        return {spec.measures[0].name: value_column(F.col(value), spec.measures[0].kind)}

    return parse


def packed(value: str = "value") -> Parser:
    """All measures end to end in one binary column, in the order of their declaration."""

    def parse(spec: CubeSpec) -> dict[str, Column]:
        out, at = {}, 1
        for m in spec.measures:
            width = 4 if m.kind == "int" else 8
            out[m.name] = value_column(F.substring(F.col(value), at, width), m.kind)
            at += width
        return out

    return parse


def parsed(spec: CubeSpec, rows: DataFrame, parser: Parser | None = None) -> DataFrame:
    """Scanned rows of encoded values as typed measures; what the parser reads goes, the other columns stay."""
    made = (parser or single_column())(spec)
    return rows.select(*[c for c in rows.columns if c not in made and c != "value"], *[v.alias(k) for k, v in made.items()])
