"""Bucketers: how one input coordinate becomes coordinates at several granularities.

On the write side a bucketer gives Column expressions, so bucketing stays in
generated code; on the read side it maps one Python value, so that a read can
be routed and pruned before anything is planned.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The granularity of a coordinate as it is.
IDENTITY = "identity"


class Bucketer:
    """Identity on a single granularity, and the base of all bucketers.

    Subclasses override ``columns`` (write side) and ``read`` (read side).
    ``multi`` marks array-valued granularities: one cell an element.
    """

    bucket_types: tuple[str, ...] = (IDENTITY,)
    multi = False

    def columns(self, col: Column) -> dict[str, Column]:
        return {IDENTITY: col}

    def read(self, value: Any, bucket_type: str) -> Any:
        return value

    def write(self, value: Any) -> dict[str, list[Any]]:
        """The write side for a single point: bucket type -> coordinates."""
        return {t: [self.read(value, t)] for t in self.emitted}

    @property
    def emitted(self) -> tuple[str, ...]:
        """Granularities that writes produce; a bucketer may name more than it emits."""
        return self.bucket_types

    @property
    def bucketed(self) -> bool:
        """More than one granularity, the first of them not identity: a read has to name one."""
        return len(self.bucket_types) > 1 and self.bucket_types[0] != IDENTITY


class Typed(Bucketer):
    """Identity with a cast to a fixed type."""

    def __init__(self, kind: str):
        self.kind = kind

    def columns(self, col: Column) -> dict[str, Column]:
        return {IDENTITY: col.cast(self.kind)}


def string() -> Bucketer:
    """UTF-8 strings. The empty string is a value; null means that the dimension is omitted."""
    return Typed("string")


def integer() -> Bucketer:
    return Typed("int")


def long() -> Bucketer:
    return Typed("bigint")


def boolean() -> Bucketer:
    return Typed("boolean")


def binary() -> Bucketer:
    return Typed("binary")


class Enum(Bucketer):
    """Names of a fixed list, stored as their ordinals. A name outside the list is null, and so omitted."""

    def __init__(self, names: Sequence[str]):
        self.names = tuple(names)

    def columns(self, col: Column) -> dict[str, Column]:
        pairs = [x for i, n in enumerate(self.names) for x in (F.lit(n), F.lit(i))]
        return {IDENTITY: F.try_element_at(F.create_map(*pairs), col)}

    def read(self, value: Any, bucket_type: str) -> Any:
        return self.names.index(value)


class Tags(Bucketer):
    """An array of strings: one cell for each distinct element. Reads take a single element."""

    multi = True

    def columns(self, col: Column) -> dict[str, Column]:
        return {IDENTITY: col}

    def write(self, value: Any) -> dict[str, list[Any]]:
        return {IDENTITY: list(dict.fromkeys(v for v in value if v is not None))}


#: Floors, finest first: the unit of date_trunc and the floor of one Python datetime. Weeks begin on Mondays.
FLOORS: dict[str, Callable[[dt.datetime], dt.datetime]] = {
    "hour": lambda t: t.replace(minute=0, second=0, microsecond=0),
    "day": lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0),
    "week": lambda t: FLOORS["day"](t) - dt.timedelta(days=t.weekday()),
    "month": lambda t: FLOORS["day"](t).replace(day=1),
    "year": lambda t: FLOORS["day"](t).replace(month=1, day=1),
}


def floor(unit: str, col: Column) -> Column:
    """Floor of a timestamp as a zoneless timestamp: the clock that the input shows decides."""
    if unit not in FLOORS:
        raise ValueError(f"no such floor: {unit!r}; there are {', '.join(FLOORS)}")
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def hour_floor(col: Column) -> Column:
    return floor("hour", col)


def day_floor(col: Column) -> Column:
    return floor("day", col)


def week_floor(col: Column) -> Column:
    return floor("week", col)


def month_floor(col: Column) -> Column:
    return floor("month", col)


def year_floor(col: Column) -> Column:
    return floor("year", col)


class Time(Bucketer):
    """Calendar buckets of a timestamp. All five are known by name; the given ones are written."""

    bucket_types = tuple(FLOORS)

    def __init__(self, units: Sequence[str] = ("hour", "day", "month")):
        if unknown := [u for u in units if u not in FLOORS]:
            raise ValueError(f"unsupported time buckets: {unknown}")
        self.units = tuple(units)

    @property
    def emitted(self) -> tuple[str, ...]:
        return self.units

    def columns(self, col: Column) -> dict[str, Column]:
        return {u: floor(u, col) for u in self.units}

    def read(self, value: dt.datetime, bucket_type: str) -> dt.datetime:
        return FLOORS[bucket_type](value.replace(tzinfo=None))


class Hierarchy(Bucketer):
    """A coordinate and its ancestors by fixed maps: Hierarchy("city", state={"PORTLAND": "OREGON"}).

    A coordinate that a map lacks has no bucket there, so rollups on that level
    skip it. For ancestors that come from a table, join it first and use
    ``Expressions``.
    """

    def __init__(self, leaf: str, **levels: Mapping[Any, Any]):
        self.levels = {k: dict(v) for k, v in levels.items()}
        self.bucket_types = (leaf, *self.levels)

    def columns(self, col: Column) -> dict[str, Column]:
        out = {self.bucket_types[0]: col}
        for name, pairs in self.levels.items():
            out[name] = F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), col)
        return out

    def read(self, value: Any, bucket_type: str) -> Any:
        """Reads name the coordinate of the level itself."""
        return value

    def write(self, value: Any) -> dict[str, list[Any]]:
        out = {self.bucket_types[0]: [value]}
        out |= {k: [m[value]] for k, m in self.levels.items() if value in m}
        return out


class Expressions(Bucketer):
    """The user's own bucketer: a function from the input column to one per granularity.

    Columns (or pandas UDFs applied to one) both serve. ``reads`` maps a Python
    value for reads, by granularity; the default takes it as the bucket itself.
    """

    def __init__(self, make: Callable[[Column], dict[str, Column]], bucket_types: Sequence[str], multi: bool = False, reads: Callable[[Any, str], Any] | None = None):
        if not bucket_types:
            raise ValueError("a bucketer needs at least one bucket type")
        self.make, self.bucket_types, self.multi, self.reads = make, tuple(bucket_types), multi, reads

    def columns(self, col: Column) -> dict[str, Column]:
        return self.make(col)

    def read(self, value: Any, bucket_type: str) -> Any:
        return self.reads(value, bucket_type) if self.reads else value
