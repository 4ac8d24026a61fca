"""Declaration of a cube: dimensions, rollups, measures."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridroll.functions.bucketers import IDENTITY, Bucketer
from gridroll.functions.measures import Measure, count

#: Name of the rollup without components, the grand total.
ALL = "__all__"


@dataclass(frozen=True)
class Dimension:
    """A named axis. ``source`` is the input column (or expression) it reads; null or missing means that a row omits it.

    ``field_bytes`` fixes the width of its coordinates in encoded keys, and
    ``id_bytes`` makes them dictionary ids of that width there.
    """

    name: str
    bucketer: Bucketer = field(default_factory=Bucketer, compare=False)
    source: str | Column | None = field(default=None, compare=False)
    field_bytes: int | None = field(default=None, compare=False)
    id_bytes: int | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if not self.bucketer.bucket_types:
            raise ValueError(f"dimension {self.name}: a bucketer needs at least one bucket type")
        if self.id_bytes is not None and not 1 <= self.id_bytes <= 7:
            raise ValueError("ids have 1 to 7 bytes")

    @property
    def input(self) -> Column:
        return F.col(self.source or self.name) if self.source is None or isinstance(self.source, str) else self.source


Component = tuple[str, str]


@dataclass(frozen=True)
class Rollup:
    """A combination of (dimension, bucket type) to keep. No component: the grand total."""

    components: frozenset[Component]

    @staticmethod
    def of(*parts: str | Component) -> Rollup:
        """Parts are dimension names, for their identity, or (dimension, bucket type) pairs."""
        found = [(p, IDENTITY) if isinstance(p, str) else (p[0], p[1]) for p in parts]
        names = [d for d, _ in found]
        if len(set(found)) != len({d for d, _ in found}):
            raise ValueError(f"a rollup can use a dimension with one bucket type only: {names}")
        return Rollup(frozenset(found))

    @property
    def name(self) -> str:
        return "-".join(sorted(d if b == IDENTITY else f"{d}_{b}" for d, b in self.components)) or ALL


def key_column(dim: str, bucket: str) -> str:
    return f"{dim}__{bucket}"


class CubeSpec:
    """Dimensions in order, the rollups to keep and the measures of a cell."""

    def __init__(self, name: str, dimensions: Sequence[Dimension], rollups: Iterable[Rollup], measures: Sequence[Measure] | None = None):
        self.name = name
        self.dimensions = tuple(dimensions)
        self.measures = tuple(measures or (count(),))
        by_name = {d.name: d for d in self.dimensions}
        if len(by_name) != len(self.dimensions):
            raise ValueError("dimension names have to differ")
        if len(self.dimensions) > 32_767:
            raise ValueError("a cube has at most 32767 dimensions")
        self.by_name = by_name
        self.rollups = tuple(dict.fromkeys(rollups))  # equal sets of components are one rollup
        for r in self.rollups:
            for d, b in r.components:
                if d not in by_name:
                    raise ValueError(f"rollup {r.name} uses the unknown dimension {d!r}")
                if b not in by_name[d].bucketer.emitted:
                    if b not in by_name[d].bucketer.bucket_types:
                        raise ValueError(f"rollup {r.name}: dimension {d!r} has no bucket type {b!r}")
                    warnings.warn(f"rollup {r.name}: dimension {d!r} never writes bucket type {b!r}, so the rollup stays empty", stacklevel=2)

    @property
    def components(self) -> list[Component]:
        """All components of any rollup, in the order of dimensions and their bucket types."""
        used = {c for r in self.rollups for c in r.components}
        return [(d.name, b) for d in self.dimensions for b in d.bucketer.bucket_types if (d.name, b) in used]

    @property
    def keys(self) -> list[str]:
        return [key_column(d, b) for d, b in self.components]

    @property
    def live_rollups(self) -> list[Rollup]:
        """Rollups all of whose components are written."""
        return [r for r in self.rollups if all(b in self.by_name[d].bucketer.emitted for d, b in r.components)]

    def extended(self, dimensions: Sequence[Dimension], rollups: Iterable[Rollup]) -> CubeSpec:
        """The same cube with dimensions appended. Cells of the old one stay valid: they have nulls in the new columns."""
        return CubeSpec(self.name, [*self.dimensions, *dimensions], [*self.rollups, *rollups], self.measures)

    def route(self, components: Iterable[Component]) -> Rollup:
        """The rollup that answers a read, which has to name exactly its components."""
        asked = frozenset(components)
        for r in self.rollups:
            if r.components == asked:
                return r
        raise ValueError(f"no rollup stores {sorted(asked)}; there are {[sorted(r.components) for r in self.rollups]}")

    def addresses(self, point: dict[str, Any]) -> Iterator[tuple[str, tuple]]:
        """(rollup, key values) of all cells that one point touches, each once. For single points and tests; DataFrames go through ``build_cells``."""
        buckets = {d: self.by_name[d].bucketer.write(v) for d, v in point.items() if v is not None}
        seen = set()
        for r in self.rollups:
            axes = [(c, [v for v in buckets.get(c[0], {}).get(c[1], []) if v is not None]) for c in self.components if c in r.components]
            if len(axes) == len(r.components) and all(vs for _, vs in axes):
                for values in product(*(vs for _, vs in axes)):
                    at = dict(zip((c for c, _ in axes), values, strict=True))
                    address = (r.name, tuple(at.get(c) for c in self.components))
                    if address not in seen:
                        seen.add(address)
                        yield address


class Read:
    """One cell to read: ``Read(spec).at("time", t, "hour").at("zip", "97201")``. Naming a dimension again replaces it."""

    def __init__(self, spec: CubeSpec, at: dict[Component, Any] | None = None):
        self.spec, self.coordinates = spec, dict(at or {})

    def at(self, dim: str, value: Any, bucket: str | None = None) -> Read:
        bucketer = self.spec.by_name[dim].bucketer
        if bucket is None and bucketer.bucketed:
            raise ValueError(f"dimension {dim!r} is bucketed: name one of {bucketer.bucket_types}")
        bucket = bucket or bucketer.bucket_types[0]
        kept = {c: v for c, v in self.coordinates.items() if c[0] != dim}
        return Read(self.spec, kept | {(dim, bucket): bucketer.read(value, bucket)})

    def raw(self, dim: str, bucket: str, value: Any) -> Read:
        """A coordinate that is a bucket already."""
        kept = {c: v for c, v in self.coordinates.items() if c[0] != dim}
        return Read(self.spec, kept | {(dim, bucket): value})

    @property
    def rollup(self) -> Rollup:
        return self.spec.route(self.coordinates)

    @property
    def keys(self) -> dict[str, Any]:
        return {key_column(d, b): v for (d, b), v in self.coordinates.items()}
