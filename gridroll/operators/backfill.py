"""Backfill: recomputed history reconciled with what was written meanwhile."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridroll.operators.merge import key_names
from gridroll.spec import CubeSpec

if TYPE_CHECKING:
    from gridroll.store import CellStore

#: What becomes of a live cell.
DELETED, OVERWRITTEN, UNCHANGED = "deleted", "overwritten", "unchanged"


def _joined(spec: CubeSpec, live: DataFrame, snapshot: DataFrame, backfill: DataFrame) -> DataFrame:
    """The three tables by key. Each side comes once to a union and one grouping, a single shuffle of all three."""
    names = [m.name for m in spec.measures]
    sides = []
    for tag, df in (("l", live), ("s", snapshot), ("b", backfill)):
        own = [c for c in key_names(spec) if c in df.columns]
        sides.append(df.select(*own, F.lit(True).alias(f"in_{tag}"), *[F.col(n).alias(f"{tag}_{n}") for n in names]))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    held = [F.max(f"in_{t}").alias(f"in_{t}") for t in "lsb"]
    values = [F.first(f"{t}_{n}", ignorenulls=True).alias(f"{t}_{n}") for t in "lsb" for n in names]
    out = rows.groupBy(*key_names(spec)).agg(*held, *values)
    return out.withColumns({f"in_{t}": F.coalesce(f"in_{t}", F.lit(False)) for t in "lsb"})


def three_way(spec: CubeSpec, live: DataFrame, snapshot: DataFrame, backfill: DataFrame) -> DataFrame:
    """Every cell's fate: keys, ``action`` and the new measures (null where deleted).

    With L, S and B the cell in live, snapshot and backfill: where L is what S
    was, B takes its place, and without a B the cell goes; where L has moved
    on, what was written since, L - S, is added to B, or stays alone. Cells
    without S become B + L, B or L. A result of 0 is stored, not deleted. A
    cell that is in the snapshot but no longer live is an error.
    """
    j = _joined(spec, live, snapshot, backfill)
    equal: Column = reduce(lambda a, b: a & b, [F.col(f"l_{m.name}").eqNullSafe(F.col(f"s_{m.name}")) for m in spec.measures])
    values = []
    for m in spec.measures:
        lv, sv, bv = (F.col(f"{t}_{m.name}") for t in "lsb")
        since = m.subtract(lv, sv)
        values.append(
            F.when(F.col("in_s") & ~F.col("in_l"), F.raise_error(F.lit("a cell of the snapshot is missing in the live table")).cast(m.kind))
            .when(F.col("in_s") & F.col("in_b"), F.when(equal, bv).otherwise(m.combine(since, bv)))
            .when(F.col("in_s"), F.when(~equal, since))
            .when(F.col("in_b") & F.col("in_l"), m.combine(bv, lv))
            .when(F.col("in_b"), bv)
            .otherwise(lv)
            .cast(m.kind)
            .alias(m.name)
        )
    names = [m.name for m in spec.measures]
    out = j.select(*key_names(spec), "in_l", "in_s", "in_b", equal.alias("_equal"), *[F.col(f"l_{n}") for n in names], *values)
    gone = F.col("in_s") & F.col("in_l") & ~F.col("in_b") & F.col("_equal")
    same = F.col("in_l") & reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"l_{n}")) for n in names])
    action = F.when(gone, F.lit(DELETED)).when(same, F.lit(UNCHANGED)).otherwise(F.lit(OVERWRITTEN))
    return out.select(*key_names(spec), action.alias("action"), *names)


def merged_cells(spec: CubeSpec, fates: DataFrame) -> DataFrame:
    return fates.where(F.col("action") != DELETED).drop("action")


def counters(fates: DataFrame) -> DataFrame:
    """(action, n): how many cells were deleted, overwritten, left unchanged."""
    return fates.groupBy("action").agg(F.count("*").alias("n"))


def run_backfill(store: CellStore, recompute: Callable[[], DataFrame], since_version: int | None = None) -> dict[str, int]:
    """Replace history by ``recompute``'s cells without losing what is written meanwhile.

    The snapshot is an immutable version of the store (``since_version``, or
    the one current at the call), so nothing is copied and later writes cannot
    leak into it. ``recompute`` runs, then the three tables are merged and
    committed as one new version; a failure leaves the live version as it was.
    Returns how many cells met which fate.
    """
    version = store.version if since_version is None else since_version
    backfill = recompute()
    return store.replace_by(lambda live: three_way(store.spec, live, store.cells(version), backfill))
