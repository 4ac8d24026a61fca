"""Commit types: how a batch of cells meets the cells that are stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridroll.spec import CubeSpec

#: Add to the stored value, blindly or by compare-and-set (the same plan), or replace it.
INCREMENT, READ_COMBINE_CAS, OVERWRITE = "INCREMENT", "READ_COMBINE_CAS", "OVERWRITE"
COMMIT_TYPES = (INCREMENT, READ_COMBINE_CAS, OVERWRITE)


def key_names(spec: CubeSpec) -> list[str]:
    return ["cube", "rollup_id", *spec.keys]


def same_cell(spec: CubeSpec, left: str, right: str) -> Column:
    """Null-safe equality of all key columns; it is still hashed, so the join is a shuffled or broadcast one."""
    return reduce(lambda a, c: a & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")), key_names(spec)[1:], F.col(f"{left}.cube") == F.col(f"{right}.cube"))


def combined(spec: CubeSpec, cells: DataFrame) -> DataFrame:
    """Cells with the same key merged into one."""
    return cells.groupBy(*key_names(spec)).agg(*[m.merged() for m in spec.measures])


def increment(spec: CubeSpec, existing: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored values plus the batch's."""
    return combined(spec, existing.unionByName(delta, allowMissingColumns=True))


def overwrite(spec: CubeSpec, existing: DataFrame, delta: DataFrame) -> DataFrame:
    """The batch's values instead of stored ones. Within the batch, values of a cell still add up first."""
    new = combined(spec, delta)
    kept = existing.alias("e").join(new.select(*key_names(spec)).alias("n"), same_cell(spec, "e", "n"), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def overwrite_in_order(spec: CubeSpec, cells: DataFrame, order: Column) -> DataFrame:
    """Each cell's last value by ``order``: what overwriting write by write leaves."""
    return cells.groupBy(*key_names(spec)).agg(*[F.max_by(m.name, order).alias(m.name) for m in spec.measures])


def merge(spec: CubeSpec, existing: DataFrame, delta: DataFrame, commit: str) -> DataFrame:
    if commit not in COMMIT_TYPES:
        raise ValueError(f"unknown commit type {commit!r}")
    return overwrite(spec, existing, delta) if commit == OVERWRITE else increment(spec, existing, delta)
