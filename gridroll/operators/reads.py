"""Reads: one cell, or a list of cells. A read is routed to its rollup before anything is planned."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gridroll.spec import CubeSpec, Read


#: Requests that are broadcast; more of them are joined by a shuffle.
BROADCAST_READS = 50_000


def point(cells: DataFrame, read: Read) -> DataFrame:
    """The cell's row, or none: absence is not 0. Partition-pruned on the rollup, key predicates pushed to the scan."""
    name = read.rollup.name
    same = [F.col(c) == F.lit(v) for c, v in read.keys.items()]
    return reduce(lambda df, p: df.where(p), same, cells.where((F.col("cube") == read.spec.name) & (F.col("rollup_id") == name)))


def get(cells: DataFrame, read: Read) -> Row | None:
    """The measures of one cell, or None."""
    return point(cells, read).select(*[m.name for m in read.spec.measures]).first()


def requests(cells: DataFrame, reads: Sequence[Read]) -> DataFrame:
    """(pos, rollup_id, keys) of the reads; all are routed first, so an invalid one fails before any cell is read."""
    names = [r.rollup.name for r in reads]
    spec: CubeSpec = reads[0].spec
    kinds = dict(cells.dtypes)
    schema = ", ".join(["pos int", "rollup_id string", *[f"`{c}` {kinds[c]}" for c in spec.keys]])
    return cells.sparkSession.createDataFrame([(i, n, *[r.keys.get(c) for c in spec.keys]) for i, (n, r) in enumerate(zip(names, reads, strict=True))], schema)


def multi_get(cells: DataFrame, reads: Sequence[Read]) -> DataFrame:
    """(pos, measures) with a row for each read in order; measures are null where the cell is absent.

    Up to BROADCAST_READS requests are broadcast to the cells of their rollups,
    more are joined by a shuffle; what they hit is put in place again by position.
    """
    if not reads:
        raise ValueError("no reads")
    spec = reads[0].spec
    asked = requests(cells, reads)
    own = cells.where((F.col("cube") == spec.name) & F.col("rollup_id").isin(sorted({r.rollup.name for r in reads})))
    match = reduce(lambda a, c: a & own[c].eqNullSafe(asked[c]), spec.keys, own["rollup_id"] == asked["rollup_id"])
    hit = own.join(F.broadcast(asked) if len(reads) <= BROADCAST_READS else asked, match).select("pos", *[own[m.name] for m in spec.measures])
    return asked.select("pos").join(hit, "pos", "left").orderBy("pos")


def multi_get_list(cells: DataFrame, reads: Sequence[Read]) -> list[Row | None]:
    names = [m.name for m in reads[0].spec.measures]
    return [None if all(r[n] is None for n in names) else r for r in multi_get(cells, reads).collect()]
