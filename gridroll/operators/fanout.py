"""The core operator: fan-out of input rows to cells and their aggregation.

Rollups are dealt into classes by the multi-valued granularities they use. In
each class these arrays are exploded, nowhere else, so that a rollup without
tags counts a row once whatever its tags are; then one GROUPING SETS computes
all rollups of the class. Partial aggregation before the exchange merges the
changes of a cell where they arise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridroll.spec import Component, CubeSpec, Rollup, key_column


def bucket_columns(spec: CubeSpec, df: DataFrame) -> DataFrame:
    """``df`` with a column for each component of a rollup; arrays, distinct and without nulls, for multi-valued ones."""
    used = set(spec.components)
    new = {}
    for d in spec.dimensions:
        wanted = [b for b in d.bucketer.emitted if (d.name, b) in used]
        if wanted:
            made = d.bucketer.columns(d.input)
            for b in wanted:
                new[key_column(d.name, b)] = F.array_distinct(F.array_compact(made[b])) if d.bucketer.multi else made[b]
    return df.withColumns(new) if new else df


def _classes(spec: CubeSpec) -> dict[frozenset[Component], list[Rollup]]:
    out: dict[frozenset[Component], list[Rollup]] = {}
    for r in spec.live_rollups:
        out.setdefault(frozenset(c for c in r.components if spec.by_name[c[0]].bucketer.multi), []).append(r)
    return out


def _names(spec: CubeSpec, rollup: Rollup) -> list[str]:
    return [key_column(*c) for c in spec.components if c in rollup.components]


def _aggregate(spec: CubeSpec, rows: DataFrame, rollups: list[Rollup], merge: bool) -> DataFrame:
    """Cells of the rollups of one class; ``merge`` if ``rows`` hold measures already."""
    aggs = [m.merged() if merge else m.updated() for m in spec.measures]
    if len(rollups) == 1:  # no Expand; rows that omit a component go before the exchange
        names = _names(spec, rollups[0])
        kept = reduce(lambda a, c: a.where(F.col(c).isNotNull()), names, rows)
        cells = kept.groupBy(*names).agg(*aggs) if names else kept.agg(*aggs, F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
        return cells.withColumn("rollup_id", F.lit(rollups[0].name))
    names = [key_column(*c) for c in spec.components if any(c in r.components for r in rollups)]
    sets = [_names(spec, r) for r in rollups]
    cells = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.grouping_id().alias("_gid"), *aggs)
    # each rollup has its grouping id: a bit for every column it leaves out, the first column's highest
    gid = {r.name: sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in s) for r, s in zip(rollups, sets, strict=True)}
    whole: Column = F.lit(False)
    label: Column = F.lit(None).cast("string")
    for r, s in zip(rollups, sets, strict=True):
        here = F.col("_gid") == gid[r.name]
        whole = whole | (here & reduce(lambda a, c: a & F.col(c).isNotNull(), s, F.lit(True)))
        label = F.when(here, F.lit(r.name)).otherwise(label)
    return cells.where(whole).withColumn("rollup_id", label).drop("_gid")


def build_cells(spec: CubeSpec, df: DataFrame, preaggregate: bool = False) -> DataFrame:
    """All cells of ``df``: cube, rollup_id, a column for each component (null where the rollup has none) and the measures.

    A row that omits a dimension is skipped by the rollups that use it and by
    no other, and adds to a cell once even if a tag is repeated or a rollup
    declared twice. ``preaggregate`` groups by all single-valued components
    first, which pays where rows are many to each such combination, since the
    rollups then multiply fewer rows.
    """
    rows = bucket_columns(spec, df)
    parts = []
    for multi, rollups in _classes(spec).items():
        some, merge = rows, False
        for d, b in sorted(multi):
            some = some.withColumn(key_column(d, b), F.explode(key_column(d, b)))
        if preaggregate and len(rollups) > 1:
            fine = [key_column(*c) for c in spec.components if any(c in r.components for r in rollups)]
            some, merge = some.groupBy(*fine).agg(*[m.updated() for m in spec.measures]), True
        parts.append(_aggregate(spec, some, rollups, merge))
    return conform(spec, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else df.sparkSession.createDataFrame([], "rollup_id string"))


def conform(spec: CubeSpec, cells: DataFrame) -> DataFrame:
    """Cells in the cube's column order; columns that ``cells`` lack, as those of an older declaration do, are null."""
    kinds = {m.name: m.kind for m in spec.measures}
    have = set(cells.columns)
    pick = lambda c: F.col(c) if c in have else F.lit(None).cast(kinds.get(c, "string")).alias(c)
    return cells.select(F.lit(spec.name).alias("cube"), "rollup_id", *[pick(c) for c in spec.keys], *[pick(m.name) for m in spec.measures])
