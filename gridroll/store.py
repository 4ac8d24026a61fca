"""Cell stores: where cubes live.

``CellStore`` keeps immutable Parquet folders and numbered manifests. A
manifest names, for each rollup, the folders whose cells add up to it. A commit
writes new folders for the rollups it touches and then creates the next
manifest, which exactly one writer can: the loser reads the winner's version
and tries again. Readers always see one whole version.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridroll.metrics import Registry
from gridroll.operators import merge as m
from gridroll.operators.backfill import DELETED
from gridroll.operators.reads import get, multi_get, multi_get_list
from gridroll.session import materialize
from gridroll.spec import CubeSpec, Read
from gridroll.versions import CommitConflict, Versions, is_io, pause

__all__ = ["CellStore", "CommitConflict", "MemoryStore", "Store", "StoreConfig"]
log = logging.getLogger(__name__)


@runtime_checkable
class Store(Protocol):
    """What a cube needs of the place where its cells live. Point writes, streams and backfill rest on this alone."""

    spec: CubeSpec
    version: int

    def cells(self, version: int | None = None, rollups: list[str] | None = None) -> DataFrame:
        """The cells of a committed version, the newest by default."""

    def merge(self, delta: DataFrame, commit: str | None = None, writer: str | None = None, batch_id: int | None = None) -> int:
        """Commit a batch of cells; returns the version that has it."""

    def set(self, read: Read, *values: Any) -> int:
        """Overwrite one cell."""

    def get(self, read: Read) -> Row | None:
        """The measures of one committed cell, or None."""

    def multi_get(self, reads: list[Read]) -> list[Row | None]:
        """The cells of all reads in their order, None where one is absent."""

    def flush(self) -> None:
        """Wait until what was merged is committed."""

    def shutdown(self) -> None:
        """Flush, and take nothing more."""


@dataclass(frozen=True)
class StoreConfig:
    """How a store commits. ``replace`` from dataclasses changes single settings.

    ``deltas`` increments of a rollup are kept as they are and added up by
    reads; one more compacts them. A commit that storage fails is tried
    ``tries`` times, one that other writers overtake ``cas_tries`` times.
    ``batch_size`` and ``flush_threads`` are what point writes to the store use
    unless they are told otherwise.
    """

    commit: str = m.INCREMENT
    batch_size: int = 10
    flush_threads: int = 5
    tries: int = 5
    cas_tries: int = 10
    deltas: int = 8
    retry_seconds: float = 0.5

    def with_(self, **changes: Any) -> StoreConfig:
        return replace(self, **changes)


def one_cell(spark: SparkSession, read: Read, values: Sequence[Any], kinds: dict[str, str]) -> DataFrame:
    """The cell that ``read`` addresses with the given measures; whole numbers as keys are longs unless ``kinds`` says otherwise."""
    spec, keys = read.spec, read.keys
    key = lambda c: F.lit(keys.get(c)).cast(kinds[c]) if c in kinds else F.lit(keys[c]).cast("bigint") if type(keys.get(c)) is int else F.lit(keys.get(c))
    return spark.range(1).select(F.lit(spec.name).alias("cube"), F.lit(read.rollup.name).alias("rollup_id"), *[key(c).alias(c) for c in spec.keys], *[F.lit(v).cast(x.kind).alias(x.name) for x, v in zip(spec.measures, values, strict=True)])


def kept_types(cells: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``cells`` with key columns of the types that a store has recorded; a value that does not fit raises."""
    have = dict(cells.dtypes)
    return cells.withColumns({k: F.col(k).cast(t) for k, t in kinds.items() if k in have and have[k] != t})


class CellStore:
    """A cube in Parquet folders under ``path``, on any store that Spark writes to."""

    def __init__(
        self, spark: SparkSession, path: str, spec: CubeSpec, config: StoreConfig | None = None, on_flush: Callable[[DataFrame], None] | None = None, after_execute: Callable[[Exception | None], None] | None = None, metrics: Registry | None = None
    ):
        self.spark, self.spec, self.config = spark, spec, config or StoreConfig()
        self.path = f"{path.rstrip('/')}/{spec.name}"
        self.versions = Versions(spark, self.path)
        self.on_flush, self.after_execute = on_flush, after_execute
        self.metrics = metrics or Registry(spec.name)
        if self.config.commit not in m.COMMIT_TYPES:
            raise ValueError(f"unknown commit type {self.config.commit!r}")

    # manifests

    @property
    def version(self) -> int:
        """The newest committed version; 0 for an empty store."""
        return self.versions.last

    def manifest(self, version: int | None = None) -> dict:
        """{"rollups": {name: [folders]}, "batches": {writer: last batch id}, "kinds": {key: type}} of a version."""
        version = self.version if version is None else version
        return self.versions.read(version) if version else {"rollups": {}, "batches": {}, "kinds": {}}

    # reading

    def cells(self, version: int | None = None, rollups: list[str] | None = None) -> DataFrame:
        """The cells of a version; of some rollups only, whose folders alone are then listed and read.

        Folders of an older declaration lack the columns of dimensions that
        were appended since; these are null.
        """
        held = self.manifest(version)
        return self._cells(held["rollups"] if rollups is None else {k: v for k, v in held["rollups"].items() if k in rollups}, held.get("kinds", {}))

    def _cells(self, held: dict[str, list[str]], kinds: dict[str, str]) -> DataFrame:
        """The cells in the folders of rollups, by the recorded types of their keys."""
        folders = sorted({f for fs in held.values() for f in fs})
        kinds = {**{k: "string" for k in self.spec.keys}, **{k: v for k, v in kinds.items() if k in self.spec.keys}, **{x.name: x.kind for x in self.spec.measures}}
        empty = self.spark.createDataFrame([], "cube string, rollup_id string, " + ", ".join(f"`{c}` {kinds[c]}" for c in [*self.spec.keys, *[x.name for x in self.spec.measures]]))
        if not folders:
            return empty
        found = self.spark.read.schema(empty.schema).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{f}" for f in folders])
        return m.combined(self.spec, found).select(*empty.columns) if any(len(fs) > 1 for fs in held.values()) else found

    @property
    def key_kinds(self) -> dict[str, str]:
        """Spark types of key columns, as the first commit with a value of theirs recorded them."""
        return {k: v for k, v in self.manifest().get("kinds", {}).items() if k in self.spec.keys}

    def get(self, read: Read) -> Row | None:
        """The measures of one committed cell, or None. Only the folders of its rollup are read."""
        return get(self.cells(rollups=[read.rollup.name]), read)

    def multi_get(self, reads: list[Read]) -> list[Row | None]:
        return multi_get_list(self.cells(rollups=sorted({r.rollup.name for r in reads})), reads)

    def multi_get_frame(self, reads: list[Read]) -> DataFrame:
        return multi_get(self.cells(rollups=sorted({r.rollup.name for r in reads})), reads)

    # writing

    def _write(self, cells: DataFrame) -> dict[str, str]:
        """Write cells by rollup; returns each rollup's new folder."""
        stamp = uuid.uuid4().hex[:12]
        to = f"{self.path}/data/{stamp}"
        cells.withColumn("_r", F.col("rollup_id")).write.partitionBy("_r").parquet(to)
        fs, p = self.versions.fs(to)
        prefix = "_r="
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith(prefix)]
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return {unescape(n.removeprefix(prefix)): f"data/{stamp}/{n}" for n in names}

    def _commit(self, change: Callable[[dict, int], dict]) -> int:
        c = self.config
        return self.versions.commit(change, self.manifest(0), c.cas_tries, c.retry_seconds, self.metrics)

    def merge(self, delta: DataFrame, commit: str | None = None, writer: str | None = None, batch_id: int | None = None) -> int:
        """Commit a batch of cells; returns the version that has it.

        Only rollups with cells in the batch are written. An increment is a
        folder of its own until ``deltas`` of them are compacted; an overwrite
        rewrites the rollups it touches. With ``writer`` and ``batch_id`` a
        batch that this writer has committed before changes nothing. Key columns
        keep the types of the first commit that had values of theirs. Errors of
        storage are tried again, without committing twice. What ``on_flush``
        raises is logged and counted; the commit stands.
        """
        failure: Exception | None = None
        stamp, since = uuid.uuid4().hex, None
        try:
            for attempt in range(max(1, self.config.tries)):
                try:
                    since = self.version if since is None else since
                    with self.metrics.timer("flush"):
                        done, batch, names = self._merge(delta, commit or self.config.commit, writer, batch_id, stamp, since)
                    break
                except Exception as e:
                    if not is_io(e) or attempt + 1 >= self.config.tries:
                        self.metrics.mark("flushFailures")
                        raise
                    self.metrics.mark("ioRetries")
                    pause(self.config.retry_seconds, attempt)
            if self.on_flush and batch is not None:
                try:
                    self.on_flush(self._changed(batch, names))
                except Exception:
                    self.metrics.mark("callbackFailures")
                    log.exception("the flush callback failed after version %d was committed", done)
            return done
        except Exception as e:
            failure = e
            raise
        finally:
            if self.after_execute:
                self.after_execute(failure)

    def _merge(self, delta: DataFrame, commit: str, writer: str | None, batch_id: int | None, stamp: str, since: int) -> tuple[int, DataFrame | None, list[str]]:
        before = self.manifest()
        if writer is not None and before["batches"].get(writer, -1) >= batch_id:
            return self.version, None, []
        batch = m.combined(self.spec, delta)
        # a key of which nothing but null is known has no type yet, and no column in the files
        unknown = [k for k, t in batch.dtypes if t == "void"]
        batch = materialize(kept_types(batch.drop(*unknown), before.get("kinds", {})))
        kinds = {k: t for k, t in batch.dtypes if k in self.spec.keys}
        sizes = {r["rollup_id"]: r["n"] for r in batch.groupBy("rollup_id").agg(F.count("*").alias("n")).collect()}  # rollups are declared, so few
        for n in sizes.values():
            self.metrics.sample("incrementSize", n)
        self.metrics.sample("batchCells", sum(sizes.values()))
        names = sorted(sizes)
        increments = self._write(batch) if commit != m.OVERWRITE else {}
        done = next((v for v in range(since + 1, self.version + 1) if self.manifest(v).get("stamp") == stamp), None)
        if done:  # an earlier try failed only after it had committed
            return done, batch, names

        def change(held: dict, version: int) -> dict:
            rollups, known = dict(held["rollups"]), {**kinds, **held.get("kinds", {})}
            if writer is not None and held["batches"].get(writer, -1) >= batch_id:
                return held
            own = batch if known == {**known, **kinds} else kept_types(batch, known)  # another writer was the first to give a type
            if commit == m.OVERWRITE:
                old = self._cells({k: v for k, v in rollups.items() if k in names}, known)
                new = own.withColumns({k: F.lit(None).cast(t) for k, t in old.dtypes if k in unknown})
                rollups |= {k: [v] for k, v in self._write(m.overwrite(self.spec, old, new).drop(*[k for k in unknown if k not in known])).items()}
            else:
                for k, v in (increments if own is batch else self._write(own)).items():
                    rollups[k] = [*rollups.get(k, []), v]
                full = {k: v for k, v in rollups.items() if len(v) > self.config.deltas}
                if full:
                    rollups |= {k: [v] for k, v in self._write(self._cells(full, known).drop(*[k for k in self.spec.keys if k not in known])).items()}
            batches = held["batches"] | ({writer: batch_id} if writer is not None else {})
            return {"rollups": rollups, "batches": batches, "kinds": known, "stamp": stamp}

        return self._commit(change), batch.withColumns({k: F.lit(None).cast("string") for k in unknown}), names

    def _changed(self, batch: DataFrame, names: list[str]) -> DataFrame:
        """The batch's cells with their new stored values."""
        return self.cells(rollups=names).alias("e").join(batch.alias("n"), m.same_cell(self.spec, "e", "n"), "left_semi")

    def replace_by(self, fates: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Commit what ``fates`` makes of the live cells (see ``operators.backfill``); returns counts by action."""
        counts: dict[str, int] = {}

        def change(held: dict, version: int) -> dict:
            live = self.cells(version)
            done = materialize(fates(live))
            counts.clear()
            counts.update({r["action"]: r["n"] for r in done.groupBy("action").agg(F.count("*").alias("n")).collect()})
            cells = done.where(F.col("action") != DELETED).drop("action")
            written = self._write(cells)
            return {"rollups": {k: [v] for k, v in written.items()}, "batches": held["batches"], "kinds": {**held.get("kinds", {}), **{k: t for k, t in cells.dtypes if k in self.spec.keys}}}

        self._commit(change)
        return counts

    def set(self, read: Read, *values: Any) -> int:
        """Overwrite one cell with the given measures."""
        return self.merge(one_cell(self.spark, read, values, self.key_kinds), m.OVERWRITE)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` versions names; returns how many. No writer may be at work."""
        top = self.version
        used = {f.split("/_r=")[0] for v in range(max(1, top - keep + 1), top + 1) for fs in self.manifest(v)["rollups"].values() for f in fs}
        fs, p = self.versions.fs(f"{self.path}/data")
        gone = 0
        for s in fs.listStatus(p) if fs.exists(p) else ():
            if f"data/{s.getPath().getName()}" not in used:
                fs.delete(s.getPath(), True)
                gone += 1
        for v in range(1, top - keep + 1):
            q = self.versions.fs(self.versions._file(v))[1]
            if fs.exists(q):
                fs.delete(q, False)
        return gone

    def flush(self) -> None:
        """Commits are synchronous, so there is nothing to wait for."""

    def shutdown(self) -> None:
        self.flush()


class MemoryStore:
    """Cells of one application, for tests. It combines by compare-and-set or overwrites."""

    def __init__(self, spark: SparkSession, spec: CubeSpec, commit: str = m.READ_COMBINE_CAS, on_flush: Callable[[DataFrame], None] | None = None):
        if commit not in (m.READ_COMBINE_CAS, m.OVERWRITE):
            raise ValueError(f"an in-memory store supports {m.READ_COMBINE_CAS} and {m.OVERWRITE}, not {commit}")
        self.spark, self.spec, self.commit, self.on_flush = spark, spec, commit, on_flush
        self.held: DataFrame | None = None
        self.version = 0

    def cells(self, version: int | None = None, rollups: list[str] | None = None) -> DataFrame:
        if self.held is None:
            raise LookupError("the store is empty")
        return self.held

    def merge(self, delta: DataFrame, commit: str | None = None, writer: str | None = None, batch_id: int | None = None) -> int:
        new = m.combined(self.spec, delta) if self.held is None else m.merge(self.spec, self.held, delta, commit or self.commit)
        self.held = materialize(new)
        self.version += 1
        if self.on_flush:
            try:
                self.on_flush(self.held.alias("e").join(delta.alias("n"), m.same_cell(self.spec, "e", "n"), "left_semi"))
            except Exception:
                log.exception("the flush callback failed after version %d was committed", self.version)
        return self.version

    def set(self, read: Read, *values: Any) -> int:
        """Overwrite one cell with the given measures."""
        kinds = {} if self.held is None else {k: t for k, t in self.held.dtypes if k in self.spec.keys and t != "void"}
        cell = one_cell(self.spark, read, values, kinds)
        return self.merge(cell.withColumns({k: F.col(k).cast("string") for k, t in cell.dtypes if t == "void"}), m.OVERWRITE)

    def get(self, read: Read) -> Row | None:
        read.rollup  # noqa: B018  an invalid read fails even on an empty store
        return None if self.held is None else get(self.held, read)

    def multi_get(self, reads: list[Read]) -> list[Row | None]:
        [r.rollup for r in reads]
        return [None] * len(reads) if self.held is None else multi_get_list(self.held, reads)

    def flush(self) -> None: ...

    def shutdown(self) -> None: ...
