"""Dictionaries: coordinates replaced by short dense ids."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridroll.functions.codecs import long_bytes
from gridroll.metrics import Registry
from gridroll.session import materialize
from gridroll.versions import Versions


def number(values: DataFrame, start: int = 0) -> DataFrame:
    """(dim, coordinate, id): distinct coordinates numbered densely in each dimension, in their order, from ``start``.

    Ranges are numbered where they lie: each partition counts the dimensions
    it holds, one row each, and adds its position to the counts before it. No
    window gathers a dimension in one task.
    """
    spark = values.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(values.dtypes)["coordinate"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            out = []
            for d in b.column("dim").to_pylist():
                out.append(seen.get(d, 0))
                seen[d] = out[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "at"])

    from gridroll.session import ship

    ship(spark)
    ranged = values.select("dim", "coordinate").distinct().repartitionByRange(n, "dim", "coordinate").sortWithinPartitions("dim", "coordinate").withColumn("part", F.spark_partition_id())
    placed = materialize(ranged.mapInArrow(place, f"dim string, coordinate {kind}, part int, at long"))
    base: list[tuple[str, int, int]] = []
    upto: dict[str, int] = {}
    for r in placed.groupBy("dim", "part").agg(F.count("*").alias("n")).orderBy("dim", "part").collect():  # rows: partitions and dimensions
        base.append((r["dim"], r["part"], upto.get(r["dim"], 0)))
        upto[r["dim"]] = base[-1][2] + r["n"]
    held = spark.createDataFrame(base, "dim string, part int, base long")
    return placed.join(F.broadcast(held), ["dim", "part"]).select("dim", "coordinate", (F.col("at") + F.col("base") + start).alias("id"))


def extend(dictionary: DataFrame, values: DataFrame, widths: dict[str, int] | None = None, start: int = 0) -> DataFrame:
    """``dictionary`` with ids for coordinates it lacks; ids once given stay.

    ``widths`` has the bytes of an id by dimension; a dimension that outgrows
    its width raises.
    """
    new = values.select("dim", "coordinate").distinct().join(dictionary, ["dim", "coordinate"], "left_anti")
    last = dictionary.groupBy("dim").agg((F.max("id") + 1).alias("next"))  # a row a dimension
    grown = number(new, 0).join(F.broadcast(last), "dim", "left").select("dim", "coordinate", (F.col("id") + F.coalesce("next", F.lit(start))).alias("id"))
    out = materialize(dictionary.unionByName(grown))
    for r in out.groupBy("dim").agg(F.max("id").alias("top")).collect():
        if widths and r["dim"] in widths and r["top"] - start >= 1 << (8 * widths[r["dim"]]):
            raise OverflowError(f"the ids of dimension {r['dim']!r} do not fit into {widths[r['dim']]} bytes")
    return out


class IdStore:
    """A dictionary in files that any number of writers extend; no two coordinates get one id, and no coordinate two.

    Each version names the folders with its ids and the next free number of
    each dimension. A writer numbers the coordinates that the newest version
    lacks and publishes the next version by compare-and-set; one that was
    overtaken numbers anew, so that no id is wasted either. ``widths`` has the
    bytes of an id by dimension; a dimension that outgrows its width raises and
    nothing is written.
    """

    def __init__(self, spark: SparkSession, path: str, widths: dict[str, int] | None = None, start: int = 0, tries: int = 10, retry_seconds: float = 0.5, metrics: Registry | None = None):
        self.spark, self.path, self.widths, self.start = spark, path.rstrip("/"), widths or {}, start
        self.tries, self.retry_seconds, self.metrics = tries, retry_seconds, metrics or Registry("ids")
        self.versions = Versions(spark, self.path)
        self.metrics.gauge("nextIds", lambda: self._held().get("next", {}))

    def _held(self) -> dict:
        last = self.versions.last
        return self.versions.read(last) if last else {"folders": [], "next": {}}

    def _read(self, folders: Sequence[str]) -> DataFrame:
        schema = "dim string, coordinate string, id long"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def dictionary(self) -> DataFrame:
        """(dim, coordinate, id) of the newest version; coordinates as strings."""
        return self._read(self._held()["folders"])

    def extend(self, values: DataFrame) -> DataFrame:
        """Give ids to the coordinates of ``values`` (dim, coordinate) that have none; returns the dictionary. Nulls get none."""
        wanted = materialize(values.select("dim", F.col("coordinate").cast("string").alias("coordinate")).where("dim is not null and coordinate is not null").distinct())

        def change(held: dict, version: int) -> dict | None:
            new = number(wanted.join(self._read(held["folders"]), ["dim", "coordinate"], "left_anti"))
            counts = {r["dim"]: r["n"] for r in new.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a dimension
            if not counts:
                return None
            after = {d: held["next"].get(d, self.start) + n for d, n in counts.items()}
            for d, n in after.items():
                if d in self.widths and n - self.start > 1 << (8 * self.widths[d]):
                    raise OverflowError(f"the ids of dimension {d!r} do not fit into {self.widths[d]} bytes")
            base = self.spark.createDataFrame([(d, held["next"].get(d, self.start)) for d in counts], "dim string, base long")
            folder = f"data/{uuid.uuid4().hex[:12]}"
            new.join(F.broadcast(base), "dim").select("dim", "coordinate", (F.col("id") + F.col("base")).alias("id")).write.parquet(f"{self.path}/{folder}")
            return {"folders": [*held["folders"], folder], "next": {**held["next"], **after}}

        with self.metrics.timer("idSeconds"):
            self.versions.commit(change, {"folders": [], "next": {}}, self.tries, self.retry_seconds, self.metrics)
        return self.dictionary()

    def find(self, dim: str, coordinate: Any) -> int | None:
        """The id of one coordinate, or None; nothing is added."""
        return finder(self.dictionary())(dim, str(coordinate))

    def get_or_create(self, dim: str, coordinate: Any) -> int:
        return finder(self.extend(self.spark.createDataFrame([(dim, str(coordinate))], "dim string, coordinate string")))(dim, str(coordinate))


def id_bytes(col: Column, width: int) -> Column:
    """An id as ``width`` bytes, big-endian."""
    if not 1 <= width <= 7:
        raise ValueError("ids have 1 to 7 bytes")
    return F.substring(long_bytes(col), 9 - width, width)


def substitute(df: DataFrame, dictionary: DataFrame, dim: str, col: str, to: str) -> DataFrame:
    """``df`` with the id of ``col`` in a column ``to``; null where the dictionary has none, and nothing is added to it."""
    own = dictionary.where(F.col("dim") == dim).select(F.col("coordinate").alias(col), F.col("id").alias(to))
    return df.join(own, col, "left")


def consistency(dictionary: DataFrame, start: int = 0) -> DataFrame:
    """(dim, n, n_ids, n_coordinates, lo, hi, consistent): a dimension is consistent if ids and coordinates are unique and ids dense from ``start``."""
    a = dictionary.groupBy("dim").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.countDistinct("coordinate").alias("n_coordinates"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    return a.withColumn("consistent", (F.col("n") == F.col("n_ids")) & (F.col("n") == F.col("n_coordinates")) & (F.col("lo") == start) & (F.col("hi") == F.col("n") + start - 1))


def exhaustion(dictionary: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(dim, used, room, near): whether a dimension has used more than a third of its ids."""
    spark = dictionary.sparkSession
    w = spark.createDataFrame(list(widths.items()), "dim string, width int")
    used = dictionary.groupBy("dim").agg(F.count("*").alias("used"))
    return used.join(F.broadcast(w), "dim").select("dim", "used", F.pow(F.lit(2.0), F.col("width") * 8).cast("bigint").alias("room")).withColumn("near", F.col("used") * 3 > F.col("room"))


class CachedLookup:
    """Ids of single coordinates for point reads, most recent ones kept in memory.

    ``find`` maps (dim, coordinate) to an id or None. With ``negative`` the
    absence of an id is remembered too.
    """

    def __init__(self, find: Callable[[str, Any], int | None], size: int = 10_000, negative: bool = False):
        self.find, self.size, self.negative = find, size, negative
        self.held: OrderedDict[tuple[str, Any], int | None] = OrderedDict()
        self.hits = self.misses = 0

    def __call__(self, dim: str, coordinate: Any) -> int | None:
        key = (dim, coordinate)
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        found = self.find(dim, coordinate)
        if found is not None or self.negative:
            self.held[key] = found
            if len(self.held) > self.size:
                self.held.popitem(last=False)
        return found

    def many(self, keys: Sequence[tuple[str, Any]], threads: int = 8) -> tuple[list[int | None], set[int]]:
        """Ids in the order asked for, and the positions that have none."""
        with ThreadPoolExecutor(threads) as pool:
            out = list(pool.map(lambda k: self(*k), keys))
        return out, {i for i, x in enumerate(out) if x is None}


def finder(dictionary: DataFrame) -> Callable[[str, Any], int | None]:
    """A lookup in a dictionary table, for ``CachedLookup``."""

    def find(dim: str, coordinate: Any) -> int | None:
        r = dictionary.where((F.col("dim") == dim) & (F.col("coordinate") == F.lit(coordinate))).select("id").first()
        return r["id"] if r else None

    return find
