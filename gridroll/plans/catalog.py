"""The cube queries on the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridroll.functions import bucketers as b
from gridroll.functions import codecs
from gridroll.functions import measures as ms
from gridroll.metrics import by_rollup
from gridroll.operators import backfill, fanout, ids, merge, reads
from gridroll.session import shared_dir, table
from gridroll.sources import points, scans
from gridroll.spec import CubeSpec, Dimension, Read, Rollup
from gridroll.store import CellStore, MemoryStore, StoreConfig
from gridroll.streaming.io import CubeIO
from gridroll.streaming.writer import BATCH_SYNC, write_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


R = Rollup.of


def cents() -> Column:
    return F.round(F.col("value") * 100).cast("bigint")


def plain(cells: DataFrame, *columns: str) -> DataFrame:
    """Cells without the cube's name; key columns as asked for."""
    return cells.select("rollup_id", *[F.col(c) for c in columns])


def events_spec(measures=None, type_source="event_type") -> CubeSpec:
    dims = [Dimension("time", b.Time(), "ts"), Dimension("type", b.string(), type_source), Dimension("user", b.long(), "user_id")]
    return CubeSpec("events", dims, [R(("time", "hour")), R(("time", "day"), "type"), R()], measures or [ms.count("n"), ms.long_sum("cents", cents)])


_EVENTS = "SELECT date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('day', ts)::TIMESTAMP AS d, event_type AS t, user_id AS u, CAST(round(value * 100) AS BIGINT) AS c, * FROM events"


@query(f"""
SELECT 'time_hour' AS rollup_id, h AS time__hour, NULL::TIMESTAMP AS time__day, NULL::VARCHAR AS type__identity, count(*) AS n, sum(c)::BIGINT AS cents FROM ({_EVENTS}) GROUP BY h
UNION ALL SELECT 'time_day-type', NULL, d, t, count(*), sum(c)::BIGINT FROM ({_EVENTS}) GROUP BY d, t
UNION ALL SELECT '__all__', NULL, NULL, NULL, count(*), sum(c)::BIGINT FROM ({_EVENTS})""")
def cube_events_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(fanout.build_cells(events_spec(), table(spark, sf_dir, "events")), "time__hour", "time__day", "type__identity", "n", "cents")


@query(_SQL["cube_events_grouping_sets"])
def cube_events_preaggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(fanout.build_cells(events_spec(), table(spark, sf_dir, "events"), preaggregate=True), "time__hour", "time__day", "type__identity", "n", "cents")


@query("""
WITH g AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'place_region' AS rollup_id, region AS place__region, NULL::VARCHAR AS place__nation, NULL::VARCHAR AS segment__identity, count(*) AS n FROM g GROUP BY region
UNION ALL SELECT 'place_nation-segment', NULL, nation, seg, count(*) FROM g GROUP BY nation, seg
UNION ALL SELECT 'place_region-segment', region, NULL, seg, count(*) FROM g GROUP BY region, seg
UNION ALL SELECT '__all__', NULL, NULL, NULL, count(*) FROM g""")
def cube_geo_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    # nation and region have a fixed, small number of rows
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    place = b.Expressions(lambda c: {"nation": c["nation"], "region": c["region"]}, ["nation", "region"])
    dims = [Dimension("place", place, F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))), Dimension("segment", b.string(), "c_mktsegment")]
    spec = CubeSpec("geo", dims, [R(("place", "region")), R(("place", "nation"), "segment"), R(("place", "region"), "segment"), R()], [ms.count("n")])
    return plain(fanout.build_cells(spec, rows), "place__region", "place__nation", "segment__identity", "n")


@query("SELECT date_trunc('week', ts)::TIMESTAMP AS time__week, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1")
def rollup_week_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CubeSpec("weeks", [Dimension("time", b.Time(["week"]), "ts")], [R(("time", "week"))], [ms.count("n"), ms.long_sum("cents", cents)])
    return fanout.build_cells(spec, table(spark, sf_dir, "events")).select("time__week", "n", "cents")


@query("SELECT user_id AS user__identity, round(sum(value), 4) AS total FROM events GROUP BY 1")
def rollup_double_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CubeSpec("users", [Dimension("user", b.long(), "user_id")], [R("user")], [ms.double_sum("total", "value")])
    return fanout.build_cells(spec, table(spark, sf_dir, "events")).select("user__identity", F.round("total", 4).alias("total"))


def part_spec(rollups) -> CubeSpec:
    dims = [Dimension("word", b.Tags(), F.split("p_name", " ")), Dimension("kind", b.Tags(), F.split("p_type", " ")), Dimension("brand", b.string(), "p_brand")]
    return CubeSpec("parts", dims, rollups, [ms.count("n")])


@query("SELECT w AS word__identity, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) GROUP BY 1")
def rollup_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.build_cells(part_spec([R("word")]), table(spark, sf_dir, "part")).select("word__identity", "n")


@query("""WITH a AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS w, p_type FROM part), c AS (SELECT p_partkey, w, unnest(list_distinct(string_split(p_type, ' '))) AS k FROM a)
SELECT w AS word__identity, k AS kind__identity, count(*) AS n FROM c GROUP BY 1, 2""")
def tags_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.build_cells(part_spec([R("word", "kind")]), table(spark, sf_dir, "part")).select("word__identity", "kind__identity", "n")


@query("""WITH a AS (SELECT p_brand AS br, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part)
SELECT '__all__' AS rollup_id, NULL::VARCHAR AS word__identity, NULL::VARCHAR AS brand__identity, count(*) AS n FROM part
UNION ALL SELECT 'brand', NULL, p_brand, count(*) FROM part GROUP BY p_brand
UNION ALL SELECT 'brand-word', w, br, count(*) FROM a GROUP BY w, br
UNION ALL SELECT 'word', w, NULL, count(*) FROM a GROUP BY w""")
def tags_mixed_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups without tags count a row once; a rollup declared twice is one."""
    return plain(fanout.build_cells(part_spec([R(), R("brand"), R("word", "brand"), R("brand", "word"), R("word")]), table(spark, sf_dir, "part")), "word__identity", "brand__identity", "n")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS attr__k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def rollup_json_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    attr = b.Expressions(lambda c: {"k": F.get_json_object(c, "$.k").cast("bigint")}, ["k"])
    return fanout.build_cells(CubeSpec("attrs", [Dimension("attr", attr, "props")], [R(("attr", "k"))], [ms.count("n")]), table(spark, sf_dir, "events")).select("attr__k", "n")


@query("""WITH e AS (SELECT nullif(event_type, 'error') AS t, date_trunc('day', ts)::TIMESTAMP AS d, user_id AS u FROM events)
SELECT 'time_day-type' AS rollup_id, d AS time__day, t AS type__identity, NULL::BIGINT AS user__identity, count(*) AS n FROM e WHERE t IS NOT NULL GROUP BY d, t
UNION ALL SELECT 'user', NULL, NULL, u, count(*) FROM e GROUP BY u
UNION ALL SELECT 'type-user', NULL, t, u, count(*) FROM e WHERE t IS NOT NULL GROUP BY t, u
UNION ALL SELECT '__all__', NULL, NULL, NULL, count(*) FROM e""")
def omitted_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = events_spec(type_source=F.nullif("event_type", F.lit("error"))).dimensions
    spec = CubeSpec("omitted", dims, [R(("time", "day"), "type"), R("user"), R("type", "user"), R()], [ms.count("n")])
    return plain(fanout.build_cells(spec, table(spark, sf_dir, "events")), "time__day", "type__identity", "user__identity", "n")


@query("SELECT count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents FROM lineitem")
def grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CubeSpec("total", [Dimension("flag", b.string(), "l_returnflag")], [R()], [ms.count("n"), ms.long_sum("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))])
    return fanout.build_cells(spec, table(spark, sf_dir, "lineitem")).select("n", "cents")


def _floor(unit: str) -> None:
    name, col = (("lineitem", "l_shipdate") if unit in ("month", "year") else ("events", "ts"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = CubeSpec("floors", [Dimension("time", b.Time([unit]), col)], [R(("time", unit))], [ms.count("n")])
        return fanout.build_cells(spec, table(spark, sf_dir, name)).select(F.col(f"time__{unit}").alias("bucket"), "n")

    run.__name__ = f"floor_{unit}"
    query(f"SELECT date_trunc('{unit}', {col})::TIMESTAMP AS bucket, count(*) AS n FROM {name} GROUP BY 1")(run)


for _unit in b.FLOORS:
    _floor(_unit)


@query("SELECT l_linenumber AS line__identity, CAST(sum(CAST(l_quantity AS INTEGER)) AS INTEGER) AS quantity FROM lineitem GROUP BY 1")
def int_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CubeSpec("lines", [Dimension("line", b.integer(), "l_linenumber")], [R("line")], [ms.int_sum("quantity", "l_quantity")])
    return fanout.build_cells(spec, table(spark, sf_dir, "lineitem")).select("line__identity", "quantity")


@query("SELECT toxic = 1 AS toxic__identity, quality = 1 AS good__identity, count(*) AS n FROM labels GROUP BY 1, 2")
def bool_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CubeSpec("labels", [Dimension("toxic", b.boolean(), F.col("toxic") == 1), Dimension("good", b.boolean(), F.col("quality") == 1)], [R("toxic", "good")], [ms.count("n")])
    return fanout.build_cells(spec, table(spark, sf_dir, "labels")).select("toxic__identity", "good__identity", "n")


@query("SELECT CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END AS INTEGER) AS type__identity, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1")
def enum_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CubeSpec("enums", [Dimension("type", b.Enum(["view", "click", "signup", "purchase"]), "event_type")], [R("type")], [ms.count("n")])
    return fanout.build_cells(spec, table(spark, sf_dir, "events")).select("type__identity", "n")


@query("SELECT l_suppkey AS supplier__identity, count(*) AS n FROM lineitem GROUP BY 1")
def long_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CubeSpec("suppliers", [Dimension("supplier", b.long(), "l_suppkey")], [R("supplier")], [ms.count("n")])
    return fanout.build_cells(spec, table(spark, sf_dir, "lineitem")).select("supplier__identity", "n")


def _reads(spec: CubeSpec) -> list[Read]:
    t = dt.datetime(2024, 1, 5, 13, 20)
    return [Read(spec).at("time", t, "hour"), Read(spec).at("type", "nobody").at("time", t, "day"), Read(spec).at("type", "click").at("time", t, "day"), Read(spec), Read(spec).at("time", dt.datetime(1999, 1, 1), "hour")]


@query("SELECT count(*) AS n FROM events WHERE date_trunc('day', ts) = TIMESTAMP '2024-01-05' AND event_type = 'click' HAVING count(*) > 0")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = events_spec([ms.count("n")])
    return reads.point(fanout.build_cells(spec, table(spark, sf_dir, "events")), _reads(spec)[2]).select("n")


@query("SELECT count(*) AS n FROM events WHERE event_type = 'nobody' HAVING count(*) > 0")
def point_get_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = events_spec([ms.count("n")])
    return reads.point(fanout.build_cells(spec, table(spark, sf_dir, "events")), _reads(spec)[1]).select("n")


@query("""SELECT 0 AS pos, nullif(count(*), 0) AS n FROM events WHERE date_trunc('hour', ts) = TIMESTAMP '2024-01-05 13:00:00'
UNION ALL SELECT 1, NULL UNION ALL SELECT 2, nullif(count(*), 0) FROM events WHERE date_trunc('day', ts) = TIMESTAMP '2024-01-05' AND event_type = 'click'
UNION ALL SELECT 3, count(*) FROM events UNION ALL SELECT 4, NULL""")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = events_spec([ms.count("n")])
    return reads.multi_get(fanout.build_cells(spec, table(spark, sf_dir, "events")), _reads(spec))


def _halves(spark: SparkSession, sf_dir: str, spec: CubeSpec) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    return fanout.build_cells(spec, e.where("event_id % 2 = 0")), fanout.build_cells(spec, e.where("event_id % 2 = 1"))


@query(_SQL["cube_events_grouping_sets"])
def merge_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches merged are the whole."""
    spec = events_spec()
    return plain(merge.increment(spec, *_halves(spark, sf_dir, spec)), "time__hour", "time__day", "type__identity", "n", "cents")


@query("""WITH c AS (SELECT user_id AS u, event_id % 2 AS half, count(*) AS n FROM events GROUP BY 1, 2)
SELECT u AS user__identity, coalesce(max(CASE WHEN half = 1 THEN n END), max(n)) AS n FROM c GROUP BY u""")
def merge_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CubeSpec("users", [Dimension("user", b.long(), "user_id")], [R("user")], [ms.count("n")])
    return merge.overwrite(spec, *_halves(spark, sf_dir, spec)).select("user__identity", "n")


@query("SELECT user_id AS user__identity, arg_max(CAST(round(value * 100) AS BIGINT), (ts, event_id)) AS cents FROM events GROUP BY 1")
def overwrite_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwriting event by event leaves each user's last value."""
    spec = CubeSpec("users", [Dimension("user", b.long(), "user_id")], [R("user")], [ms.long_sum("cents", cents)])
    e = table(spark, sf_dir, "events").select(F.lit("users").alias("cube"), F.lit("user").alias("rollup_id"), F.col("user_id").alias("user__identity"), cents().alias("cents"), "ts", "event_id")
    return merge.overwrite_in_order(spec, e, F.struct("ts", "event_id")).select("user__identity", "cents")


def _history(spark: SparkSession, sf_dir: str, recount: str) -> tuple[CubeSpec, DataFrame, DataFrame, DataFrame]:
    """Live events, the snapshot of them taken when 6 of 8 were there, and recomputed history."""
    spec = CubeSpec("users", [Dimension("user", b.long(), "user_id"), Dimension("type", b.string(), "event_type")], [R("user"), R("type", "user")], [ms.count("n")])
    e = table(spark, sf_dir, "events")
    make = lambda rows: fanout.build_cells(spec, rows)
    return spec, make(e), make(e.where("event_id % 8 < 6")), make(e.where(recount))


_FATE = """WITH k AS (
  SELECT 'user' AS rollup_id, user_id AS u, NULL::VARCHAR AS t, count(*) AS l, count(*) FILTER (event_id % 8 < 6) AS s, count(*) FILTER ({b}) AS b FROM events GROUP BY user_id
  UNION ALL SELECT 'type-user', user_id, event_type, count(*), count(*) FILTER (event_id % 8 < 6), count(*) FILTER ({b}) FROM events GROUP BY user_id, event_type),
f AS (SELECT rollup_id, u, t, l, CASE WHEN s > 0 AND b = 0 AND l = s THEN NULL ELSE l - s + b END AS n FROM k)
"""


@query(_FATE.format(b="event_id % 3 = 0") + "SELECT rollup_id, u AS user__identity, t AS type__identity, n FROM f WHERE n IS NOT NULL")
def backfill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, live, snap, back = _history(spark, sf_dir, "event_id % 3 = 0")
    return backfill.merged_cells(spec, backfill.three_way(spec, live, snap, back)).select("rollup_id", "user__identity", "type__identity", "n")


@query(_FATE.format(b="false") + "SELECT CASE WHEN n IS NULL THEN 'deleted' WHEN n = l THEN 'unchanged' ELSE 'overwritten' END AS action, count(*) AS n FROM f GROUP BY 1")
def backfill_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, live, snap, back = _history(spark, sf_dir, "false")
    return backfill.counters(backfill.three_way(spec, live, snap, back))


@query("SELECT rollup_id, n FROM (VALUES ('x', 0)) v(rollup_id, n) WHERE false")
def backfill_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing recounted and nothing written since the snapshot: no cell is left."""
    spec, live, _, _ = _history(spark, sf_dir, "false")
    return backfill.merged_cells(spec, backfill.three_way(spec, live, live, live.limit(0))).select("rollup_id", F.col("n").cast("int").alias("n"))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    values = e.select(F.lit("type").alias("dim"), F.col("event_type").alias("coordinate")).unionByName(e.select(F.lit("user").alias("dim"), F.col("user_id").cast("string").alias("coordinate")))
    return ids.number(values)


@query("""SELECT 'type' AS dim, event_type AS coordinate, dense_rank() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)
UNION ALL SELECT 'user', u, dense_rank() OVER (ORDER BY u) - 1 FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events)""")
def id_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir)


@query("SELECT 'type' AS dim, count(DISTINCT event_type) AS n, true AS consistent FROM events UNION ALL SELECT 'user', count(DISTINCT user_id), true FROM events")
def id_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.consistency(_dictionary(spark, sf_dir)).select("dim", "n", "consistent")


@query("""SELECT p_partkey, CAST((((((31 + ((p_partkey >> 24) & 255)) * 31 + ((p_partkey >> 16) & 255)) * 31 + ((p_partkey >> 8) & 255)) * 31 + (p_partkey & 255)) & 255) AS INTEGER) AS byte FROM part""")
def hash_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", codecs.hash_byte(codecs.int_bytes(F.col("p_partkey"))).alias("byte"))


@query("SELECT '01' || printf('%016x', user_id) || CASE WHEN t IS NULL THEN '' ELSE '01' || lower(hex(rpad(t, 8, ' '))) END AS key, count(*) AS n FROM (SELECT user_id, NULL::VARCHAR AS t FROM events UNION ALL SELECT user_id, event_type FROM events) GROUP BY 1")
def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte keys of cells, the types padded to their widest, 8 bytes; a wildcard at the end leaves no trace."""
    spec = CubeSpec("keys", [Dimension("user", b.long(), "user_id"), Dimension("type", b.string(), F.rpad("event_type", 8, " "))], [R("user"), R("user", "type")], [ms.count("n")])
    cells = fanout.build_cells(spec, table(spark, sf_dir, "events"))
    return cells.select(F.lower(F.hex(codecs.row_key(spec, cells, {"user": 8, "type": 8}))).alias("key"), "n")


_FLAT = ["time__hour", "time__day", "type__identity", "n", "cents"]


@query(_SQL["cube_events_grouping_sets"])
def store_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches committed to a Parquet store, and a third delivered again, which changes nothing."""
    spec = events_spec()
    store = CellStore(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}", spec)
    even, odd = _halves(spark, sf_dir, spec)
    store.merge(even, writer="w", batch_id=0)
    store.merge(odd, writer="w", batch_id=1)
    store.merge(odd, writer="w", batch_id=1)
    return plain(store.cells(), *_FLAT)


@query(_SQL["merge_overwrite"])
def store_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = CubeSpec("users", [Dimension("user", b.long(), "user_id")], [R("user")], [ms.count("n")])
    store = CellStore(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}", spec, StoreConfig(commit=merge.OVERWRITE))
    for half in _halves(spark, sf_dir, spec):
        store.merge(half)
    return store.cells().select("user__identity", "n")


@query(_SQL["cube_events_grouping_sets"])
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, merged into a store: the same cells as in one batch."""
    spec, at = events_spec(), f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"
    store = CellStore(spark, at, spec)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    write_stream(points.stream(spark, sf_dir, schema, pathGlobFilter="events.parquet"), store, f"{at}-checkpoint", BATCH_SYNC)
    return plain(store.cells(), *_FLAT)


@query(_FATE.format(b="event_id % 3 = 0") + "SELECT rollup_id, u AS user__identity, t AS type__identity, n FROM f WHERE n IS NOT NULL")
def store_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six eighths of the events, a snapshot, the rest, and history recounted from a third of them."""
    spec, live, snap, back = _history(spark, sf_dir, "event_id % 3 = 0")
    store = CellStore(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}", spec)
    since = store.merge(snap)
    store.merge(fanout.build_cells(spec, table(spark, sf_dir, "events").where("event_id % 8 >= 6")))
    backfill.run_backfill(store, lambda: back, since)
    return store.cells().select("rollup_id", "user__identity", "type__identity", "n")


@query("""WITH d AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events))
SELECT id, count(*) AS n FROM events JOIN d USING (event_type) GROUP BY id""")
def id_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    d = _dictionary(spark, sf_dir)
    return ids.substitute(e.select("event_type"), d, "type", "event_type", "id").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT 'time_hour' AS rollup_id, count(DISTINCT date_trunc('hour', ts)) AS cells FROM events UNION ALL SELECT 'time_day-type', count(DISTINCT (date_trunc('day', ts), event_type)) FROM events UNION ALL SELECT '__all__', 1")
def rollup_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_rollup(fanout.build_cells(events_spec(), table(spark, sf_dir, "events")))


@query("SELECT event_id, event_type FROM events WHERE event_type >= 'click' AND event_type < 'click' || chr(255)")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range scan by key prefix, cut at region bounds."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type").withColumn("key", F.encode("event_type", "UTF-8"))
    return scans.scan(e, scans.prefix_scans(b"click", [b"error", b"clicj", b"purchase"])).drop("key")


def _store(spark: SparkSession, spec: CubeSpec, **config: object) -> CellStore:
    return CellStore(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}", spec, StoreConfig(**config))


@query("SELECT l_linenumber AS line__identity, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1 UNION ALL SELECT 1000, 5")
def store_overwrite_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overwriting store with 32-bit keys: two batches, of which the later stays, and a cell that is set."""
    spec = CubeSpec("lines", [Dimension("line", b.integer(), "l_linenumber")], [R("line")], [ms.count("n")])
    store, rows = _store(spark, spec, commit=merge.OVERWRITE), table(spark, sf_dir, "lineitem")
    for half in (0, 1):
        store.merge(fanout.build_cells(spec, rows.where(F.col("l_orderkey") % 2 == half)))
    store.set(Read(spec).at("line", 1000), 5)
    return store.cells().select("line__identity", "n")


@query("SELECT CAST(p_size AS BIGINT) AS size__identity, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 1000, 7")
def store_set_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell set in an empty store, whose key type holds for what is merged later."""
    spec = CubeSpec("sizes", [Dimension("size", b.integer(), "p_size")], [R("size")], [ms.count("n")])
    store = _store(spark, spec)
    store.set(Read(spec).at("size", 1000), 7)
    store.merge(fanout.build_cells(spec, table(spark, sf_dir, "part")))
    return store.cells().select("size__identity", "n")


@query(_SQL["merge_increment"])
def memory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = events_spec()
    store = MemoryStore(spark, spec)
    for half in _halves(spark, sf_dir, spec):
        store.merge(half)
    return plain(store.cells(), *_FLAT)


@query(_SQL["merge_increment"])
def store_compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers that hold the same version: the one that is overtaken commits on top of the other."""
    spec = events_spec()
    at = f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"
    even, odd = _halves(spark, sf_dir, spec)
    stores = [CellStore(spark, at, spec, StoreConfig(commit=merge.READ_COMBINE_CAS, cas_tries=50, retry_seconds=0.05)) for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda sd: sd[0].merge(sd[1]), zip(stores, (even, odd), strict=True)))
    return plain(stores[0].cells(), *_FLAT)


@query("SELECT CASE user_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS cube, user_id AS user__identity, count(*) AS n FROM events GROUP BY 1, 2")
def cube_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cubes under one path keep to themselves."""
    at = f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}"
    out = []
    for name, rest in (("even", 0), ("odd", 1)):
        spec = CubeSpec(name, [Dimension("user", b.long(), "user_id")], [R("user")], [ms.count("n")])
        store = CellStore(spark, at, spec)
        store.merge(fanout.build_cells(spec, table(spark, sf_dir, "events").where(F.col("user_id") % 2 == rest)))
        out.append(store.cells().select("cube", "user__identity", "n"))
    return out[0].unionByName(out[1])


@query("SELECT l_returnflag AS flag__identity, count(*) AS n FROM lineitem GROUP BY 1")
def raw_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that were made elsewhere go past the bucketers."""
    spec = CubeSpec("flags", [Dimension("flag", b.string(), "l_returnflag")], [R("flag")], [ms.count("n")])
    made = table(spark, sf_dir, "lineitem").groupBy(F.lit("flag").alias("rollup_id"), F.col("l_returnflag").alias("flag__identity")).agg(F.count("*").alias("n"))
    return points.raw_cells(spec, made).select("flag__identity", "n")


@query("SELECT r_name AS region__identity, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def point_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point by point through the batching writer: the 25 nations, a batch of ten cells at a time."""
    spec = CubeSpec("regions", [Dimension("region", b.string(), "r_name")], [R("region")], [ms.count("n")])
    store = _store(spark, spec)
    io = CubeIO(spark, store, {"region__identity": "string"}, BATCH_SYNC, batch_size=3)
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for r in nations.select("r_name").collect():  # nation has a fixed, small number of rows
        io.write_sync(1, at={"region": r["r_name"]})
    io.shutdown()
    return store.cells().select("region__identity", "n")


@query("SELECT r_name AS region__identity, count(*) AS n FROM region GROUP BY 1")
def collection_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection in memory as input, an item a partition."""
    spec = CubeSpec("regions", [Dimension("region", b.string(), "name")], [R("region")], [ms.count("n")])
    items = [r["r_name"] for r in table(spark, sf_dir, "region").select("r_name").collect()]  # region has a fixed, small number of rows
    return fanout.build_cells(spec, points.collection(spark, items, "name string")).select("region__identity", "n")


@query("""WITH e AS (SELECT event_type AS t, CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'look' WHEN 'purchase' THEN 'buy' END AS g FROM events)
SELECT 'type_kind' AS rollup_id, t AS type__kind, NULL::VARCHAR AS type__group, count(*) AS n FROM e GROUP BY t
UNION ALL SELECT 'type_group', NULL, g, count(*) FROM e WHERE g IS NOT NULL GROUP BY g""")
def hierarchy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchy by a fixed map; what it lacks has no cell on that level."""
    kinds = b.Hierarchy("kind", group={"view": "look", "click": "look", "purchase": "buy"})
    spec = CubeSpec("kinds", [Dimension("type", kinds, "event_type")], [R(("type", "kind")), R(("type", "group"))], [ms.count("n")])
    return plain(fanout.build_cells(spec, table(spark, sf_dir, "events")), "type__kind", "type__group", "n")


@query("SELECT user_id AS user__identity, CAST(max(round(value * 100)) AS BIGINT) AS top FROM events GROUP BY 1")
def custom_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure of the user's own, the largest value, merged from two batches."""
    top = ms.Measure("top", "bigint", lambda: F.max(cents()), F.max, F.greatest, lambda a, c: a, max)
    spec = CubeSpec("tops", [Dimension("user", b.long(), "user_id")], [R("user")], [top])
    return merge.increment(spec, *_halves(spark, sf_dir, spec)).select("user__identity", "top")


@query("SELECT user_id AS user__identity, count(*) AS n FROM events GROUP BY 1")
def result_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose measure is stored as bytes, parsed back."""
    spec = CubeSpec("users", [Dimension("user", b.long(), "user_id")], [R("user")], [ms.count("n")])
    cells = fanout.build_cells(spec, table(spark, sf_dir, "events"))
    stored = cells.select("user__identity", codecs.value_bytes(F.col("n"), "bigint").alias("value"))
    return scans.parsed(spec, stored).select("user__identity", "n")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def split_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans between derived split keys read every row once."""
    e = table(spark, sf_dir, "events").select("event_id", codecs.long_bytes(F.col("event_id")).alias("key"))
    parts = [scans.scan(e, [r]) for r in scans.prefix_scans(b"", scans.split_keys(e, 4))]
    return reduce(DataFrame.unionByName, parts).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("""SELECT dim, count(*) AS n, count(DISTINCT id) AS ids, max(id) AS top FROM (
  SELECT 'type' AS dim, dense_rank() OVER (ORDER BY event_type) AS id FROM (SELECT DISTINCT event_type FROM events)
  UNION ALL SELECT 'user', dense_rank() OVER (ORDER BY user_id) FROM (SELECT DISTINCT user_id FROM events)) GROUP BY dim""")
def id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durable ids from 1, given by two writers at once; one of them asks again for what has ids."""
    at = f"{shared_dir(spark)}/ids/{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    values = lambda rows: rows.select(F.lit("type").alias("dim"), F.col("event_type").alias("coordinate")).unionByName(rows.select(F.lit("user").alias("dim"), F.col("user_id").cast("string").alias("coordinate")))
    stores = [ids.IdStore(spark, at, start=1, tries=50, retry_seconds=0.05) for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda s: s[0].extend(values(e.where(s[1]))), zip(stores, ("event_id % 3 < 2", "event_id % 3 > 0"), strict=True)))
    return stores[0].extend(values(e)).groupBy("dim").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("id").alias("top"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
