"""Stores, commits, backfill, streaming, point IO, ids, codecs, scans, metrics."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from gridroll.functions import bucketers as b
from gridroll.functions import codecs
from gridroll.functions import measures as ms
from gridroll.metrics import Registry, by_rollup, observed
from gridroll.operators import backfill, ids
from gridroll.operators.fanout import build_cells
from gridroll.operators.merge import INCREMENT, OVERWRITE, READ_COMBINE_CAS
from gridroll.sources.points import stream
from gridroll.sources.scans import KeyRange, packed, parsed, prefix_scans, scan, split_keys
from gridroll.spec import CubeSpec, Dimension, Read, Rollup
from gridroll.store import CellStore, MemoryStore, Store, StoreConfig
from gridroll.streaming.io import AsyncException, Batch, CubeIO
from gridroll.streaming.writer import BATCH_ASYNC, BATCH_SYNC, FULL_SYNC, write_stream

R = Rollup.of
T = dt.datetime(2024, 5, 6, 7, 30)
ZIP = CubeSpec("zip", [Dimension("time", b.Time(["hour", "day"]), "ts"), Dimension("zip", b.string(), "zip")], [R(("time", "hour"), "zip"), R(("time", "day"), "zip"), R(("time", "hour")), R(("time", "day"))], [ms.long_sum("value", "op")])
KINDS = {"time__hour": "timestamp_ntz", "time__day": "timestamp_ntz", "zip__identity": "string"}
ROW = "ts timestamp_ntz, zip string, op long"


def at(zip_=None, t=T, unit="hour"):
    r = Read(ZIP).at("time", t, unit)
    return r.at("zip", zip_) if zip_ else r


def cells(spark, *data):
    return build_cells(ZIP, spark.createDataFrame(list(data), ROW))


def value(r):
    return None if r is None else r["value"]


@pytest.mark.parametrize("kind", ["parquet", "memory"])
def test_contract(spark, tmp_path, kind):
    store = CellStore(spark, str(tmp_path), ZIP) if kind == "parquet" else MemoryStore(spark, ZIP)
    assert store.get(at("97201")) is None
    store.merge(cells(spark, (T, "97201", 5)))
    store.merge(cells(spark, (T + dt.timedelta(hours=1), "97201", 10)))
    later = T + dt.timedelta(hours=1)
    got = store.multi_get([at("97207"), at("97201"), at("97201", later), at("97207", later), at("97201", unit="day"), at("97207", unit="day")])
    assert [value(x) for x in got] == [None, 5, 10, None, 15, None]
    assert value(store.get(at(unit="day"))) == 15
    with pytest.raises(ValueError):
        store.get(Read(ZIP).at("zip", "97201"))


def test_overwrite_and_set(spark, tmp_path):
    store = CellStore(spark, str(tmp_path), ZIP, StoreConfig(commit=OVERWRITE))
    store.merge(cells(spark, (T, "a", 1), (T, "b", 7)))
    store.merge(cells(spark, (T, "a", 1), (T, "a", 1)))  # within a batch values add up
    assert value(store.get(at("a"))) == 2 and value(store.get(at("b"))) == 7
    store.set(at("b"), 100)
    assert value(store.get(at("b"))) == 100 and value(store.get(at("a"))) == 2


def test_compaction_versions_vacuum(spark, tmp_path):
    flushed = []
    store = CellStore(spark, str(tmp_path), ZIP, StoreConfig(deltas=2), on_flush=lambda df: flushed.append(df.count()))
    for i in range(4):
        store.merge(cells(spark, (T, "a", 1)))
        assert value(store.get(at("a"))) == i + 1
    assert flushed == [4] * 4 and store.version == 4
    assert store.cells(1).where("rollup_id = 'time_hour'").first()["value"] == 1  # old versions stay readable
    assert max(len(v) for v in store.manifest()["rollups"].values()) <= 2
    assert store.vacuum(1) > 0 and value(store.get(at("a"))) == 4


def test_batch_ids_and_concurrency(spark, tmp_path):
    store = CellStore(spark, str(tmp_path), ZIP, StoreConfig(commit=READ_COMBINE_CAS, cas_tries=50, retry_seconds=0.05))
    for _ in range(2):
        store.merge(cells(spark, (T, "a", 1)), writer="w", batch_id=0)
    assert value(store.get(at("a"))) == 1
    errors = []

    def work():
        try:
            for _ in range(2):
                CellStore(spark, str(tmp_path), ZIP, StoreConfig(cas_tries=50, retry_seconds=0.05)).merge(cells(spark, (T, "a", 1)))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and value(store.get(at("a"))) == 9


def test_torn_manifest_is_never_seen(spark, tmp_path):
    """A writer that dies before its version has a name leaves the store as it was."""
    store = CellStore(spark, str(tmp_path), ZIP)
    store.merge(cells(spark, (T, "a", 1)))
    for crash in ("write", "name"):
        dying = CellStore(spark, str(tmp_path), ZIP, StoreConfig(tries=1))
        if crash == "name":
            dying.versions._name = lambda *_: (_ for _ in ()).throw(RuntimeError("killed"))
        else:
            (tmp_path / "zip/_manifests/.aside").write_text('{"rol')
            continue
        with pytest.raises(RuntimeError):
            dying.merge(cells(spark, (T, "a", 1)))
    assert store.version == 1 and value(store.get(at("a"))) == 1
    assert not store.versions.publish(1, {}) and store.versions.publish(2, store.manifest(1))


@pytest.mark.parametrize("commit", [INCREMENT, OVERWRITE])
def test_int_keys(spark, tmp_path, commit):
    """Key types are those of the first values, whichever way they come."""
    spec = CubeSpec("n", [Dimension("k", b.integer(), "k"), Dimension("z", b.string(), "z")], [R("k"), R("k", "z")], [ms.count("n")])
    rows = build_cells(spec, spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, z string"))
    first = CellStore(spark, str(tmp_path / "1"), spec, StoreConfig(commit=commit))
    first.merge(rows)
    first.merge(rows)
    assert first.get(Read(spec).at("k", 1))["n"] == (2 if commit == OVERWRITE else 4) and dict(first.cells().dtypes)["k__identity"] == "int"
    later = CellStore(spark, str(tmp_path / "2"), spec, StoreConfig(commit=commit))
    later.set(Read(spec).at("k", 9), 100)
    later.merge(rows)
    later.set(Read(spec).at("k", 1).at("z", "a"), 50)
    got = later.multi_get([Read(spec).at("k", 9), Read(spec).at("k", 1), Read(spec).at("k", 1).at("z", "a"), Read(spec).at("k", 2).at("z", "a")])
    assert [r["n"] for r in got] == [100, 2, 50, 1] and later.cells().count() == 6


def test_callback_cannot_fail_a_commit(spark, tmp_path):
    def boom(df):
        raise RuntimeError("callback")

    seen = []
    store = CellStore(spark, str(tmp_path), ZIP, on_flush=boom, after_execute=seen.append)
    store.merge(cells(spark, (T, "a", 1)))
    assert value(store.get(at("a"))) == 1 and seen == [None] and store.metrics.counts["callbackFailures"] == 1
    memory = MemoryStore(spark, ZIP, on_flush=boom)
    assert memory.merge(cells(spark, (T, "a", 1))) == 1


def test_io_retry(spark, tmp_path):
    """Storage that fails now and then costs tries; a commit that went through before the error counts once."""
    store = CellStore(spark, str(tmp_path), ZIP, StoreConfig(retry_seconds=0.01))
    left, write, publish = [2], store._write, store.versions.publish

    def flaky(df):
        if left[0]:
            left[0] -= 1
            raise OSError("disk")
        return write(df)

    store._write = flaky
    assert store.merge(cells(spark, (T, "a", 1))) == 1 and store.metrics.counts["ioRetries"] == 2

    def lost_answer(version, content):
        publish(version, content)
        store.versions.publish = publish
        raise OSError("answer lost")

    store.versions.publish = lost_answer
    assert store.merge(cells(spark, (T, "a", 5))) == 2 and value(store.get(at("a"))) == 6
    left[0] = 99
    with pytest.raises(OSError):
        store.merge(cells(spark, (T, "a", 1)))
    assert store.metrics.counts["flushFailures"] == 1 and left[0] == 99 - store.config.tries
    left[0] = 0
    bad = cells(spark, (T, "a", 1)).withColumn("value", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):  # not an error of storage: one try
        store.merge(bad)
    assert isinstance(store, Store) and isinstance(MemoryStore(spark, ZIP), Store)
    name = "gridroll:type=zip,name="
    assert store.metrics.report()[name + "batchCells"]["n"] >= 2 and store.metrics.report()[name + "casTries"]["max"] == 1


def test_memory_store_commits(spark):
    with pytest.raises(ValueError):
        MemoryStore(spark, ZIP, INCREMENT)


def test_backfill(spark, tmp_path):
    """Recounting what is there changes nothing; recounting nothing deletes; later writes survive."""
    store = CellStore(spark, str(tmp_path), ZIP)
    data = [(T, "a", 5), (T, "b", 2)]
    store.merge(cells(spark, *data))
    v = store.version
    assert backfill.run_backfill(store, lambda: cells(spark, *data)) == {"unchanged": 6}

    def recount():
        store.merge(cells(spark, (T, "a", 6), (T, "c", 7)))
        return cells(spark, (T, "a", 5))

    counts = backfill.run_backfill(store, recount, v)
    assert counts["deleted"] == 2
    assert [value(x) for x in store.multi_get([at("a"), at("b"), at("c"), at()])] == [11, None, 7, 18]


def test_new_dimension(spark, tmp_path):
    """A dimension appended later leaves old cells valid."""
    old = CellStore(spark, str(tmp_path), ZIP)
    old.merge(cells(spark, (T, "a", 1)))
    wide = ZIP.extended([Dimension("color", b.string(), "color")], [R("color", ("time", "hour"))])
    new = CellStore(spark, str(tmp_path), wide)
    new.merge(build_cells(wide, spark.createDataFrame([(T, "a", 1, "RED")], ROW + ", color string")))
    assert value(new.get(Read(wide).at("color", "RED").at("time", T, "hour"))) == 1
    assert value(new.get(Read(wide).at("time", T, "hour").at("zip", "a"))) == 2
    assert value(old.get(at("a"))) == 2


@pytest.mark.parametrize("sync", [BATCH_SYNC, BATCH_ASYNC])
def test_stream(spark, tmp_path, sync):
    src = str(tmp_path / "in")
    spark.createDataFrame([(T, "a", i) for i in range(20)], ROW).repartition(4).write.parquet(src)
    store = CellStore(spark, str(tmp_path / "store"), ZIP)
    s = stream(spark, src, ROW, max_files=1)
    q = write_stream(s, store, str(tmp_path / "cp"), sync, "100 milliseconds")
    if sync == BATCH_ASYNC:
        q.processAllAvailable()
        q.stop()
    assert value(store.get(at("a"))) == 190 and store.version >= 2
    q = write_stream(s, store, str(tmp_path / "cp"), BATCH_SYNC)  # nothing new: nothing is added
    assert value(store.get(at("a"))) == 190
    with pytest.raises(ValueError):
        write_stream(s, store, str(tmp_path / "cp"), "SOON")


def test_stream_failure_ends_query(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(T, "a", 1)], ROW).write.parquet(src)

    class Broken:
        spec = ZIP

        def merge(self, *a, **k):
            raise OSError("disk gone")

    with pytest.raises(Exception, match="disk gone"):
        write_stream(stream(spark, src, ROW), Broken(), str(tmp_path / "cp"), BATCH_SYNC)


def test_point_io(spark):
    clock = [0.0]
    store = MemoryStore(spark, ZIP)
    io = CubeIO(spark, store, KINDS, BATCH_SYNC, batch_size=1000, batch_millis=1000, clock=lambda: clock[0])
    io.write_sync(1, at={"time": T, "zip": "a"})
    assert io.get(at("a")) is None  # not flushed, not seen
    clock[0] = 1.001
    io.write_sync(1, at={"time": T, "zip": "a"})  # the first write after the deadline flushes
    assert value(io.get(at("a"))) == 2
    io.write_sync(1, at={"time": T, "zip": "a"})
    assert value(io.get(at("a"))) == 2
    io.shutdown()
    assert value(store.get(at("a"))) == 3
    sized = CubeIO(spark, MemoryStore(spark, ZIP), KINDS, BATCH_SYNC, batch_size=5)
    sized.write_sync(1, at={"time": T, "zip": "a"})
    sized.write_sync(1, at={"time": T, "zip": "a"})  # the same four cells
    assert sized.get(at("a")) is None
    sized.write_sync(1, at={"time": T, "zip": "b"})  # six cells
    assert value(sized.get(at("a"))) == 2
    report = sized.metrics.report()
    assert report["gridroll:type=zip,name=flushesDueToSize"] == 1 and report["gridroll:type=zip,name=rollup.time_hour.write"] == 3


def test_point_io_levels_and_poison(spark):
    with pytest.raises(ValueError):
        CubeIO(spark, MemoryStore(spark, ZIP), KINDS, BATCH_ASYNC).write_sync(1, at={"time": T})
    store = MemoryStore(spark, ZIP)
    io = CubeIO(spark, store, KINDS, FULL_SYNC)
    io.write_sync(batch=Batch(ZIP, {("time_hour", (T.replace(minute=0), None, None)): (4,)}))
    assert value(store.get(at())) == 4

    def fail(*a, **k):
        raise OSError("gone")

    store.merge = fail
    with pytest.raises(OSError):
        io.write_sync(1, at={"time": T})
    with pytest.raises(AsyncException):
        io.write_async(1, at={"time": T})


def test_ids(spark):
    values = spark.createDataFrame([("d", f"v{i:03d}") for i in range(300)] * 2 + [("e", "x")], "dim string, coordinate string")
    one = ids.number(values)
    assert [r["id"] for r in one.where("dim = 'd'").orderBy("coordinate").collect()] == list(range(300))
    more = ids.extend(one, spark.createDataFrame([("d", "v000"), ("d", "new"), ("f", "y")], "dim string, coordinate string"))
    got = {(r["dim"], r["coordinate"]): r["id"] for r in more.collect()}
    assert got["d", "new"] == 300 and got["d", "v000"] == 0 and got["f", "y"] == 0 and got["e", "x"] == 0
    assert {r["dim"]: r["consistent"] for r in ids.consistency(more).collect()} == {"d": True, "e": True, "f": True}
    assert not ids.consistency(more.where("id <> 5")).where("dim = 'd'").first()["consistent"]
    with pytest.raises(OverflowError):
        ids.extend(one, values, {"d": 1})
    near = {r["dim"]: r["near"] for r in ids.exhaustion(more, {"d": 1, "e": 1}).collect()}
    assert near == {"d": True, "e": False}
    got = ids.substitute(spark.createDataFrame([("v002",), ("zz",)], "coordinate string").toDF("c"), more, "d", "c", "id").orderBy("c").collect()
    assert [r["id"] for r in got] == [2, None]
    assert spark.range(1).select(ids.id_bytes(F.lit(258), 5)).first()[0] == bytes([0, 0, 0, 1, 2])


def test_id_store(spark, tmp_path):
    """Writers that start from the same version give no id twice; ids stay; an exhausted dimension raises and stays as it was."""
    stores = [ids.IdStore(spark, str(tmp_path), {"narrow": 1}, start=1, tries=50, retry_seconds=0.05) for _ in range(3)]
    values = lambda names, dim="d": spark.createDataFrame([(dim, x) for x in names], "dim string, coordinate string")
    parts = [[f"v{i}" for i in range(k, k + 20)] + [None] for k in (0, 10, 20)]
    threads = [threading.Thread(target=lambda s=s, p=p: s.extend(values(p))) for s, p in zip(stores, parts, strict=True)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = {r["coordinate"]: r["id"] for r in stores[0].dictionary().collect()}
    assert sorted(got) == sorted(f"v{i}" for i in range(40)) and sorted(got.values()) == list(range(1, 41))
    assert {r["coordinate"]: r["id"] for r in stores[1].extend(values(["v3", "w"])).collect()} == got | {"w": 41}
    assert stores[2].find("d", "w") == 41 and stores[2].find("d", "x") is None and stores[2].get_or_create("d", "w") == 41
    stores[0].extend(values(range(256), "narrow"))
    for _ in range(2):
        with pytest.raises(OverflowError):
            stores[0].extend(values(["one more"], "narrow"))
    assert stores[0].dictionary().where("dim = 'narrow'").count() == 256


def test_cached_lookup():
    asked = []
    find = lambda d, c: asked.append(c) or (None if c == "no" else len(c))
    plain, negative = ids.CachedLookup(find), ids.CachedLookup(find, negative=True)
    for look, n in ((plain, 2), (negative, 1)):
        asked.clear()
        [look("d", "no") for _ in range(2)]
        assert len(asked) == n
    assert plain.many([("d", "abc"), ("d", "no"), ("d", "a")]) == ([3, None, 1], {1})


def test_codecs(spark):
    one = lambda c: bytes(spark.range(1).select(c).first()[0])
    assert one(codecs.bool_bytes(F.lit(True))) == b"\x01" and one(codecs.bool_bytes(F.lit(False))) == b"\x00"
    assert one(codecs.long_bytes(F.lit(5))) == b"\0\0\0\0\0\0\0\x05"
    assert [one(codecs.int_bytes(F.lit(x))).hex() for x in (-1, 2147483647, -2147483648)] == ["ffffffff", "7fffffff", "80000000"]
    assert [one(codecs.ordinal_bytes(F.lit(n), w)) for n, w in ((1, 5), (2, 1), (2, 3), (2, 9))] == [b"\0\0\0\0\x01", b"\x02", b"\0\0\x02", b"\0" * 8 + b"\x02"]
    raw = bytes.fromhex("002301050e1e11d2")
    assert codecs.hash_byte_of(raw) == 0xB9 == spark.range(1).select(codecs.hash_byte(F.lit(bytearray(raw)))).first()[0]
    assert codecs.hash_byte_of(raw, 1) == spark.range(1).select(codecs.hash_byte(F.lit(bytearray(raw[1:])))).first()[0]
    assert spark.range(1).select(codecs.hash_byte(F.lit(bytearray()))).first()[0] == 1 == codecs.hash_byte_of(b"")
    with pytest.raises(ValueError):
        codecs.hash_byte_of(raw, 3, 2)
    for kind, v in (("bigint", -7), ("int", 7), ("double", 1.2)):
        assert codecs.decode_value(codecs.encode_value(v, kind), kind) == v


def test_row_keys(spark):
    spec = CubeSpec("k", [Dimension("t", b.Time(["hour", "day"]), "ts"), Dimension("z", b.string(), "zip")], [R("z"), R(("t", "day")), R(("t", "hour"), "z"), R()])
    df = build_cells(spec, spark.createDataFrame([(dt.datetime(1970, 1, 1, 1, 5), "ab")], "ts timestamp_ntz, zip string"))
    got = {r["rollup_id"]: bytes(r["k"]).hex() for r in df.select("rollup_id", codecs.row_key(spec, df, {"t": 8, "z": 2}).alias("k")).collect()}
    assert got == {"__all__": "", "z": "00" + "00" * 9 + "016162", "t_day": "0101" + "00" * 8, "t_hour-z": "0100" + f"{3_600_000:016x}" + "016162"}
    salted = df.select(codecs.row_key(spec, df, {"t": 8, "z": 2}, prefix=b"P", salted=True).alias("k")).where("length(k) = 2").first()["k"]
    assert bytes(salted) == b"P\x01"
    with pytest.raises(Exception, match="not 3"):
        df.select(codecs.row_key(spec, df, {"t": 8, "z": 3})).collect()


def test_scans(spark):
    keys = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"c00", b"c11", b"e", b"g")], "key binary")
    splits = [b"d", b"c01"]
    assert len(prefix_scans(b"", [])) == 1 and len(prefix_scans(b"", splits)) == 3
    counts = lambda p: [scan(keys, [r]).count() for r in prefix_scans(p, splits)]
    assert counts(b"e") == [1] and counts(b"d") == [0] and counts(b"c") == [1, 1]
    assert KeyRange(b"a", b"b").predicate(F.col("key")) is not None


def test_split_keys_and_parsers(spark):
    rows = [(bytes([k]), codecs.encode_value(k - 100, "bigint") + codecs.encode_value(-k, "int") + codecs.encode_value(k / 7 - 3, "double")) for k in range(200)]
    df = spark.createDataFrame(rows, "key binary, value binary")
    splits = split_keys(df, 4)
    sizes = [scan(df, [r]).count() for r in prefix_scans(b"", splits)]
    assert len(splits) == 3 and sum(sizes) == 200 and max(sizes) < 150
    assert split_keys(df.where("false"), 4) == []
    three = CubeSpec("p", [Dimension("k", b.long(), "k")], [R("k")], [ms.long_sum("a"), ms.int_sum("b"), ms.double_sum("c")])
    got = parsed(three, df, packed()).orderBy("key").collect()
    assert [(r["a"], r["b"], r["c"]) for r in got] == [(k - 100, -k, k / 7 - 3) for k in range(200)]
    one = CubeSpec("p", [Dimension("k", b.long(), "k")], [R("k")], [ms.double_sum("c")])
    odd = [0.0, -0.0, float("inf"), -1e-310, 1.7e308]
    back = parsed(one, spark.createDataFrame([(i, codecs.encode_value(x, "double")) for i, x in enumerate(odd)] + [(9, None)], "i int, value binary")).orderBy("i").collect()
    assert [r["c"] for r in back] == [*odd, None]
    with pytest.raises(ValueError):
        parsed(three, df)
    with pytest.raises(Exception, match="bytes"):
        parsed(one, spark.createDataFrame([(b"xx",)], "value binary")).collect()


def test_metrics(spark):
    r = Registry("x")
    with r.timer("t"):
        pass
    r.gauge("g", lambda: 3)
    assert r.report()["gridroll:type=x,name=t"]["n"] == 1 and r.report()["gridroll:type=x,name=g"] == 3
    df, o = observed(cells(spark, (T, "a", 1), (T, "b", 1)))
    assert df.count() == 6 and o.get["cells"] == 6
    assert {x["rollup_id"]: x["cells"] for x in by_rollup(df).collect()}["time_hour-zip"] == 2
