"""Fan-out, rollups, reads, measures, floors: golden vectors and a model of single points."""

import datetime as dt
import random
import warnings
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridroll.functions import bucketers as b
from gridroll.functions import measures as ms
from gridroll.operators import backfill, fanout, merge, reads
from gridroll.sources.points import collection, raw_cells, rows
from gridroll.spec import ALL, CubeSpec, Dimension, Read, Rollup

R = Rollup.of
NOW = dt.datetime(2015, 8, 15)
CITY = {"PORTLAND": "OREGON", "SALEM": "OREGON", "SANFRANCISCO": "CALIFORNIA", "SACRAMENTO": "CALIFORNIA", "OLYMPIA": "WASHINGTON", "SEATTLE": "WASHINGTON"}
DEVICE = {"HTC_MYTOUCH": "ANDROID", "SAMSUNG_GALAXY": "ANDROID", "IPAD": "APPLE", "IPHONE": "APPLE"}


def mobile():
    dims = [Dimension("time", b.Time(), "ts"), Dimension("place", b.Hierarchy("city", state=CITY), "city"), Dimension("device", b.Hierarchy("device", os=DEVICE), "device")]
    rollups = [R(("place", "city"), ("device", "os")), R(("place", "state")), R(("place", "state"), ("device", "device")), R(("time", "month"), ("place", "state")), R(("time", "hour")), R(("device", "device"), ("time", "day")), R(), R(("time", "month"), ("place", "state"), ("device", "os"))]
    return CubeSpec("mobile", dims, rollups)


def test_hierarchies(spark):
    spec = mobile()
    data = [("IPHONE", "PORTLAND", NOW), ("IPAD", "PORTLAND", NOW), ("SAMSUNG_GALAXY", "PORTLAND", NOW), ("HTC_MYTOUCH", "PORTLAND", NOW), ("HTC_MYTOUCH", "PORTLAND", dt.datetime(2015, 7, 15)), ("IPAD", "SEATTLE", NOW), ("IPAD", "SEATTLE", NOW - dt.timedelta(hours=1)), ("IPHONE", "SEATTLE", NOW), ("IPHONE", "OLYMPIA", NOW - dt.timedelta(days=1)), ("IPHONE", "OLYMPIA", dt.datetime(2015, 7, 15)), ("IPHONE", "OLYMPIA", dt.datetime(2015, 7, 15)), ("IPHONE", "SEATTLE", dt.datetime(2015, 7, 15))]
    cells = fanout.build_cells(spec, spark.createDataFrame(data, "device string, city string, ts timestamp_ntz")).cache()
    r = Read(spec)
    asked = [
        (r.at("place", "PORTLAND", "city").at("device", "APPLE", "os"), 2),
        (r.at("place", "PORTLAND", "city").at("device", "ANDROID", "os"), 3),
        (r.at("place", "OREGON", "state"), 5),
        (r.at("device", "IPHONE", "device").at("time", NOW, "day"), 2),
        (r.at("time", NOW + dt.timedelta(minutes=59), "hour"), 6),
        (r, 12),
        (r.at("place", "WASHINGTON", "state").at("time", dt.datetime(2015, 7, 20), "month").at("device", "APPLE", "os"), 3),
        (r.at("place", "NEVADA", "state"), None),
    ]
    got = reads.multi_get_list(cells, [a for a, _ in asked])
    assert [None if x is None else x["value"] for x in got] == [n for _, n in asked]
    assert reads.get(cells, asked[2][0])["value"] == 5 and reads.get(cells, asked[-1][0]) is None
    with pytest.raises(ValueError, match="no rollup stores"):
        reads.multi_get(cells, [r, r.at("place", "SALEM", "city")])
    with pytest.raises(ValueError, match="bucketed"):
        r.at("time", NOW)


def test_omitted_dimension(spark):
    spec = CubeSpec("xyz", [Dimension(c, b.long(), c) for c in "xyz"], [R("x", "y"), R("y", "z")])
    cells = fanout.build_cells(spec, rows(spark, [{"x": 1, "y": 1}, {"y": 1, "z": 1}], "x long, y long, z long"))
    assert reads.get(cells, Read(spec).at("x", 1).at("y", 1))["value"] == 1
    assert cells.count() == 2


def _random_rows(seed, n=300):
    rng = random.Random(seed)
    pick = lambda xs, p=0.2: None if rng.random() < p else rng.choice(xs)
    tags = lambda: None if rng.random() < 0.1 else [rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(4))]
    return [(pick([1, 2]), pick(["u", ""]), tags(), tags(), rng.randrange(-5, 9)) for _ in range(n)]


TAGGED = CubeSpec(
    "tagged",
    [Dimension("x", b.long(), "x"), Dimension("y", b.string(), "y"), Dimension("s", b.Tags(), "s"), Dimension("t", b.Tags(), "t")],
    [R(), R("x"), R("x", "y"), R("s"), R("s", "t"), R("t", "x"), R("x", "t"), R("y", "s"), R("y")],
    [ms.count("n"), ms.long_sum("v", "v")],
)


@pytest.mark.parametrize("preaggregate", [False, True])
def test_against_model(spark, preaggregate):
    """Cells of a table are those of its points, one by one; tags, nulls, repeats and all."""
    data = _random_rows(3)
    n, v = Counter(), Counter()
    for x, y, s, t, val in data:
        for a in TAGGED.addresses({"x": x, "y": y, "s": s, "t": t}):
            n[a] += 1
            v[a] += val
    cells = fanout.build_cells(TAGGED, spark.createDataFrame(data, "x long, y string, s array<string>, t array<string>, v long"), preaggregate)
    got = {(r["rollup_id"], tuple(r[k] for k in TAGGED.keys)): (r["n"], r["v"]) for r in cells.collect()}
    assert got == {a: (n[a], v[a]) for a in n}


def test_batches_add_up(spark):
    """Any split into batches gives the same cells; every rollup of single-valued dimensions sums to the total."""
    df = spark.createDataFrame(_random_rows(5), "x long, y string, s array<string>, t array<string>, v long").withColumn("i", F.monotonically_increasing_id() % 3)
    whole = {tuple(r) for r in fanout.build_cells(TAGGED, df).collect()}
    parts = fanout.build_cells(TAGGED, df.where("i = 0"))
    for i in (1, 2):
        parts = merge.increment(TAGGED, parts, fanout.build_cells(TAGGED, df.where(f"i = {i}")))
    assert {tuple(r) for r in parts.collect()} == whole


def test_empty_input(spark):
    assert fanout.build_cells(mobile(), spark.createDataFrame([], "device string, city string, ts timestamp_ntz")).count() == 0
    only = CubeSpec("one", [Dimension("x", b.long(), "x")], [R()])
    assert fanout.build_cells(only, spark.createDataFrame([], "x long")).count() == 0


def test_declarations():
    d = Dimension("x", b.Time(["hour"]))
    with pytest.raises(ValueError, match="unknown dimension"):
        CubeSpec("c", [d], [R("z")])
    with pytest.raises(ValueError, match="one bucket type only"):
        R(("x", "hour"), ("x", "day"))
    with pytest.raises(ValueError, match="no bucket type"):
        CubeSpec("c", [d], [R(("x", "minute"))])
    with pytest.warns(UserWarning, match="stays empty"):
        CubeSpec("c", [d], [R(("x", "week"))])
    with pytest.raises(ValueError, match="unsupported"):
        b.Time(["minute"])
    with pytest.raises(ValueError, match="at least one"):
        b.Expressions(lambda c: {}, [])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert len(CubeSpec("c", [Dimension("x"), Dimension("y")], [R("x", "y"), R("y", "x")]).rollups) == 1
    assert R().name == ALL and R("b", ("a", "hour")).name == "a_hour-b"


def test_floors(spark):
    t, want = dt.datetime(2012, 7, 19, 14, 40, 12, 34000), {"hour": dt.datetime(2012, 7, 19, 14), "day": dt.datetime(2012, 7, 19), "week": dt.datetime(2012, 7, 16), "month": dt.datetime(2012, 7, 1), "year": dt.datetime(2012, 1, 1)}
    df = spark.createDataFrame([(t,)], "t timestamp_ntz")
    assert df.select(*[b.floor(u, F.col("t")).alias(u) for u in want]).first().asDict() == want
    assert {u: b.FLOORS[u](t) for u in want} == want
    weeks = [(dt.datetime(2012, 8, 3, 14, 40), dt.datetime(2012, 7, 30)), (dt.datetime(2014, 1, 3, 14, 40), dt.datetime(2013, 12, 30))]
    got = spark.createDataFrame(weeks, "t timestamp_ntz, w timestamp_ntz").select(b.week_floor(F.col("t")).alias("f"), "w").collect()
    assert all(r["f"] == r["w"] for r in got)
    with pytest.raises(ValueError):
        b.floor("minute", F.col("t"))


def test_measures(spark):
    df = spark.createDataFrame([(1, 1.2), (1, 1.2)], "k long, v double")
    spec = CubeSpec("m", [Dimension("k", b.long(), "k")], [R("k")], [ms.double_sum("d", "v"), ms.int_sum("i", "k"), ms.count("n")])
    r = fanout.build_cells(spec, df).first()
    assert (r["d"], r["i"], r["n"]) == (2.4, 2, 2)
    big = CubeSpec("m", [Dimension("k", b.long(), "k")], [R()], [ms.long_sum("v", F.lit((1 << 63) - 1))])
    with pytest.raises(Exception, match="OVERFLOW"):
        fanout.build_cells(big, df).collect()


def test_custom_measure_and_bucketer(spark):
    """A product as a measure, and a user's bucketer of two granularities."""
    product = ms.Measure("p", "double", lambda: F.exp(F.sum(F.log("v"))), lambda c: F.exp(F.sum(F.log(c))), lambda a, c: a * c, lambda a, c: a / c)
    sizes = b.Expressions(lambda c: {"ten": F.floor(c / 10) * 10, "odd": c % 2 == 1}, ["ten", "odd"], reads=lambda v, t: v // 10 * 10 if t == "ten" else v % 2 == 1)
    spec = CubeSpec("p", [Dimension("k", sizes, "k")], [R(("k", "ten")), R(("k", "odd"))], [product])
    df = spark.createDataFrame([(11, 2.0), (12, 3.0), (25, 5.0)], "k long, v double")
    cells = merge.increment(spec, fanout.build_cells(spec, df.where("k < 12")), fanout.build_cells(spec, df.where("k >= 12")))
    assert round(reads.get(cells, Read(spec).at("k", 17, "ten"))["p"], 6) == 6
    assert round(reads.get(cells, Read(spec).at("k", 3, "odd"))["p"], 6) == 10


KEYED = CubeSpec("fate", [Dimension("k", b.long(), "k")], [R("k")])


def _cells(spark, d):
    return raw_cells(KEYED, spark.createDataFrame([("k", k, v) for k, v in d.items()], "rollup_id string, k__identity long, value long"))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(0, 6), st.integers(0, 2)), st.dictionaries(st.integers(0, 6), st.integers(0, 2)), st.dictionaries(st.integers(0, 6), st.integers(0, 2)))
def test_three_way(spark, live, snap, back):
    snap = {k: v for k, v in snap.items() if k in live}
    want = {}
    for k in live.keys() | back.keys():
        if k in snap and live[k] == snap[k]:
            if k in back:
                want[k] = back[k]
        else:
            want[k] = live.get(k, 0) - snap.get(k, 0) + back.get(k, 0)
    fates = backfill.three_way(KEYED, _cells(spark, live), _cells(spark, snap), _cells(spark, back))
    assert {r["k__identity"]: r["value"] for r in backfill.merged_cells(KEYED, fates).collect()} == want


def test_three_way_lost_cell(spark):
    with pytest.raises(Exception, match="missing in the live table"):
        backfill.three_way(KEYED, _cells(spark, {}), _cells(spark, {1: 1}), _cells(spark, {})).collect()


def test_sources(spark):
    assert collection(spark, [1, 2, 3], "x int").rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="unknown rollup"):
        raw_cells(KEYED, spark.createDataFrame([("zz", 1, 1)], "rollup_id string, k__identity long, value long")).collect()


def test_reads_beyond_broadcast(spark, monkeypatch):
    """Many reads at once are joined by a shuffle, with the same answer."""
    spec = CubeSpec("k", [Dimension("k", b.long(), "k")], [R("k")], [ms.count("n")])
    cells = fanout.build_cells(spec, spark.range(50).select((F.col("id") % 20).alias("k")))
    asked = [Read(spec).at("k", k) for k in (3, 99, 3, 15, 0)]
    first = [tuple(r) for r in reads.multi_get(cells, asked).collect()]
    monkeypatch.setattr(reads, "BROADCAST_READS", 2)
    assert [tuple(r) for r in reads.multi_get(cells, asked).collect()] == first == [(0, 3), (1, None), (2, 3), (3, 2), (4, 3)]


def test_reads_prune(spark, tmp_path):
    """A point read touches one partition, and its keys reach the scan."""
    cells = fanout.build_cells(TAGGED, spark.createDataFrame(_random_rows(7), "x long, y string, s array<string>, t array<string>, v long"))
    cells.write.partitionBy("rollup_id").parquet(str(tmp_path / "c"))
    plan = reads.point(spark.read.parquet(str(tmp_path / "c")), Read(TAGGED).at("x", 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rollup_id" in plan and "EqualTo(x__identity,1)" in plan
