"""Sharding by global prefix sums of sizes.

Rows are put into one global order by range partitioning; each partition's
total is collected (one row a partition), their prefix sums are the partitions'
bases, and a running sum inside each partition gives every row its place in
the whole. Cutting the places at equal targets yields contiguous, balanced
shards. Nothing but the slim columns (key, size, checksum) is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridroll.session import materialize, ship


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``before`` (sizes) and ``place`` (rows) ahead of each row in its partition."""
    total = rows = 0
    for b in batches:
        cum = pc.cumulative_sum(b.column("size"))
        before = pc.add(pc.subtract(cum, b.column("size")), total)
        place = pa.array(range(rows, rows + b.num_rows), pa.int64())
        if b.num_rows:
            total += cum[-1].as_py()
            rows += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, before, place], names=[*b.schema.names, "before", "place"])


def shard_documents(docs: DataFrame, shards: int = 8, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row of ``docs`` to one of ``shards`` shards.

    ``law`` is ``bytes``: contiguous in id order, cut where the running sum of
    sizes (UTF-8 bytes of the text plus 1; 1 for a null text) passes equal
    targets, a row belonging to the shard that holds its midpoint; or ``rows``:
    contiguous, counts at most one apart. Returns id, ``size``,
    ``text_crc32``, ``law``, ``shard`` and ``slot`` (gapless from 0 in each
    shard). Null ids come first. Rows equal in id, size and checksum are
    interchangeable, and may be split between neighbouring shards. An empty
    table gives an empty result. Other columns of ``docs`` are ignored.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    if shards < 1:
        raise ValueError("shards must be positive")
    ship(docs.sparkSession)
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        )
    )
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "size", "text_crc32", "tie"]
    # the tie breaker lets a key with very many equal rows be split between partitions
    ranged = slim.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie").withColumn("part", F.spark_partition_id().cast("long"))
    placed = materialize(ranged.mapInArrow(_running, "doc_id long, size long, text_crc32 long, part long, before long, place long"))
    totals = placed.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).orderBy("part").collect()  # a row a partition
    all_bytes, all_rows, bases = 0, 0, []
    for t in totals:
        bases.append((t["part"], all_bytes, all_rows))
        all_bytes, all_rows = all_bytes + t["size"], all_rows + t["rows"]
    base = spark.createDataFrame(bases, "part long, base_bytes long, base_rows long")
    at = placed.join(F.broadcast(base), "part").withColumn("row", F.col("base_rows") + F.col("place"))
    if law == "bytes":
        # twice the midpoint, so that all stays in whole numbers
        middle = F.expr(f"((2 * (base_bytes + before) + size) * {shards}L) div {max(1, 2 * all_bytes)}L")
        at = at.withColumn("shard", F.least(middle, F.lit(shards - 1)).cast("int"))
    else:
        at = at.withColumn("shard", F.expr(f"least((row * {shards}L) div {max(1, all_rows)}L, {shards - 1})").cast("int"))
    firsts = at.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most ``shards`` rows
    return at.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` to one folder a shard, rows in slot order. ``id_col`` has to be unique."""
    joined = docs.join(assigned.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
