"""What several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridroll.session import materialize

#: A maximal run of characters other than space and the ASCII controls 9 to 13 is a word.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only after it was counted and found no larger than this.
BROADCAST_ROWS = 50_000


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def masked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with all columns renamed out of the way of an operator's own, and the new name of each."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def join_small(df: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is usually small.

    ``small`` has to be cheap to count (written, or an aggregate). It is
    broadcast if it has at most ``limit`` rows; else both sides are shuffled
    and adaptive execution splits a hot key.
    """
    return df.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, how)


def smallest(df: DataFrame, key: list[str], rows: int, total: int) -> DataFrame:
    """``rows`` of the ``total`` rows of ``df``, those of the smallest hashes of ``key``: a fixed sample for fitting.

    A threshold on the hash, four standard errors above the expected one, goes
    first, so that no more than about ``rows`` rows leave their partitions. Where
    many rows are equal there may be fewer.
    """
    share = min(1.0, (rows + 4 * rows**0.5 + 16) / max(1, total))
    hashed = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(*key), 24))
    some = hashed.where(F.col("_h") < int(share * (1 << 40))) if share < 1 else hashed
    return some.orderBy("_h", *key).limit(rows).drop("_h")


def _settled(e: DataFrame) -> bool:
    """True if every node has one parent at most and no parent has one."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").limit(1).count()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has two long columns, ``a`` and ``b``; self-loops and nulls are
    ignored. Returns (id, component) for every id in an edge; component is the
    smallest id reachable. Rounds alternate large-star and small-star, so their
    number grows with the logarithm of a component's size, and every round is
    written to the shared folder. The links of a node are only aggregated
    (min) and joined, never gathered in one row.
    """
    e = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(e):
            break
        # large star: a node's larger neighbours, and itself, are linked to the smallest of its neighbours and itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        e = materialize(large.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # small star: all smaller neighbours of a node, and itself, are linked to the smallest of them
        small = e.groupBy("u").agg(F.min("v").alias("m"))
        e2 = e.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v")))
        e = materialize(e2.distinct())
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
