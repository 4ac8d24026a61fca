"""Mixing sources to target weights by hash-threshold histograms. Native: no Python on executors.

Each source gets a word budget. Whole epochs of a source are taken while they
fit; what is left of the budget is filled by the documents whose hash lies
below a threshold of that source. The threshold comes from histograms of words
by hash bucket: the boundary bucket, in which the budget is used up, is the
only one refined at the next level. Nothing is sorted globally and a document
is kept or not by comparing its own hash with one number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridroll.llm.common import join_small, word_count
from gridroll.session import materialize

#: Bits of the hash, bits that one histogram level resolves, and levels before single hash values are compared.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 10, 3


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Word budgets of sources. ``sizes``: (source, source_size), a row a source.

    Sources in code point order, null last, weigh as ``weights`` says, which
    repeats. Together they get ``share`` of all words. A source gets at most
    ``cap`` times its size; the excess goes to the others by weight until none
    is above. That fixed point is least(cap * size, weight * level) with the
    largest level that the sources, taken by rising cap * size / weight, give.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row a source, after aggregation
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    return (
        sizes.withColumn("weight", w)
        .withColumn("ratio", F.col("source_size") * cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows) * share)
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("total") - F.col("capped")) / F.col("rest")).over(all_rows))
        .select("source", "source_size", "weight", F.least(F.col("source_size") * cap, F.col("weight") * F.greatest("level", F.lit(0.0))).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, source, size (words; 0 for null or empty text),
    source_size, target, copies (times the document is taken) and taken
    (size * copies). Each source's sum of taken is as near its target as a cut
    between two hash values allows, thus within half a document. Rows with the
    same id share a hash and are taken together. A source of no words, and an
    empty table, take nothing. Reruns agree: the hash depends on the id only.
    """
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    slim = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), hashed.alias("h")))
    plan = materialize(
        targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    # per source: the bucket, by its leading bits, in which the budget ends, and the words before it
    edge = plan.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    rows = slim.where("size > 0").select("source", "h", "size")
    for level in range(1, LEVELS + 1):
        bits = level * LEVEL_BITS
        inside = join_small(rows.alias("r"), edge.alias("e"), same(rows, edge) & (F.shiftrightunsigned(rows["h"], HASH_BITS - bits + LEVEL_BITS) == edge["prefix"]))
        bucket = F.shiftrightunsigned("r.h", HASH_BITS - bits).alias("bucket")
        histogram = inside.groupBy("r.source", bucket).agg(F.sum("r.size").alias("words"), F.first("e.budget").alias("budget"), F.first("e.before").alias("ahead"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 2 ** LEVEL_BITS rows a source at most
        cum = histogram.withColumn("upto", F.col("ahead") + F.sum("words").over(running))
        edge = materialize(
            cum.where("upto > budget").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "budget")).alias("x")).select("source", "x.budget", F.col("x.bucket").alias("prefix"), "x.before")
        )
    # the few hash values left in the boundary bucket: the cut that comes nearest to the budget
    inside = join_small(rows.alias("r"), edge.alias("e"), same(rows, edge) & (F.shiftrightunsigned(rows["h"], HASH_BITS - LEVELS * LEVEL_BITS) == edge["prefix"]))
    values = inside.groupBy("r.source", "r.h").agg(F.sum("r.size").alias("words"), F.first("e.budget").alias("budget"), F.first("e.before").alias("ahead"))
    cum = values.withColumn("upto", F.col("ahead") + F.sum("words").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
    cuts = cum.select("source", F.abs(F.col("upto") - F.col("budget")).alias("miss"), (F.col("h") + 1).alias("cut")).unionByName(
        edge.select("source", F.abs(F.col("before") - F.col("budget")).alias("miss"), F.shiftleft("prefix", HASH_BITS - LEVELS * LEVEL_BITS).alias("cut"))
    )
    best = cuts.groupBy("source").agg(F.min(F.struct("miss", "cut")).alias("x")).select("source", "x.cut")
    # a source whose boundary was never reached has no budget left beyond its whole words
    final = materialize(plan.join(best, plan["source"].eqNullSafe(best["source"]), "left").select(plan["source"], "source_size", "target", "whole", F.coalesce("cut", F.when(F.col("budget") > 0, F.lit(1 << HASH_BITS)).otherwise(0)).alias("cut")))
    out = join_small(slim.alias("d"), final.alias("f"), slim["source"].eqNullSafe(final["source"]))
    copies = (F.col("f.whole") + (F.col("d.h") < F.col("f.cut")).cast("int")).alias("copies")
    return out.select("d.doc_id", "d.source", "d.size", "f.source_size", "f.target", copies, (F.col("d.size") * copies).alias("taken"))
