"""A training corpus from raw documents: five stages, each one operator of gridroll.llm.

Every stage takes (spark, docs, sf_dir) and returns what the next one reads;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridroll.llm.common import WORD
from gridroll.llm.linededup import dedup_lines
from gridroll.llm.mixing import mix
from gridroll.llm.ngram_join import jaccard_join
from gridroll.llm.packing import pack
from gridroll.llm.quality import classify
from gridroll.session import materialize, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity of trusted text's model rejects go."""
    ship(spark)
    return classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; so does a document of which no word is left. n_chars follows the text."""
    out = dedup_lines(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the row of the smallest id stays, rows without an id last; so does one row of each id and text without words.

    Rows are told apart by a number of their own, so rows that share an id, or have none, stay if their texts differ.
    """
    ship(spark)
    rows = materialize(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))  # written, so the numbers are fixed
    groups = jaccard_join(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text", "lang", "source", "n_chars"), "_row")
    ranked = rows.select("_row", "doc_id", F.when(~F.col("text").rlike(WORD), F.col("text")).alias("blank"), rank.alias("rank")).join(groups, "_row")
    first = ranked.groupBy("group", F.when(F.col("group").isNull(), F.col("doc_id")), "blank").agg(F.min("rank").alias("rank")).select("rank._row")
    return rows.join(first, "_row", "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: up to three times, or not at all."""
    docs = docs.select(*COLUMNS)
    # a document's copies depend on its id and source alone
    taken = materialize(mix(docs).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "copies").where("copies > 0").distinct())
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_id"]) & docs["source"].eqNullSafe(taken["_source"]))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048; returns where each piece of a document lies."""
    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: A byte-level language model and a tokenizer are beyond SQL; the tests hold every stage against brute force on its own input instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
