"""Sources of input: single points, in-memory collections, tables, streams, raw cells."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridroll.operators.fanout import conform
from gridroll.spec import CubeSpec

#: File formats that Spark reads and writes without further packages.
FORMATS = ("parquet", "orc", "csv", "json", "text", "avro")


def rows(spark: SparkSession, points: Sequence[dict[str, Any]], schema: str) -> DataFrame:
    """Points as rows; a dimension that a point leaves out is null, and so omitted."""
    names = [x.name for x in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(p.get(n) for n in names) for p in points], schema)


def collection(spark: SparkSession, items: Sequence[Any], schema: str, splits: int | None = None) -> DataFrame:
    """A collection in memory as a table of ``splits`` partitions, one an item by default."""
    n = max(1, splits or len(items))
    data = [x if isinstance(x, tuple) else (x,) for x in items]
    return spark.createDataFrame(spark.sparkContext.parallelize(data, n), schema) if data else spark.createDataFrame([], schema)


def files(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table in files. Filters and columns of later steps reach the scan where the format allows."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; there are {FORMATS}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int | None = None, **options: str) -> DataFrame:
    """A folder whose new files are a stream."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def raw_cells(spec: CubeSpec, df: DataFrame) -> DataFrame:
    """Cells made elsewhere, past the bucketers: they have rollup_id, key columns and measures. Unknown rollups are refused."""
    known = [r.name for r in spec.rollups]
    checked = df.withColumn("rollup_id", F.when(F.col("rollup_id").isin(known), F.col("rollup_id")).otherwise(F.raise_error(F.concat(F.lit("unknown rollup "), F.coalesce("rollup_id", F.lit("null")))).cast("string")))
    return conform(spec, checked)
