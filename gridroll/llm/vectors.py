"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridroll.llm.common import smallest

#: At most so many vectors, those of the smallest hashes, are brought to the driver to fit a rotation or codebooks.
FIT_ROWS = 10_000


def usable(vec: str, dim: int) -> Column:
    """True for vectors of ``dim`` finite components that are not all 0; false for others and for null."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dim) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def common_length(df: DataFrame, vec: str) -> int:
    """The most frequent vector length (the smaller of equals); 0 for none."""
    top = df.where(F.size(vec) > 0).groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else 0


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fit_sample(df: DataFrame, id_col: str, vec: str, dim: int, total: int, rows: int = FIT_ROWS) -> np.ndarray:
    """A fixed sample of at most ``rows`` of ``total`` vectors, for fitting only."""
    got = smallest(df.select(id_col, vec), [id_col], rows, total).select(vec).toArrow()
    return matrix(got.column(0).combine_chunks(), dim) if got.num_rows else np.zeros((0, dim))
