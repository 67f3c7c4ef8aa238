"""Vector columns: which rows take part, and their components as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(frame: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(id, v, more …) of the rows whose vector holds finite numbers only and has the usual number of dimensions.

    That is the most frequent number above zero; of several, the smallest."""
    v = F.col("v")
    rows = frame.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *(F.col(c) for c in more)
    )
    rows = rows.where(v.isNotNull() & (F.size(v) > 0))
    rows = rows.where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def floored(vector: str, factor: int, shift: int, limit: int) -> Column:
    """floor(factor * c) + shift of every component c, as longs; floor(factor * c) stays within ± limit."""
    return F.transform(
        vector, lambda c: F.floor(F.greatest(F.least(c * factor, F.lit(float(limit))), F.lit(float(-limit)))) + shift
    )


def matrix(column: pa.ListArray, kind=np.int64) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)
