"""Whole-number vectors shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import saved


def finite(vector: Column) -> Column:
    """True where a vector is there and none of its components is null, NaN or infinite."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(ok & (F.size(vector) > 0), F.lit(False))


def whole_vectors(rows: DataFrame, vector: str, scale: int, add: int, limit: int, name: str) -> tuple[DataFrame, int]:
    """Rows with ``x``, the vector as whole numbers ``floor(scale * c) + add``, saved; and the dimension.

    Rows without a finite vector are left out, and so are rows of another length
    than the commonest one (the shorter of equally common ones).  ``floor(scale * c)``
    beyond ``limit`` either way counts as the limit, so that sums of squares keep
    to 64 bits.
    """
    c = F.col(vector).cast("array<double>")
    clip = lambda x: F.greatest(F.least(F.floor(x * float(scale)), F.lit(limit)), F.lit(-limit)) + F.lit(add)
    kept = rows.where(finite(c)).withColumn("x", F.transform(c, clip).cast("array<long>")).drop(vector)
    kept = saved(kept, name)
    sizes = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    return kept.where(F.size("x") == dim), dim


def matrix(batch: pa.RecordBatch, dim: int, column: str = "x") -> np.ndarray:
    """A list column of ``dim`` components each as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
