"""What the two embedding operators share: usable vectors, and the cosine of
pairs in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(col):
    """True for vectors that are not null, not zero and hold finite numbers only."""
    x = F.transform(col, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(col.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def one_vector_per_id(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): usable vectors as doubles; of rows sharing an id the smallest array."""
    v = F.col(vector_col).cast("array<double>")
    return (table.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
            .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v")))


def matrix(column) -> np.ndarray:
    """Rows of equal length from an Arrow list column or a sequence of arrays."""
    if isinstance(column, (pa.ListArray, pa.ChunkedArray)):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(column), -1)
    return np.stack([np.asarray(x, np.float64) for x in column])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pair_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, summed in the order
    of the components, so that equal vectors give equal scores wherever they lie."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return np.clip(dot / np.sqrt(aa * bb), -1.0, 1.0)
