"""Vectors as rows of bytes: what the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(df: DataFrame, vector: str, every_length: bool = False) -> DataFrame:
    """Rows whose vector is there, not zero, and finite in every component, with the
    vector as doubles in bytes (`raw`).  Negative zeros become zeros, so that equal
    vectors have equal bytes.  Vectors of different lengths have no cosine: only the
    commonest length takes part, unless the caller keeps lengths apart."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(F.col(vector), lambda x: x != 0)
    good = df.where(F.col(vector).isNotNull()).where(finite & some)
    if not every_length:
        sizes = good.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
        good = good.where(F.size(vector) == (sizes[0]["size"] if sizes else 0))
    good = good.withColumn(vector, F.col(vector).cast("array<double>"))
    kept = [c for c in df.columns if c != vector]

    def pack(batches):
        for batch in batches:
            column = batch.column(vector)
            flat = column.flatten().to_numpy(zero_copy_only=False) + 0.0
            end = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            raws = [flat[a:b].tobytes() for a, b in zip([0, *end], end, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(raws, pa.binary())], [*kept, "raw"])

    return good.select(*kept, vector).mapInArrow(pack, good.select(*kept).schema.add("raw", "binary"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a binary column, one per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(n, -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    if not rows.size:
        return rows
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
