"""What the operators on vectors share: which vectors count, and packing rows into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not zero, no null or non-finite component."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of vectors of one length, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def by_dim(lists: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, rows) for each length of the vectors in a column."""
    dims = np.diff(lists.offsets.to_numpy())
    for d in np.unique(dims).tolist():
        yield d, np.flatnonzero(dims == d)


def moments(vectors: DataFrame, square: bool, unit: bool) -> dict[int, tuple[np.ndarray, np.ndarray | None]]:
    """Mean and, if ``square``, mean outer product of all vectors in column v, by length. Each task sends its sums, d or d * d numbers;
    they are added up by Spark before the driver reads d + d * d of them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for d, rows in by_dim(batch.column(0)):
                x = matrix(batch.column(0).take(pa.array(rows)), d)
                if unit:
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                own = total.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
                own[0] += len(x)
                own[1] += x.sum(axis=0)
                if square:
                    own[2] += x.T @ x
        for d, (n, first, second) in total.items():
            flat = np.r_[n, first, second.ravel() if square else np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), d)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["dim", "at", "value"])

    parts = vectors.select("v").mapInArrow(sums, "dim bigint, at bigint, value double").groupBy("dim", "at").agg(F.sum("value").alias("value"))
    found: dict[int, list[tuple[int, float]]] = {}
    for r in parts.collect():
        found.setdefault(r.dim, []).append((r.at, r.value))
    out = {}
    for d, pairs in found.items():
        flat = np.array([v for _, v in sorted(pairs)])
        out[d] = flat[1 : d + 1] / flat[0], flat[d + 1 :].reshape(d, d) / flat[0] if square else None
    return out


def block_numbers() -> Iterator[int]:
    """Numbers that no other task of the stage gives."""
    part, k = TaskContext.get().partitionId(), 0
    while True:
        yield part << 32 | k
        k += 1
