"""Shared storage and Arrow helpers of the operators in this folder."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and the five control characters from tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that Spark sends to Python.
BATCH = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only where neither the session nor the context names one and the master is local (tests) a
    temporary folder is made and set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="proofsieve-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage,
    survives lost executors and gives the optimizer true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/proofsieve/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_binary(column: pa.Array) -> pa.Array:
    """Text as UTF-8 bytes with 64-bit offsets; null becomes the empty text."""
    return column.cast(pa.large_binary()).fill_null(b"")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column, without a copy."""
    column = as_binary(column)
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def by_bytes(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, one row at least."""
    at, _ = byte_view(column)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(at, at[start] + most, "right")) - 1
        end = min(max(end, start + 1), len(column))
        yield start, end
        start = end


def bytes_of(size: str) -> int:
    """A size as Spark's settings have it, such as 64m or 1048576b, in bytes; without a unit it is bytes."""
    number, unit = re.fullmatch(r"\s*(-?[0-9]+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit[:1]]


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends Python at most BATCH bytes at a time. Whole texts go both ways, each worker and its
    executor hold a few batches of them, and Spark's own limit of 64 MB is too much for that. The setting stays in the session, since plans read it when they
    run; a lower one of the user's is kept."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < bytes_of(conf.get(name)) <= BATCH:
        conf.set(name, f"{BATCH}b")
    return df


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library than glibc
        return None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives what it has freed back to the system when a task ends. Python workers outlive their tasks, and what they keep
    free for later counts against the executor while other stages need it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)

    return tidied


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores ahead until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def per_text(
    df: DataFrame, column: str, fields: list[tuple[str, str]], make: Callable[[], Callable[[list[str]], list[pa.Array]]],
    keep: list[str], most: int = 4 << 20,
) -> DataFrame:
    """``keep`` columns of ``df`` and the columns ``fields`` computed from the texts in ``column``.

    ``make`` runs once for each task and returns the function from a list of texts (null: empty) to one
    Arrow array a field. It gets at most ``most`` bytes of text at a time, whole texts always.
    """
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(fresh("text", keep)))
    schema = ", ".join([*(f"`{c}` {dict(source.dtypes)[c]}" for c in keep), *(f"{n} {t}" for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(len(keep))
            for start, end in by_bytes(texts, most):
                part = [x if x is not None else "" for x in texts.slice(start, end - start).to_pylist()]
                own = [batch.column(i).slice(start, end - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *work(part)], names=[*keep, *(n for n, _ in fields)])

    return small_batches(source).mapInArrow(tidy(run), schema)
