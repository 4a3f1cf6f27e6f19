"""Exchange of corpus-wide facts in packed form, between chunks of documents and shards of keys.

Documents are dealt into chunks of a few megabytes by a hash. A chunk sends each shard one row with the
sorted distinct keys it holds, so a key that a third of all documents share reaches its shard once for each
chunk, and the shard answers each row with one value per key. Neither side grows with a hot key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsieve.llm.shared import small_batches

#: Bytes of text in a chunk; a text that is longer is a chunk's share by itself.
CHUNK = 8 << 20
#: Bytes of text for each pair of a chunk and a shard, at least. Chunks grow with the square root of the corpus, so that the row that a
#: chunk sends a shard carries a few hundred keys at any size; at 100 TB a chunk has 450 MB.
PER_ROW = 2048


def pieces(docs: DataFrame, text_column: str = "text", chunk_bytes: int = CHUNK) -> int:
    """The number of chunks, and of shards."""
    total = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    return max(math.ceil(total / max(chunk_bytes, math.isqrt(total * PER_ROW))), 3 * docs.sparkSession.sparkContext.defaultParallelism)


def dealt(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK) -> tuple[DataFrame, int]:
    """(doc_id, text, chunk) and the number of chunks. Rows are dealt by a hash of id and text; a null text becomes empty."""
    n = pieces(docs, text_column, chunk_bytes)
    text = F.coalesce(F.col(text_column), F.lit(""))
    chunk = F.pmod(F.xxhash64(F.col(id_column), text), F.lit(n)).cast("int")
    return small_batches(docs).select(F.col(id_column).alias("doc_id"), text.alias("text"), chunk.alias("chunk")), n


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; larger keys never have a smaller shard."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def split_by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, start, end) of the shards that ``keys``, sorted, have."""
    own = shard_of(keys, shards)
    there = np.unique(own)
    return list(zip(there.tolist(), np.searchsorted(own, there).tolist(), np.searchsorted(own, there, "right").tolist(), strict=True))


def squeeze(arrays: list[np.ndarray]) -> bytes:
    """Arrays of integers from 0 on, in bytes of equal weight one after the other, compressed."""
    head, parts = [], []
    for x in arrays:
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        head += [len(x), width]
        parts.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = b"".join([np.array([len(arrays), *head], np.int64).tobytes(), *parts])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    """The arrays of ``squeeze`` as 64-bit integers."""
    raw = np.frombuffer(pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), "zstd"), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    at, out = 8 + 16 * n, []
    for size, width in raw[8:at].view(np.int64).reshape(-1, 2).tolist():
        wide = np.zeros((size, 8), np.uint8)
        wide[:, :width] = raw[at : at + size * width].reshape(width, size).T
        out.append(wide.view("<i8").ravel())
        at += size * width
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first from 0."""
    return np.diff(x, prepend=x.dtype.type(0))


def packed(rows: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
