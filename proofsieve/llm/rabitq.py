"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Each vector less the mean is rotated by a seeded random rotation and kept as the signs of its components, packed in bits, with
its length, the inner product of the code and the vector, and its inner product with the mean. A query is rotated and cut into
bit planes; counting the bits that a code shares with each plane gives the inner product of both, and with the scalars
an estimate of that of the vectors, without bias and with a known error. In each block of codes the best estimates are
computed exactly, which gives a threshold; every vector whose upper bound reaches it is reranked on the original vectors. Blocks of codes pass
a block of queries one after the other, so the best so far set the threshold from the second on, and only the last best leave the task.
All rows are coded; only the mean, over all rows, and the rotation are kept outside the codes. The stated queries meet all rows in blocks; a
block's vectors go along with its codes in their own precision, since a block of a thousand queries asks for nearly all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.llm.shared import stored
from proofsieve.llm.vectors import block_numbers, by_dim, matrix, moments, usable

#: Candidates in a block; queries in a block; pairs that are reranked at a time.
CODES, QUERIES, RERANKED = 8192, 1024, 1 << 16
#: Bit planes of a query.
PLANES = 6
#: Width of the error bound in standard deviations, about.
BOUND = 2.4
SEED = 5


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))[0]


class Codes:
    """One-bit codes of the rows of x."""

    def __init__(self, bits: np.ndarray, length: np.ndarray, factor: np.ndarray, at_mean: np.ndarray, dim: int):
        self.bits, self.length, self.factor, self.at_mean, self.dim = bits, length, factor, at_mean, dim

    @classmethod
    def of(cls, x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> Codes:
        rest = x - mean
        length = np.linalg.norm(rest, axis=1)
        turned = rest @ turn / np.maximum(length, 1e-300)[:, None]
        factor = np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])
        return cls(np.packbits(turned > 0, axis=1), length, np.where(length > 0, factor, 1.0), x @ mean, x.shape[1])

    def shared(self, levels: np.ndarray) -> np.ndarray:
        """For each query and code the sum of the query's levels where the code has a one, counted on packed bits."""
        wide = -(-self.bits.shape[1] // 8) * 8
        words = lambda x: np.pad(x, ((0, 0), (0, wide - x.shape[1]))).view(np.uint64)
        codes, out = words(self.bits).T.copy(), np.zeros((len(levels), len(self.bits)), np.int32)
        for plane in range(PLANES):
            asked = words(np.packbits(levels >> plane & 1, axis=1))
            for word in range(len(codes)):
                out += np.left_shift(np.bitwise_count(asked[:, word, None] & codes[word]), plane, dtype=np.int32)
        return out

    def estimates(self, queries: np.ndarray, mean: np.ndarray, turn: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products, their error bounds), a row for each query."""
        rest = queries - mean
        turned, size = rest @ turn, np.linalg.norm(rest, axis=1)
        low, step = turned.min(axis=1, keepdims=True), np.maximum(np.ptp(turned, axis=1, keepdims=True), 1e-300) / ((1 << PLANES) - 1)
        levels = np.rint((turned - low) / step).astype(np.uint8)
        # Of the query's levels with the code's signs: twice those at its ones less all.
        signed = 2 * self.shared(levels).astype(np.float32) - levels.sum(axis=1, dtype=np.float32, keepdims=True)
        ones = 2 * np.bitwise_count(self.bits).sum(axis=1, dtype=np.float32) - np.float32(self.dim)
        cosine = (step.astype(np.float32) * signed + low.astype(np.float32) * ones) / (math.sqrt(self.dim) * self.factor).astype(np.float32)
        # <v, q> = <v - m, q - m> + <v, m> + <q, m> - <m, m>
        value = cosine * self.length.astype(np.float32) + self.at_mean.astype(np.float32) + (queries @ mean - mean @ mean).astype(np.float32)[:, None]
        # The code's error, and that of the levels, each off by a twelfth of a squared step.
        spread = np.sqrt(np.maximum(0, 1 - self.factor**2) / max(1, self.dim - 1)) / self.factor * self.length * bound
        rounded = step.ravel() * bound / math.sqrt(12)
        error = np.sqrt((size[:, None].astype(np.float32) * spread.astype(np.float32)) ** 2 + (rounded[:, None].astype(np.float32) * (self.length / self.factor).astype(np.float32)) ** 2)
        return value, error + np.float32(1e-5)


def exact(queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision; equal vectors give equal products."""
    out = np.empty(len(rows))
    for k in range(0, len(rows), RERANKED):
        s = slice(k, k + RERANKED)
        out[s] = (queries[rows[s]] * vectors[columns[s]]).sum(axis=1)
    return out


def nearest_in(codes: Codes, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int, bound: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, product) of the k nearest of each query in a block, of those that reach its ``floor``; a query's own id is left out."""
    value, error = codes.estimates(queries, mean, turn, bound)
    own = query_ids[:, None] == ids[None, :]
    value[own] = -np.inf
    first = min(4 * k, len(ids))
    best = np.argpartition(-value, first - 1, axis=1)[:, :first]
    rows = np.repeat(np.arange(len(queries)), first)
    products = exact(queries, vectors, rows, best.ravel()).reshape(len(queries), first)
    products[np.take_along_axis(own, best, axis=1)] = -np.inf
    threshold = floor if first < k else np.maximum(floor, -np.partition(-products, k - 1, axis=1)[:, k - 1])
    rows, columns = np.nonzero((value + error >= threshold[:, None]) & ~own)
    again = np.zeros(value.shape, bool)
    again[np.repeat(np.arange(len(queries)), first), best.ravel()] = True
    again[rows, columns] = True
    again[own] = False
    rows, columns = np.nonzero(again)
    products = exact(queries, vectors, rows, columns)
    reach = products >= floor[rows]
    return best_of(rows[reach], columns[reach], ids[columns[reach]], products[reach], k)


def best_of(rows: np.ndarray, columns: np.ndarray, ids: np.ndarray, products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, product) of the k largest products of each row, ties to the smaller id, in this order."""
    order = np.lexsort((ids, -products, rows))
    rows, columns, products = rows[order], columns[order], products[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k], products[place < k]


class Best:
    """The k nearest so far of the queries of a block; ``floor``: the product that a vector must reach to be among them."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.rows, self.ids, self.products = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, rows: np.ndarray, ids: np.ndarray, products: np.ndarray) -> None:
        ids = np.r_[self.ids, ids]
        self.rows, self.ids, self.products = best_of(np.r_[self.rows, rows], ids, ids, np.r_[self.products, products], self.k)
        last = np.flatnonzero(np.arange(len(self.rows)) - np.searchsorted(self.rows, self.rows) == self.k - 1)
        self.floor[self.rows[last]] = self.products[last]


def stored_kind(vectors: DataFrame) -> type:
    """The precision in which components are kept: that of the column, which double precision holds exactly."""
    return np.float32 if dict(vectors.dtypes)["v"] == "array<float>" else np.float64


def packed_rows(vectors: DataFrame, size: int, means: dict[int, np.ndarray] | None) -> DataFrame:
    """Blocks (dim, block, ids, v) of ``vectors`` (id, v), with their codes if the means are given."""
    coded = ["bits", "length", "factor", "at_mean"] if means is not None else []
    kind = stored_kind(vectors)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_numbers()
        turns: dict[int, np.ndarray] = {}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def blocks(d: int, least: int) -> Iterator[pa.RecordBatch]:
            ids, x = (np.concatenate(part) for part in zip(*held[d], strict=True))
            while len(ids) >= max(1, least):
                own, v = ids[:size], x[:size]
                ids, x = ids[size:], x[size:]
                values = [d, next(numbers), own.tobytes(), v.tobytes()]
                if means is not None:
                    turn = turns.setdefault(d, rotation(d))
                    c = Codes.of(v.astype(np.float64), means[d], turn)
                    values += [c.bits.tobytes(), c.length.tobytes(), c.factor.tobytes(), c.at_mean.tobytes()]
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * (len(values) - 2)]
                yield pa.RecordBatch.from_arrays([pa.array([a], t) for a, t in zip(values, kinds, strict=True)], names=["dim", "block", "ids", "v", *coded])
            held[d] = [(ids, x)]

        for batch in batches:
            for d, rows in by_dim(batch.column(1)):
                part = batch.take(pa.array(rows))
                held.setdefault(d, []).append((part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)))
                if sum(len(i) for i, _ in held[d]) >= size:
                    yield from blocks(d, size)
        for d in held:
            yield from blocks(d, 1)

    return vectors.mapInArrow(pack, "dim int, block bigint, ids binary, v binary" + "".join(f", {c} binary" for c in coded))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, bound: float = BOUND, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id is divisible by ``every``, by inner product in
    double precision, ties to the smaller id; all candidates if there are fewer.

    Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take no part. A query is
    compared with vectors of its own length, but with none that has its own id. Rows that repeat an id are vectors of their own: each of
    them may be in a list, and each that is a query has a list of its own, ranks from 1, under the id that they share. Queries and
    candidates meet in blocks. An empty table gives an empty one; other columns are ignored.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    kind = stored_kind(rows)
    means = {d: m for d, (m, _) in moments(rows, square=False, unit=False).items()}
    index = stored(packed_rows(rows, CODES, means), "rabitq-index")
    asked = stored(packed_rows(rows.where(F.col("id") % every == 0), QUERIES, None), "rabitq-queries")
    queries = asked.select("dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("v").alias("queries"))
    # Block numbers of both sides are paired first; each side's rows follow their numbers.
    salts = 64
    one = index.select("dim", "block", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"))
    two = queries.select("dim", "query_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    pairs = one.hint("merge").join(two.hint("merge"), ["dim", "salt"]).select("block", "query_block")
    # The last join leaves the rows of a query block together, in one task or, if Spark splits it, a few; each gives out its own best.
    met = pairs.hint("merge").join(index.hint("merge"), "block").hint("merge").join(queries.drop("dim").hint("merge"), "query_block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        own, best, query_ids, q = None, Best(0, k), np.zeros(0, np.int64), np.zeros((0, 0))

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(best.rows), own if own is not None else 0)), pa.array(best.rows), pa.array(query_ids[best.rows]), pa.array(best.ids), pa.array(best.products)], names=["block", "place", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                d = r["dim"]
                if r["query_block"] != own:
                    yield done()
                    own, query_ids, q = r["query_block"], np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["queries"], kind).astype(np.float64).reshape(-1, d)
                    best = Best(len(q), k)
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["v"], kind).astype(np.float64).reshape(-1, d)
                codes = Codes(np.frombuffer(r["bits"], np.uint8).reshape(len(ids), -1), *(np.frombuffer(r[c]) for c in ("length", "factor", "at_mean")), d)
                turn = turns.setdefault(d, rotation(d))
                for a in range(0, len(q), 256):
                    row, column, product = nearest_in(codes, x, ids, q[a : a + 256], query_ids[a : a + 256], means[d], turn, k, bound, best.floor[a : a + 256])
                    best.add(a + row, ids[column], product)
        yield done()

    found = met.mapInArrow(search, "block bigint, place bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
