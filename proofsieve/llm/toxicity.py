"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the distinct terms i, j of a text, so a
pair such as an insult and the mention of a group has a weight of its own. Terms are runs of letters,
A-Z in lower case, hashed into ``buckets``; every bucket takes part. The linear weights are fitted with an L1 penalty that grows with
every step, which leaves most of them at zero, and factors act between the buckets whose weight isn't zero at the time. So
no term is chosen beforehand, and what is sent to every task is small: the kept buckets, 2^18 at most. The penalty is the one that does best on
a held fifth of the training rows. Weights are fitted on at most ``max_rows`` training rows, taken by the hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.llm.shared import by_bytes, byte_view, fresh, small_batches, stored, tidy
from proofsieve.llm.words import LETTER, Hasher, ranges

SEED = 4
#: A fit takes this many steps at least, however few its rows.
STEPS = 400
#: L1 penalties a step that are tried on held training rows.
PENALTIES = [0.05, 0.1, 0.2, 0.5, 1.0]


@dataclass
class Machine:
    """``place``: for each bucket its row in the weights, or -1."""

    place: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Scores before the sigmoid; (rows[k], terms[k]) are the distinct terms of text rows[k]."""
        out = self.bias + np.bincount(rows, self.linear[terms], n)
        if len(rows):
            for f in range(self.factors.shape[1]):
                v = self.factors[terms, f]
                out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def distinct_buckets(texts: pa.Array, hasher: Hasher, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, sorted, each once."""
    at, raw = byte_view(texts)
    hashes, first = hasher(at, raw)
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(first))
    pairs = np.unique(rows * buckets + (hashes % np.uint64(buckets)).astype(np.int64))
    return pairs // buckets, pairs % buckets


def features(docs: DataFrame, key: str, text: str, buckets: int, more: list[str]) -> DataFrame:
    """(key, terms, more columns): the distinct buckets of each text as 32-bit integers in a binary column."""
    dtypes = dict(docs.dtypes)
    schema = ", ".join([f"`{key}` {dtypes[key]}, terms binary", *(f"`{c}` {dtypes[c]}" for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SEED, LETTER, lower=True)
        for batch in batches:
            for a, b in by_bytes(batch.column(1), 2 << 20):
                rows, terms = distinct_buckets(batch.column(1).slice(a, b - a), hasher, buckets)
                ends = np.searchsorted(rows, np.arange(b - a + 1))
                terms = terms.astype(np.int32)
                found = pa.array([terms[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), found, *(c.slice(a, b - a) for c in batch.columns[2:])], names=[key, "terms", *more])

    return small_batches(docs.select(key, text, *more)).mapInArrow(tidy(run), schema)


def shrunk(pull: np.ndarray, squares: np.ndarray, rate: float, force: float) -> np.ndarray:
    """Linear weights after gradients that sum to ``pull``; those of at most ``force`` leave a weight at zero."""
    return np.where(np.abs(pull) <= force, 0.0, -(pull - np.sign(pull) * force) / ((1 + np.sqrt(squares)) / rate + 1))


def fit_weights(y: np.ndarray, ends: np.ndarray, terms: np.ndarray, buckets: int, factors: int, epochs: int, rate: float, sparse: float, decay: float, batch: int = 256) -> Machine:
    """The machine for labels ``y`` and the distinct buckets terms[ends[k]:ends[k + 1]] of row k, by the log loss in a fixed random order.

    Linear weights follow the regularised leader with an L1 penalty of ``sparse`` for each step taken, so the penalty grows as the sum of gradients
    does; factors follow AdaGrad. Without ``factors`` the fit is a linear one.
    """
    rng, n = np.random.default_rng(SEED), len(y)
    bias, gb = float(np.log((y.sum() + 0.5) / (n - y.sum() + 1.5))), 1e-2
    pull, squares, step = np.zeros(buckets), np.zeros(buckets), 0
    v, gv = rng.normal(0, 0.02, (buckets, factors)), np.full((buckets, factors), 1e-2)
    for _ in range(max(epochs, -(-STEPS * batch // n))):
        for part in np.array_split(rng.permutation(n), max(1, n // batch)):
            sizes = ends[part + 1] - ends[part]
            row = np.repeat(np.arange(len(part)), sizes)
            t = terms[ranges(ends[part], sizes)]
            own, at = np.unique(t, return_inverse=True)
            held = squares[own]
            weight = shrunk(pull[own], held, rate, sparse * step)
            raw = bias + np.bincount(row, weight[at], len(part))
            kept = weight != 0 if factors else np.zeros(len(own), bool)
            if some := kept.any():
                at_v, row_v = (np.cumsum(kept) - 1)[at[kept[at]]], row[kept[at]]
                factor = v[own[kept]]
                by_row = lambda x, r=row_v, m=len(part): np.stack([np.bincount(r, c, m) for c in x.T], axis=1)
                sums = by_row(factor[at_v])
                raw += 0.5 * (sums**2 - by_row(factor[at_v] ** 2)).sum(axis=1)
            error = sigmoid(raw) - y[part]
            slope = np.bincount(at, error[row], len(own))
            new = held + slope**2
            pull[own] += slope - (np.sqrt(new) - np.sqrt(held)) / rate * weight
            squares[own], step = new, step + 1
            if some:
                steep = error[row_v][:, None] * (sums[row_v] - factor[at_v])
                dv = by_row(steep, at_v, len(factor)) + decay * factor
                gv[own[kept]] += dv**2
                v[own[kept]] -= 0.1 * dv / np.sqrt(gv[own[kept]])
            gb += error.sum() ** 2
            bias -= 0.1 * error.sum() / np.sqrt(gb)
    w = shrunk(pull, squares, rate, sparse * step)
    chosen = np.flatnonzero(w)
    place = np.full(buckets, -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    return Machine(place, bias, np.r_[w[chosen], 0.0], np.r_[v[chosen], np.zeros((1, factors))])


def some_rows(which: np.ndarray, ends: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, terms) of the rows ``which``."""
    sizes = np.diff(ends)[which]
    return np.r_[0, np.cumsum(sizes)], terms[ranges(ends[:-1][which], sizes)]


def held_loss(y: np.ndarray, ends: np.ndarray, terms: np.ndarray, sparse: float, *settings) -> float:
    """The log loss of every fifth row under a machine fitted on the others."""
    buckets, factors, epochs, rate, decay = settings
    held = np.arange(len(y)) % 5 == 0
    machine = fit_weights(y[~held], *some_rows(np.flatnonzero(~held), ends, terms), buckets, factors, epochs, rate, sparse, decay)
    at, own = some_rows(np.flatnonzero(held), ends, terms)
    places, rows = machine.place[own], np.repeat(np.arange(held.sum()), np.diff(at))
    raw = machine.raw(rows[places >= 0], places[places >= 0], int(held.sum()))
    return float(np.mean(np.logaddexp(0, np.where(y[held] == 1, -raw, raw))))


def penalty(spark: SparkSession, y: np.ndarray, ends: np.ndarray, terms: np.ndarray, *settings) -> float:
    """Of PENALTIES that with the smallest loss of held rows, of equal losses the larger one; each is tried in a task of its own."""
    if len(y) < 10 or not 0 < y.sum() < len(y):
        return PENALTIES[-1]
    sent = spark.sparkContext.broadcast((y, ends, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tried = [float(PENALTIES[k]) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(tried, pa.float64()), pa.array([held_loss(*sent.value, x, *settings) for x in tried], pa.float64())], names=["sparse", "loss"])

    tried = spark.range(0, len(PENALTIES), 1, len(PENALTIES)).mapInArrow(run, "sparse double, loss double").collect()
    return min((r.loss, -r.sparse) for r in tried)[1] * -1


def training(docs: DataFrame, labels: DataFrame, buckets: int, max_rows: int, max_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, ends, terms) of the training rows: at most ``max_rows``, with at most about ``max_bytes`` of buckets, by the hash of the id."""
    train = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    train = train.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    train = stored(train, "toxicity-labels")
    n = train.count()
    if n > max_rows:  # by a hash of the id, so that only texts of the sample are read on
        train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * 0.97 * max_rows / n)).limit(max_rows)
    texts = docs.where("doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id", "text").join(F.broadcast(train), "doc_id")  # max_rows rows at most
    found = stored(features(texts, "doc_id", "text", buckets, ["toxic"]), "toxicity-features")
    size = found.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    if size > max_bytes:
        found = found.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * 0.97 * max_bytes / size))
    got = found.toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    lists = got["terms"].combine_chunks()
    at, raw = byte_view(lists if isinstance(lists, pa.Array) else lists.chunk(0))
    return got["toxic"].to_numpy().astype(float), at // 4, np.frombuffer(raw, np.int32)


def fit(
    docs: DataFrame, labels: DataFrame, buckets: int = 1 << 18, max_rows: int = 20_000, max_bytes: int = 64 << 20, factors: int = 4, epochs: int = 5, rate: float = 1.0, sparse: float | None = None, decay: float = 0.1,
) -> Machine:
    """The machine for ``labels`` (doc_id, toxic), from the rows whose crc32(doc_id as text) mod 5 is not 0.

    Without ``sparse`` the penalty is chosen inside the training rows, by the same rule however many they are. A doc_id labelled twice counts as toxic if any of its
    labels is 1; null ids and null labels are left out. Without training rows every text scores 0.25.
    """
    y, ends, terms = training(docs, labels, buckets, max_rows, max_bytes)
    if not len(y):
        return Machine(np.full(buckets, -1, np.int32), float(np.log(1 / 3)), np.zeros(1), np.zeros((1, factors)))
    if sparse is None:
        sparse = penalty(docs.sparkSession, y, ends, terms, buckets, factors, epochs, rate, decay)
    return fit_weights(y, ends, terms, buckets, factors, epochs, rate, sparse, decay)


def score(docs: DataFrame, machine: Machine, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns and the score as ``name``, 0 to 1, for each row; null and empty texts score by the bias alone."""
    dtypes = dict(docs.dtypes)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(fresh("text", keep)))
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    buckets = len(machine.place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = Hasher(SEED, LETTER, lower=True), sent.value
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in by_bytes(texts, 2 << 20):
                rows, terms = distinct_buckets(texts.slice(a, b - a), hasher, buckets)
                terms = own.place[terms]
                there = terms >= 0
                out = sigmoid(own.raw(rows[there], terms[there], b - a))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), pa.array(out)], names=[*keep, name])

    return small_batches(source).mapInArrow(tidy(run), ", ".join([*(f"`{c}` {dtypes[c]}" for c in keep), f"`{name}` double"]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; a null doc_id counts as held out."""
    out = score(docs, fit(docs, labels), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    name = fresh("score", docs.columns)
    return score(docs, fit(docs, labels), docs.columns, name).where(F.col(name) < 0.5).select(*docs.columns)
