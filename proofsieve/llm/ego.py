"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors cosine >= c is a Euclidean distance of at most eps = sqrt(2 - 2 c). Vectors are projected on
principal dimensions, which never makes a distance larger, and sorted by label and by their cells in a grid of width
eps over the leading ones. The sorted sequence is cut into blocks of a few megabytes with bounding boxes over more of
the dimensions; two blocks of a label whose boxes are further apart than eps hold no pair. The other pairs of blocks are
dealt over the cluster, and each is joined recursively: intervals are halved until their boxes are too distant or they
are small enough to compare, and there the rows too far from the other's box are left out first.

Equal vectors of a label form a class that is compared once and counts with its number. A pair of blocks
returns one count and one local root for each of its vectors, never the links themselves, so a
dense group costs rows in proportion to its vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsieve.llm.components import components, roots
from proofsieve.llm.shared import stored
from proofsieve.llm.vectors import block_numbers, by_dim, matrix, moments, usable

#: Bytes of the vectors of a block; vectors of an interval that are compared without halving.
BLOCK, LEAF = 4 << 20, 256
#: Principal dimensions of the grid, and of the boxes.
LEADING, BOXED = 4, 16
#: Added to eps against rounding in the projections; links are settled by the cosine alone.
SLACK = 1e-9


class Interval:
    """A stretch of the sorted sequence: ids, weights, unit vectors and projections."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, units: np.ndarray, lead: np.ndarray):
        self.ids, self.weights, self.units, self.lead = ids, weights, units, lead
        self.low, self.high = lead.min(axis=0), lead.max(axis=0)

    def halves(self) -> tuple[Interval, Interval]:
        m = len(self.ids) // 2
        cut = lambda s: Interval(self.ids[s], self.weights[s], self.units[s], self.lead[s])
        return cut(slice(0, m)), cut(slice(m, None))

    def far(self, other: Interval, eps: float) -> bool:
        gap = np.maximum(0, np.maximum(self.low - other.high, other.low - self.high))
        return float(gap @ gap) > eps * eps


def ego_join(a: Interval, b: Interval, cosine: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, links, roots) of what is linked; ``a is b`` joins an interval with itself."""
    if a.far(b, eps):
        return
    if max(len(a.ids), len(b.ids)) <= LEAF:
        yield from compare(a, b, cosine, eps)
    elif a is b:
        x, y = a.halves()
        for pair in ((x, x), (x, y), (y, y)):
            yield from ego_join(*pair, cosine, eps)
    elif len(a.ids) >= len(b.ids):
        for x in a.halves():
            yield from ego_join(x, b, cosine, eps)
    else:
        for y in b.halves():
            yield from ego_join(a, y, cosine, eps)


def near_box(rows: Interval, box: Interval, eps: float) -> np.ndarray:
    """Which rows are within eps of a box."""
    gap = np.maximum(0, np.maximum(rows.lead - box.high, box.low - rows.lead))
    return (gap * gap).sum(axis=1) <= eps * eps


def compare(a: Interval, b: Interval, cosine: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    at, to = np.flatnonzero(near_box(a, b, eps)), np.flatnonzero(near_box(b, a, eps))
    hit = a.units[at] @ b.units[to].T >= cosine
    if a is b:
        np.fill_diagonal(hit, False)  # an interval is within its own box, so all its rows are there
    x, y = hit.any(axis=1), hit.any(axis=0)
    if not x.any():
        return
    hit, at, to = hit[x][:, y], at[x], to[y]
    ids, other = a.ids[at], b.ids[to]
    # Each vector takes the smallest root of those it is linked with until nothing changes.
    root, far = ids.copy(), other.copy()
    most = np.iinfo(np.int64).max
    while True:
        new_far = np.minimum(far, np.where(hit, root[:, None], most).min(axis=0))
        new_root = np.minimum(root, np.where(hit, new_far[None, :], most).min(axis=1))
        if (new_far == far).all() and (new_root == root).all():
            break
        root, far = new_root, new_far
    yield ids, hit @ b.weights[to], root
    if a is not b:
        yield other, a.weights[at] @ hit, far


def linked(a: Interval, b: Interval, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, roots) of two blocks: each vector that is linked, once."""
    parts = [*ego_join(a, b, cosine, eps)]
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    ids, links, root = (np.concatenate(x) for x in zip(*parts, strict=True))
    own, at = np.unique(ids, return_inverse=True)
    nodes, lowest = roots(ids, root)
    return own, np.bincount(at, links, len(own)).astype(np.int64), lowest[np.searchsorted(nodes, own)]


def sequence(classes: DataFrame, eps: float, partitions: int | None = None) -> DataFrame:
    """Blocks of the sorted sequence of ``classes`` (cid, weight, label, v): label, dim, block, low, high and the packed rows."""
    axes = {}
    for d, (mean, square) in moments(classes.select("v"), square=True, unit=True).items():
        axes[d] = np.linalg.eigh(square - np.outer(mean, mean))[1][:, ::-1][:, : min(BOXED, d)]
    dims = [f"c{k}" for k in range(LEADING)]
    kind = dict(classes.dtypes)["label"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in by_dim(batch.column(3)):
                part = batch.take(pa.array(rows))
                x = matrix(part.column(3), d)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                lead = x @ axes[d]
                cells = np.floor(lead / eps).astype(np.int32)
                own = [pa.array(cells[:, k] if k < cells.shape[1] else np.zeros(len(x), np.int32)) for k in range(LEADING)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.full(len(x), d, np.int32)), *own, pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in lead], pa.binary())], names=["cid", "weight", "label", "dim", *dims, "unit", "lead"])

    placed = classes.select("cid", "weight", "label", "v").mapInArrow(place, f"cid bigint, weight bigint, label {kind}, dim int, {', '.join(f'{c} int' for c in dims)}, unit binary, lead binary")
    order = ["label", "dim", *dims, "cid"]
    ranged = placed.repartitionByRange(partitions, *order) if partitions else placed.repartitionByRange(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, key = block_numbers(), [], None

        def block() -> pa.RecordBatch:
            ids, weights, units, leads = zip(*held, strict=True)
            lead = np.frombuffer(b"".join(leads), np.float64).reshape(len(held), -1)
            values = [*key, next(numbers), lead.min(axis=0).tolist(), lead.max(axis=0).tolist(), np.array(ids, np.int64).tobytes(), np.array(weights, np.int64).tobytes(), b"".join(units), b"".join(leads)]
            kinds = [label_type, pa.int32(), pa.int64(), *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["label", "dim", "block", "low", "high", "ids", "weights", "units", "leads"])

        for batch in batches:
            label_type = batch.schema.field("label").type
            for label, d, *row in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "cid", "weight", "unit", "lead")), strict=True):
                if held and (key != (label, d) or 8 * d * len(held) >= BLOCK):
                    yield block()
                    held.clear()
                key = label, d
                held.append(row)
        if held:
            yield block()

    return ranged.sortWithinPartitions(*order).mapInArrow(pack, f"label {kind}, dim int, block bigint, low array<double>, high array<double>, ids binary, weights binary, units binary, leads binary")


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: the blocks of a label and length whose boxes are at most ``eps`` apart. Looked up by the grid's first dimension."""
    cell = lambda c: F.floor(F.col(c)[0] / eps)
    boxes = blocks.select("label", "dim", "block", "low", "high")
    one = boxes.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    two = boxes.withColumn("cell", F.explode(F.sequence(cell("low") - 1, cell("high") + 1)))
    two = two.select("label", "dim", "cell", *[F.col(c).alias(f"{c}2") for c in ("block", "low", "high")])
    near = one.hint("merge").join(two.hint("merge"), ["label", "dim", "cell"]).where("block <= block2")
    gaps = F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), 2))
    return near.where(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g) <= (eps + SLACK) ** 2).select(F.col("block").alias("a"), F.col("block2").alias("b")).distinct()


def join_blocks(pairs: DataFrame, blocks: DataFrame, cosine: float, eps: float) -> DataFrame:
    """(cid, links, root) for each pair of blocks and each vector that it links."""
    packed = ("dim", "ids", "weights", "units", "leads")
    of = lambda side: blocks.select(F.col("block").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in packed]).hint("merge")
    dealt = pairs.hint("merge").join(of("a"), "a").hint("merge").join(of("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]

                def interval(side: str, r=r) -> Interval:
                    ids, weights = (np.frombuffer(r[f"{c}_{side}"], np.int64) for c in ("ids", "weights"))
                    units, lead = (np.frombuffer(r[f"{c}_{side}"], np.float64).reshape(len(ids), -1) for c in ("units", "leads"))
                    return Interval(ids, weights, units, lead)

                x = interval("a")
                ids, links, root = linked(x, x if r["a"] == r["b"] else interval("b"), cosine, eps + SLACK)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], names=["cid", "links", "root"])

    return dealt.mapInArrow(run, "cid bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors``.

    Vectors are compared only with vectors of the same label and length; a link is a cosine of at least ``cosine`` in
    double precision. A row with a null label or id, or whose vector is null, zero or holds null or non-finite
    components, links with nothing and is its own component. Rows that repeat an id are vectors of
    their own: each has the links of its vector, and both bear the component's smallest id. An empty table gives an empty one; other
    columns are ignored. Classes are told apart by 128 bits of a hash of label and vector.
    """
    eps = math.sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v"))
    valid = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("v")
    key = [F.xxhash64(F.lit(salt), "label", "v").alias(name) for salt, name in ((1, "k1"), (2, "k2"))]
    each = rows.where(valid).select("vec_id", "label", "v", *key)
    classes = each.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "ego-classes")
    blocks = stored(sequence(classes, eps), "ego-blocks")
    found = stored(join_blocks(block_pairs(blocks, eps), blocks, cosine, eps), "ego-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = components(found, "cid", "root").withColumnRenamed("node", "cid")
    # A component bears its smallest vec_id, not the number of one of its classes.
    joined = links.hint("merge").join(classes.select("cid", "k1", "k2", "rep", "weight").hint("merge"), "cid", "right").hint("merge").join(named.hint("merge"), "cid", "left")
    joined = stored(joined.select("k1", "k2", "rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "ego-joined")
    lowest = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = joined.hint("merge").join(lowest.hint("merge"), "component").select("k1", "k2", "n_links", "component_id")
    good = rows.where(valid).select("vec_id", *key).hint("merge").join(per_class.hint("merge"), ["k1", "k2"], "left").select("vec_id", "n_links", "component_id")
    rest = rows.where(~valid).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
