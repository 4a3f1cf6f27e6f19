"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsieve.llm.shared import stored, tidy


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, low): the smallest of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))


def _joined(pairs: DataFrame) -> DataFrame:
    return pairs.hint("merge").join(_lowest(pairs).hint("merge"), "u")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest one."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _joined(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these. Here u > v in every link."""
    moved = _joined(links)
    return moved.select("u", F.col("low").alias("v")).union(moved.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v")).distinct()


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) of the links (a[i], b[i])."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (root[x], root[y], x, y):  # a root that meets a smaller one takes it, and so does all below it
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contracted(links: DataFrame) -> DataFrame:
    """The links of each partition as stars: each node and the smallest one that it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            node, root = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
            own = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], names=["u", "v"])

    return links.select("u", "v").mapInArrow(tidy(run), "u bigint, v bigint")


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: no node has two links up, or one up and one down."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node in ``links``, of 64-bit integers, the smallest node that it reaches.

    Links of a node with itself or with null don't count. Each round shortens the links of every partition to stars, moves what is left
    between partitions, and is written to the shared folder; the loop ends when all links are stars. A hub's links are
    reduced in each task before they are shuffled, and the joins may be split by AQE.
    """
    now = links.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where(F.col(a) != F.col(b))
    while True:
        now = stored(_small_star(_large_star(_contracted(now))), "components")
        if _settled(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
