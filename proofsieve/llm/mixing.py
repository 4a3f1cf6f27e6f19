"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact size in words. A source's target is met by whole passes over all its documents and, for
the rest of the budget, by a number of documents of each size: in proportion first, then one
more of some sizes, and the last words by bounded-knapsack dynamic programming. Which documents of a size are
taken is settled by a seeded hash of their id. Only (id, source, size) is shuffled, never text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.llm.shared import fresh, stored

#: No document is taken more often than this.
MOST = 3
#: Words that are left to the dynamic programming, or more where a source's longest document is longer; it holds two arrays of the words that are left and the longest document.
DP_WORDS = 1 << 16
#: Documents of one source and size that are ranked together.
RANKED = 5_000
SEED = 7


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, at most ``counts``, for the sum nearest to ``budget``, the smaller one of two. Sums are counted in
    the sizes' common divisor."""
    unit = max(1, int(np.gcd.reduce(sizes))) if len(sizes) else 1
    sizes, goal = sizes // unit, budget // unit
    most = goal + int(sizes.max(initial=0))
    reached, by = np.zeros(most + 1, bool), np.full(most + 1, -1, np.int32)
    reached[0] = True
    for k, (size, count) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        if reached[goal] and goal * unit == budget:
            break
        front = np.flatnonzero(reached)
        for _ in range(count):
            front = front[front <= most - size] + size
            front = front[~reached[front]]
            if not len(front):
                break
            reached[front] = True
            by[front] = k
    sums = np.flatnonzero(reached)
    out, at = np.zeros(len(sizes), np.int64), int(sums[np.argmin(np.abs(sums * unit - budget))])
    while at:
        out[by[at]] += 1
        at -= int(sizes[by[at]])
    return out


def fit_budget(sizes: np.ndarray, counts: np.ndarray, target: float, seed: int = SEED, dp_words: int = DP_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(how often to take all documents of each size, how many of them to take once more) for a target of words."""
    total = int((sizes * counts).sum())
    passes = min(MOST, int(target // total))
    rest = budget = round(target) - passes * total
    extra, most = np.zeros(len(sizes), np.int64), counts * (MOST - passes)
    if passes < MOST and budget > 0:
        extra = np.floor(counts * (budget / total)).astype(np.int64)
        rest -= int((sizes * extra).sum())
        order = np.random.default_rng(seed).permutation(len(sizes))
        for k in order.tolist():
            if rest <= dp_words:
                break
            if sizes[k] <= rest and extra[k] < counts[k]:
                extra[k] += 1
                rest -= int(sizes[k])
        extra[order] += knapsack(sizes[order], (most - extra)[order], max(0, rest))  # above dp_words only if some document is longer than the rest
        if budget <= max(dp_words, 4 * int(sizes.max())) and abs(budget - int((sizes * extra).sum())) > 1:  # a source of a few documents: all of the budget is fitted
            every = np.zeros_like(extra)
            every[order] = knapsack(sizes[order], most[order], budget)
            extra = min(extra, every, key=lambda x: abs(budget - int((sizes * x).sum())))
    return passes + extra // counts, extra % counts


def targets(sized: DataFrame) -> DataFrame:
    """(key, source_size, target) for each source of ``sized`` (key, source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target stops at three times the
    source's size; the excess goes to the other sources by weight until none is above. The table has one row per source;
    each round reads three sums from it.
    """
    # Places of the sorted sources: the place in its partition of the sort and, by a count of each partition, those before it.
    sums = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    within = stored(sums.select("key", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("own")), "mixing-sources")
    before, starts = 0, [(-1, 0)]
    for r in within.groupBy("part").agg((F.max("own") + 1).alias("n")).orderBy("part").collect():
        starts.append((r.part, before))
        before += r.n
    # A row for each partition of the sort; as an Arrow table it reaches the JVM without a Python worker, which would stay.
    starts = F.broadcast(sized.sparkSession.createDataFrame(pa.table({"part": pa.array([x for x, _ in starts], pa.int32()), "start": pa.array([x for _, x in starts], pa.int64())})))
    sources = within.join(starts, "part").select("key", "source_size", ((F.col("own") + F.col("start")) % 3 + 1).cast("double").alias("weight"))
    full = F.col("source_size") * MOST
    level, before = 0.0, -1
    while True:
        above = full < F.col("weight") * level
        total, held, weights, n = sources.agg(
            F.sum("source_size"), F.sum(F.when(above, full).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.sum(above.cast("int"))
        ).first()
        if not total or not weights or n == before:
            break
        level, before = (total - held) / weights, n
    return sources.select("key", "source_size", F.least(full.cast("double"), F.col("weight") * level).alias("target"))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and ``copies`` (0 to 3), one row for each row of ``docs``.

    A null text has size 0, as an empty one has, and is never taken. Repeated rows are documents of their own. An empty table gives an empty table; if all sizes are 0 then so are the targets. Null ids rank by their hash like any other.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sized = stored(docs.select("doc_id", "source", key.alias("key"), size.alias("size")), "mixing-sizes")
    per_source = targets(sized)
    counted = sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        passes, extra = fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), float(rows["target"].iloc[0]))
        return rows.assign(passes=passes, extra=extra)[["key", "size", "n", "passes", "extra"]]

    with_target = counted.hint("merge").join(per_source.hint("merge"), "key").select("key", "size", "n", "target")
    plan = stored(with_target.groupBy("key").applyInPandas(fit, "key string, size bigint, n bigint, passes int, extra bigint"), "mixing-plan")
    order = F.xxhash64(F.lit(SEED), "doc_id")
    drawn = sized.hint("merge").join(plan.hint("merge"), ["key", "size"], "left")
    drawn = drawn.withColumn("order", order).withColumn("bucket", F.pmod("order", F.coalesce(F.ceil(F.col("n") / RANKED), F.lit(1))))
    # Of a size's documents the first ``extra`` in the order of (bucket, order) are taken; no window holds more than a bucket.
    by_bucket = drawn.where("extra > 0").groupBy("key", "size", "bucket").agg(F.count("*").alias("own"), F.first("extra").alias("extra"))
    earlier = F.sum("own").over(Window.partitionBy("key", "size").orderBy("bucket")) - F.col("own")
    quota = by_bucket.select("key", "size", "bucket", (F.col("extra") - earlier).alias("quota"))
    ranked = drawn.hint("merge").join(quota.hint("merge"), ["key", "size", "bucket"], "left")
    nth = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("order", "doc_id"))
    taken = ranked.withColumn("copies", F.coalesce("passes", F.lit(0)) + F.coalesce(nth <= F.col("quota"), F.lit(False)).cast("int"))
    return taken.hint("merge").join(per_source.hint("merge"), "key").select("doc_id", "source", "size", "source_size", "target", "copies")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Rows that share id, source and size are told apart by their place among these, in the order of the text.
    """
    size, row, place, times, alike, copy = (fresh(n, docs.columns) for n in ("size", "row", "nth", "copies", "alike", "copy"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    nth = lambda *order: F.row_number().over(Window.partitionBy(row).orderBy(*order))
    plan = stored(copies(docs).select("doc_id", "source", "size", "copies").withColumn(row, F.xxhash64("doc_id", "source", "size")), "mixing-copies")
    of_row = plan.groupBy(row).agg(F.count("*").alias(alike), F.max("copies").alias(times))
    found = docs.withColumn(size, words).withColumn(row, F.xxhash64("doc_id", "source", size)).hint("merge").join(of_row.hint("merge"), row)
    # Only rows that share all three are numbered; texts of the others are shuffled once, to meet their number of copies.
    placed = plan.withColumn(place, nth("doc_id", "source", "size", "copies")).where("copies > 0").select(row, place, F.col("copies").alias(times))
    shared = found.where(F.col(alike) > 1).drop(times).withColumn(place, nth("doc_id", "source", size, "text")).hint("merge").join(placed.hint("merge"), [row, place])
    taken = found.where((F.col(alike) == 1) & (F.col(times) > 0)).select(*docs.columns, times).union(shared.select(*docs.columns, times))
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)
