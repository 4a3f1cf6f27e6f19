"""SimHash near-duplicates by multi-index hashing.

Documents with equal fingerprints form a class, and only classes are compared. A fingerprint is
cut into segments. If two differ in at most r = m a + b bits (b < m) over m segments, then they differ
in at most a bits in one of the first b + 1 segments or in at most a - 1 bits in one of the others. So
each class looks up, in the table of each segment, all values in a Hamming ball of that
small radius around its own; the matches are verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.llm.components import components
from proofsieve.llm.shared import fresh, per_text, stored

BITS = 64


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash, as a signed integer, of the word shingles of a text with A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(shingle, len(words))
    first, last = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, np.int64), len(first)
    for k in range(0, n, 1 << 16):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(first[k : k + (1 << 16)], last[k : k + (1 << 16)], strict=True)], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3, seed: int = 42) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed 64-bit integer; null texts count as empty (fp 0)."""

    def work(texts: list[str]) -> list[pa.Array]:
        return [pa.array([fingerprint(t, shingle, seed) for t in texts], pa.int64())]

    return per_text(docs, "text", [("fp", "bigint")], lambda: work, keep)


def balls(width: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` bits."""
    return [sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(range(width), k)]


def near_pairs(classes: DataFrame, most: int = 2, segments: int = 2) -> DataFrame:
    """(a, b): representatives of all pairs of ``classes`` (fp, rep) whose fp differ in 1 to ``most`` bits."""
    cuts = [BITS * k // segments for k in range(segments + 1)]
    a, rest = divmod(most, segments)
    probes, entries = [], []
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        radius, width = (a if k <= rest else a - 1), high - low
        if radius < 0:
            continue
        value, segment = F.shiftrightunsigned("fp", low), F.lit(k).alias("segment")
        value = value.bitwiseAND((1 << width) - 1) if high < BITS else value  # the last segment has no bits above it
        masks = F.array([F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("bigint") for m in balls(width, radius)])
        probes.append(classes.withColumn("own", value).select(segment, F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("value"), "fp", "rep"))
        entries.append(F.struct(segment, value.alias("value")))
    table = classes.select(F.explode(F.array(entries)).alias("x"), F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    table = table.select("x.segment", "x.value", "fp2", "rep2")
    asked = probes[0]
    for more in probes[1:]:
        asked = asked.union(more)
    found = asked.hint("merge").join(table.hint("merge"), ["segment", "value"]).where("fp < fp2")
    return found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= most).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))


def near_duplicates(docs: DataFrame, most: int = 2, segments: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable by links of at most ``most`` bits, for each row.

    Null and empty texts have fingerprint 0 and link like any other. A row with a null doc_id gets a
    fingerprint, links with nothing and has a null component_id. Repeated rows are repeated in the
    result; an empty table gives an empty one; other columns are ignored.
    """
    rows = stored(fingerprints(docs, ["doc_id"], shingle, seed), "simhash-fingerprints")
    classes = stored(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    links = stored(near_pairs(classes, most, segments), "simhash-links")
    found = components(links, "a", "b")
    named = classes.hint("merge").join(found.hint("merge"), classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = rows.hint("merge").join(named.hint("merge"), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, **settings: int) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is its component's smallest; of rows that repeat such an id
    the one with the smallest text; and all rows without an id."""
    return smallest(docs, near_duplicates(docs, **settings))


def smallest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """What ``representatives`` returns, for ``groups`` of (doc_id, component_id)."""
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    own = docs.where("doc_id is not null").hint("merge").join(kept.hint("merge"), "doc_id", "left_semi")
    nth = fresh("nth", docs.columns)
    first = own.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(nth) == 1)
    return first.select(*docs.columns).unionByName(docs.where("doc_id is null"))
