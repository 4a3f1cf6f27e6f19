"""Ranked lexical search of all documents for each of a table of items, by collapsing equal bags of terms.

1. Documents are tokenized once and restricted to the vocabulary of the items: a sorted list of (term, occurrences), the bag, and the number n of all terms.
2. A document's score depends on its bag and on m, its length against the mean, alone. Documents are classed by a hash of both, verified on
   both whole, and of each class the ``k`` smallest doc_ids are kept: no more can be among the best of an item.
3. Each class is scored once against the items that share a term with it; a task keeps the ``k`` best members of each item so far, and
   classes below the last of them aren't expanded.
4. The tasks' bests are ranked by score and doc_id.

All numbers but the logarithm are 64-bit integers. The items' terms are sent to every task; a table of items with more of them than ``most_terms``
is answered in rounds. A document is a row: repeated rows are found each. A null doc_id comes last among equal scores; null and empty texts have no
terms, and an item without terms has no hits. Rows of items that are equal count once, and different rows of one item_id as one text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.llm.shared import by_bytes, byte_view, small_batches, stored
from proofsieve.llm.words import LETTER_OR_DIGIT, ranges, runs

#: Item terms that are sent to every task at a time.
MOST_TERMS = 1 << 20
#: Scores that a task holds at a time.
CELLS = 1 << 20
#: Bytes of text that are tokenized at a time; a longer text goes by itself.
PART = 4 << 20


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term, times) for each term of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words = runs(*byte_view(batch.column(1)), LETTER_OR_DIGIT)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), words.cast(pa.string())], names=["item", "term"])

    own = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).distinct()
    return small_batches(own).mapInArrow(run, f"item {dict(own.dtypes)['item']}, term string").groupBy("item", "term").agg(F.count("*").alias("times"))


def bags(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, bag) for each row of ``docs`` (doc_id, text): its number of terms, and of those in the vocabulary the places in it, ascending, then
    their occurrences, as 32-bit integers; null without any."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for a, b in by_bytes(batch.column(1), PART):
                sizes, words = runs(*byte_view(batch.column(1).slice(a, b - a)), LETTER_OR_DIGIT)
                place = pc.fill_null(pc.index_in(words, known), -1).to_numpy()
                there = np.flatnonzero(place >= 0)
                row = np.repeat(np.arange(b - a, dtype=np.int64), sizes)[there]
                cells, tf = np.unique(row * len(known) + place[there], return_counts=True)
                ends = np.searchsorted(cells // max(1, len(known)), np.arange(b - a + 1))
                code, tf = (cells % max(1, len(known))).astype(np.int32), tf.astype(np.int32)
                found = pa.array([code[x:y].tobytes() + tf[x:y].tobytes() if y > x else None for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes.astype(np.int64)), found], names=["doc_id", "n", "bag"])

    return small_batches(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, bag binary")


def unpacked(bags_here: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of terms of each bag, places, occurrences)."""
    at, raw = byte_view(bags_here)
    at, flat = at // 4, np.frombuffer(raw, np.int32)
    sizes = np.diff(at) // 2
    first = ranges(at[:-1], sizes)
    return sizes, flat[first], flat[first + np.repeat(sizes, sizes)]


def document_counts(held: DataFrame, size: int) -> np.ndarray:
    """For each place of the vocabulary the number of bags that have it; a task sends one number a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column(0))[1], minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["place", "df"])

    got = held.select("bag").where("bag is not null").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["place"].to_numpy()] = got["df"].to_numpy()
    return out


class Best:
    """The ``k`` best (score, doc) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, order: np.ndarray) -> None:
        """``order`` ranks all docs added so far, the smallest first; ``doc`` are places in it."""
        item, score, doc = np.concatenate((self.item, item)), np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        by = np.lexsort((order[doc], -score, item))
        item, score, doc = item[by], score[by], doc[by]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        kept = nth < self.k
        last = nth == self.k - 1
        self.least[item[last]] = score[last]
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


def scored(classes: DataFrame, items: pa.Array, starts: np.ndarray, item_of: np.ndarray, times: np.ndarray, weights: np.ndarray, k: int, kind: str) -> DataFrame:
    """(item, doc_id, score): of each task's classes (m, bag, members) the ``k`` best members of each item.

    ``item_of[starts[p]:starts[p + 1]]`` are the items with the term at place p, ``times`` their occurrences in them.
    """
    sent = classes.sparkSession.sparkContext.broadcast((items, starts, item_of, times, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, begin, holder, many, weight = sent.value
        best, docs = Best(len(ids), k), pa.array([], batch_type)
        most, width = max(1, CELLS // max(1, len(ids))), 16  # few at first, until there are bests that keep others from being expanded
        for whole in batches:
            a = 0
            while a < whole.num_rows:
                width = min(2 * width, most)
                batch = whole.slice(a, width)
                a += width
                sizes, place, tf = unpacked(batch.column(1))
                row = np.repeat(np.arange(len(sizes)), sizes)
                m = batch.column(0).to_numpy()[row]
                tf = tf.astype(np.int64)
                part = weight[place] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                total = np.zeros(len(sizes) * len(ids), np.int64)
                wide = begin[place + 1] - begin[place]
                done = np.cumsum(wide)
                at = 0
                while at < len(wide):  # so many entries that their items stay within a bound
                    end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + 4 * CELLS, "right")))
                    own = ranges(begin[place[at:end]], wide[at:end])
                    entry = np.repeat(np.arange(at, end), wide[at:end])
                    np.add.at(total, row[entry] * len(ids) + holder[own], part[entry] * many[own])
                    at = end
                cells = np.flatnonzero(total.reshape(len(sizes), -1) >= best.least)
                if len(cells):
                    members = batch.column(2)
                    first = members.offsets.to_numpy()
                    count = np.diff(first)[cells // len(ids)]
                    new = ranges(first[cells // len(ids)], count)
                    held = len(docs)
                    docs = pa.concat_arrays([docs, pc.take(members.values, pa.array(new))])
                    order = np.empty(len(docs), np.int64)
                    order[pc.sort_indices(docs, null_placement="at_end").to_numpy()] = np.arange(len(docs))
                    best.add(np.repeat(cells % len(ids), count), np.repeat(total[cells], count), held + np.arange(len(new)), order)
                    docs, best.doc = docs.take(pa.array(best.doc)), np.arange(len(best.doc))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.item)), docs, pa.array(best.score)], names=["item", "doc_id", "score"])

    batch_type = classes.select("members").limit(0).toArrow().schema.field(0).type.value_type
    return classes.select("m", "bag", "members").mapInArrow(run, f"item {kind}, doc_id {dict(classes.dtypes)['members'][6:-1]}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", most_terms: int = MOST_TERMS) -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each item, of equal scores the smaller doc_id first.

    ``docs`` has doc_id and text, ``items`` the column ``item`` and text.
    """
    asked = stored(item_terms(items, item, "text"), "lexical-items")
    rounds = max(1, math.ceil(asked.count() / most_terms))
    kind = dict(asked.dtypes)["item"]
    found = []
    for turn in range(rounds):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == turn).toArrow() if rounds > 1 else asked.toArrow()  # most_terms rows or so
        ids, terms = own["item"].combine_chunks().dictionary_encode(null_encoding="encode"), own["term"].cast(pa.large_string()).combine_chunks()
        vocabulary = pc.unique(terms)
        held = stored(bags(docs.select("doc_id", "text"), vocabulary), "lexical-bags")
        n_docs, n_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not len(vocabulary):
            continue
        df = document_counts(held, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        places = pc.index_in(terms, vocabulary).to_numpy()
        by = np.argsort(places, kind="stable")
        starts = np.searchsorted(places[by], np.arange(len(vocabulary) + 1))
        classes = classed(held.where("bag is not null"), n_docs, n_terms, k)
        found.append(scored(classes, ids.dictionary, starts, ids.indices.to_numpy()[by].astype(np.int64), own["times"].to_numpy()[by], weights, k, kind))
    if not found:
        return asked.select(F.col("item").alias(item)).limit(0).select(item, F.lit(0).alias("rank"), F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), F.lit(0).cast("long").alias("score"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = reduce(DataFrame.union, found).withColumn("rank", nth).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", "doc_id", "score")


def classed(held: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(m, bag, members): the classes of equal m and bag with their ``k`` smallest doc_ids. They meet by a hash and are told apart by the whole of both."""
    relative = F.expr(f"cast((cast(75 * n as decimal(20,0)) * cast({n_docs} as decimal(18,0))) div cast({n_terms} as decimal(18,0)) as long)")
    rows = held.withColumn("m", F.lit(100 - 75) + relative).withColumn("hash", F.xxhash64("m", "bag"))
    nth = F.row_number().over(Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last()))
    return rows.select("hash", "m", "bag", "doc_id", nth.alias("nth")).where(F.col("nth") <= k).groupBy("hash", "m", "bag").agg(F.collect_list(F.struct("doc_id")).alias("members")).select("m", "bag", F.col("members.doc_id").alias("members"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of the ten best documents of each item."""
    return search(docs, items)


def oracle_sql() -> str:
    """The report in DuckDB."""
    terms = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH bag AS (SELECT doc_id, {terms.format('text')} AS t FROM documents), held AS (SELECT doc_id, len(t) AS n, t FROM bag WHERE len(t) > 0),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM held),
asked AS (SELECT item_id, unnest({terms.format('text')}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)), wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY 1, 2),
posting AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM held) GROUP BY 1, 2, 3),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM posting, size GROUP BY term, docs),
part AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))) AS value FROM posting JOIN weight USING (term), size),
total AS (SELECT item_id, doc_id, CAST(sum(times * value) AS BIGINT) AS score FROM wanted JOIN part USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM total WHERE score > 0) WHERE rank <= 10"""
