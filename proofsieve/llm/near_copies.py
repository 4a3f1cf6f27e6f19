"""SimHash near-duplicates at a similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

First the fingerprints of the sets are matched by multi-index hashing, and the matches are verified on the whole sets. That can't
find all links: at similarity 0.8 two fingerprints differ in about 10 bits, in more
than 12 for a pair in six, and looking up balls so wide costs more than comparing all pairs. So the other candidates come from the
shingles themselves. In any fixed order of all shingles, two sets that similar share one of their first n - ceil(0.8 n) + 1
shingles each; rare shingles go first, so common passages seldom meet. Candidates are left out where the sizes or the
parities prove that they differ too much, and the others are verified on the whole sets, so no pair is lost and none is wrong.

Equal sets are one class. A large group of near copies has pairs with the square of its size, each of them at many shingles, but few
are needed to connect it. So before shingles meet, each class is compared with a few of those that have the same pick: the set's first hash from
a fixed point on, the same for two sets as often as they are similar. Where many classes share a shingle they are compared with one of them first,
and only pairs that aren't linked already are made. Shingles are looked up in packed rows from batches of texts to shards of hashes, and only the texts of
candidates are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofsieve.llm.chunks import pieces, split_by_shard, squeeze, steps, unsqueeze
from proofsieve.llm.components import components
from proofsieve.llm.shared import by_bytes, byte_view, small_batches, stored, tidy
from proofsieve.llm.simhash import near_pairs
from proofsieve.llm.words import Hasher, joined

SEED = 5
SHINGLE = 5
#: A shingle in so many texts of a batch is common there; at most COMMON of these, 12 MB, are put last in the order (which changes no result).
OFTEN, COMMON = 2, 1 << 20
#: Bytes of text in a batch where shingles are counted.
BATCH = 4 << 20
#: All pairs are compared once they are at most so many times the rows of candidates, or once a round links fewer than one row in FEW.
PAIRS, FEW = 8, 50
#: Bits of the parities of a set, at least; a power of two that is no less than its size.
PARITIES = 512
#: Bits in which fingerprints that are matched first may differ, and segments of the index.
BITS, SEGMENTS = 2, 2
#: Each set picks the first of its hashes from each of so many points on.
POINTS = np.arange(8, dtype=np.uint64) << np.uint64(61)
#: So many of the classes that have a pick in common are compared with all of these.
HEADS = 6
#: Entries that are packed at a time; so many classes at most are sent to every task to fetch their texts, 16 MB of ids.
PACKED, SENT = 400_000, 2_000_000


def shingle_sets(texts: pa.Array, hasher: Hasher, shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles, A-Z in lower case; a shorter text is one shingle."""
    at, raw = byte_view(texts)
    hashes, first = hasher(at, raw)
    folds = [hashes]
    for k in range(1, shingle):
        folds.append(joined(folds[-1][: max(0, len(hashes) - k)], hashes[k:]))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        width = min(shingle, b - a)
        out.append(np.unique(folds[width - 1][a : b - width + 1]) if width else np.zeros(0, np.uint64))
    return out


def key_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def parities(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes is in each of some cells; two sets have at least as many hashes that only one has as these bits differ."""
    cells = max(PARITIES, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) % cells, minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed integer."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(own), 1 << 16):
        total += np.unpackbits(own[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(own)).view("<i8")[0])


def picks(own: np.ndarray) -> np.ndarray:
    """The distinct hashes of a sorted set that come first from each of the POINTS on, around; hashes are random, so two sets have one of these in common with a chance that is their similarity."""
    return np.unique(own[np.searchsorted(own, POINTS) % max(1, len(own))]) if len(own) else own


def _batched(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hasher = Hasher(SEED, lower=True)
    for batch in batches:
        for a, b in by_bytes(batch.column(column), most):
            part = batch.slice(a, b - a)
            yield part, shingle_sets(part.column(column), hasher)


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, parities, fp, picks) for each row; and rows with a null key of (hash, n): shingles common in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "parities", "fp", "picks", "hash", "n"]
        for part, sets in _batched(batches, 1, BATCH):
            own = [key_of(x) for x in sets]
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.int64()), pa.array([parities(x) for x in sets], pa.list_(pa.int64())), pa.array([fingerprint(x) for x in sets], pa.int64()), pa.array([picks(x).view(np.int64) for x in sets], pa.list_(pa.int64())), none, pa.array([len(x) for x in sets], pa.int64())], names=names)
            once = dict(zip(own, sets, strict=True)).values()
            hashes, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *once]), return_counts=True)
            hashes, n = hashes[n >= OFTEN], n[n >= OFTEN]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), part.column(0).type), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.list_(pa.int64())), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.list_(pa.int64())), pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], names=names)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, key bigint, parities array<bigint>, fp bigint, picks array<bigint>, hash bigint, n bigint")


def shared_shingles(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(hash, key, n, r): the shingles of each set of which a similar one has one among its own, where another set has the same; n is the set's size and r
    how many of its shingles come from there on in the order. Two sets of which this is the first one that they share have min(r, r') in common at most,
    and 4/9 of n + n' if they are similar; so an entry stays only while another one of the shingle is small enough for it."""
    sent, shards = docs.sparkSession.sparkContext.broadcast(common), pieces(docs, "text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = sent.value
        held: dict[int, tuple[np.ndarray, int]] = {}

        def flush() -> pa.RecordBatch:
            own_keys, sizes = np.array([*held], np.int64).view(np.uint64), np.array([n for _, n in held.values()], np.int64)
            hashes, of = np.concatenate([x for x, _ in held.values()]), np.repeat(np.arange(len(held)), [len(x) for x, _ in held.values()])
            place = np.concatenate([np.arange(len(x)) for x, _ in held.values()])
            order = np.argsort(hashes, kind="stable")
            hashes, of, place = hashes[order], of[order], place[order]
            cut, data = split_by_shard(hashes, shards), []
            for _, a, b in cut:
                there, at = np.unique(of[a:b], return_inverse=True)
                data.append(squeeze([steps(hashes[a:b]), at, own_keys[there], sizes[there], place[a:b]]))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in cut], pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])

        for _, sets in _batched(batches, 0):
            for own in sets:
                key = key_of(own)
                if key in held:
                    continue
                n, most = len(own), len(own) - (4 * len(own) + 4) // 5 + 1
                if len(often):
                    place = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    own = own[np.argsort(np.where(often[place] == own, counts[place], 0), kind="stable")]
                held[key] = own[:most], n
            if sum(len(x) for x, _ in held.values()) >= PACKED:
                yield flush()
                held = {}
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        rows = [unsqueeze(x) for x in table["data"].to_pylist()]
        hashes = np.concatenate([np.cumsum(r[0].view(np.uint64)) for r in rows])
        own_keys, n = (np.concatenate([r[i][r[1]] for r in rows]) for i in (2, 3))
        left = n - np.concatenate([r[4] for r in rows])
        order = np.lexsort((own_keys, hashes))
        hashes, own_keys, n, left = hashes[order], own_keys[order], n[order], left[order]
        once = np.r_[True, (hashes[1:] != hashes[:-1]) | (own_keys[1:] != own_keys[:-1])][: len(hashes)]
        while True:
            hashes, own_keys, n, left = hashes[once], own_keys[once], n[once], left[once]
            group = np.cumsum(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)]) - 1
            least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
            np.minimum.at(least, group, n)
            once = (np.bincount(group)[group] > 1) & (4 * (n + least[group]) <= 9 * left)
            if once.all():
                break
        return pa.table({"hash": hashes.view(np.int64), "key": own_keys, "n": n.astype(np.int32), "r": left.astype(np.int32)})

    asked = small_batches(docs.select("text")).mapInArrow(tidy(ask), "shard int, data binary")
    return asked.groupBy("shard").applyInArrow(meet, "hash bigint, key bigint, n int, r int")


def texts_of(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, text): a text of each of the keys in ``asked``."""
    reps = stored(classes.hint("merge").join(asked.select("key").distinct().hint("merge"), "key", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "near-copies-reps")
    few = reps.count() <= SENT
    named = docs.select("doc_id", "text")
    found = named.join(F.broadcast(reps), "doc_id", "left_semi") if few else named.hint("merge").join(reps.hint("merge"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _batched(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in sets], pa.int64()), part.column(0)], names=["key", "text"])

    own = small_batches(found.select(F.coalesce("text", F.lit("")).alias("text"))).mapInArrow(tidy(run), "key bigint, text string")
    return own.groupBy("key").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of keys whose sets have a similarity of 0.8 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            for key, text in ((0, 2), (1, 3)):
                ids = batch.column(key).to_pylist()
                first = [k for k, i in enumerate(ids) if i not in sets and not sets.update({i: None})]
                one = pa.RecordBatch.from_arrays([batch.column(text).take(pa.array(first, pa.int64())), pa.array([ids[k] for k in first], pa.int64())], names=["text", "key"])
                for part, found in _batched(iter([one]), 0):
                    sets.update(zip(part.column(1).to_pylist(), found, strict=True))
            good = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                good.append(5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = texts.select(F.col("key").alias("a"), F.col("text").alias("x")), texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    both = pairs.hint("merge").join(left.hint("merge"), "a").hint("merge").join(right.hint("merge"), "b")
    return small_batches(both.select("a", "b", "x", "y")).mapInArrow(tidy(run), "a bigint, b bigint")


def _candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): pairs of keys that may be similar by the sizes and the parities of their sets, each once."""
    fits = pairs.where("key <> key2 and 5L * least(n, n2) >= 4L * greatest(n, n2)")
    out = fits.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b"), (F.col("n") + F.col("n2")).alias("sizes")).distinct()
    for name in ("a", "b"):
        own = classes.select(F.col("key").alias(name), F.col("parities").alias(f"{name}_parities"))
        out = out.hint("merge").join(own.hint("merge"), name)
    return out.where(_close("a_parities", "b_parities", F.col("sizes"))).select("a", "b")


def _close(a: str, b: str, sizes: Column) -> Column:
    """Whether sets of ``sizes`` elements together may be similar by the parities of both. Of sets with different numbers of cells the larger one's halves are laid over each other."""
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    x, y = (F.when(F.size(own) > F.size(other), folded(own)).otherwise(F.col(own)) for own, other in ((a, b), (b, a)))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    return differ * 9 <= sizes


def matched(classes: DataFrame) -> DataFrame:
    """(key, n, key2, n2): classes whose fingerprints are equal or differ in at most BITS bits; of equal ones each with one of them."""
    prints = classes.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("one"))
    own = classes.hint("merge").join(prints.hint("merge"), "fp").where("key <> one.key").select("key", "n", F.col("one.key").alias("key2"), F.col("one.n").alias("n2"))
    table = prints.select("fp", F.col("one.key").alias("rep"))
    near = near_pairs(table, BITS, SEGMENTS)
    for end, name, n in (("a", "key", "n"), ("b", "key2", "n2")):
        near = near.hint("merge").join(classes.select(F.col("key").alias(end), F.col("n").alias(n)).hint("merge"), end).withColumnRenamed(end, name)
    return own.union(near.select("key", "n", "key2", "n2"))


def picked(classes: DataFrame) -> DataFrame:
    """(key, n, key2, n2): classes that have a pick in common and may be similar by their sizes and parities, each with at most HEADS of them."""
    rows = classes.select("key", "n", "parities", F.explode("picks").alias("pick"))
    nth = F.row_number().over(Window.partitionBy("pick").orderBy(F.xxhash64("pick", "key"), "key"))
    first = rows.select("pick", "key").withColumn("nth", nth).where(F.col("nth") <= HEADS).withColumn("met", F.count("*").over(Window.partitionBy("pick"))).where("met > 1")
    own = first.select("pick", "key").hint("merge").join(classes.select("key", "n", "parities").hint("merge"), "key")
    # Written, so that AQE may split a pick that many classes have. Many have one in a common passage, so rows carry their parities here too.
    heads = stored(own.select(F.col("pick").alias("pick2"), F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("parities").alias("parities2")), "near-copies-heads")
    near = F.expr("pick = pick2 and key <> key2 and 5L * least(n, n2) >= 4L * greatest(n, n2)") & _close("parities", "parities2", F.col("n") + F.col("n2"))
    return rows.hint("merge").join(heads.hint("merge"), near).select("key", "n", "key2", "n2")


def links(shared: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): pairs of similar keys that connect the same keys as all such pairs do; ``shared`` is (hash, key, n, r)."""

    def similar(asked: DataFrame) -> DataFrame:
        pairs = stored(_candidates(asked, classes), "near-copies-pairs")
        texts = stored(texts_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("key"))), "near-copies-texts")
        return stored(verified(pairs, texts), "near-copies-links")

    near = "4L * (n + n2) <= 9L * least(r, r2)"
    found, turn, fresh_links = similar(matched(classes).union(picked(classes))), 0, None
    now = shared
    while True:
        groups = components(found, "a", "b")
        now = now.select("hash", "key", "n", "r").hint("merge").join(groups.hint("merge"), F.col("key") == F.col("node"), "left").select("hash", "key", "n", "r", F.coalesce("component", "key").alias("label"))
        # Of classes that share a shingle, the ones that aren't all linked yet.
        each = now.groupBy("hash").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(F.xxhash64(F.lit(turn), "key").alias("order"), "key", "n", "r", "label")).alias("one"))
        now = stored(now.hint("merge").join(each.where("low < high").hint("merge"), "hash").select("hash", "key", "n", "r", "label", "c", "one"), "near-copies-open")
        rows, pairs = now.agg(F.count("*"), F.coalesce(F.sum((F.col("c") - 1) / 2), F.lit(0.0))).first()
        if not rows:
            break
        whole = pairs <= PAIRS * rows or (fresh_links is not None and fresh_links * FEW < rows)
        if whole:
            # Rows carry their parities, so that pairs which these rule out are never made, let alone shuffled.
            rows_now = now.hint("merge").join(classes.select("key", "parities").hint("merge"), "key")
            other = rows_now.select(F.col("hash").alias("hash2"), F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("r").alias("r2"), F.col("label").alias("label2"), F.col("parities").alias("parities2"))
            asked = rows_now.hint("merge").join(other.hint("merge"), F.expr("hash = hash2 and key < key2 and label <> label2") & F.expr(near) & _close("parities", "parities2", F.col("n") + F.col("n2")))
            asked = asked.select("key", "n", "key2", "n2")
        else:
            asked = now.select("key", "n", "label", F.col("one.key").alias("key2"), F.col("one.n").alias("n2"), F.col("r"), F.col("one.r").alias("r2"), F.col("one.label").alias("label2")).where("label <> label2").where(near)
        new = similar(asked)
        fresh_links = new.count()
        found = found.union(new)
        if whole:
            break
        turn += 1
    return found


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable by links of similarity 0.8 or more, for each row.

    Texts without words are equal. A row with a null doc_id links with nothing and has a null component_id. Repeated rows are
    repeated in the result; other columns are ignored.
    """
    named = docs.where("doc_id is not null")
    both = stored(keys(named), "near-copies-keys")
    rows = both.where("key is not null")
    first = [F.first(c).alias(c) for c in ("n", "parities", "fp", "picks")]
    classes = stored(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), *first), "near-copies-classes")
    often = both.where("key is null").groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "hash").limit(COMMON).toArrow()
    hashes, n = often["hash"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(hashes)
    shared = stored(shared_shingles(named, (hashes[order], n[order])), "near-copies-shared")
    similar = links(shared, classes, named)
    for name in ("a", "b"):
        own = classes.select(F.col("key").alias(name), F.col("rep").alias(f"{name}_rep"))
        similar = similar.hint("merge").join(own.hint("merge"), name)
    groups = components(stored(similar.select("a_rep", "b_rep"), "near-copies-linked"), "a_rep", "b_rep")
    of_class = classes.hint("merge").join(groups.hint("merge"), classes.rep == groups.node, "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = rows.hint("merge").join(of_class.hint("merge"), "key").select("doc_id", "component_id")
    return out.union(docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("component_id")))
