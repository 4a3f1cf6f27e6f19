"""Scoring texts by a trigram model in Elias-Fano tries.

P(w | u v) = max(c(u v w) - D, 0) / c(u v) + D T(u v) / c(u v) P(w | v), P(w | v) likewise over P(w) = (c(w) + 1) / (N + V + 1); c are
counts in the training texts, T(h) is the number of different words after h, and an unseen h leaves the lower order.

The vocabulary level is the sorted sequence of the words' 64-bit hashes, over all shards; a word's id is its place in it. The tries are
shards by the first word. Level one of a shard holds its words, monotone, and their quantised weights D T / c. Pointers,
monotone too, lead to each word's range in level two, which holds the ids after it, made monotone by the rank of the first word, with
their quantised first terms and weights, and from there on to level three. An n-gram is found by successor searches inside its contexts' ranges.

A context with more than half a shard's share of the corpus is split by the hash of the word after it. Each part knows the
context's whole count; the parts' shares of its weight are added up by who asks. Split pairs are words of level one in their own right.

Counting and asking go together: each chunk of documents sends each shard its distinct n-grams with their
training counts, the shard merges them, builds its trie and answers each chunk from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofsieve.llm.chunks import CHUNK, dealt, packed, split_by_shard, squeeze, steps, unsqueeze
from proofsieve.llm.eliasfano import EliasFano, pack, unpack
from proofsieve.llm.shared import byte_view, stored
from proofsieve.llm.words import Hasher, mix

#: The hash that stands for the end of a text, and as a context for its start.
END = np.uint64(0x5BD1E9955BD1E995)
DISCOUNT = 0.75
LEVELS = 254
#: In the first level ids from 1 << SPLIT_BITS on are split pairs.
SPLIT_BITS = 40
#: Contexts in fewer of a chunk's tokens than one in RARE aren't looked at as hot; those under LEAST never.
RARE, LEAST = 4096, 64
#: One shard of hot contexts for so many shards of words.
PER_HOT = 16

ASKED = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])
ASKED_DDL = "shard int, chunk int, data binary"
#: What the vocabulary's shards return: answers to chunks, and a row each of (n, known, size), or hot contexts in ``data``.
WORDS, SIZES, HOT, GRAMS = range(4)
ANSWER = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("shard", pa.int32()), ("data", pa.binary()), ("n", pa.int64()), ("known", pa.int64()), ("size", pa.int64())])
ANSWER_DDL = "kind int, chunk int, shard int, data binary, n bigint, known bigint, size bigint"
RESULT = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
RESULT_DDL = "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def step_of(total: int) -> float:
    """Width of a level of the quantiser, in log10, for a corpus of ``total`` tokens."""
    return (math.log10(total + 1) + 1) / LEVELS


def keyed(context: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    """(context, id) as one key, the context above the ``bits`` of an id. Raises if either doesn't fit, so that no two n-grams are ever one."""
    if int(ids.max(initial=0)) >> bits or int(context.max(initial=0)) >> 64 - bits:
        raise OverflowError(f"a shard's {int(context.max(initial=0)) + 1} contexts and ids of {bits} bits don't fit in 64 bits: deal smaller chunks")
    return context.astype(np.uint64) << np.uint64(bits) | ids.astype(np.uint64)


def quantised(p: np.ndarray, step: float) -> np.ndarray:
    """0 for 0, else 1 to 255: the nearest level of log10(p)."""
    with np.errstate(divide="ignore"):
        level = np.rint(-np.log10(p) / step)
    return np.where(p > 0, 1 + np.clip(level, 0, LEVELS), 0).astype(np.uint8)


def values_of(step: float) -> np.ndarray:
    """The value of each of the 256 codes."""
    return np.r_[0.0, 10.0 ** (-step * np.arange(LEVELS + 1))]


class Tokens:
    """The tokens of a chunk's texts, words and an end each: ``words``, sorted and distinct with END among them, and ``own``, the word of each token."""

    def __init__(self, table: pa.Table):
        texts = table["text"].combine_chunks()
        at, raw = byte_view(texts if isinstance(texts, pa.Array) else texts.chunk(0))
        hashes, first = Hasher(seed=1, lower=True)(at, raw)
        self.n = len(texts)
        tokens = np.insert(hashes, first[1:], END)
        self.first = first + np.arange(self.n + 1)
        self.train = np.repeat(table["train"].to_numpy(zero_copy_only=False), np.diff(self.first))
        self.words, own = np.unique(np.r_[tokens, END], return_inverse=True)
        self.own, end = own[:-1], own[-1]
        #: The word before each token; END before the first of a text.
        self.before = np.r_[end, self.own[:-1]][: len(self.own)]
        self.before[self.first[:-1]] = end

    def counts(self, of: np.ndarray, n: int, train: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of[self.train if train is None else train], minlength=n)

    def hot(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, occurrences) of the words, v being 0, and the pairs that many tokens follow."""
        least = max(LEAST, len(self.own) // RARE)
        often = np.bincount(self.before, minlength=len(self.words))
        many = np.flatnonzero(often >= least)
        heavy = often >= least
        both = heavy[self.before] & heavy[self.own]
        codes, n = np.unique(self.before[both] * len(self.words) + self.own[both], return_counts=True)
        codes, n = codes[n >= least], n[n >= least]
        u, v = np.r_[self.words[many], self.words[codes // len(self.words)]], np.r_[np.zeros(len(many), np.uint64), self.words[codes % len(self.words)]]
        return u, v, np.r_[often[many], n]


@dataclass
class Hot:
    """The contexts that are split, by the hashes of their words (v is 0 for one word), and their numbers of parts."""

    u: np.ndarray
    v: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, sums: DataFrame, total: int, shards: int) -> Hot:
        """From (data): packed contexts with their tokens. These add up to two times all tokens at most, so no more than about 4 * shards contexts
        have half a shard's share; only those are collected."""
        share = max(LEAST, total / (2 * shards))

        def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    u, v, n = unsqueeze(x)
                    yield pa.RecordBatch.from_arrays([pa.array(c[n > share]) for c in (u, v, n)], names=["u", "v", "n"])

        found = sums.select("data").mapInArrow(above, "u bigint, v bigint, n bigint").toArrow()
        u, v, n = (found[c].to_numpy() for c in ("u", "v", "n"))
        u, v = u.view(np.uint64), v.view(np.uint64)
        order = np.lexsort((v, u))
        return cls(u[order], v[order], np.minimum(np.ceil(n[order] / share), shards).astype(np.int64))


class Nest:
    """A chunk's n-grams, in the order in which they are sent: instances of roots, their entries, and the entries' leaves.

    A root is a word, or a split pair; an entry is a word after it; a leaf is a word after both. A split root has an instance for each
    part, in shards of their own.
    """

    def __init__(self, own: Tokens, ids: np.ndarray, hot: Hot, shards: int):
        w = len(own.words)
        self.codes, self.pair = np.unique(own.before * w + own.own, return_inverse=True)
        inside = np.ones(len(own.own), bool)
        inside[own.first[:-1]] = False
        #: Tokens that have a pair before them, and the trigram of each.
        self.later = np.flatnonzero(inside)
        leaves, leaf = np.unique(self.pair[self.later - 1] * w + own.own[self.later], return_inverse=True)
        pair_count = own.counts(self.pair, len(self.codes))
        leaf_count = own.counts(leaf, len(leaves), own.train[self.later])
        of, leaf_word = leaves // w, leaves % w
        # Split pairs that the chunk has: their leaves become entries of a root of their own.
        u_at, v_at = np.searchsorted(own.words, hot.u), np.searchsorted(own.words, hot.v)
        there = (own.words[np.minimum(u_at, w - 1)] == hot.u) & (own.words[np.minimum(v_at, w - 1)] == hot.v) & (hot.v > 0)
        split = np.flatnonzero(there)
        code = u_at[split] * w + v_at[split]
        at = np.searchsorted(self.codes, code)
        real = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == code)
        split, at = split[real], at[real]
        #: The root of each pair that is split, or -1.
        self.moved = np.full(len(self.codes), -1)
        self.moved[at] = w + np.arange(len(split))
        to = self.moved[of]
        away = to >= 0
        entry_root = np.r_[self.codes // w, to[away]]
        entry_id = np.r_[ids[self.codes % w], ids[leaf_word[away]]]
        entry_count = np.r_[pair_count, leaf_count[away]]
        root_key = np.r_[ids, (1 << SPLIT_BITS) + split]
        root_count = np.bincount(entry_root, entry_count, len(root_key)).astype(np.int64)
        parts = np.ones(len(root_key), np.int64)
        single = hot.v == 0
        own_hot = single & (own.words[np.minimum(u_at, w - 1)] == hot.u)
        parts[u_at[own_hot]] = hot.parts[own_hot]
        parts[w:] = hot.parts[split]
        begin = np.cumsum(parts) - parts
        root = np.repeat(np.arange(len(parts)), parts)
        shard = ((mix(root_key.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)[root] + np.arange(len(root)) - begin[root]) % shards
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.root, self.shard, self.n_roots = root[order], shard[order], len(parts)
        instance = place[begin[entry_root] + (mix(entry_id.astype(np.uint64) + np.uint64(1)) % parts[entry_root].astype(np.uint64)).astype(np.int64)]
        entry_order = np.argsort(instance, kind="stable")
        #: Where each entry, each leaf is sent.
        self.entry_at = np.empty(len(entry_order), np.int64)
        self.entry_at[entry_order] = np.arange(len(entry_order))
        stay = np.flatnonzero(~away)
        leaf_order = stay[np.argsort(self.entry_at[of[stay]], kind="stable")]
        leaf_at = np.empty(len(leaves), np.int64)
        leaf_at[leaf_order] = np.arange(len(leaf_order))
        moved_at = len(self.codes) + np.cumsum(away) - 1
        #: Of each token in ``later``: the place of its trigram, among entries where the pair is split, or else among leaves.
        self.split = away[leaf]
        self.at = np.where(self.split, self.entry_at[np.where(away, moved_at, 0)][leaf] if len(leaves) else 0, leaf_at[leaf])
        self.key, self.count = root_key[self.root], root_count[self.root]
        self.entries = np.bincount(instance, minlength=len(order))
        self.entry_id, self.entry_count = entry_id[entry_order], entry_count[entry_order]
        self.leaves = np.bincount(self.entry_at[of[stay]], minlength=len(entry_order))
        self.leaf_id, self.leaf_count = ids[leaf_word[leaf_order]], leaf_count[leaf_order]

    def rows(self, chunk: int) -> pa.Table:
        there = np.unique(self.shard)
        a = np.searchsorted(self.shard, there)
        b = np.r_[a[1:], len(self.shard)]
        entry, leaf = np.r_[0, np.cumsum(self.entries)], np.r_[0, np.cumsum(self.leaves)]
        out = {name: [] for name in ASKED.names}
        for shard, x, y in zip(there.tolist(), a.tolist(), b.tolist(), strict=True):
            e, f = entry[x], entry[y]
            g, h = leaf[e], leaf[f]
            out["shard"].append(shard)
            out["chunk"].append(chunk)
            out["data"].append(squeeze([steps(self.key[x:y]), self.count[x:y], self.entries[x:y], self.entry_id[e:f], self.entry_count[e:f], self.leaves[e:f], self.leaf_id[g:h], self.leaf_count[g:h]]))
        return packed(out, ASKED)


class Trie:
    """A shard's levels; the training n-grams alone."""

    def __init__(self, bits: int, roots: EliasFano, weights: np.ndarray, pointers: EliasFano, second: EliasFano, terms: np.ndarray, second_weights: np.ndarray, second_pointers: EliasFano, third: EliasFano, third_terms: np.ndarray):
        self.bits, self.roots, self.weights, self.pointers, self.second, self.terms = bits, roots, weights, pointers, second, terms
        self.second_weights, self.second_pointers, self.third, self.third_terms = second_weights, second_pointers, third, third_terms

    @classmethod
    def of(cls, roots: np.ndarray, counts: np.ndarray, context: np.ndarray, ids: np.ndarray, pairs: np.ndarray, context3: np.ndarray, ids3: np.ndarray, triples: np.ndarray, total: int, bits: int) -> Trie:
        """From sorted roots with their counts, entries (place of the root, id) with theirs, and leaves (place of the entry, id) with theirs, all sorted; ids have ``bits`` bits."""
        step = step_of(total)

        def level(above: np.ndarray, context: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple:
            kinds = np.bincount(context, minlength=len(above))
            weights = quantised(np.where(above > 0, DISCOUNT * kinds / np.maximum(above, 1), 0), step)
            return weights, EliasFano.of(np.r_[0, np.cumsum(kinds)]), EliasFano.of(keyed(context, ids, bits)), quantised(np.maximum(n - DISCOUNT, 0) / np.maximum(above[context], 1), step)

        weights, pointers, second, terms = level(counts, context, ids, pairs)
        followed = np.bincount(context3, triples, len(ids)).astype(np.int64)
        return cls(bits, EliasFano.of(roots), weights, pointers, second, terms, *level(followed, context3, ids3, triples))

    def pack(self) -> bytes:
        return pack([np.array([self.bits]), *self.roots.arrays(), self.weights, *self.pointers.arrays(), *self.second.arrays(), self.terms, self.second_weights, *self.second_pointers.arrays(), *self.third.arrays(), self.third_terms])

    @classmethod
    def view(cls, buffer: bytes | memoryview | np.ndarray) -> Trie:
        bits, *x = unpack(buffer)
        e = lambda k: EliasFano(*x[k : k + 4])
        return cls(int(bits[0]), e(0), x[4], e(5), e(9), x[13], x[14], e(15), e(19), x[23])

    def root(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each root, its weight code); a root that isn't there has place -1 and code 0."""
        at, found = self.roots.successor(keys.astype(np.uint64))
        return np.where(found, at, -1), _codes(self.weights, at, found)

    def entry(self, root: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each entry in its root's range, its term code, its weight code)."""
        at, found = _within(self.pointers, self.second, root, ids, self.bits)
        return np.where(found, at, -1), _codes(self.terms, at, found), _codes(self.second_weights, at, found)

    def leaf(self, entry: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The term code of each leaf in its entry's range."""
        return _codes(self.third_terms, *_within(self.second_pointers, self.third, entry, ids, self.bits))


def _codes(codes: np.ndarray, at: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.where(found, codes[np.where(found, at, 0)], 0).astype(np.uint8) if len(codes) else np.zeros(len(at), np.uint8)


def _within(pointers: EliasFano, level: EliasFano, context: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Successor search for (context, id) between the context's pointers; contexts ascend, -1 is none."""
    at, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    known = np.flatnonzero(context >= 0)
    if len(known) and level.n:
        once, inverse = np.unique(context[known], return_inverse=True)
        if len(once) * 8 > pointers.n:  # nearly all contexts are asked for: one pass over the pointers is cheaper than finding each
            ends = pointers.values().astype(np.int64)
            low, high = ends[once][inverse], ends[once + 1][inverse]
        else:
            low, high = pointers.access(once).astype(np.int64)[inverse], pointers.access(once + 1).astype(np.int64)[inverse]
        at[known], found[known] = level.successor(keyed(context[known], ids[known], bits), low, high)
    return at, found


def _gathered(context: np.ndarray, ids: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, id, sum of the counts, inverse) of what is distinct."""
    keys, inverse = np.unique(keyed(context, ids, bits), return_inverse=True)
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64), np.bincount(inverse, counts, len(keys)).astype(np.int64), inverse


class Merged:
    """The rows that a shard got: all that is asked, distinct, and with ``trie`` the training part of it. Ids have ``bits`` bits."""

    def __init__(self, table: pa.Table, bits: int):
        self.bits = bits
        rows = [unsqueeze(x) for x in table["data"].to_pylist()]
        self.sizes = [(len(r[0]), len(r[3]), len(r[6])) for r in rows]
        key, count, entries, entry_id, entry_count, leaves, leaf_id, leaf_count = (np.concatenate(x) for x in zip(*[(np.cumsum(r[0]), *r[1:]) for r in rows], strict=True))
        self.key, self.root_of = np.unique(key, return_inverse=True)
        self.count = np.bincount(self.root_of, count, len(self.key)).astype(np.int64)
        self.context, self.id, self.pairs, self.entry_of = _gathered(np.repeat(self.root_of, entries), entry_id, entry_count, bits)
        self.context3, self.id3, self.triples, self.leaf_of = _gathered(np.repeat(self.entry_of, leaves), leaf_id, leaf_count, bits)

    def trie(self, total: int) -> Trie:
        root, entry, leaf = self.count > 0, self.pairs > 0, self.triples > 0
        context, context3 = np.cumsum(root) - 1, np.cumsum(entry) - 1
        return Trie.of(self.key[root], self.count[root], context[self.context[entry]], self.id[entry], self.pairs[entry], context3[self.context3[leaf]], self.id3[leaf], self.triples[leaf], total, self.bits)

    def answers(self, trie: Trie) -> list[bytes]:
        root, weights = trie.root(self.key)
        entry, terms, second_weights = trie.entry(root[self.context], self.id)
        leaves = trie.leaf(entry[self.context3], self.id3)[self.leaf_of]
        weights, terms, second_weights = weights[self.root_of], terms[self.entry_of], second_weights[self.entry_of]
        out, (x, y, z) = [], (0, 0, 0)
        for a, b, c in self.sizes:
            out.append(squeeze([weights[x : x + a], terms[y : y + b], second_weights[y : y + b], leaves[z : z + c]]))
            x, y, z = x + a, y + b, z + c
        return out


def _row(kind: int, chunk: int | None, shard: int, data: bytes | None = None, sizes: tuple[int, int, int] = (0, 0, 0)) -> tuple:
    return kind, chunk, shard, data, *sizes


def _answer(rows: list[tuple]) -> pa.Table:
    return packed({name: [r[i] for r in rows] for i, name in enumerate(ANSWER.names)}, ANSWER)


def _ask_words(shards: int):
    def ask(table: pa.Table) -> pa.Table:
        own, chunk = Tokens(table), table["chunk"][0].as_py()
        counts = own.counts(own.own, len(own.words))
        rows = [(shard, chunk, squeeze([steps(own.words[a:b]), counts[a:b]])) for shard, a, b in split_by_shard(own.words, shards)]
        u, v, n = own.hot()
        part = (mix(u ^ v) % np.uint64(max(1, shards // PER_HOT))).astype(np.int64)
        rows += [(-1 - k, chunk, squeeze([u[part == k], v[part == k], n[part == k]])) for k in np.unique(part).tolist()]
        return packed({name: [r[i] for r in rows] for i, name in enumerate(ASKED.names)}, ASKED)

    return ask


def _settle_words(table: pa.Table) -> pa.Table:
    """A shard of the vocabulary: for each chunk the places and training counts of its words; or the sums of hot contexts."""
    shard, rows = table["shard"][0].as_py(), [unsqueeze(x) for x in table["data"].to_pylist()]
    if shard < 0:
        u, v, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((v, u))
        u, v, n = u[order], v[order], n[order]
        new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
        begin = np.flatnonzero(new)
        return _answer([_row(HOT, None, shard, squeeze([u[begin], v[begin], np.add.reduceat(n, begin)]))])
    keys = [np.cumsum(r[0].view(np.uint64)) for r in rows]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(at, np.concatenate([r[1] for r in rows]), len(every)).astype(np.int64)
    out, k = [_row(SIZES, None, shard, None, (int(counts.sum()), int((counts > 0).sum()), len(every)))], 0
    for chunk, own in zip(table["chunk"].to_pylist(), keys, strict=True):
        place = at[k : k + len(own)]
        out.append(_row(WORDS, chunk, shard, squeeze([steps(place), counts[place]])))
        k += len(own)
    return _answer(out)


@dataclass
class Vocabulary:
    """What a task needs to know of all shards: where the ids of each begin, training tokens, distinct ones, the split contexts, and the bits of an id."""

    begin: np.ndarray
    total: int
    known: int
    hot: Hot
    bits: int

    def words(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(id and training count of each of a chunk's words)."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in answers.sort_by("shard").to_pylist():
            if r["kind"] == WORDS:
                place, n = unsqueeze(r["data"])
                ids.append(np.cumsum(place) + self.begin[r["shard"]])
                counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)


def vocabulary(rows: DataFrame, shards: int) -> tuple[DataFrame, Vocabulary]:
    """(answers to the chunks, the vocabulary). The driver reads three numbers a shard and the contexts that may be hot."""
    answers = stored(rows.groupBy("chunk").applyInArrow(_ask_words(shards), ASKED_DDL).groupBy("shard").applyInArrow(_settle_words, ANSWER_DDL), "ngrams-words")
    sizes = {r.shard: (r.n, r.known, r.size) for r in answers.where(F.col("kind") == SIZES).select("shard", "n", "known", "size").collect()}
    total, known, size = (np.array([sizes.get(k, (0, 0, 0))[i] for k in range(shards)], np.int64) for i in range(3))
    split = Hot.of(answers.where(F.col("kind") == HOT), int(total.sum()), shards)
    return answers.where(F.col("kind") == WORDS), Vocabulary(np.cumsum(size) - size, int(total.sum()), int(known.sum()), split, max(1, int(size.sum()).bit_length()))


def _ask_grams(shards: int, voc: Vocabulary):
    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ASKED.empty_table()
        return Nest(Tokens(table), voc.words(answers)[0], voc.hot, shards).rows(table["chunk"][0].as_py())

    return ask


def tries(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """(shard, trie): the model of the training texts (doc_id, text, ...), one packed trie a shard, for ``Trie.view``."""
    rows, shards = dealt_with(docs, chunk_bytes)
    words, voc = vocabulary(rows, shards)

    def build(table: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "trie": pa.array([Merged(table, voc.bits).trie(voc.total).pack()], pa.binary())})

    asked = rows.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_ask_grams(shards, voc), ASKED_DDL)
    return asked.groupBy("shard").applyInArrow(build, "shard int, trie binary")


def dealt_with(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """The columns of ``dealt`` and train: whether crc32(doc_id as text) mod 7 is not 2; a null id is held out."""
    rows, n = dealt(docs, chunk_bytes=chunk_bytes)
    return rows.withColumn("train", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))), n


def score(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Null texts count as empty: one token, the end. A row with a null doc_id is held out. Repeated rows are
    counted and scored as often as they occur. An empty table gives an empty one; other columns are ignored. Words are
    told apart by 64-bit hashes, n-grams by the words' whole ids.
    Memory follows the size of a chunk, of a shard's distinct n-grams, or the longest text.
    """
    rows, shards = dealt_with(docs, chunk_bytes)
    words, voc = vocabulary(rows, shards)
    values = values_of(step_of(voc.total))

    def answer(table: pa.Table) -> pa.Table:
        merged, shard = Merged(table, voc.bits), table["shard"][0].as_py()
        trie = Trie.view(merged.trie(voc.total).pack())
        return _answer([_row(GRAMS, chunk, shard, data) for chunk, data in zip(table["chunk"].to_pylist(), merged.answers(trie), strict=True)])

    def add_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        own = Tokens(table)
        ids, counts = voc.words(answers)
        nest = Nest(own, ids, voc.hot, shards)
        got = [unsqueeze(r["data"]) for r in answers.sort_by("shard").to_pylist() if r["kind"] == GRAMS]
        weights, terms, second, leaves = (values[np.concatenate(x)] for x in zip(*got, strict=True))
        weights = np.bincount(nest.root, weights, nest.n_roots)
        unseen = lambda x: np.where(x > 0, x, 1.0)  # noqa: E731  a context that isn't known leaves the lower order
        single = (counts + 1) / (voc.total + voc.known + 1)
        n_pairs = len(nest.codes)
        pair_terms, pair_weights = terms[nest.entry_at[:n_pairs]], second[nest.entry_at[:n_pairs]]
        pair_weights = np.where(nest.moved >= 0, weights[nest.moved], pair_weights)
        p = pair_terms[nest.pair] + unseen(weights[own.before]) * single[own.own]
        last = np.zeros(len(nest.later))
        last[nest.split], last[~nest.split] = terms[nest.at[nest.split]], leaves[nest.at[~nest.split]]
        p[nest.later] = last + unseen(pair_weights[nest.pair[nest.later - 1]]) * p[nest.later]
        add = lambda x: np.add.reduceat(x, own.first[:-1])  # noqa: E731  each text has a token
        columns = [table["doc_id"].combine_chunks(), table["train"].combine_chunks(), pa.array(np.diff(own.first)), pa.array(add((counts > 0)[own.own].astype(np.int64))), pa.array(add(np.log10(single)[own.own])), pa.array(add(np.log10(p)))]
        return pa.table(columns, schema=RESULT)

    by_chunk = rows.groupBy("chunk")
    grams = by_chunk.cogroup(words.groupBy("chunk")).applyInArrow(_ask_grams(shards, voc), ASKED_DDL).groupBy("shard").applyInArrow(answer, ANSWER_DDL)
    found = by_chunk.cogroup(words.union(grams).groupBy("chunk")).applyInArrow(add_up, RESULT_DDL)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(voc.total).cast("bigint").alias("train_tokens"), "base_score", "score")
