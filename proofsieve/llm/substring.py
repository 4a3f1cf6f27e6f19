"""Substring dedup by level-wise doubling.

Levels are window lengths that double, from ``window / 2`` to ``window`` words. A window that occurs in
one document only can't be part of a longer one that occurs in two, so windows
repeated at one level alone are extended to twice the length at the next. For removal the level of ``window`` is the last,
since a repeat that is longer is covered by windows that are themselves repeated; ``repeat_lengths`` goes on until none survives.

At the first level it is enough to look at anchors: each window is anchored at the half-length window with the
smallest hash inside it, which depends on the window's words alone. So equal windows have equal anchors, and two
in twenty-seven half-length windows are looked up instead of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from proofsieve.llm.chunks import CHUNK, dealt, packed, split_by_shard
from proofsieve.llm.shared import byte_view, stored
from proofsieve.llm.words import Hasher, joined

ASKED = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("first", pa.binary()), ("several", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int32()), ("level", pa.int32()), ("shard", pa.int32()), ("flags", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
#: Flags of a key: it is in two documents at least; it is in a document before the chunk's first one with it.
REPEATED, EARLIER = 1, 2


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on, by doubling."""
    parts, power, size = [], words, 1
    while size <= width:
        if width & size:
            parts.append((size, power))
        power, size = joined(power[: max(0, len(power) - size)], power[size:]), size * 2
    n, at, out = max(0, len(words) - width + 1), 0, None
    for size, part in reversed(parts):
        own = part[at : at + n]
        out, at = own if out is None else joined(out, own), at + size
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[: max(0, len(x) - size)], x[size:]), size * 2
    shift = width - size
    return np.minimum(x[: len(x) - shift], x[shift:]) if shift and len(x) > shift else x[: max(0, len(x) - shift)]


def distinct(keys: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(order by key, group of each in that order, index of the first and of the last of each group)."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if more is not None:
        new[1:] |= more[order][1:] != more[order][:-1]
    begin = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, begin, np.r_[begin[1:], len(k)][: len(begin)] - 1


def asked(chunk: int, docs: np.ndarray, keys: np.ndarray, more: np.ndarray | None, shards: int) -> pa.Table:
    """What a chunk asks the shards about windows with these keys; ``docs``, their documents, ascend."""
    order, _, begin, last = distinct(keys, more)
    own, docs = keys[order][begin], docs[order]
    first, several = docs[begin], docs[begin] != docs[last]
    rows = {name: [] for name in ASKED.names}
    for shard, a, b in split_by_shard(own, shards):
        values = (shard, chunk, own[a:b].tobytes(), b"" if more is None else more[order][begin[a:b]].tobytes(), first[a:b].tobytes(), np.packbits(several[a:b]).tobytes())
        for name, value in zip(ASKED.names, values, strict=True):
            rows[name].append(value)
    return packed(rows, ASKED)


def answered(docs: np.ndarray, keys: np.ndarray, more: np.ndarray | None, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flags of each window, whether its document comes after the chunk's first one with its key)."""
    order, group, begin, _ = distinct(keys, more)
    docs = docs[order]
    of, later = np.zeros(len(keys), np.uint8), np.zeros(len(keys), bool)
    of[order], later[order] = flags[group], docs > docs[begin][group]
    return of, later


class Windows:
    """The windows of a chunk, with the documents in the order of their ids."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table.take(pc.sort_indices(table, [("doc_id", "ascending")])).combine_chunks()
        self.ids, text = self.table["doc_id"].combine_chunks(), self.table["text"].combine_chunks()
        self.at, self.raw = byte_view(text if isinstance(text, pa.Array) else text.chunk(0))
        words, self.first_word = Hasher(seed=1)(self.at, self.raw)
        self.window, self.n_words = window, len(words)
        half = window // 2
        known = np.asarray(self.ids.is_valid())
        sizes = np.diff(self.first_word)
        starts = np.where(known, np.maximum(0, sizes - window + 1), 0)
        doc = np.repeat(np.arange(len(sizes)), starts)
        offset = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts)
        #: Where each window starts, and its document.
        self.start, self.doc = self.first_word[:-1][doc] + offset, self.ids.fill_null(0).to_numpy()[doc]
        if len(doc):
            self.halves = window_hashes(words, half)
            self.anchor = sliding_min(self.halves, window - half + 1)[self.start]
        else:
            self.halves = self.anchor = np.zeros(0, np.uint64)

    def candidates(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows with a repeated anchor, and the two keys of each: both half windows together, and the anchor."""
        every = np.arange(len(self.start))
        of, _ = answered(self.doc[every], self.anchor, None, flags)
        which = np.flatnonzero(of & REPEATED)
        at, half = self.start[which], self.window // 2
        return which, joined(self.halves[at], self.halves[at + self.window - half]), self.anchor[which]


def flags_of(answers: pa.Table, level: int) -> np.ndarray:
    """The flags of a level in the order of the keys."""
    own = answers.filter(pc.equal(answers["level"], level)).sort_by("shard")
    return np.frombuffer(b"".join(own["flags"].to_pylist()), np.uint8)


def settle(level: int, table: pa.Table) -> pa.Table:
    """A shard's answers: for each key of each row REPEATED and EARLIER."""
    read = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
    keys, more, first = read("keys", np.uint64), read("more", np.uint64), read("first", np.int64)
    sizes = [len(k) for k in keys]
    several = np.concatenate([np.unpackbits(x, count=n) for x, n in zip(read("several", np.uint8), sizes, strict=True)])
    k, f = np.concatenate(keys), np.concatenate(first)
    m = np.concatenate(more) if len(more[0]) else np.zeros(len(k), np.uint64)
    order = np.lexsort((f, m, k))
    new = np.ones(len(k), bool)
    new[1:] = (k[order][1:] != k[order][:-1]) | (m[order][1:] != m[order][:-1])
    begin, group = np.flatnonzero(new), np.cumsum(new) - 1
    low, high = f[order][begin], f[order][np.r_[begin[1:], len(k)] - 1]
    repeated = (low != high) | np.maximum.reduceat(several[order], begin).astype(bool)
    out = np.zeros(len(k), np.uint8)
    out[order] = REPEATED * repeated[group] + EARLIER * (low[group] < f[order])
    parts = [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]
    n = len(parts)
    return pa.table([table["chunk"].combine_chunks(), pa.array([level] * n, pa.int32()), table["shard"].combine_chunks(), pa.array(parts, pa.binary())], schema=ANSWER)


def dedup(docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words that stay joined by one space, for each row of ``docs``.

    Removed is each word in a window of ``window`` words that also starts in a document with a smaller doc_id.
    Words are ``[^\\x20\\x09-\\x0D]+``. Texts shorter than the window lose nothing; null texts count as empty; a row
    with a null doc_id loses nothing and takes nothing from others; rows that share a doc_id are one document
    and take nothing from each other; an empty table gives an empty one; other columns are ignored. Windows are
    compared by two 64-bit hashes. Memory follows the size of a chunk or the longest text.
    """
    rows, shards = dealt(docs, id_column, text_column, chunk_bytes)
    by_chunk, anchors, windows = levels(rows, shards, window)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        own = Windows(table, window)
        which, keys, more = own.candidates(flags_of(answers, 0))
        flags, later = answered(own.doc[which], keys, more, flags_of(answers, 1))
        at = own.start[which[later | (flags & EARLIER > 0)]]
        change = np.zeros(own.n_words + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        keep = np.cumsum(change[:-1]) == 0
        raw, lost, kept = own.raw.tobytes(), [], []
        for a, b, x, y in zip(own.at[:-1].tolist(), own.at[1:].tolist(), own.first_word[:-1].tolist(), own.first_word[1:].tolist(), strict=True):
            mask = keep[x:y]
            gone = y - x - int(np.count_nonzero(mask))
            words = raw[a:b].split()
            lost.append(gone)
            kept.append(b" ".join(compress(words, mask.tolist()) if gone else words))
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table([own.ids, pa.array(np.diff(own.first_word)), pa.array(lost, pa.int64()), texts], schema=RESULT)

    return by_chunk.cogroup(anchors.union(windows).groupBy("chunk")).applyInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


ASKED_DDL, ANSWER_DDL = "shard int, chunk int, keys binary, more binary, first binary, several binary", "chunk int, level int, shard int, flags binary"


def levels(rows: DataFrame, shards: int, window: int) -> tuple[GroupedData, DataFrame, DataFrame]:
    """(rows by chunk, answers about anchors, answers about the windows of repeated anchors)."""

    def first_level(table: pa.Table) -> pa.Table:
        own = Windows(table, window)
        return asked(table["chunk"][0].as_py(), own.doc, own.anchor, None, shards)

    def last_level(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return ASKED.empty_table()
        own = Windows(table, window)
        which, keys, more = own.candidates(flags_of(answers, 0))
        return asked(table["chunk"][0].as_py(), own.doc[which], keys, more, shards)

    by_chunk = rows.groupBy("chunk")
    anchors = by_chunk.applyInArrow(first_level, ASKED_DDL).groupBy("shard").applyInArrow(lambda t: settle(0, t), ANSWER_DDL)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(last_level, ASKED_DDL).groupBy("shard").applyInArrow(lambda t: settle(1, t), ANSWER_DDL)
    return by_chunk, anchors, windows


STATE = pa.schema([("chunk", pa.int32()), ("docs", pa.binary()), ("at", pa.binary()), ("keys", pa.binary()), ("more", pa.binary())])
STATE_DDL = "chunk int, docs binary, at binary, keys binary, more binary"


def _state(chunk: int, docs: np.ndarray, at: np.ndarray, keys: np.ndarray, more: np.ndarray) -> pa.Table:
    """A chunk's surviving windows; no row if there is none."""
    values = (chunk, docs.tobytes(), at.tobytes(), keys.tobytes(), more.tobytes())
    return packed({n: [v] if len(docs) else [] for n, v in zip(STATE.names, values, strict=True)}, STATE)


def _doubled(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(docs, at, keys, more) of the windows of twice the length both halves of which survive, from a chunk's state."""
    docs, at = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["at"], np.int64)
    keys, more = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["more"], np.uint64)
    # Windows of a text follow each other in the order of their places, which no two texts of a chunk share.
    half = np.minimum(np.searchsorted(at, at + length), max(0, len(at) - 1))
    both = (at[half] == at + length) & (docs[half] == docs)
    first, second = np.flatnonzero(both), half[both]
    return docs[first], at[first], joined(keys[first], keys[second]), joined(more[first], more[second] ^ np.uint64(1))


def _level(length: int, shards: int) -> tuple:
    """The functions of one level: (documents that survive at ``length``, what is asked about twice the length, what survives there)."""

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.unique(np.frombuffer(r["docs"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), length))], names=["doc_id", "length"])

    def extend(table: pa.Table) -> pa.Table:
        r = table.to_pylist()[0]
        docs, _, keys, more = _doubled(r, length)
        return asked(r["chunk"], docs, keys, more, shards)

    def survive(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return STATE.empty_table()
        r = table.to_pylist()[0]
        docs, at, keys, more = _doubled(r, length)
        flags, _ = answered(docs, keys, more, flags_of(answers, 2))
        kept = flags & REPEATED > 0
        return _state(r["chunk"], docs[kept], at[kept], keys[kept], more[kept])

    return there, extend, survive


def repeat_lengths(docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, length): the longest of the lengths window, 2 window, 4 window, ... at which a window of the document is also in another
    one; documents without a repeat have no row.

    Level by level the windows that are repeated, and they alone, are extended to twice their length, until none survives. The surviving windows' hashes
    are kept packed, a row a chunk, so no level after the first reads the texts again.
    """
    rows, shards = dealt(docs, id_column, text_column, chunk_bytes)
    by_chunk, anchors, windows = levels(rows, shards, window)

    def begin(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return STATE.empty_table()
        own = Windows(table, window)
        which, keys, more = own.candidates(flags_of(answers, 0))
        flags, _ = answered(own.doc[which], keys, more, flags_of(answers, 1))
        kept = flags & REPEATED > 0
        # A gap of a window's length between texts keeps their places apart.
        text = np.searchsorted(own.first_word, own.start[which[kept]], "right") - 1
        return _state(table["chunk"][0].as_py(), own.doc[which[kept]], own.start[which[kept]] + text * (1 << 32), keys[kept], more[kept])

    state, length, found = stored(by_chunk.cogroup(anchors.union(windows).groupBy("chunk")).applyInArrow(begin, STATE_DDL), "substring-level"), window, None
    while not state.isEmpty():
        there, extend, survive = _level(length, shards)
        level = state.mapInArrow(there, "doc_id bigint, length bigint")
        found = level if found is None else found.union(level)
        grouped = state.groupBy("chunk")
        answers = grouped.applyInArrow(extend, ASKED_DDL).groupBy("shard").applyInArrow(lambda t: settle(2, t), ANSWER_DDL)
        state, length = stored(grouped.cogroup(answers.groupBy("chunk")).applyInArrow(survive, STATE_DDL), "substring-level"), length * 2
    if found is None:
        return rows.limit(0).select("doc_id", F.lit(0).cast("bigint").alias("length"))
    return found.groupBy("doc_id").agg(F.max("length").alias("length"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
