"""Byte-level BPE encoding and decoding by replaying the merges over a block of the corpus.

The distinct pre-tokens of a block form one token sequence. An inverted index from merge rank to
the positions of the pairs that make it is kept up to date, and the merges are applied in rank
order at all their positions; a merge touches only the neighbours of its position. Blocks are
independent, so no pre-token dictionary is shuffled, broadcast or collected: that dictionary
grows with the corpus. A task keeps the pre-tokens it has seen, up to ``REMEMBER``; beyond that
it starts anew, which changes time but no result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from proofsieve.llm.shared import per_text

REMEMBER = 250_000
#: Bytes of text in a block.
BLOCK = 4 << 20
#: In the block's sequence: between pre-tokens, and where a token was merged into the one before it.
END, GONE = -1, -2
#: No token has this rank.
NONE = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and decimal ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encodes pre-tokens and decodes ids by one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bits = max(self.tokens, default=0).bit_length()
        #: Every pair of tokens (left << bits | right) that makes a token, with its rank.
        self.made: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.made[left << self.bits | right] = rank
        self.keys = np.array(sorted(self.made), np.int64)
        self.values = np.array([self.made[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or NONE."""
        key = np.where((left < 0) | (right < 0), -1, left << self.bits | right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word: all merges of the block in rank order, within a rank from left to right.

        Where a merge makes a pair of a lower rank than its own, that pair would have to go first;
        such words are merged anew one by one.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(sizes + 1) - sizes
        token = np.full(int(sizes.sum()) + len(words) + 1, END, np.int64)
        inside = np.ones(len(token), bool)
        inside[0] = inside[first + sizes] = False
        token[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        before, after = np.arange(-1, len(token) - 1), np.arange(1, len(token) + 1)
        rank_at = np.full(len(token), NONE, np.int64)
        rank_at[:-1] = self.pair_ranks(token[:-1], token[1:])
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []
        again: list[np.ndarray] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(places, cuts), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(waiting, rank)

        if len(there := np.flatnonzero(rank_at != NONE)):
            enter(there, rank_at[there])
        while waiting:
            rank = heapq.heappop(waiting)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            right = after[at]
            if len(at) > 1:
                if (at[1:] <= at[:-1]).any():
                    at = np.unique(at)
                    right = after[at]
                if (right[:-1] == at[1:]).any():  # pairs that share a token: from left to right, every other one
                    keep, taken = [], -1
                    for k, (x, y) in enumerate(zip(at.tolist(), right.tolist(), strict=True)):
                        if x != taken:
                            keep.append(k)
                            taken = y
                    at, right = at[keep], right[keep]
            far = after[right]
            token[at], token[right], rank_at[right] = rank, GONE, NONE
            after[at], before[far] = far, at
            prev = before[at]
            places, same = np.concatenate((prev, at)), np.full(len(at), rank, np.int64)
            new = self.pair_ranks(np.concatenate((token[prev], same)), np.concatenate((same, token[far])))
            rank_at[places] = new
            found = new != NONE
            if found.any():
                places, new = places[found], new[found]
                if (new < rank).any():
                    again.append(places[new < rank])
                enter(places, new)
        left = np.flatnonzero(token >= 0)
        ends = np.searchsorted(left, first + sizes)
        ids = token[left].tolist()
        out = [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if words else []
        if again:
            for w in np.unique(np.searchsorted(first, np.concatenate(again), "right") - 1).tolist():
                out[w] = self.merge_one(words[w])
        return out

    def merge_one(self, word: bytes) -> list[int]:
        """Token ids of one word: the leftmost pair of the lowest rank first, again and again."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        while len(ids) > 1:
            ranks = [self.made.get(a << self.bits | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
            rank = min(ranks)
            if rank == NONE:
                break
            at = ranks.index(rank)
            ids[at : at + 2] = [rank]
        return ids

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-tokens; one that is itself a token is that token."""
        out, rest, raw = {}, [], []
        for word in words:
            data = word.encode()
            rank = self.ranks.get(data)
            if rank is None:
                rest.append(word)
                raw.append(data)
            else:
                out[word] = [rank]
        out.update(zip(rest, self.replay(raw), strict=True))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class Digests:
    """Texts of a block to (n_tokens, sha256 of the ids, sha256 of the decoded bytes) and, if asked, the ids."""

    def __init__(self, path: str, pattern: str, ids: bool = False):
        self.codec, self.ids = Codec(load_ranks(path), pattern), ids
        self.seen: dict[str, tuple[int, str, bytes]] = {}

    def __call__(self, texts: list[str]) -> list[pa.Array]:
        once: dict[str, str] = {}  # a pre-token that repeats is one string
        split = [[once.setdefault(word, word) for word in self.codec.pattern.findall(text)] for text in texts]
        new = [word for word in once if word not in self.seen]
        if len(self.seen) + len(new) > REMEMBER:
            self.seen.clear()
            new = [*once]
        for word, ids in self.codec.encode_words(new).items():
            self.seen[word] = len(ids), " ".join(map(str, ids)), self.codec.decode(ids)
        n, by_ids, by_bytes, all_ids = [], [], [], []
        for words in split:
            found = [self.seen[w] for w in words]
            joined = " ".join([x[1] for x in found])
            n.append(sum([x[0] for x in found]))
            by_ids.append(sha256(joined.encode()).hexdigest())
            by_bytes.append(sha256(b"".join([x[2] for x in found])).hexdigest())
            if self.ids:
                all_ids.append([int(x) for x in joined.split()])
        out = [pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())]
        return [*out, pa.array(all_ids, pa.list_(pa.int32()))] if self.ids else out


FIELDS = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its id, n_tokens, ids_sha256, decoded_sha256 and, with
    ``ids=True``, the token ids as ``ids ARRAY<INT>``.

    Null and empty texts have no tokens and the digests of the empty text; repeated rows and null ids
    stay as they are; an empty table gives an empty table; other columns are ignored, whatever their names.
    A text is held whole by one task, so memory follows the longest text. ``path`` names the rank
    file, which must be readable on every executor.
    """
    fields = [*FIELDS, ("ids", "array<int>")] if ids else FIELDS
    return per_text(docs, text_column, fields, lambda: Digests(path, pattern, ids), [id_column], BLOCK)


def decode(encoded: DataFrame, path: str, ids_column: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text``: the bytes of the ids as UTF-8, invalid sequences replaced. Null ids give null text."""
    from collections.abc import Iterator

    names = [*keep, ids_column]
    schema = ", ".join([*(f"`{c}` {dict(encoded.dtypes)[c]}" for c in keep), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in load_ranks(path).items()}
        for batch in batches:
            texts = [None if x is None else b"".join([tokens[i] for i in x]).decode("utf-8", "replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*names).mapInArrow(run, schema)
