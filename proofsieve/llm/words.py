"""Words and their 64-bit hashes, for many texts at a time, as NumPy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from proofsieve.llm.shared import SPACES

#: Bytes of words ``[^\x20\x09-\x0D]+``, of runs of letters (ASCII letters and all bytes of other characters), and of runs of letters and digits.
WORD = np.array([b not in SPACES for b in range(256)])
LETTER = np.array([b >= 128 or bytes([b]).isalpha() for b in range(256)])
LETTER_OR_DIGIT = np.array([b >= 128 or bytes([b]).isalnum() for b in range(256)])
#: Bytes with A-Z in lower case.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Of 64-bit words the lowest 0 to 8 bytes.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of the longest word that is hashed together with the others.
LONG = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))


class Hasher:
    """64-bit hashes of words: eight bytes at a time are mixed into a state that begins with the length. Words of more than ``LONG`` bytes
    take XXH64. No step is linear in the bytes, so words built to collide under a polynomial don't."""

    def __init__(self, seed: int = 1, inside: np.ndarray = WORD, lower: bool = False):
        self.seed, self.inside, self.lower = seed, inside, lower

    def spans(self, at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words; ``at`` are the offsets of the texts in ``raw``, no word spans two."""
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = self.inside[raw]
        cut = at[(at > 0) & (at < len(raw))]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def __call__(self, at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, index of the first word of each text and, last, the number of words)."""
        starts, ends = self.spans(at, raw)
        data = np.concatenate((LOWER[raw] if self.lower else raw, np.zeros(8, np.uint8)))
        lanes = np.ndarray((len(raw) + 1,), "<u8", data, strides=(1,))
        sizes = ends - starts
        out = mix((sizes.astype(np.uint64) + np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xA0761D6478BD642F))
        rest, done = np.arange(len(starts)), 0
        while len(rest):
            left = sizes[rest] - done
            lane = lanes[starts[rest] + done] & MASKS[np.minimum(left, 8)]
            out[rest] = mix(out[rest] * np.uint64(0xD6E8FEB86659FD93) ^ lane * np.uint64(0xE7037ED1A0B428DB))
            rest, done = rest[(left > 8) & (sizes[rest] <= LONG)], done + 8
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), self.seed)
        return out, np.searchsorted(starts, at)


def runs(at: np.ndarray, raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of runs of ``inside`` bytes in each text, all the runs as strings), A-Z in lower case. ``inside`` holds all bytes of other characters or none."""
    starts, ends = Hasher(inside=inside).spans(at, raw)
    data = np.ascontiguousarray(LOWER[raw[inside[raw]]])
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return np.diff(np.searchsorted(starts, at)), words


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... ``sizes[0]`` numbers, then those of the next start, and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
