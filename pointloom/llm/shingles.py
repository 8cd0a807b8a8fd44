"""Sets of hashed word n-grams, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Hashing a word anew costs little more than looking it up.
CACHED = 1 << 16


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """The sorted distinct 64-bit hashes of a text's word n-grams, A-Z in lower case; of all words as one if they are
    fewer; empty without words. Words stand between ASCII white space. Takes UTF-8 bytes or None."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.hashes = words, _WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        found = (text or b"").lower().split()
        if len(found) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 5)] if found else [], np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        last = len(h) - self.words + 1
        out = h[:last].copy()
        for k in range(1, self.words):
            out *= np.uint64(0x9E3779B185EBCA87)
            out ^= out >> np.uint64(29)
            out += h[k : last + k]
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(32)
        out.sort()  # np.unique hashes first, which costs more than sorting so few
        first = np.ones(len(out), bool)
        np.not_equal(out[1:], out[:-1], out=first[1:])
        return out[first]


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a whole set."""
    data = shingles.tobytes()
    return tuple(x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh3_64_intdigest(data), xxhash.xxh3_64_intdigest(data, 1)))
