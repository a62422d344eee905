"""Shingle sets and minwise signatures of texts, in numpy, for use inside Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

MINHASHES = 256
#: Two bits of each minimum, packed into 64-bit words.
SKETCH_WORDS = MINHASHES * 2 // 64
_MULTIPLIERS = (np.random.default_rng(20240229).integers(0, 2**31, MINHASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_PRIME, _PRIME2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hash of each word seen, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text.

    A-Z are lower-cased; a shorter text is one shingle, a text without a word has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    mixed = h[:n] + np.uint64(width)
    for j in range(1, width):
        mixed *= _PRIME
        mixed ^= mixed >> np.uint64(29)
        mixed += h[j : j + n]
    mixed *= _PRIME2
    mixed ^= mixed >> np.uint64(32)
    mixed *= _PRIME
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def set_id(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of MINHASHES hash functions over a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINHASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (_MULTIPLIERS * x[None, at : at + 2048]).min(axis=1), out=out)
    return out


def sketch(mins: np.ndarray) -> np.ndarray:
    """Two bits per minimum as SKETCH_WORDS signed 64-bit words: first all low bits, then all high bits."""
    two = (mins * np.uint32(0x9E3779B1)) >> np.uint32(30)
    bits = np.concatenate([two & 1, two >> 1]).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing minima (by two bits each) between all rows of ``a`` and of ``b``."""
    half = SKETCH_WORDS // 2
    a, b = a.view(np.uint64), b.view(np.uint64)  # of a negative number the bits of its absolute value would be counted
    out = np.zeros((len(a), len(b)), np.int32)
    for w in range(half):
        x = a[:, None, w] ^ b[None, :, w]
        x |= a[:, None, half + w] ^ b[None, :, half + w]
        out += np.bitwise_count(x)
    return out
