"""XXH64 shingle hashes and bit votes, the part of the fingerprints that runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at space and at \\x09-\\x0D (null: no words)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, repeats included.

    Fewer words make one shingle of the whole sequence; no words make none."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0] + [e + 1 for e in ends]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:])], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set; index 0 is the highest bit. Blocks bound the memory."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        block = hashes[i:i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return total


def pack_bits(bits: np.ndarray) -> int:
    """64 booleans (highest first) as the signed 64-bit integer that a Spark long holds."""
    return int(np.packbits(bits).view(">i8")[0])


def majority_fingerprint(text: str | None, size: int) -> int:
    """A bit is set if it is set in over half of the shingle hashes; 0 for a text without words."""
    hashes = shingle_hashes(words_of(text), size)
    return pack_bits(2 * bit_counts(hashes) > len(hashes))
