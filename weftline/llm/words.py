"""Hashes of word shingles: words of non-white ASCII, A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
SEED = 8


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh3_64_intdigest(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    begins = (ends - sizes)[: len(found) - words + 1].tolist()
    stops = (ends - 1)[words - 1 :].tolist()
    hashed = xxhash.xxh3_64_intdigest
    return np.array([hashed(line[a:b], seed) for a, b in zip(begins, stops, strict=True)], np.uint64)
