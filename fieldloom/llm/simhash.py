"""Fingerprints of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's shingles, in order, repeats included. A-Z is lower-cased; shingles are width words joined by single spaces;
    fewer words are one shingle; no words give none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1]
    stops, n, digest = ends[width - 1 :] - 1, len(starts), xxhash.xxh64_intdigest
    out = np.empty(n, np.uint64)
    for k in range(0, n, CHUNK):
        at = slice(k, k + CHUNK)
        out[at] = [digest(joined[a:b], seed) for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
    return out


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash: a bit is set if more than half of the hashes have it; zero for none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i, c in enumerate((2 * ones > n).tolist()) if c)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of a text's shingles; no words give zero."""
    return majority(shingle_hashes(text, width, seed))
