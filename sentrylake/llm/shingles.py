"""Runs of five words as hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
U = np.uint64
#: Fixed odd multipliers of the mixing steps.
M1, M2, M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs (of all words, if fewer), sorted, and how often each occurs."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(h) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(h))):
        s = mix(s * M3 + h[j : j + n])
    return np.unique(s, return_counts=True)
