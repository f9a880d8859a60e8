"""Words and text hashing shared by the operators of this package."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a longest run of letters or digits of any script; callers lower the text first.
WORD = re.compile(r"[^\W_]+")
_SEEN_LIMIT = 500_000


class WordCodes:
    """Stable 64-bit codes of words, remembered per Python worker up to a fixed number of entries."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        try:
            return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(seen) > _SEEN_LIMIT:
                seen.clear()
            for w in set(words):
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (xor-shift multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_codes(codes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``width`` words that stay inside one text.

    ``starts`` are the texts' offsets into ``codes`` with a final end.  Returns the codes and the text's number of each.
    """
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if len(codes) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(codes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    inside = owner[:n] == owner[width - 1 :]
    return out[inside], owner[:n][inside]
