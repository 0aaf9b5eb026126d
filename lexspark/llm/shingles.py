"""Word and shingle hashes of texts as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

from lexspark.llm.shared import WORKER_CACHES, forget_others


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, kept while they fit."""

    def __init__(self, limit: int = 250_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, number of words of each text)"""
        if len(self.known) > self.limit:
            self.known.clear()
        new: set[bytes] = set()
        for words in texts:
            new.update(words)
        digest = xxhash.xxh3_64_intdigest
        self.known.update((w, digest(w)) for w in new if w not in self.known)
        get = self.known.__getitem__
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.fromiter((h for words in texts for h in map(get, words)), np.uint64, int(sizes.sum())), sizes


_WORDS = WordHashes()
WORKER_CACHES.append(_WORDS.known)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased (A-Z) texts; words are runs other than space and U+0009..U+000D."""
    forget_others(_WORDS.known)
    return _WORDS.of([(t or "").encode().lower().split() for t in texts])


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; with fewer words the whole sequence is one shingle."""
    hashes, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    n = max(0, len(hashes) - k + 1)
    folded = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            folded = mix(folded * np.uint64(31) + hashes[j : j + n])
        out = []
        for end, size in zip(ends, sizes):
            if size >= k:
                out.append(np.unique(folded[end - size : end - k + 1]))
            elif size:
                x = np.array([size], np.uint64)
                for h in hashes[end - size : end]:
                    x = mix(x * np.uint64(31) + h)
                out.append(x)
            else:
                out.append(np.empty(0, np.uint64))
    return out
