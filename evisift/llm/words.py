"""Words as every operator of this package sees them: maximal runs without ASCII white space."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def split_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; ``bytes.split`` parts at exactly the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes of a text with A-Z lower-cased and everything else as it was."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def word_count(text: Column) -> Column:
    """Number of words as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(values: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of unsigned 64-bit integers (the finaliser of splitmix64)."""
    z = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


class WordHashes(dict):
    """64-bit digests of words, remembered for as many words as fit ``limit`` entries."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Digests of all windows of ``size`` words in order; a shorter text is one window, an empty one none."""
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    n = len(hashes) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            # mixed between additions, so the order of the words counts
            total = mix64(total + hashes[k:n + k])
    return total
