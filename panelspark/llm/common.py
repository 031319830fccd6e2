"""Helpers shared by the training-data operators: word hashing and shingles."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

__all__ = ["BROADCAST_ROWS", "Scratch", "WORD", "WS", "WordHash", "looked_up", "mix", "shingle_hashes", "word_hashes", "words_of"]

#: Rows of a small table that are broadcast at most; beyond, keys are salted so often.
BROADCAST_ROWS, SALTS = 100_000, 32

#: White space that separates words: space and the control characters 9 to 13.
WS = r"\x20\x09-\x0D"
WORD = f"[^{WS}]+"


class WordHash(dict):
    """64-bit hashes of words, remembered for at most ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of UTF-8 text; null has none."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; fewer words make one run, no word makes none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i]
    return mix(h)


def looked_up(rows: DataFrame, table: DataFrame, count: int, key: str = "g") -> DataFrame:
    """``rows`` with the columns that ``table`` of ``count`` rows holds for their key, or nulls.

    Keys aren't null. A hot key is shared out whether the table is broadcast or too large for it.
    """
    of = table.withColumnRenamed(key, "of")
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(of), F.col(key) == F.col("of"), "left").drop("of")
    of = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("part", (F.rand(1) * SALTS).cast("int"))
    return rows.join(of, (F.col(key) == F.col("of")) & (F.col("part") == F.col("salt")), "left").drop("of", "salt", "part")
