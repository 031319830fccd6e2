"""Token counts by byte-pair merging with a heap over a linked list of symbols.

Counts equal those of the vocabulary file's own library: special strings count one, then the file's
normalizer (NFC, white space, lower case), splitting pattern and byte alphabet apply, and every
piece starts as one symbol a byte, the last one marked as a word end. The lowest-rank adjacent pair
merges until none is left; the count is the number of symbols less that of merges. No identifiers
are made. Pieces never cross white space, so counts are remembered by white-space-separated word.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that remain when the lowest-rank adjacent pair, leftmost first, merges until none can."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    alive, merges = [True] * n, 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        alive[j] = False
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return n - merges


class WordBpe(dict):
    """Token counts of white-space-free byte strings, remembered for at most ``limit`` of them."""

    def __init__(self, path: str, limit: int = 1_000_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.limit, self.end = limit, model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): r for r, m in reversed(list(enumerate(model["merges"])))}
        self.known = set(model["vocab"])
        self.alphabet = byte_symbols()
        self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.mark = {s[:2].encode() for s in special}

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        n = 0
        if any(m in word for m in self.mark):
            n = len(self.special.findall(text))
            parts = self.special.split(text) if n else [text]
        else:
            parts = [text]
        for part in parts:
            lower = unicodedata.normalize("NFC", part)
            lower = lower.lower() if "Σ" not in lower else "".join(c.lower() for c in lower)
            for piece in self.piece.findall(lower):
                symbols = [self.alphabet[b] for b in piece.encode()]
                symbols[-1] += self.end
                n += count_merged([s for s in symbols if s in self.known], self.ranks)
        if len(self) < self.limit:
            self[word] = n
        return n

    def count(self, text: bytes) -> int:
        return sum(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=1)
def _loaded(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    A null text counts as empty: no bytes, no tokens. Repeated rows repeat in the result; extra
    columns are ignored. ``path`` names the vocabulary file, which every worker can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(bpe.count, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
