"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped by the scoring workers.

Training: tasks count words and then packed word-pair counts of whole texts; Spark deals the packed
counts by previous word, and each bucket is merged into sorted arrays and written to the shared
folder. Scoring: workers map the arrays and look up the distinct pairs of a batch by binary search.
No array passes through the driver, which only sees totals and the four counts of counts.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, words_of
from .store import local_file, write_file

#: The end of a text, a word that no text can hold; the start is no word and has the id below.
END = b""
CHUNK, HELD = 1_500_000, 6_000_000


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, held_out``; a null doc_id is not held out."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), out.alias("held_out"))


def _word_counts(train: DataFrame) -> DataFrame:
    """``h, n``: occurrences of every word hash in the training texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            h = pa.array(_hash(list(seen)).view(np.int64))
            return pa.RecordBatch.from_arrays([h, pa.array(seen.values(), pa.int64())], ["h", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.large_binary()):
                seen.update(words_of(t.as_py()))
                seen[END] += 1
                if len(seen) > 500_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    return train.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _packed(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unpacked(b: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


class Vocabulary:
    """Sorted word hashes and counts, mapped; a word's id is its place among all sorted hashes."""

    def __init__(self, uri: str, sizes: list[int]):
        self.parts = [np.memmap(local_file(f"{uri}/words-{b:05d}"), "<u8", "r", shape=(2, n)) if n else np.zeros((2, 0), "<u8") for b, n in enumerate(sizes)]
        self.before = np.cumsum([0, *sizes])
        self.width = (1 << 64) // len(sizes)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1 for unknown words) and training counts of word hashes."""
        order = np.argsort(h)
        s = h[order]
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        cuts = np.searchsorted(s, np.array([b * self.width for b in range(1, len(self.parts))], np.uint64))
        for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(s)], strict=True)):
            part = self.parts[b]
            if hi > lo and part.shape[1]:
                at = np.minimum(np.searchsorted(part[0], s[lo:hi]), part.shape[1] - 1)
                hit = part[0][at] == s[lo:hi]
                ids[order[lo:hi]] = np.where(hit, at + self.before[b], -1)
                counts[order[lo:hi]] = np.where(hit, part[1][at], 0)
        return ids, counts


def _write_vocabulary(words: DataFrame, uri: str, bits: int) -> list[int]:
    """Write the sorted arrays by the top ``bits`` of the hash and return the size of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().astype(np.uint64)) for b in batches]
        if not parts:
            return
        h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h, n = h[order], n[order]
        top = (h >> np.uint64(64 - bits)).astype(np.int64)
        for b in np.unique(top):
            lo, hi = np.searchsorted(top, b), np.searchsorted(top, b, "right")
            write_file(f"{uri}/words-{b:05d}", [h[lo:hi].tobytes(), n[lo:hi].tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([int(hi - lo)], pa.int64())], ["bucket", "n"])

    done = words.select("h", "n", F.shiftrightunsigned("h", 64 - bits).alias("top")).repartition(1 << bits, "top").select("h", "n").mapInArrow(run, "bucket int, n long").collect()
    sizes = [0] * (1 << bits)
    for r in done:
        sizes[r["bucket"]] = r["n"]
    return sizes


@functools.lru_cache(maxsize=2)
def _vocabulary(uri: str, sizes: tuple[int, ...]) -> Vocabulary:
    return Vocabulary(uri, list(sizes))


def _pairs(texts: list[bytes | None], vocabulary: Vocabulary, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Previous and own word id of every token, tokens' training counts, and the ends of the texts."""
    rows = [[*words_of(t), END] for t in texts]
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for r in rows for w in r), np.int64, sum(map(len, rows)))
    ids, counts = vocabulary.find(_hash(list(known)))
    ends = np.cumsum([len(r) for r in rows])
    own = ids[flat]
    before = np.r_[start, own[:-1]]
    before[ends[:-1]] = start
    return before, own, counts[flat], ends


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows in runs of a few megabytes of text; a longer text is a run of its own."""
    for batch in batches:
        texts = [x.as_py() for x in batch.column(column).cast(pa.large_binary())]
        at = held = 0
        for i, t in enumerate(texts):
            held += len(t or b"")
            if held > 6_000_000 or i + 1 == len(texts):
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, held = i + 1, 0


_PAIRS = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())])


def _deal(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed arrays by bucket; keys are sorted and distinct within each."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(b, _packed(keys[i].astype("<u8")), _packed(counts[i].astype("<u4"))) for b in range(buckets) if len(i := order[cuts[b] : cuts[b + 1]])]
    for at in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64], strict=True), _PAIRS.types, strict=True)], schema=_PAIRS)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[starts], np.add.reduceat(n.astype(np.uint64), starts)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Summed counts of each bucket of a partition that is sorted by bucket."""
    now, parts, held = None, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if parts:
                    yield now, *_merged(parts)
                now, parts, held = row["bucket"], [], 0
            parts.append((_unpacked(row["pairs"], "<u8"), _unpacked(row["counts"], "<u4")))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [_merged(parts)]
                held = len(parts[0][0]) // 2
    if parts:
        yield now, *_merged(parts)


class KneserNey:
    """The mapped model: ``uri`` and the totals that training found."""

    def __init__(self, uri: str, sizes: list[int], buckets: int, totals: dict):
        self.uri, self.sizes, self.buckets, self.totals = uri, tuple(sizes), buckets, totals

    @functools.cached_property
    def arrays(self) -> list[tuple[np.ndarray, ...]]:
        out = []
        for b in range(self.buckets):
            n = self.totals["pairs"].get(b, 0)
            width = -(-(sum(self.sizes) + 1 - b) // self.buckets) if b <= sum(self.sizes) else 0
            raw = local_file(f"{self.uri}/pairs-{b:05d}") if n else None
            keys = np.memmap(raw, "<u8", "r", shape=(n,)) if n else np.zeros(0, "<u8")
            counts = np.memmap(raw, "<u4", "r", offset=8 * n, shape=(n,)) if n else np.zeros(0, "<u4")
            ctx = np.memmap(local_file(f"{self.uri}/contexts-{b:05d}"), "<u4", "r", shape=(width, 4)) if n else np.zeros((width, 4), "<u4")
            cont = np.memmap(local_file(f"{self.uri}/left-{b:05d}"), "<u4", "r", shape=(width,)) if self.totals["left"].get(b) else np.zeros(width, "<u4")
            out.append((keys, counts, ctx, cont))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "arrays"}

    def log10(self, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 P(own | before) of distinct pairs of ids; own -1 is an unknown word, before -1 an unknown context."""
        t, B = self.totals, self.buckets
        c, ctx, cont = np.zeros(len(own)), np.zeros((len(own), 4)), np.zeros(len(own))
        home = np.where(before >= 0, before % B, -1)
        for b in np.unique(home[home >= 0]):
            i = np.flatnonzero(home == b)
            keys, counts, table, _ = self.arrays[b]
            ctx[i] = table[before[i] // B]
            j = i[own[i] >= 0]
            if len(keys) and len(j):
                want = (before[j].astype(np.uint64) << np.uint64(32)) | own[j].astype(np.uint64)
                order = np.argsort(want)
                at = np.minimum(np.searchsorted(keys, want[order]), len(keys) - 1)
                c[j[order]] = np.where(keys[at] == want[order], counts[at], 0)
        home = np.where(own >= 0, own % B, -1)
        for b in np.unique(home[home >= 0]):
            i = np.flatnonzero(home == b)
            cont[i] = self.arrays[b][3][own[i] // B]
        d, e = np.array([0.0, *t["discounts"]]), np.array([0.0, *t["left_discounts"]])
        low = np.maximum(cont - e[np.minimum(cont, 3).astype(int)], 0) / t["types"] + t["left_gamma"] / (t["words"] + 1)
        total = ctx[:, 0]
        seen = total > 0
        safe = np.where(seen, total, 1)
        gamma = np.where(seen, ctx[:, 1:] @ d[1:] / safe, 1.0)
        high = np.where(seen, np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / safe, 0.0)
        return np.log10(high + gamma * low)


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; fixed ones where counts are missing."""
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]


def train(spark: SparkSession, texts: DataFrame, scratch: Scratch, buckets: int | None = None) -> KneserNey:
    """Count words and word pairs of all ``texts(text)`` and write the model's arrays."""
    uri = scratch.path("model")
    parts = max(12, texts.rdd.getNumPartitions())
    buckets = buckets or parts
    words = scratch.table(_word_counts(texts), "words")
    total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = _write_vocabulary(words, uri, max(4, (parts - 1).bit_length()))
    start, width = total[0], [(-(-(total[0] + 1 - b) // buckets) if b <= total[0] else 0) for b in range(buckets)]
    key = tuple(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(uri, key)
        held: list[np.ndarray] = []
        for _, some in _batches(batches, 0):
            before, own, _, _ = _pairs(some, vocabulary, start)
            held.append((before.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64))
            if sum(map(len, held)) > CHUNK:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, n = np.unique(np.concatenate(held), return_counts=True)
        yield from _deal(k, n, ((k >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, k, n in _by_bucket(batches):
            write_file(f"{uri}/pairs-{b:05d}", [k.astype("<u8").tobytes(), n.astype("<u4").tobytes()])
            at = (k >> np.uint64(32)).astype(np.int64) // buckets
            table = np.zeros((width[b], 4), "<u4")
            table[:, 0] = np.bincount(at, n, width[b])
            for i, want in enumerate((n == 1, n == 2, n >= 3), 1):
                table[:, i] = np.bincount(at[want], minlength=width[b])
            write_file(f"{uri}/contexts-{b:05d}", [table.tobytes()])
            own, times = np.unique(k & np.uint64(0xFFFFFFFF), return_counts=True)
            stats = np.array([len(k), *(int((n == i).sum()) for i in (1, 2, 3, 4))], "<u8")
            yield pa.RecordBatch.from_arrays([pa.array([-1 - b], pa.int32()), pa.array([stats.tobytes()], pa.binary()), pa.array([b""], pa.binary())], schema=_PAIRS)
            yield from _deal(own, times, (own % np.uint64(buckets)).astype(np.int64), buckets)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, k, n in _by_bucket(batches):
            dense = np.zeros(width[b], "<u4")
            dense[k.astype(np.int64) // buckets] = n
            write_file(f"{uri}/left-{b:05d}", [dense.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (n.sum(), *((n == i).sum() for i in (1, 2, 3, 4)), (n >= 3).sum()))], ["bucket", "total", "n1", "n2", "n3", "n4", "many"])

    schema = "bucket int, pairs binary, counts binary"
    counted = texts.select("text").mapInArrow(count, schema)
    merged = scratch.table(counted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, schema), "merged")
    pairs = {-1 - r["bucket"]: np.frombuffer(r["pairs"], "<u8").tolist() for r in merged.filter("bucket < 0").select("bucket", "pairs").collect()}
    own = merged.filter("bucket >= 0").repartition(parts, "bucket").sortWithinPartitions("bucket")
    lefts = {r["bucket"]: r for r in own.mapInArrow(left, "bucket int, total long, n1 long, n2 long, n3 long, n4 long, many long").collect()}
    scratch.drop(merged)
    n = np.sum([p[1:] for p in pairs.values()], axis=0).tolist() if pairs else [0] * 4
    m = {c: sum(r[c] for r in lefts.values()) for c in ("total", "n1", "n2", "n3", "n4", "many")}
    e = discounts(m["n1"], m["n2"], m["n3"], m["n4"])
    types = max(m["total"], 1)
    gamma = (e[0] * m["n1"] + e[1] * m["n2"] + e[2] * m["many"]) / types if m["total"] else 1.0
    return KneserNey(uri, sizes, buckets, {"tokens": int(total[1]), "words": int(total[0]), "types": types, "pairs": {b: p[0] for b, p in pairs.items()}, "left": {b: True for b in lefts}, "discounts": discounts(*n), "left_discounts": e, "left_gamma": gamma})


@functools.lru_cache(maxsize=1)
def _opened(uri: str, sizes: tuple, buckets: int, totals: bytes) -> KneserNey:
    import pickle

    return KneserNey(uri, list(sizes), buckets, pickle.loads(totals))


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """Token numbers and log10 probabilities of all ``docs(doc_id, text, held_out)`` under the model."""
    import pickle

    uri, sizes, buckets, totals = model.uri, model.sizes, model.buckets, pickle.dumps(model.totals)
    tokens, words = model.totals["tokens"], model.totals["words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kn = _vocabulary(uri, sizes), _opened(uri, sizes, buckets, totals)
        for batch, texts in _batches(batches, 1):
            before, own, counts, ends = _pairs(texts, vocabulary, words)
            k, back = np.unique(((before + 1) << 32) | (own + 1), return_inverse=True)
            p = kn.log10((k >> 32) - 1, (k & 0xFFFFFFFF) - 1)[back]
            base = np.log10((counts + 0.5) / (tokens + 0.5 * (words + 1)))
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            add = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ends - starts, pa.int64()), pa.array(add((counts > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(ends), tokens), pa.int64()), pa.array(add(base)), pa.array(add(p))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Score every text of ``docs(doc_id, text)`` by a model of those whose id hash is not held out.

    A null text is empty and holds its end alone. Repeated rows count and appear as often as they
    occur; extra columns are ignored. Without training texts every token has the uniform
    probability of the unknown word. ``perplexity`` is that of the text under the model.
    """
    scratch = Scratch(spark, "kneser-ney")
    texts = _texts(docs)
    model = train(spark, texts.filter("not held_out").select("text"), scratch)
    scored = score(texts.select("doc_id", "text", "held_out"), model)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
