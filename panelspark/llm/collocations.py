"""Collocations of words, counted by prefix-free parsing.

Texts are cut where their content says so: a run of words whose hash is divisible by ``EVERY`` ends a
chunk and begins the next one, which overlaps by that run. Copies and shared passages give the same
chunks wherever they begin, so the dictionary of distinct chunks with their frequencies is smaller
than the corpus, and phrases are counted in it, each occurrence times the frequency of its chunk.
A phrase belongs to the chunk in which it begins before the closing run, so that none is counted
twice, and every phrase of at most one word more than the run lies in its chunk as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHash, mix, shingle_hashes
from .ngram_jaccard import _planes, _unplanes

#: Words of a chunk on average.
EVERY = 24
#: Bytes of distinct chunks, and phrases, that a task holds before it writes them.
HELD_BYTES, HELD = 48_000_000, 3_000_000
#: Distinct phrases of a bucket about.
BUCKET = 1_500_000
#: A phrase with one in so many word occurrences or more is one of few, and is broadcast.
HEAVY = 2_000
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n\n ")
_END = b"\n"


def chunks_of(text: bytes, run: int, known: WordHash) -> list[tuple[bytes, int]]:
    """The chunks of a text and the words that each one owns.

    A chunk's words are joined by spaces, with a line feed as a word of its own where a piece ends; a
    chunk that ends with one owns all its words, any other all but its last ``run``.
    """
    seq: list[bytes] = []
    for piece in text.lower().translate(_BREAKS).split(b"\n"):
        words = piece.split()
        if words:
            seq += words
            seq.append(_END)
    if not seq:
        return []
    ends = np.fromiter((w is _END for w in seq), bool, len(seq))
    starts = np.zeros(0, int)
    if len(seq) > run:
        h = np.fromiter(map(known.__getitem__, seq), np.uint64, len(seq))
        whole = np.ones(len(seq) - run + 1, bool)
        for i in range(run):
            whole &= ~ends[i : len(seq) - run + 1 + i]
        starts = np.flatnonzero(whole & (shingle_hashes(h, run) % np.uint64(EVERY) == 0))
    cuts = [0, *starts[starts > 0].tolist()]
    owned = np.r_[0, np.cumsum(~ends)]
    out = [(b" ".join(seq[a : b + run]), int(owned[b] - owned[a])) for a, b in zip(cuts, cuts[1:])]
    return [*out, (b" ".join(seq[cuts[-1] :]), int(owned[-1] - owned[cuts[-1]]))]


_CHUNK = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("owned", pa.int64()), ("freq", pa.int64())])


def _parsed(docs: DataFrame, run: int) -> DataFrame:
    """Distinct chunks of every task, with what they own and how often they came."""

    def flush(held: dict[tuple[str, bytes], list[int]]) -> Iterator[pa.RecordBatch]:
        rows = [(lang, chunk, owned, freq) for (lang, chunk), (owned, freq) in held.items()]
        for at in range(0, len(rows), 8192):
            lang, chunk, owned, freq = zip(*rows[at : at + 8192], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(chunk, pa.binary()).cast(pa.string()), pa.array(owned), pa.array(freq)], schema=_CHUNK)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = WordHash(), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for chunk, owned in chunks_of(text.as_buffer().to_pybytes() if text.is_valid else b"", run, known):
                    seen = held.get((lang, chunk))
                    if seen:
                        seen[1] += 1
                    else:
                        held[lang, chunk] = [owned, 1]
                        size += len(chunk) + 200
                if size > HELD_BYTES:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string")).mapInArrow(parse, "lang string, chunk string, owned long, freq long")


def _flat(chunks: list[bytes], langs: list[str], longest: int, known: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all chunks with their language mixed in, the chunk of every word, and where
    phrases may begin and where pieces end."""
    words = [c.split(b" ") for c in chunks]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    of = np.repeat(np.arange(len(chunks)), sizes)
    salt = mix(np.fromiter((known[lang.encode()] for lang in langs), np.uint64, len(langs)) + np.uint64(1))
    ends = np.fromiter((w == _END for w in flat), bool, len(flat))
    last = np.cumsum(sizes)
    owned = np.ones(len(flat), bool)
    for end in last[~ends[last - 1]]:
        owned[end - longest + 1 : end] = False
    return h ^ salt[of], of, owned & ~ends, ends


_MESSAGE = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
_TYPES = (np.uint64, np.int64, np.int32, np.int64)


def _packed(h: np.ndarray, *rest: np.ndarray) -> bytes:
    """Sorted distinct hashes as gaps, and the values beside them, by significance and compressed."""
    gaps = np.r_[h[:1], h[1:] - h[:-1]]
    return zstandard.compress(len(h).to_bytes(8, "little") + b"".join(_planes(x) for x in (gaps, *rest)), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(raw)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in _TYPES:
        size = n * np.dtype(kind).itemsize
        out.append(_unplanes(raw[at : at + size], kind))
        at += size
    return np.cumsum(out[0], dtype=np.uint64), *out[1:]


def _summed(h: np.ndarray, f: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes in order, their summed counts, and the other values of one occurrence each."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
    return (h[first], np.add.reduceat(f[order], first) if len(h) else f, *(x[order[first]] for x in rest))


def _counted(dictionary: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Counts of all phrases of a task's chunks as messages to ranges of hashes.

    With every phrase goes one of its places: a chunk's number, and the place of the word and the
    number of words in one value.
    """
    most = HELD

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        h, f, place, key = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        width = (1 << 64) // buckets + 1
        cuts = np.searchsorted(h, np.array([i * width for i in range(1, buckets)], np.uint64))
        rows = [(b, _packed(h[lo:hi], f[lo:hi], place[lo:hi], key[lo:hi])) for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(h)], strict=True)) if hi > lo]
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64], strict=True), _MESSAGE.types, strict=True)], schema=_MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, held = WordHash(), [], 0
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                chunks = [c.as_buffer().to_pybytes() for c in part.column("chunk")]
                h, of, begin, ends = _flat(chunks, part.column("lang").to_pylist(), longest, known)
                freq, key = part.column("freq").to_numpy(), part.column("key").to_numpy()
                place = (np.arange(len(h)) - np.searchsorted(of, of)).astype(np.int32)
                ok = begin.copy()
                for n in range(1, longest + 1):
                    if n > 1:
                        ok = ok[:-1] & ~ends[n - 1 :]
                    if not len(ok):
                        break
                    g = shingle_hashes(h, n)[ok]
                    at_chunk = of[: len(ok)][ok]
                    parts.append((g, freq[at_chunk], place[: len(ok)][ok] * longest + (n - 1), key[at_chunk]))
                    held += len(g)
                if held >= most:
                    parts = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                    held = len(parts[0][0])
                    if held >= most // 2:
                        yield from flush(parts)
                        parts, held = [], 0
        yield from flush(parts)

    return dictionary.select("lang", "chunk", "freq", "key").mapInArrow(run, "bucket int, packed binary")


_FREQUENT = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("key", pa.int64())])


def _frequent(messages: DataFrame, parts: int, longest: int, least: int) -> DataFrame:
    """``h, f, n, place, key`` of the phrases that occur ``least`` times or more."""
    most = HELD

    def out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, f, place, key = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        ok = f >= least
        yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), pa.array(f[ok]), pa.array(place[ok] % longest + 1), pa.array(place[ok] // longest), pa.array(key[ok])], schema=_FREQUENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, limit = None, [], 0, most
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    yield from out(held)
                    now, held, size, limit = row["bucket"], [], 0, most
                held.append(_unpacked(row["packed"]))
                size += len(held[-1][0])
                if size > limit:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    limit = max(most, 2 * size)
        yield from out(held)

    return messages.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "h long, f long, n int, place int, key long")


def _spelled(rows: DataFrame, longest: int) -> DataFrame:
    """``h, lang, phrase, f, n`` and the hashes of all shorter phrases inside, each with its first word
    and length, of ``rows(h, f, n, place, lang, chunk)``."""
    inner = pa.list_(pa.struct([("g", pa.int64()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            phrases, parts = [], []
            for n, place, lang, chunk in zip(*(batch.column(c).to_pylist() for c in ("n", "place", "lang", "chunk")), strict=True):
                words = chunk.encode().split(b" ")[place : place + n]
                salt = mix(np.array([known[lang.encode()]], np.uint64) + np.uint64(1))
                h = np.fromiter(map(known.__getitem__, words), np.uint64, n) ^ salt
                phrases.append(b" ".join(words))
                parts.append([{"g": int(g), "first": i, "words": k} for k in range(1, n) for i, g in enumerate(shingle_hashes(h, k).view(np.int64).tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(phrases, pa.binary()).cast(pa.string()), batch.column("f"), batch.column("n"), pa.array(parts, inner)], ["h", "lang", "phrase", "f", "n", "parts"])

    return rows.select("h", "f", "n", "place", "lang", "chunk").mapInArrow(run, "h long, lang string, phrase string, f long, n int, parts array<struct<g:long,first:int,words:int>>")


def score() -> Column:
    """Of columns ``f``, ``l`` and ``r``, with products of up to 38 digits."""
    return F.expr("cast(1000000 * (cast(f AS decimal(16,0)) * cast(f AS decimal(16,0))) AS decimal(38,0)) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))")


def collocations(spark: SparkSession, docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, covered: tuple[int, int] = (50, 100)) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases of 2 to ``longest`` words.

    ``docs(text, lang)``: A-Z is lower-cased, pieces end at ``.,;:!?`` and at line feeds, vertical tabs,
    form feeds and carriage returns, words at spaces and tabs. A null text has no words, a null lang
    is ``und``; extra columns are ignored, repeated rows count again. ``a`` is the phrase's count
    (``least`` or more), ``l`` and ``r`` are those of its parts at the cut of least score, ``n`` are the
    language's words; the score is ``floor(1000000 * a * a / (l * r))``, the first cut of equals
    counts. A phrase inside a longer candidate with ``num/den`` of its count goes (``covered``). Ties
    are ordered by count, then by the bytes of the phrase. An empty table gives no rows.

    Phrases are told apart by 64-bit hashes; among ``m`` distinct ones a pair collides with a chance
    of ``m * m / 2 ** 65``.
    """
    scratch = Scratch(spark, "collocations")
    run = longest - 1
    dictionary = _parsed(docs, run).groupBy("lang", "chunk").agg(F.first("owned").alias("owned"), F.sum("freq").alias("freq"))
    dictionary = scratch.table(dictionary.withColumn("key", F.monotonically_increasing_id()), "dictionary", compression="zstd")
    words = scratch.table(dictionary.groupBy("lang").agg(F.sum(F.col("owned") * F.col("freq")).alias("n"), F.sum("owned").alias("distinct")), "words")
    every, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    parts = max(32, -(-int(distinct) * longest // (2 * BUCKET)))
    counts = scratch.table(_frequent(_counted(dictionary, longest, 2 * parts), parts, longest, least), "counts")
    at = counts.filter("n > 1").withColumnRenamed("key", "of")
    found = at.join(dictionary.select("key", "lang", "chunk"), F.col("of") == F.col("key"))
    phrases = scratch.table(_spelled(found, longest), "phrases")
    scratch.drop(dictionary)

    heavy = F.col("f") * HEAVY >= F.lit(int(every))
    side = counts.select(F.col("h").alias("g"), F.col("f").alias("of"))
    inside = phrases.select("h", "f", "n", F.explode("parts").alias("p")).select("h", "f", "n", "p.*")
    near = inside.join(F.broadcast(side.filter(F.col("of") * HEAVY >= F.lit(int(every)))), "g", "left")
    cold = near.filter("of IS NULL").drop("of").join(counts.filter(~heavy).select(F.col("h").alias("g"), F.col("f").alias("of")), "g")
    inside = scratch.table(near.filter("of IS NOT NULL").unionByName(cold), "inside")
    num, den = covered
    gone = inside.filter((F.col("words") > 1) & (F.col("f") * den >= F.col("of") * num)).select(F.col("g").alias("h")).distinct()
    edge = inside.filter("first = 0 OR first + words = n")
    cut = F.when(F.col("first") == 0, F.col("words")).otherwise(F.col("first")).alias("cut")
    cuts = edge.groupBy("h", "f", cut).agg(F.max(F.when(F.col("first") == 0, F.col("of"))).alias("l"), F.max(F.when(F.col("first") > 0, F.col("of"))).alias("r"))
    best = cuts.withColumn("score", score()).groupBy("h").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    ranked = phrases.select("h", "lang", "phrase", F.col("f").alias("a")).join(gone, "h", "left_anti").join(best, "h").select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    out = ranked.join(words.select(F.col("lang").alias("of"), "n"), F.col("lang") == F.col("of"))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
