"""Near-duplicate components by SetSketch registers.

Every text is the set of its distinct word shingles, and two texts link when
``den * |A & B| >= num * |A | B|``:

1. A shingle gets one exponential value for each register, and a register keeps the least value of
   the set, cut to its place on a logarithmic scale: ``floor(1 - log_b(x / SCALE))``, truncated to
   16 bits. Registers of a union are the greater ones of its parts, and registers of two sets agree
   with a chance of the sets' similarity, or slightly more.
2. ``ROWS`` registers make a band, and equal bands make a candidate pair. At similarity 0.8 a pair
   misses all ``BANDS`` bands with a chance of 3 in a million; at 0.2 one in a hundred meets.
3. Candidates are compared in rounds that grow components, so groups of copies need no pair of
   members (see ``ngram_jaccard.grow``). A bitmap of the shingles bounds the overlap of a pair before
   it is formed. Of the pairs formed, the counts of greater, equal and smaller registers and the two
   set sizes give the likelihood of every similarity; a pair stays unless the wanted similarity is
   less likely than the best one by a factor of ``exp(SLACK)``, about one linked pair in a million.
4. What stays is verified on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, WordHash, mix
from .ngram_jaccard import _BITS, _ENTRY, BITMAP, _key, _named, _sets, bitmap, grow, least_ids

#: Bands and registers of each.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Base of the logarithmic scale, and the value at its lower end; a least value above is cut.
BASE, SCALE = 1.02, 64.0
#: Nats by which the wanted similarity may be less likely than the best one.
SLACK = 12.0
#: Shingles that are sketched at once, and held by a task at most before it writes.
AT_ONCE, HELD = 1 << 15, 1_000_000
_ODD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix(np.arange(REGISTERS + 1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets of 64-bit hashes, one row a set."""
    out = np.empty((len(sets), REGISTERS), np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    at = 0
    while at < len(sets):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), AT_ONCE, "right")) + at)
        flat = np.concatenate(sets[at:upto])
        starts = np.r_[0, np.cumsum(sizes[at : upto - 1])]
        one = np.empty_like(flat)
        for i in range(REGISTERS):
            np.multiply(flat, _ODD[i], out=one)
            np.add(one, _ADD[i], out=one)
            out[at:upto, i] = np.minimum.reduceat(one, starts)
        at = upto
    least = -np.log1p(-(np.maximum(out, 1) / 2.0**64))
    return np.clip(np.floor(1 - np.log(least / SCALE) / np.log(BASE)), 0, 65535).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """A 64-bit token for each band of every set."""
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS))
    for i in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + regs.reshape(len(regs), BANDS, ROWS)[:, :, i])
    return h.view(np.int64)


def log_likelihood(greater: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarities ``j`` (columns) for pairs (rows) with so many registers that
    are greater or smaller in A than in B, the others equal; -inf where the sizes exclude ``j``."""
    u = (n_a / (n_a + n_b))[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = u - (1 - u) * j, (1 - u) - u * j
    p, q = chance(more), chance(less)
    g, s = greater[:, None], smaller[:, None]
    tiny = 1e-12
    ll = g * np.log(np.maximum(p, tiny)) + s * np.log(np.maximum(q, tiny)) + (REGISTERS - g - s) * np.log(np.maximum(1 - p - q, tiny))
    return np.where((more < -1e-12) | (less < -1e-12), -np.inf, ll)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of register rows may have a similarity of ``least`` or more."""
    j = np.unique(np.r_[np.linspace(0, 1, 101), least])
    greater, smaller = (a > b).sum(1), (a < b).sum(1)
    ll = log_likelihood(greater, smaller, n_a.astype(float), n_b.astype(float), j)
    return ll[:, j >= least].max(1) >= ll.max(1) - SLACK


_SKETCH = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("text", pa.string()), ("registers", pa.binary()), ("tokens", pa.list_(pa.int64())), *((b, pa.int64()) for b in _BITS), ("roster", pa.binary())])
_SKETCH_SQL = "key long, n int, text string, registers binary, tokens array<long>, " + ", ".join(f"{b} long" for b in _BITS) + ", roster binary"


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """One row for every class of a task's chunk, and rows with the rosters of its documents."""

    def flush(held: dict[int, tuple[np.ndarray, str]], roster: list[tuple]) -> Iterator[pa.RecordBatch]:
        if roster:
            entries = pa.array([np.array(roster, _ENTRY).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in _SKETCH.types[:-1]), entries], schema=_SKETCH)
        keys, items = list(held), list(held.values())
        for at in range(0, len(items), 2048):
            some = items[at : at + 2048]
            regs = registers([s for s, _ in some])
            bits = np.array([bitmap(s) for s, _ in some])
            columns = [keys[at : at + 2048], [len(s) for s, _ in some], [t for _, t in some], [r.tobytes() for r in regs], list(bands(regs)), *(bits[:, i] for i in range(BITMAP)), [None] * len(some)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SKETCH.types, strict=True)], schema=_SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, roster = WordHash(), {}, 0, []
        for batch in batches:
            for text, (i, s) in zip(batch.column(1), _sets(batch, k, known), strict=True):
                key = _key(s) if len(s) else 0
                roster.append((i or 0, i is not None, len(s), key))
                if len(s) and key not in held:
                    held[key] = s, text.as_py()
                    size += len(s)
                if size >= HELD or len(roster) >= HELD:
                    yield from flush(held, roster)
                    held, size, roster = {}, 0, []
        yield from flush(held, roster)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SKETCH_SQL)


def _lists(classes: DataFrame, k: int) -> DataFrame:
    """``key, n, shared``: the full shingle sets of ``classes(key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = list(_sets(batch.slice(at, 64), k, known))
                sets = [s.view(np.int64) for _, s in part]
                yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in part], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["key", "n", "shared"])

    return classes.mapInArrow(run, "key long, n int, shared array<long>")


def sketch_components(spark: SparkSession, docs: DataFrame, k: int = 4, num: int = 80, den: int = 100, rounds: int = 8) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links reach, the document itself included; kept says
    that it is the document's own. A null or empty text, or one without words, has no shingles,
    stays alone and is kept; fewer than ``k`` words make one shingle. Exact copies, repeated rows
    among them, share a class; a row without doc_id takes the component's id and is kept only where
    the whole component has none. Extra columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "setsketch")
    sketches = scratch.table(_sketched(docs, k), "sketches", compression="zstd")
    named = scratch.table(_named(sketches), "named")
    classes = sketches.filter("key IS NOT NULL")
    tokens = classes.select("key", F.explode("tokens").alias("token"))
    met = tokens.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select("token")
    prefix = tokens.join(met, "token", "left_semi").distinct().select("key", F.lit(1).alias("level"), "token", F.lit(0).alias("pos"))
    prefix = scratch.table(prefix, "prefix")
    met = scratch.table(prefix.select("key").distinct(), "keys")
    few = F.broadcast(met) if met.count() <= BROADCAST_ROWS else met
    found = classes.join(few, "key", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "text", "registers", *_BITS)])
    found = scratch.table(found, "classes")
    scratch.drop(sketches, met)
    lists = scratch.table(_lists(found.select("key", "text"), k), "lists")
    sides = scratch.table(found.select("key", "n", "registers"), "registers")
    labels = scratch.table(found.select("key", F.col("key").alias("comp"), "n", F.col("n").alias("common"), *_BITS), "labels")
    scratch.drop(found)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            stay = likely(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), num / den)
            yield batch.select(["a", "b"]).filter(pa.array(stay))

    def thinned(pairs: DataFrame) -> DataFrame:
        side = lambda x: sides.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(filtered, "a long, b long")

    labels = grow(scratch, prefix, labels, lists, num, den, rounds, thinned)
    out = least_ids(scratch, named, labels)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
