"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every text is the set of its distinct word shingles. Two texts link when
``den * |A & B| >= num * |A | B|``. The join needs no pair within a group of copies:

1. Texts with the same set form one class; only classes are compared.
2. One shuffle of packed shingle hashes finds the shingles of two or more classes and how many
   classes hold each. The others can't be shared, so they only count towards prefix lengths.
3. Each class orders its shingles by that frequency. With ``need = ceil(num/den * n)``, two linked
   sets share at least ``l`` of their first ``n - need + l`` shingles, for every ``l``. A class takes
   the ``l`` of least estimated cost: shingles looked up, plus verifications bounded by hits / l.
   A pair must fit in size and in the places of its common shingles. Linked sets share ``o`` =
   ``num/(num+den) * (n + n')`` shingles, so the smaller ``l`` of the two many lie among the first
   ``n - o + l`` of either; only pairs with so many there are verified. A bitmap in which every shared shingle of a set
   flips one bit bounds ``o`` before a pair is even formed: two bitmaps that differ in ``x`` bits
   belong to sets that differ in ``x`` shingles at least. Pairs in a group of texts that resemble
   each other without linking fail there.
4. Components grow in rounds. While the candidate pairs between different components outnumber the
   prefix rows and rounds still find links, each prefix shingle proposes only (leader, other) pairs,
   with new and twice as many leaders each round; what a round links needs no more comparison, and a
   shingle whose classes all lie in one component is left out from then on. The last
   round takes every candidate pair that still crosses components, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Scratch, WordHash, shingle_hashes, words_of

#: A shingle of so many classes or more is simply "very frequent"; prefixes put it last.
SATURATED = 65_536
#: Shingles packed into one message at most, those of a bucket about, and those that a task that
#: counts holds before it sorts.
CHUNK, BUCKET, HELD = 1_000_000, 4_000_000, 4_000_000
#: Longest additional prefix that is considered, and the cost of a verification in lookups.
LEVELS, VERIFY_COST = 4, 20
#: Leaders of a shingle in a round at most.
LEADERS = 8
#: Share of the classes that a leader round must link to be worth another one.
WORTH = 0.01
#: 64-bit words of the bitmap of a set.
BITMAP = 8


def _sets(batch: pa.RecordBatch, k: int, known: WordHash) -> Iterator[tuple[int | None, np.ndarray]]:
    """Sorted distinct shingle hashes of every text; all texts of some megabytes are hashed at once."""
    ids = batch.column(0).to_pylist()
    for at in range(0, len(ids), 512):
        words = [words_of(t.as_py()) for t in batch.column(1).slice(at, 512).cast(pa.large_binary())]
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, sum(map(len, words)))
        runs = shingle_hashes(flat, k) if len(flat) >= k else flat
        end = 0
        for i, w in zip(ids[at : at + 512], words, strict=True):
            start, end = end, end + len(w)
            s = np.sort(runs[start : end - k + 1] if len(w) >= k else shingle_hashes(flat[start:end], k))
            yield i, s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s


def _key(s: np.ndarray) -> int:
    """Identity of a shingle set as a signed 64-bit integer."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an array ordered by significance, so that sorted values compress well."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


_PACKED = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("roster", pa.binary())])
#: A document's entry in a roster: its id (or none), set size and set identity.
_ENTRY = np.dtype([("doc_id", "<i8"), ("named", "?"), ("n", "<i8"), ("key", "<i8")])


def _pack(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Shingles of all classes as gaps of sorted hashes, one message for each chunk and range of hashes.

    A chunk also sends the roster of its documents along, to a bucket of its own.
    """

    chunk = CHUNK

    def flush(sets: dict[int, np.ndarray], roster: list[tuple]) -> Iterator[pa.RecordBatch]:
        if roster:
            entries = np.array(roster, _ENTRY)
            yield pa.RecordBatch.from_arrays([pa.array([buckets + xxhash.xxh3_64_intdigest(entries.tobytes()) % buckets], pa.int32()), *(pa.array([b""], pa.binary()) for _ in range(4)), pa.array([entries.tobytes()], pa.binary())], schema=_PACKED)
        if not sets:
            return
        keys = np.fromiter(sets, np.int64, len(sets))
        sizes = np.fromiter(map(len, sets.values()), np.int32, len(sets))
        h = np.concatenate(list(sets.values()))
        own = np.repeat(np.arange(len(keys), dtype=np.uint32), sizes)
        order = np.argsort(h)
        h, own = h[order], own[order]
        width = (1 << 64) // buckets + 1
        cuts = np.searchsorted(h, np.array([i * width for i in range(1, buckets)], np.uint64))
        rows = []
        for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(h)], strict=True)):
            if hi > lo:
                here, local = np.unique(own[lo:hi], return_inverse=True)
                gaps = np.r_[h[lo : lo + 1], h[lo + 1 : hi] - h[lo : hi - 1]]
                rows.append((b, *(zstandard.compress(x, 1) for x in (_planes(gaps), _planes(local.astype(np.uint32)))), keys[here].tobytes(), zstandard.compress(_planes(sizes[here]), 1), None))
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64], strict=True), _PACKED.types, strict=True)], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets, held, roster = WordHash(), {}, 0, []
        for batch in batches:
            for i, s in _sets(batch, k, known):
                key = _key(s) if len(s) else 0
                roster.append((i or 0, i is not None, len(s), key))
                if len(s) and key not in sets:
                    sets[key] = s
                    held += len(s)
                if held >= chunk or len(roster) >= chunk:
                    yield from flush(sets, roster)
                    sets, held, roster = {}, 0, []
        yield from flush(sets, roster)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "bucket int, hashes binary, owners binary, keys binary, sizes binary, roster binary")


_SHARED = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("roster", pa.binary())])
_TOKEN = np.dtype([("df", "<u4"), ("h", "<u8")])


class _Counter:
    """Occurrences of one range of hashes; very frequent shingles leave early.

    What has left is forgotten: a class that comes again brings its very frequent shingles again.
    A sort that frees less than half doubles the number of entries until the next one, so entries
    are sorted a logarithmic number of times, whatever they are.
    """

    def __init__(self, saturated: int, most: int) -> None:
        self.saturated, self.most = saturated, most
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.frequent = np.empty(0, np.uint64)

    def add(self, h: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((h, key, n))
        self.held += len(h)
        if self.held > self.most:
            yield from self.out(last=False)
            self.most = max(self.most, 2 * self.held)

    def out(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        h, key, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        again = np.r_[False, same] | np.r_[same, False]
        alone, order = order[~again], order[again]
        rest = (h[alone], key[alone], n[alone])
        if len(self.frequent):
            known = np.isin(rest[0], self.frequent)
            order, rest = np.r_[order, alone[known]], tuple(x[~known] for x in rest)
        h, key, n = h[order], key[order], n[order]
        order = np.lexsort((key, h))
        h, key, n = h[order], key[order], n[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        h, key, n = h[first], key[first], n[first]
        if not len(h):
            self.parts, self.held = ([], 0) if last else ([rest], len(rest[0]))
            return
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        counts = np.diff(np.r_[starts, len(h)])
        df = np.repeat(counts, counts).astype(np.uint32)
        df[np.isin(h, self.frequent)] = self.saturated
        ready = df >= (2 if last else self.saturated)
        df = np.minimum(df, self.saturated)
        self.frequent = np.union1d(self.frequent, h[df >= self.saturated])
        self.parts = [] if last else [rest, (h[~ready], key[~ready], n[~ready])]
        self.held = sum(len(p[0]) for p in self.parts)
        h, key, n, df = h[ready], key[ready], n[ready], df[ready]
        order = np.argsort(key, kind="stable")
        tokens = np.empty(len(h), _TOKEN)
        tokens["df"], tokens["h"] = df[order], h[order]
        key, n = key[order], n[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        ends = np.r_[starts[1:], len(key)] if len(key) else starts
        for at in range(0, len(starts), 4096):
            s, e = starts[at : at + 4096], ends[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(key[s], pa.int64()), pa.array(n[s], pa.int32()), pa.array([tokens[i:j].tobytes() for i, j in zip(s, e, strict=True)], pa.binary()), pa.nulls(len(s), pa.binary())], schema=_SHARED)


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """For every class its shingles that other classes hold too, with their frequency, in pieces.

    Pieces of a class may repeat very frequent shingles.
    """
    saturated, most = SATURATED, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counter = None, _Counter(saturated, most)
        for batch in batches:
            for row in batch.to_pylist():
                if row["roster"] is not None:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([row["roster"]], pa.binary())], schema=_SHARED)
                    continue
                if row["bucket"] != now:
                    yield from counter.out(last=True)
                    now, counter = row["bucket"], _Counter(saturated, most)
                hashes, own, sizes = (_unplanes(zstandard.decompress(row[c]), t) for c, t in (("hashes", np.uint64), ("owners", np.uint32), ("sizes", np.int32)))
                yield from counter.add(np.cumsum(hashes, dtype=np.uint64), np.frombuffer(row["keys"], np.int64)[own], sizes[own])
        yield from counter.out(last=True)

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, n int, tokens binary, roster binary")


def _named(shared: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, key`` of every document, from the rosters; the key is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                e = np.frombuffer(raw, _ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array(e["doc_id"], mask=~e["named"]), pa.array(e["n"]), pa.array(e["key"], mask=e["n"] == 0)], ["doc_id", "n_shingles", "key"])

    return shared.filter("roster IS NOT NULL").select("roster").mapInArrow(run, "doc_id long, n_shingles long, key long")


def choose_level(df: np.ndarray, n: int, need: int) -> int:
    """The number of common prefix shingles to ask for, of least estimated cost.

    ``df`` are the frequencies of the shared shingles in prefix order; the ``n - len(df)`` others
    come first. Looking up costs the list lengths; at most hits / l candidates have l hits.
    """
    alone, total, best = n - len(df), np.cumsum(df), (np.inf, 1)
    for level in range(1, min(LEVELS, need) + 1):
        size = n - need + level - alone
        hits = float(total[min(size, len(df)) - 1]) if size > 0 else 0.0
        best = min(best, (hits + VERIFY_COST * hits / level, level))
    return best[1]


def bitmap(h: np.ndarray) -> np.ndarray:
    """``BITMAP`` words in which every hash flips the bit that its leading bits name."""
    at = (h >> np.uint64(32)) % np.uint64(64 * BITMAP)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * BITMAP) & 1).view(np.int64)


_BITS = [f"bits{i}" for i in range(BITMAP)]
_CLASS = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("level", pa.int32()), ("shared", pa.list_(pa.int64())), ("prefix", pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())]))), ("common", pa.int32()), *((b, pa.int64()) for b in _BITS)])


def _prefixes(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Classes that can have a partner: chosen level, shared shingles, prefix, number and bitmap of those shared.

    ``pos`` is the shingle's place in the order of the whole set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                t = np.frombuffer(b"".join(row["tokens"]), _TOKEN)
                n, need = row["n"], -(-row["n"] * num // den)
                if len(t) < need:
                    continue
                t = t[np.lexsort((t["h"], t["df"]))]
                t = t[np.r_[True, t["h"][1:] != t["h"][:-1]]]
                if len(t) < need:
                    continue
                level = choose_level(t["df"], n, need)
                size = n - need + level - (n - len(t))
                h = t["h"].view(np.int64)
                prefix = [{"token": int(x), "pos": n - len(t) + i} for i, x in enumerate(h[: max(0, size)])]
                rows.append((row["key"], n, level, h, prefix, len(h), *bitmap(t["h"])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _CLASS.types, strict=True)], schema=_CLASS)

    whole = shared.filter("roster IS NULL").groupBy("key").agg(F.first("n").alias("n"), F.collect_list("tokens").alias("tokens"))
    bits = ", ".join(f"{b} long" for b in _BITS)
    return whole.mapInArrow(run, f"key long, n int, level int, shared array<long>, prefix array<struct<token:long,pos:int>>, common int, {bits}")


def _verified(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` of classes that link, by their exact intersection."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(den * both >= num * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def grow(scratch: Scratch, prefix: DataFrame, labels: DataFrame, lists: DataFrame, num: int, den: int, rounds: int, likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``labels`` with the component of every class once all linked candidates of ``prefix`` are merged.

    ``prefix(key, level, token, pos)``, ``labels(key, comp, n, common, bits...)`` and
    ``lists(key, n, shared)`` are tables of ``scratch``; ``likely`` may thin out ``(a, b)`` pairs
    before they are verified.
    """
    rows = prefix.count()

    def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
        x, y = (labels.select(F.col("key").alias(c), F.col("comp").alias(f"comp_{c}")) for c in "ab")
        edges = links.join(x, "a").join(y, "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
        found = connected_components(edges, scratch)
        new = scratch.table(labels.join(found, labels.comp == found.node, "left").select("key", F.coalesce("root", "comp").alias("comp"), "n", "common", *_BITS), "labels")
        scratch.drop(labels, found)
        return new

    sizes = den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")
    overlap = F.floor((num * (F.col("n_a") + F.col("n_b")) + (num + den - 1)) / (num + den))
    places = F.least("pos_a", "pos_b") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= overlap
    apart = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in _BITS), F.lit(0))
    bits = F.col("common_a") + F.col("common_b") - apart >= 2 * overlap
    level = F.least("level_a", "level_b")
    early = F.greatest(F.col("pos_a") - F.col("n_a"), F.col("pos_b") - F.col("n_b")) < level - overlap
    found = total = labels.count()
    of_class, of_place = ["comp", "n", "common", *_BITS], ["key", "level", "pos"]
    renamed = lambda c, names: [F.col(x).alias(f"{x}_{c}") for x in names]
    for turn in range(rounds + 1):
        placed = prefix.join(labels.select("key", "comp"), "key")
        by = placed.groupBy("token", "comp").count().groupBy("token").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("sq"), F.max_by("comp", F.struct("count", "comp")).alias("most"))
        by = scratch.table(by.filter("n * n > sq"), "tokens")
        crossing = by.agg(F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2)).first()[0]
        if not crossing:
            break
        old, prefix = prefix, scratch.table(prefix.join(by.select("token"), "token", "left_semi"), "prefix")
        scratch.drop(old)
        last = crossing <= rows or turn == rounds or found < WORTH * total
        seen = scratch.table(prefix.join(labels, "key"), "seen")
        if last:
            left = seen.join(by.select("token", "most"), "token").filter("comp <> most").select("token", "most", *renamed("a", of_place + of_class))
            pairs = left.join(seen.select("token", *renamed("b", of_place + of_class)), "token").filter("comp_a <> comp_b and (comp_b = most or key_a < key_b)")
        else:
            some = [F.struct(F.xxhash64("key", F.lit(turn), F.lit(i)), *renamed("a", of_place)) for i in range(min(1 << turn, LEADERS))]
            lead = prefix.groupBy("token").agg(*[F.min(x).alias(f"x{i}") for i, x in enumerate(some)])
            lead = lead.select("token", F.explode(F.array_distinct(F.array(*[F.struct(*(f"x{i}.{x}_a" for x in of_place)) for i in range(len(some))]))).alias("x")).select("token", "x.*")
            lead = lead.join(labels.select(F.col("key").alias("key_a"), *renamed("a", of_class)), "key_a")
            pairs = seen.select("token", *renamed("b", of_place + of_class)).join(lead, "token").filter("comp_a <> comp_b")
        pairs = pairs.filter(sizes & places & early & bits).groupBy(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).agg(F.count(F.lit(1)).alias("hits"), F.first(level).alias("ask"))
        pairs = scratch.table(pairs.filter("hits >= ask").select("a", "b"), "pairs")
        if likely is not None:
            old, pairs = pairs, scratch.table(likely(pairs), "likely")
            scratch.drop(old)
        links = scratch.table(_verified(pairs, lists, num, den), "links")
        found = links.count()
        labels = merge(labels, links)
        scratch.drop(seen, by, pairs, links)
        if last:
            break
    return labels


def least_ids(scratch: Scratch, named: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``named(doc_id, n_shingles, key)``."""
    least = named.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    least = least.join(labels.select("key", "comp"), "key", "left").select("key", F.coalesce("comp", "key").alias("comp"), "doc_id")
    of = scratch.table(least, "least")
    of = scratch.table(of.join(of.groupBy(F.col("comp").alias("c")).agg(F.min("doc_id").alias("component_id")), F.col("comp") == F.col("c")).select("key", "component_id"), "ids")
    scratch.keep(named, of)
    return named.join(of, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, rounds: int = 8) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links reach, the document itself included. A null or
    empty text, or one without words, has no shingles and stays alone; fewer than ``k`` words make
    one shingle. Exact copies, repeated rows among them, share a class. Extra columns are ignored.
    ``rounds`` limits the leader rounds only; the last round is complete whatever they leave.
    """
    scratch = Scratch(spark, "ngram-jaccard")
    words = (docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // 6
    buckets = max(64, -(-words // BUCKET))
    shared = scratch.table(_shared(_pack(docs, k, buckets), -(-buckets // 2)), "shared")
    named = scratch.table(_named(shared), "named")
    classes = scratch.table(_prefixes(shared, num, den), "classes")
    scratch.drop(shared)
    lists = classes.select("key", "n", "shared")
    prefix = scratch.table(classes.select("key", "level", F.explode("prefix").alias("p")).select("key", "level", "p.token", "p.pos"), "prefix")
    labels = scratch.table(classes.select("key", F.col("key").alias("comp"), "n", "common", *_BITS), "labels")
    labels = grow(scratch, prefix, labels, lists, num, den, rounds)
    return least_ids(scratch, named, labels)
