"""Benchmark decontamination by exact gates over windows of the size of each item.

1. Gate, exact: ``J >= num/den`` between a window and an item of ``n`` shingles each needs
   ``2 n num / (num + den)`` common ones. Only runs of text that hold so many shingles of one item
   become windows; moving such a window to its first common shingle loses none of them.
2. Every window is compared with the items whose gates it has passed, by the weighted Jaccard
   similarity of their shingles, weights being the numbers of occurrences. No pair at the threshold
   is lost, as some would be by fingerprints of words within a fixed number of bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import Scratch
from .quality import words_of
from .url_filters import ascii_lower

#: Benchmark shingles that are broadcast at most; larger benchmarks are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def runs_of(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` words of an array; empty for fewer words."""
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)], F.lit(k))
    return F.when(F.size(words) < k, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - k), at))


def of_size(k: int) -> Callable[[Column], Column]:
    return lambda words: runs_of(words, k)


def numbered(runs: Column) -> Column:
    """A multiset as a set: the hash of every element together with its occurrence number."""
    return let(F.array_sort(runs), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i.cast("long") - F.array_position(s, x))))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, num: int = 75, den: int = 100, k: int = 5) -> DataFrame:
    """``doc_id, text_hash, item_id, start_word, n_words, similarity``: best window of each pair found.

    ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` are compared as lower-cased (A-Z) words.
    Items of fewer than ``k`` words are one shingle and need an exact run; items without words and
    null texts match nothing; a text shorter than the item is one window. Rows that repeat doc_id
    and text give one result; equal items each give theirs. Extra columns are ignored.
    """
    scratch = Scratch(spark, "decontamination")
    words = words_of(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words.alias("words")).filter(F.size("words") > 0)
    items = items.withColumns({"size": F.size("words"), "k": F.least(F.size("words"), F.lit(k))})
    sizes = [r["k"] for r in items.select("k").distinct().collect()]
    runs = F.coalesce(*[F.when(F.col("k") == s, runs_of(F.col("words"), s)) for s in range(1, k + 1)])
    items = scratch.table(items.withColumn("runs", runs).withColumns({"n": F.size("runs"), "need": F.ceil(2 * num * F.size("runs") / F.lit(num + den)).cast("int")}), "items")
    wanted = items.select("item_id", "k", "size", "n", "need", F.explode(F.array_distinct("runs")).alias("h"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words.alias("words"))
    anchors = None
    for s in sizes:
        found = base.select("doc_id", "text_hash", F.size("words").alias("length"), F.posexplode(let(F.col("words"), of_size(s))).alias("pos", "h"))
        found = found.join(wanted, "h").select("doc_id", "text_hash", "length", "item_id", "k", "size", "n", "need", "pos")
        anchors = found if anchors is None else anchors.unionByName(found)
    if anchors is None:
        return spark.createDataFrame([], "doc_id long, text_hash long, item_id long, start_word int, n_words int, similarity double")
    near = anchors.groupBy("doc_id", "text_hash", "item_id", "length", "k", "size", "n", "need").agg(F.array_sort(F.collect_set("pos")).alias("ps"))
    near = near.withColumn("ps", let(F.col("ps"), lambda ps: F.filter(ps, lambda p, i: F.get(ps, i + F.least(F.col("need"), F.ceil(num * F.col("n") / F.lit(den)).cast("int")) - 1) <= p + F.col("n") - 1)))
    starts = F.transform("ps", lambda p: F.struct(F.greatest(F.least(p, F.col("length") - F.col("size")), F.lit(0)).alias("start"), F.least("size", "length").alias("size"), F.col("k").alias("k")))
    near = near.filter(F.size("ps") > 0).select("doc_id", "text_hash", F.struct("item_id", F.col("size").alias("item_size")).alias("item"), F.explode(F.array_distinct(starts)).alias("w"))
    near = near.groupBy("doc_id", "text_hash", "w").agg(F.array_sort(F.collect_set("item")).alias("items"))
    near = near.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("w.*", "items")).alias("ws"))
    near = scratch.table(near, "near").withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    both = base.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))

    def fill(w: Column) -> Column:
        part = F.slice(F.col("words"), w["start"] + 1, w["size"])
        run = lambda x: F.coalesce(*[F.when(w["k"] == s, runs_of(x, s)) for s in sizes])
        return let(part, lambda x: F.struct(w["start"].alias("start"), w["size"].alias("size"), w["items"].alias("items"), numbered(run(x)).alias("runs")))

    windows = both.select("doc_id", "text_hash", F.explode(F.transform("ws", fill)).alias("w")).select("doc_id", "text_hash", "w.*")
    windows = scratch.table(windows.distinct(), "windows")
    full = windows.select("doc_id", "text_hash", "start", "size", "runs", F.explode("items").alias("item")).select("doc_id", "text_hash", "start", "size", "runs", "item.*")
    full = full.join(items.select("item_id", F.col("size").alias("item_size"), numbered(F.col("runs")).alias("item_runs")), ["item_id", "item_size"])
    inter = F.size(F.array_intersect("runs", "item_runs"))
    union = F.size("runs") + F.size("item_runs") - inter
    full = full.withColumns({"inter": inter, "union": union}).filter(den * F.col("inter") >= num * F.col("union"))
    best = F.max(F.struct((F.col("inter") / F.col("union")).alias("similarity"), (-F.col("start")).alias("s"), F.col("size").alias("n")))
    out = full.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("m"))
    return out.select("doc_id", "text_hash", "item_id", (-F.col("m.s")).alias("start_word"), F.col("m.n").alias("n_words"), "m.similarity")


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose text holds no benchmark item; null ids and texts stay."""
    bad = contaminated(spark, docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_text")).distinct()
    bad = Scratch(spark, "contaminated").table(bad, "documents")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(docs["text"]) == F.col("bad_text")), "left_anti")
