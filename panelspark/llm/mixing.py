"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source shall be taken ``target / source size`` times: the whole part for sure,
the fraction with that probability. Fractions are settled in pairs: words move at random from one
document to the other until the probability of one of the two is 0 or 1, which keeps every
expectation and the words that both bring together. Pairs meet within small blocks of one source;
what a block leaves open, one document at most, goes up a reduction tree over blocks, until one
document of the source is left and is drawn on its own. Only where smaller documents could not make
up for one of its two outcomes, the other one is taken.

Large documents are settled first, in phases of sizes that differ by ``SPAN`` at most. What a phase
takes too much or too little, less than one of its documents, changes the probability of all
smaller ones alike, so a source misses its target by less than one of its small documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, looked_up

#: Documents that meet in a block on average, the ratio of sizes that one phase spans, and the largest size of the last one.
FAN, SPAN, LAST = 64, 8, 16
_UNIT = "struct<size:bigint,id:bigint,copy:bigint,p:double>"


def _draw(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / F.lit(float(1 << 53))


def _settle(units: Column, seed: int) -> Column:
    """Fold an array of open units: ``done`` are settled at 0 or 1, ``open`` is the one left."""
    start = F.struct(F.lit(None).cast(_UNIT).alias("open"), F.array().cast(f"array<{_UNIT}>").alias("done"))

    def at(u: Column, p: Column) -> Column:
        return F.struct(u["size"].alias("size"), u["id"].alias("id"), u["copy"].alias("copy"), p.alias("p"))

    def meet(acc: Column, u: Column) -> Column:
        o = acc["open"]
        has, room = o["p"] * o["size"], (1 - o["p"]) * o["size"]
        gives, takes = u["p"] * u["size"], (1 - u["p"]) * u["size"]
        up, down = F.least(room, gives), F.least(has, takes)
        rises = _draw(seed, o["id"], o["copy"], u["id"], u["copy"]) * (up + down) < down
        first = F.when(rises, room <= gives).otherwise(has <= takes)
        settled = F.when(rises, F.when(first, at(o, F.lit(1.0))).otherwise(at(u, F.lit(0.0)))).otherwise(F.when(first, at(o, F.lit(0.0))).otherwise(at(u, F.lit(1.0))))
        left = F.when(first, at(u, F.when(rises, (gives - room) / u["size"]).otherwise((gives + has) / u["size"]))).otherwise(at(o, F.when(rises, (has + gives) / o["size"]).otherwise((has - takes) / o["size"])))
        return F.when(o.isNull(), F.struct(at(u, u["p"]).alias("open"), acc["done"].alias("done"))).otherwise(F.struct(left.alias("open"), F.concat(acc["done"], F.array(settled)).alias("done")))

    return F.aggregate(units, start, meet)


def source_targets(sources: DataFrame, weights: tuple[float, ...], most: float, scratch: Scratch) -> DataFrame:
    """``source, n`` (words) with ``target``, the words to take, for the distinct sources of a table.

    Sources by code point, null last, take the weights in turn; shares of the whole stop at
    ``most`` times a source's size, and the excess goes to the others by weight until none is above.
    Sources are numbered within ranges and the ranges added up, so that no task sees them all.
    """
    order = F.col("source").asc_nulls_last()
    ranged = sources.repartitionByRange(order).sortWithinPartitions(order)
    place = F.monotonically_increasing_id()
    ranged = scratch.table(ranged.select("source", "n", F.shiftright(place, 33).alias("range"), place.bitwiseAND((1 << 33) - 1).alias("place")), "sources")
    ranges = ranged.groupBy("range").agg(F.count("*").alias("k"))  # one row a range
    first = ranges.select("range", (F.sum("k").over(Window.orderBy("range")) - F.col("k")).alias("first"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("first") + F.col("place"), F.lit(len(weights))).cast("int") + 1)
    plan = scratch.table(ranged.join(first, "range").select("source", "n", weight.alias("weight")), "weights")
    total = float(plan.agg(F.sum("n")).first()[0] or 0)
    full, rate = -1.0, 0.0
    while True:  # each turn fills at least one more source
        capped = F.col("weight") * rate > most * F.col("n")
        x = plan.agg(F.sum(F.when(capped, most * F.col("n")).otherwise(0.0)).alias("full"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(capped, 1)).alias("k")).first()
        if x["k"] == full or not x["open"]:
            break
        full, rate = x["k"], (total - x["full"]) / x["open"]
    capped = F.col("weight") * rate > most * F.col("n")
    return plan.select("source", "n", F.when(capped, most * F.col("n")).otherwise(F.col("weight") * rate).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs(doc_id, text, source)``.

    A document's size is its number of words (null text: 0). Rows that repeat doc_id, source and
    size are drawn one by one. The random numbers depend on the seed and the documents alone, so
    that reruns agree whatever the partitions. Documents without words are never taken; extra
    columns are ignored.
    """
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = scratch.table(rows.withColumn("g", name), "sizes")
    plan = source_targets(rows.groupBy("source").agg(F.sum("size").alias("n")), weights, most, scratch)
    rate = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    plan = scratch.table(plan.select(name.alias("g"), F.col("n").alias("source_size"), "target", F.floor(rate).alias("whole"), ((rate - F.floor(rate)) * F.col("n")).alias("wanted")), "plan")
    sources = plan.count()
    units = rows.groupBy("g", "source", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    largest = rows.agg(F.max("size")).first()[0] or 0
    bounds = [0]
    while bounds[-1] < largest:
        bounds.append(max(LAST, bounds[-1] * SPAN))
    phase = F.lit(0)
    for k, b in enumerate(reversed(bounds[1:-1]), 1):
        phase = F.when(F.col("size") <= b, k).otherwise(phase)
    units = scratch.table(units.withColumn("phase", F.when(F.col("size") > 0, phase)), "units")
    sums = scratch.table(units.filter("phase IS NOT NULL").groupBy("g", "phase").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "phases")
    union = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    taken = spark.createDataFrame([], "g string, words long")
    settled = []
    for k in range(len(bounds) - 1):
        words_from = lambda at: sums.filter(F.col("phase") >= at).groupBy("g").agg(F.sum("words").alias("words"))
        left = plan.select("g", "wanted").join(taken.groupBy("g").agg(F.sum("words").alias("had")), "g", "left")
        left = left.select("g", (F.col("wanted") - F.coalesce("had", F.lit(0))).alias("left"))
        chance = F.least(F.greatest(F.col("left") / F.col("words"), F.lit(0.0)), F.lit(1.0))
        share = scratch.table(left.join(words_from(k), "g").select("g", "left", chance.alias("p")), "chances")
        most_units = sums.filter(F.col("phase") == k).agg(F.max("n")).first()[0]
        if not most_units:
            continue
        live = looked_up(units.filter(F.col("phase") == k).select("g", "size", F.col("doc_id").alias("id"), "copy"), share.select("g", "p"), sources)
        live = live.select("g", F.struct("size", "id", "copy", "p").alias("u"))
        step, blocks, done = 0, -(-most_units // FAN), []
        while True:
            block = F.pmod(F.xxhash64("u.id", "u.copy", F.lit(step)), F.lit(blocks))
            grouped = live.groupBy("g", block.alias("block")).agg(F.sort_array(F.collect_list("u"), asc=False).alias("us"))
            folded = scratch.table(grouped.select("g", _settle(F.col("us"), seed + 100 * k + step).alias("x")), "folded")
            done.append(folded.select("g", F.explode("x.done").alias("u")).filter("u.p = 1").select("g", "u.*"))
            live = folded.select("g", F.col("x.open").alias("u"))
            if blocks == 1:
                break
            step, blocks = step + 1, -(-blocks // FAN)
        had = union(done).groupBy("g").agg(F.sum("size").alias("had"))
        last = live.join(share.select("g", "left"), "g").join(had, "g", "left").join(words_from(k + 1), "g", "left")
        rest, below = F.col("left") - F.coalesce("had", F.lit(0)), F.coalesce("words", F.lit(0))
        beyond = lambda x: F.greatest(x - below, -x, F.lit(0.0))
        gain = beyond(rest) - beyond(rest - F.col("u.size"))
        drawn = F.when(F.abs(gain) > 1e-6, gain > 0).otherwise(_draw(seed, F.col("u.id"), F.col("u.copy")) < F.col("u.p"))
        settled += [*done, scratch.table(last.filter(drawn).select("g", "u.*"), "last")]
        new = union([*done, settled[-1]]).groupBy("g").agg(F.sum("size").alias("words"))
        taken = scratch.table(taken.unionByName(new), "taken")
    extra = F.lit(0)
    if settled:
        drawn = union(settled).select(F.col("g").alias("h"), "id", F.col("copy").alias("c"), F.col("size").alias("z"))
        units = units.join(drawn, (F.col("g") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("c")) & (F.col("size") == F.col("z")), "left")
        extra = F.when(F.col("z").isNotNull(), 1).otherwise(0)
    out = looked_up(units.withColumn("extra", extra), plan, sources)
    copies = (F.when(F.col("size") > 0, F.col("whole")).otherwise(0) + F.col("extra")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
