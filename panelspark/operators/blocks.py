"""Ordered rows of a key, dealt into blocks, so that no key has to fit one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Rows of a block about, and blocks of a key at most.
BLOCK_ROWS, MOST_BLOCKS = 1_000_000, 512
#: Rows of a block of a laid-out table.
LAID_ROWS = 4096


def with_blocks(df: DataFrame, key: str, order: str, scratch: Scratch, rows: int | None = None, name: str = "_block") -> DataFrame | None:
    """Add ``name``: 0 for keys of at most ``rows`` rows, else a number that grows with ``order``; None
    where no key has more.

    A longer key is cut at quantiles of ``order`` (a number, date or timestamp), so rows of equal
    order share a block; nulls come first. Null keys are a key. The quantiles of long keys, of which
    there are at most ``count / rows``, are the only thing that is sent to all tasks.
    """
    rows = rows or BLOCK_ROWS
    long = df.groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    long = scratch.table(long.withColumn("_blocks", F.least(F.ceil(F.col("_n") / rows), F.lit(MOST_BLOCKS)).cast("int")), "long")
    top = long.agg(F.max("_blocks")).first()[0]
    if top is None:
        return None
    found = df.select(F.col(key), F.col(order)).join(F.broadcast(long), F.col(key).eqNullSafe(F.col("_of")))
    grid = F.array(*[F.lit(i / top) for i in range(1, top)])
    cuts = found.groupBy("_of").agg(F.first("_blocks").alias("_blocks"), F.percentile_approx(order, grid, max(10_000, 20 * top)).alias("_cuts"))
    step = F.greatest(F.floor(F.lit(top) / F.col("_blocks")).cast("int"), F.lit(1))
    cuts = scratch.table(cuts.withColumn("_step", step).select("_of", F.expr("filter(_cuts, (c, i) -> (i + 1) % _step = 0)").alias("_cuts")), "cuts")
    at = F.expr(f"size(filter(_cuts, c -> c <= `{order}`))")
    return df.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_of")), "left").withColumn(name, F.coalesce(F.when(F.col(order).isNotNull() & F.col("_cuts").isNotNull(), at), F.lit(0)).cast("int")).drop("_of", "_cuts")


def with_index(df: DataFrame, key: str, order: list, scratch: Scratch, name: str = "_index", block: str = "_block") -> DataFrame:
    """Add the 0-based place of a row among the rows of its key, and ``_rows``, the rows of the key.

    Rows are numbered within blocks (of ``with_blocks`` over the first of ``order``), and the sizes
    of the blocks before are added. ``block`` stays. The result is one table of ``scratch``.
    """
    w = Window.partitionBy(key, block).orderBy(*order)
    df = df.withColumn(name, F.row_number().over(w).cast("long") - 1)
    sizes = df.groupBy(F.col(key).alias("_of"), F.col(block).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_of", "_at", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_of")).alias("_rows"))
    joined = df.join(sizes, F.col(key).eqNullSafe(F.col("_of")) & (F.col(block) == F.col("_at")))
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_of", "_at", "_before")


#: Columns of a laid-out table: the key as text, a row's place in it, and the place's block.
LAID = ("_key", "_index", "_block")


def _blocks(c: Column, rows: int | None, most: int) -> Column:
    """``_block`` with the rows of a block noted, or that all keys have one, and the rows of the longest key."""
    return c.cast("long").alias("_block", metadata={"rows": rows, "most": most})


def block_rows(df: DataFrame) -> int | None:
    """Rows of a block of a laid-out table; None where every key is one block."""
    return df.schema["_block"].metadata["rows"]


def most_rows(df: DataFrame) -> int:
    """Rows of the longest block of a laid-out table."""
    noted = df.schema["_block"].metadata
    return min(noted["most"], noted["rows"] or noted["most"])


def lay_out(df: DataFrame, key: str = "secid", order: str = "date") -> DataFrame:
    """Add ``LAID``: rows of each key in ``order`` (distinct within a key), cut every ``LAID_ROWS`` rows.

    Rows of a block meet in one task; a longer key has several. Where no key is longer, one shuffle by
    key serves all that follows, and rows that were dealt by a key of text already stay where they are.
    A null key is a key; an empty table stays empty.
    """
    scratch, rows = Scratch(df.sparkSession, "blocks"), LAID_ROWS
    # written, so that the shuffle files of the count go
    counts = df.groupBy(F.col(key).cast("string").alias("_of")).count().agg(F.max("count").alias("n"))
    most = scratch.table(counts, "most").first()[0] or 0
    if most <= rows:
        place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long") - 1
        return df.withColumns({"_key": F.col(key).cast("string"), "_index": place}).select("*", _blocks(F.lit(0), None, most))
    df = df.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    cut = with_blocks(df, "_key", order, scratch, rows, "_cut")
    placed = with_index(cut, "_key", [order], scratch, "_index", "_cut").drop("_cut", "_rows")
    return placed.select("*", _blocks(F.floor(F.col("_index") / rows), rows, most))


def laid_out(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of laid-out rows that takes any and gives its rows back without ``LAID``."""

    @wraps(fn)
    def run(df: DataFrame, *args: object, **more: object) -> DataFrame:
        if "_block" in df.columns:
            return fn(df, *args, **more)
        return fn(lay_out(df), *args, **more).drop(*LAID)

    return run


def in_block() -> WindowSpec:
    return Window.partitionBy("_key", "_block").orderBy("_index")


def reaching(df: DataFrame, reach: int, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``add(df)``, whose windows within a block look back over ``reach`` rows at most.

    The last ``reach`` rows of a block are copied to the blocks that need them, where they take part
    in windows and are then removed.
    """
    rows = block_rows(df)
    if rows is None:
        return add(df)
    to = F.explode(F.sequence(F.col("_block"), F.floor((F.col("_index") + reach) / rows).cast("long"))).alias("_to")
    copies = df.select("*", to).withColumn("_copy", F.col("_to") > F.col("_block"))
    copies = copies.select(*[c for c in df.columns if c != "_block"], "_copy", _blocks(F.col("_to"), rows, most_rows(df)))
    return add(copies).filter(~F.col("_copy")).drop("_copy")


def running_sums(df: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Add ``out: column`` sums from a key's first row on; null where the column is, and later rows go on."""
    w = in_block().rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({o: F.sum(c).over(w) for o, c in sums.items()})
    if block_rows(df) is not None:
        ends = df.groupBy(F.col("_key").alias("_of"), F.col("_block").alias("_at")).agg(*[F.sum(c).alias(f"_b_{o}") for o, c in sums.items()])
        upto = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("_of", "_at", *[F.coalesce(F.sum(f"_b_{o}").over(upto), F.lit(0)).alias(f"_b_{o}") for o in sums])
        out = out.join(ends, (F.col("_key") == F.col("_of")) & (F.col("_block") == F.col("_at")))
        out = out.withColumns({o: F.col(o) + F.col(f"_b_{o}") for o in sums}).drop("_of", "_at", *[f"_b_{o}" for o in sums])
    return out.withColumns({o: F.when(F.col(c).isNotNull(), F.col(o)) for o, c in sums.items()})
