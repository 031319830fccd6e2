"""Incremental maintenance of stored tables: marks, appends, upserts, merges and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import id_chunk, id_date

#: Tasks that may share the rows of one key when a panel is written.
SHARES = 4


def write_panel(df: DataFrame, path: str, fmt: str = "parquet", key: str = "secid") -> None:
    """One folder per key; a repeated run replaces the whole table.

    A key's rows are dealt to ``SHARES`` tasks, so that a hot key has as many files instead of one task.
    """
    df.repartition(F.col(key), F.pmod(F.xxhash64(*df.columns), F.lit(SHARES))).write.mode("overwrite").partitionBy(key).format(fmt).option("header", "true").save(path)


def high_water_mark(df: DataFrame, col: str) -> DataFrame:
    """One row with the largest stored value; null for an empty table."""
    return df.agg(F.max(col).alias("mark"))


def append_new_dates(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those new ones whose key isn't stored, in the existing columns."""
    fresh = new.join(existing.select(keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True).select(existing.columns)


def append_newer(new: DataFrame, existing: DataFrame, col: str) -> DataFrame:
    """Existing rows and those strictly newer than their largest ``col``; all when there is none."""
    mark = F.broadcast(high_water_mark(existing, col))
    fresh = new.crossJoin(mark).filter(F.col("mark").isNull() | (F.col(col) > F.col("mark"))).drop("mark")
    return existing.unionByName(fresh, allowMissingColumns=True)


def _pick(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def upsert_latest(history: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: the new one where there is one, else the stored; the largest ``seq`` of each."""
    both = history.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return _pick(both, [key], [F.desc("_v"), F.desc(seq)]).drop("_v")


def merge_first(tables: list[DataFrame], key: str, seq: str) -> DataFrame:
    """One row per key, that of the first table and smallest ``seq``; ``position`` orders the result.

    The position follows date and chunk of the id; ids without them come last. Rows are counted
    within their date and dates before them are summed, so no task sees all rows.
    """
    both = tables[0].withColumn("_v", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        both = both.unionByName(t.withColumn("_v", F.lit(i)), allowMissingColumns=True)
    rows = _pick(both, [key], [F.asc("_v"), F.asc(seq)]).drop("_v")
    rows = rows.withColumn("_day", id_date(key))
    days = rows.groupBy(F.col("_day").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    days = days.select("_of", (F.sum("_n").over(Window.orderBy(F.asc_nulls_last("_of"))) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_day").orderBy(id_chunk(key).asc_nulls_last(), key)))
    rows = rows.join(days, F.col("_day").eqNullSafe(F.col("_of")))
    return rows.withColumn("position", (F.col("_before") + F.col("_i")).cast("int")).drop("_day", "_of", "_before", "_i")


def merge_representatives(old: DataFrame, new: DataFrame, key: str = "cluster_id", time: str = "datetime") -> DataFrame:
    """Distinct by key, the stored row first; without the key column, distinct rows."""
    if key not in old.columns:
        return old.unionByName(new, allowMissingColumns=True).distinct()
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return _pick(both, [key], [F.asc("_v"), F.asc(time)]).drop("_v")


def merge_clusters(old: DataFrame, new: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Stored clusters and those new ones whose key isn't stored."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def replace_last_day(old: DataFrame, new: DataFrame, col: str = "date") -> DataFrame:
    """New rows appended; the last stored day goes first if the new rows hold it."""
    last = old.agg(F.max(col).alias("_last"))
    again = F.broadcast(new.join(last, F.col(col) == F.col("_last")).select("_last").distinct())
    kept = old.join(again, F.col(col) == F.col("_last"), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


def assign_parts(df: DataFrame, first: int, other: int, day: str, order: list[str]) -> DataFrame:
    """Add ``part``: 0 for the first rows by day and ``order``, then one number for every ``other`` rows.

    Rows are counted within their day and days before them are summed, so no task sees all rows.
    """
    before = df.groupBy(F.col(day).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_day", (F.sum("_n").over(Window.orderBy(F.asc_nulls_first("_day"))) - F.col("_n")).alias("_before"))
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(day).orderBy(*order)))
    rows = rows.join(before, F.col(day).eqNullSafe(F.col("_day")))
    n = F.col("_before") + F.col("_i") - 1
    part = F.when(n < first, 0).otherwise(F.floor((n - first) / other) + 1).cast("int")
    return rows.withColumn("part", part).select(*df.columns, "part")


def run_report(df: DataFrame, key: str = "secid", time: str = "date") -> DataFrame:
    """Rows, first and last time by key, and whether there is anything."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_date"), F.max(time).alias("last_date")).withColumn("status", F.when(F.col("n_rows") > 0, "ok").otherwise("empty"))


def missing_records(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` whose key ``done`` lacks."""
    return source.join(done.select(key).distinct(), key, "left_anti")
