"""Macro series, the trading calendar and the merge of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def monthly_to_daily(df: DataFrame, end_date: str, value: str = "cpi") -> DataFrame:
    """Every day from the first month (``month`` as MM.yyyy) to ``end_date`` with the month's value carried."""
    rows = df.select(F.try_to_timestamp("month", F.lit("MM.yyyy")).cast("date").alias("date"), F.col(value)).filter("date IS NOT NULL")
    end = F.lit(end_date).cast("date")
    until = F.least(F.coalesce(F.date_sub(F.lead("date").over(Window.orderBy("date")), 1), end), end)
    return rows.withColumn("_to", until).filter("date <= _to").select(F.explode(F.sequence("date", "_to")).alias("date"), value)


def macro_table(series: DataFrame, names: list[str], ffill: bool = False) -> DataFrame:
    """One row per day of any series, one column each: a pivot instead of a chain of outer joins."""
    wide = series.groupBy("date").pivot("series", names).agg(F.first("value", ignorenulls=True))
    if not ffill:
        return wide
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names})


def merge_features(technical: DataFrame, fundamentals: DataFrame, macro: DataFrame, key: str = "secid") -> DataFrame:
    """Technical rows with the fundamentals of their key and day and the macro values of their day.

    Macro rows are one a day, so the optimizer may broadcast them by their size.
    """
    return technical.join(fundamentals, [key, "date"], "left").join(macro, "date", "left")


def trading_calendar(spark: SparkSession, prices: DataFrame, holidays: DataFrame, start: str, end: str) -> DataFrame:
    """``date, is_trading_day``: observed days within the price history, weekdays without holiday after it."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    seen = prices.select("date").distinct().withColumn("_seen", F.lit(True))
    off = holidays.select("date").distinct().withColumn("_off", F.lit(True))
    span = prices.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    rows = days.join(seen, "date", "left").join(off, "date", "left").join(F.broadcast(span))
    weekday = ~F.dayofweek("date").isin(1, 7)
    trading = F.when(F.col("date") > F.col("_hi"), weekday & F.col("_off").isNull()).when(F.col("date") >= F.col("_lo"), F.col("_seen").isNotNull()).otherwise(False)
    return rows.select("date", F.coalesce(trading, F.lit(False)).alias("is_trading_day"))
