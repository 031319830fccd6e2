"""Panel-shaped views of generic order, event and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def half_up(c: Column | str, digits: int) -> Column:
    """Round half up by plain arithmetic, the same on every engine with IEEE doubles."""
    p = F.lit(float(10**digits))
    return F.floor((F.col(c) if isinstance(c, str) else c) * p + 0.5) / p


def near(c: Column | str, digits: int) -> Column:
    """Rounded with the tie point moved off decimal fractions, so that sums in another order agree."""
    p = F.lit(float(10**digits))
    return F.floor((F.col(c) if isinstance(c, str) else c) * p + 0.4567) / p


def bars(spark: SparkSession, sf_dir: str, by_ticker: bool = False) -> DataFrame:
    """Daily bars ``secid, date, open, high, low, close, volume, waprice`` of order lines by supplier.

    Most bars have one line, so lines are hardly fewer when they are grouped before they travel. With
    ``by_ticker`` they travel as they are and by supplier: windows over a ticker then need no other shuffle.
    """
    t = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    t = t.select(F.col("l_suppkey").cast("string").alias("secid"), F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    if by_ticker:
        t = t.repartition("secid")
    t = t.select("secid", "date", half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"), "l_quantity", "l_extendedprice", order.alias("o"))
    return t.groupBy("secid", "date").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"),
        F.sum("l_quantity").alias("volume"), half_up(F.sum("l_extendedprice") / F.sum("l_quantity"), 2).alias("waprice"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily macro series ``date, series, value``: mean order value by priority."""
    t = table(spark, sf_dir, "orders")
    name = F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9]+", "_")
    return t.groupBy(F.to_date("o_orderdate").alias("date"), name.alias("series")).agg(half_up(F.avg("o_totalprice"), 2).alias("value"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages ``datetime, channel_name, message_link, views, news`` of documents, a minute apart."""
    t = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return t.select(at.alias("datetime"), F.col("source").alias("channel_name"), F.concat(F.lit("t.me/c/"), F.col("doc_id").cast("string")).alias("message_link"), F.col("n_chars").alias("views"), F.col("text").alias("news"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily scores ``date, source, secid, score`` in -3..3 of user events; the largest value of a day."""
    t = table(spark, sf_dir, "events")
    source = F.when(F.col("event_type").isin("click", "view"), "blog").otherwise("news")
    bucket = (F.floor(F.col("value")) % 7 - 3).cast("double")
    return t.groupBy(F.to_date("ts").alias("date"), source.alias("source"), F.col("user_id").cast("string").alias("secid")).agg(F.max(bucket).alias("score"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long reports ``ticker, report_type, period_end, publication_date, metric, value`` by nation."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").cast("string").alias("ticker"), F.to_date("o_orderdate").alias("d"), "o_totalprice", "c_acctbal", "o_orderstatus")
    quarter = F.last_day(F.make_date(F.year("d"), F.quarter("d") * 3, F.lit(1)))
    year = F.make_date(F.year("d"), F.lit(12), F.lit(31))
    both = t.withColumn("report_type", F.lit("quarterly")).withColumn("period_end", quarter).unionByName(t.withColumn("report_type", F.lit("yearly")).withColumn("period_end", year))
    part = lambda status: half_up(F.sum(F.when(F.col("o_orderstatus") == status, F.col("o_totalprice")).otherwise(0.0)), 2)
    by = both.groupBy("ticker", "report_type", "period_end").agg(
        half_up(F.sum("o_totalprice"), 2).alias("Revenue"), half_up(F.sum("c_acctbal") * 20, 2).alias("NetProfit"), part("P").alias("EBITDA"), half_up(F.max("o_totalprice") * 100, 2).alias("Assets"),
        half_up(F.min("o_totalprice") * 100, 2).alias("Equity"), part("F").alias("Debt"), part("O").alias("Cash"),
    )
    names = ["Revenue", "NetProfit", "EBITDA", "Assets", "Equity", "Debt", "Cash"]
    long = by.unpivot(["ticker", "report_type", "period_end"], names, "metric", "value")
    lag = F.when(F.col("report_type") == "yearly", 90).otherwise(45)
    return long.select("ticker", "report_type", "period_end", F.date_add("period_end", lag).alias("publication_date"), "metric", "value")
