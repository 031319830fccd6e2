"""Scores rolled up to trading days, rolling means of signals, and forward targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import drop_all_null_columns, filter_dates, round_half, split_list, trim_leading_null

HORIZONS = (1, 3, 7, 30, 180, 365)


def load_scores(wide: DataFrame, source: str) -> DataFrame:
    """Wide day rows ``date, summary, <ticker>...`` to ``date, source, secid, score``; nulls dropped."""
    names = [c for c in wide.columns if c not in ("date", "summary")]
    long = wide.select("date", *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).unpivot(["date"], names, "secid", "score")
    return long.filter("score IS NOT NULL").select("date", F.lit(source).alias("source"), "secid", "score")


def rollup_scores(scores: DataFrame, calendar: DataFrame, keys: list[str] = ("source", "secid"), weight: float = 0.6, direction: str = "backward") -> DataFrame:
    """Scores of trading days, those of the days off blended in.

    A score of a day off attaches to the latest trading day that has scores before it
    (``direction="forward"``: to the next one, without look-ahead). With b the mean of the attached
    scores, a day's own score null or 0 gives b, else (1 - weight) own + weight b; rounded to 2
    places. Scores before the first trading day are dropped.
    """
    keys = list(keys)
    by = Window.partitionBy(*keys).orderBy("date")
    rows = scores.join(calendar, "date", "left").withColumn("_open", F.coalesce("is_trading_day", F.lit(False)))
    if direction == "backward":
        day = F.max(F.when(F.col("_open"), F.col("date"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    else:
        day = F.min(F.when(F.col("_open"), F.col("date"))).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_day", day).filter("_day IS NOT NULL")
    own = F.max(F.when(F.col("_open"), F.col("score"))).alias("own")
    rest = F.avg(F.when(~F.col("_open"), F.col("score"))).alias("b")
    out = rows.groupBy(*keys, F.col("_day").alias("date")).agg(own, rest)
    blended = F.when(F.col("b").isNull(), F.col("own")).when(F.col("own").isNull() | (F.col("own") == 0), F.col("b")).otherwise((1 - weight) * F.col("own") + weight * F.col("b"))
    return out.select(*keys, "date", round_half(blended, 2).alias("score"))


def rolling_nonzero(df: DataFrame, col: str, periods: tuple[int, ...] = (15, 50), keys: list[str] = ("source", "secid")) -> DataFrame:
    """Add ``<col>_roll_<n>``: mean of the non-zero values of n rows, rounded to 2 places."""
    w = Window.partitionBy(*keys).orderBy("date")
    value = F.when(F.col(col) != 0, F.col(col))
    return df.withColumns({f"{col}_roll_{n}": round_half(F.avg(value).over(w.rowsBetween(1 - n, 0)), 2) for n in periods})


def index_scores(rolled: DataFrame, mapping: DataFrame, market: str = "MOEX") -> DataFrame:
    """``secid, source, date, market_score, index_score``: the market index apart, the mean of the others.

    ``mapping(secid, indices)`` lists a ticker's indices; ``rolled`` holds the indices' own rows.
    """
    of = mapping.select("secid", F.explode(split_list("indices")).alias("index"))
    rows = of.join(rolled.withColumnRenamed("secid", "index"), "index")
    return rows.groupBy("secid", "source", "date").agg(F.max(F.when(F.col("index") == market, F.col("score"))).alias("market_score"), round_half(F.avg(F.when(F.col("index") != market, F.col("score"))), 2).alias("index_score"))


def signal_features(panel: DataFrame, scores: DataFrame, calendar: DataFrame, mapping: DataFrame, sources: tuple[str, ...] = ("blog", "news")) -> DataFrame:
    """The panel with each source's rolled score, its rolling means and the index scores."""
    rolled = rollup_scores(scores, calendar)
    own = rolling_nonzero(rolled, "score")
    idx = rolling_nonzero(index_scores(rolled, mapping), "index_score")
    for s in sources:
        for part in (own, idx):
            cols = [c for c in part.columns if c not in ("source", "secid", "date")]
            side = part.filter(F.col("source") == s).select("secid", "date", *[F.col(c).alias(f"{s}_{c}") for c in cols])
            panel = panel.join(side, ["secid", "date"], "left")
    return panel


def ratio_targets(df: DataFrame, horizons: tuple[int, ...] = (1, 3, 7, 30, 180), price: str = "close") -> DataFrame:
    """Add ``target_<h>d``: price h rows ahead over today's, less one."""
    w = Window.partitionBy("secid").orderBy("date")
    return df.withColumns({f"target_{h}d": F.when(F.col(price) != 0, F.lead(price, h).over(w) / F.col(price) - 1) for h in horizons})


def pct_targets(df: DataFrame, horizons: tuple[int, ...] = HORIZONS, price: str = "close", digits: int = 4, window: WindowSpec | None = None) -> DataFrame:
    """The same in percent, rounded; overwrites columns of that name. ``window`` holds all rows of a ticker by date."""
    w = window or Window.partitionBy("secid").orderBy("date")
    return df.withColumns({f"target_{h}d": F.when(F.col(price) != 0, F.round((F.lead(price, h).over(w) / F.col(price) - 1) * 100, digits)) for h in horizons})


def binary_targets(df: DataFrame, horizons: tuple[int, ...] = HORIZONS, null_tail: bool = False) -> DataFrame:
    """Add ``target_<h>d_binary``: 1 above zero; null counts as 0 unless ``null_tail``."""
    up = lambda h: (F.col(f"target_{h}d") > 0).cast("int")
    return df.withColumns({f"target_{h}d_binary": up(h) if null_tail else F.coalesce(up(h), F.lit(0)) for h in horizons})


def ensure_columns(df: DataFrame, names: list[str], kind: str = "double") -> DataFrame:
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def training_set(df: DataFrame, start: str = "2019-02-01", end: str | None = None, horizons: tuple[int, ...] = (1, 3, 7, 30, 180)) -> DataFrame:
    """Rows of the window from each ticker's first close on, with targets and without empty columns."""
    rows = ratio_targets(trim_leading_null(filter_dates(df, start, end), "close"), horizons)
    return drop_all_null_columns(rows)
