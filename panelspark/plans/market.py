"""Whole plans: the market panel, and its training set, as one lazy table each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import LAID, block_rows, in_block, lay_out
from ..operators.fundamentals import daily_asof, financial_ratios, finish_fundamentals, last_sizes, latest_restatement, net_debt, pivot_metrics
from ..operators.indicators import technical_features
from ..operators.macro import macro_table, merge_features
from ..operators.signals import binary_targets, pct_targets
from ..scratch import Scratch

#: Days of all tickers' fundamentals that are broadcast at most.
BROADCAST_ROWS = 200_000


def daily_fundamentals(reports: DataFrame, metrics: list[str], end_date: str) -> DataFrame:
    """Long reports to one row per ticker and day, in millions."""
    wide = pivot_metrics(latest_restatement(reports), metrics)
    return finish_fundamentals(net_debt(daily_asof(wide, end_date)))


def _packed(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, list[str]]:
    """``keys`` and all other columns as one struct ``name``, and their names: a row without a partner carries one null."""
    cols = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.struct(*cols).alias(name)), cols


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def market_panel(bars: DataFrame, reports: DataFrame, series: DataFrame, sizes: DataFrame, metrics: list[str], names: list[str], end_date: str, digits: int = 4) -> DataFrame:
    """Indicators, fundamentals, macro values, ratios and targets of every ticker and day.

    Bars are laid out first, and targets look ahead in them. Everything is joined to these narrow rows,
    before the indicators widen them tenfold: wide rows are not shuffled any more. Macro values are one
    row a day and broadcast; fundamentals and issue sizes are written, and broadcast up to a bound, so
    that bars which come dealt by ticker are not shuffled at all.
    """
    scratch = Scratch(bars.sparkSession, "market")
    daily, reported = _packed(daily_fundamentals(reports, metrics, end_date).withColumnRenamed("ticker", "secid"), ["secid", "date"], "_reported")
    days, observed = _packed(scratch.table(macro_table(series, names), "macro"), ["date"], "_observed")
    daily, sizes = (_small(scratch.table(t, n)) for t, n in ((daily, "reported"), (last_sizes(sizes), "sizes")))
    laid = lay_out(bars)
    narrow = pct_targets(laid, digits=digits, window=in_block() if block_rows(laid) is None else None)
    narrow = narrow.join(sizes, "secid", "left")
    narrow, joined = _packed(binary_targets(narrow), laid.columns, "_joined")
    wide = technical_features(merge_features(narrow, daily, F.broadcast(days))).drop(*LAID)
    wide = wide.select(*[c for c in wide.columns if c != "_joined"], *[f"_joined.{c}" for c in joined])
    wide = wide.select(*[c for c in wide.columns if c not in ("_reported", "_observed")], *[f"_reported.{c}" for c in reported], *[f"_observed.{c}" for c in observed])
    return financial_ratios(wide).filter(F.col("close").isNotNull())
