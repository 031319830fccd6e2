"""Company reports to daily fundamentals and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_numeric, parse_pub_date, period_end, safe_divide, unit_scale

#: Report labels of each metric in order of preference, and that of the publication date.
METRIC_LABELS = {
    "Revenue": ["Выручка"],
    "EBITDA": ["EBITDA"],
    "OperatingProfit": ["Операционная прибыль"],
    "NetProfit": ["Чистая прибыль", "Чистая прибыль н/с"],
    "Assets": ["Активы", "Активы банка"],
    "Equity": ["Капитал", "Чистые активы", "Баланс стоимость"],
    "Debt": ["Долг"],
    "Cash": ["Наличность"],
    "OperatingCashFlow": ["Операционный денежный поток"],
    "CAPEX": ["CAPEX"],
    "OperatingExpenses": ["Операционные расходы", "Опер. расходы"],
    "DividendsPaid": ["Див.выплата"],
}
DATE_LABEL = "Дата отчета"
#: The 17 ratios.
RATIOS = ("ROE_y", "ROA_y", "EBITDA_Margin_y", "NetProfit_Margin_y", "Debt_Equity_q", "Debt_Equity_y", "NetDebt_EBITDA_y_q", "NetDebt_EBITDA_y_y", "EPS_y", "BVPS_q", "BVPS_y", "SPS_y", "PE_y", "PB_q", "PB_y", "PS_y", "EV_EBITDA_y")


def match_metric_rows(cells: DataFrame, labels: dict[str, list[str]] = METRIC_LABELS) -> DataFrame:
    """``cells(file, row_no, label, ...)`` of the row that gives each metric: the first, in file order,
    whose trimmed label starts with the first label that any row of the file starts with."""
    spark = cells.sparkSession
    wanted = spark.createDataFrame([(m, i, a) for m, names in labels.items() for i, a in enumerate(names)], "metric string, rank int, alias string")
    hits = cells.select("file", "row_no", "label").distinct().join(F.broadcast(wanted), F.trim("label").startswith(F.col("alias")))
    best = hits.groupBy("file", "metric").agg(F.min(F.struct("rank", "row_no")).alias("b")).select("file", "metric", F.col("b.row_no").alias("row_no"))
    return cells.join(best, ["file", "row_no"])


def reports_long(cells: DataFrame, since: int = 2018) -> DataFrame:
    """Long reports of report cells ``file, ticker, report_type, row_no, label, period, text``.

    Periods from ``since`` on; the publication date is that of the date row, else 90 days after a
    year's and 45 after a quarter's end; earlier publication than the period's end drops the value,
    as does text that is no number. Values are scaled by the unit in the label.
    """
    dates = cells.filter(F.trim("label").startswith(DATE_LABEL)).select(F.col("file").alias("f"), F.col("period").alias("p"), parse_pub_date("text").alias("published"))
    dates = dates.groupBy("f", "p").agg(F.min("published").alias("published"))
    rows = match_metric_rows(cells).withColumns({"period_end": period_end("period"), "value": clean_numeric("text") * unit_scale("label")})
    rows = rows.filter((F.year("period_end") >= since) & F.col("value").isNotNull())
    rows = rows.join(dates, (F.col("file") == F.col("f")) & (F.col("period") == F.col("p")), "left")
    late = F.date_add("period_end", F.when(F.col("report_type") == "yearly", 90).otherwise(45))
    rows = rows.withColumn("publication_date", F.coalesce("published", late))
    return rows.filter("publication_date >= period_end").select("ticker", "report_type", "period_end", "publication_date", "metric", "value")


def latest_restatement(df: DataFrame) -> DataFrame:
    """The value published last for each ticker, period, metric and report type."""
    w = Window.partitionBy("ticker", "report_type", "period_end", "metric").orderBy(F.desc("publication_date"), F.desc("value"))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pivot_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per ticker and publication date with ``<metric>_q`` and ``<metric>_y``; means on collisions."""
    suffix = F.when(F.col("report_type") == "yearly", "_y").otherwise("_q")
    names = [f"{m}{s}" for m in metrics for s in ("_q", "_y")]
    return df.withColumn("name", F.concat("metric", suffix)).groupBy("ticker", F.col("publication_date").alias("date")).pivot("name", names).agg(F.avg("value"))


def daily_asof(df: DataFrame, end_date: str, key: str = "ticker") -> DataFrame:
    """Every day from a key's first row to ``end_date``, each column carrying its last value.

    Gaps are filled by intervals to the next row, so a day costs one row and no join.
    """
    cols = [c for c in df.columns if c not in (key, "date")]
    by = Window.partitionBy(key).orderBy("date")
    carried = df.withColumns({c: F.last(c, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)) for c in cols})
    until = F.least(F.coalesce(F.date_sub(F.lead("date").over(by), 1), F.lit(end_date).cast("date")), F.lit(end_date).cast("date"))
    spans = carried.withColumn("_to", until).filter("date <= _to")
    return spans.withColumn("date", F.explode(F.sequence("date", "_to"))).select(key, "date", *cols)


def asof_join(left: DataFrame, right: DataFrame, key: str, on: str = "date") -> DataFrame:
    """Backward as-of join: each left row with the last non-null right values at or before its day.

    Both sides are merged in one sorted window per key; no range join takes place. Value columns
    that both sides have are refused, as a row could not tell whose they are.
    """
    cols = [c for c in right.columns if c not in (key, on)]
    if clash := sorted(set(cols) & set(left.columns)):
        raise ValueError(f"both sides have the columns {clash}; rename those of one side")
    both = left.withColumn("_l", F.lit(1)).unionByName(right.withColumn("_l", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(on, "_l").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols}).filter("_l = 1").drop("_l")


def net_debt(df: DataFrame) -> DataFrame:
    return df.withColumns({f"NetDebt{s}": F.col(f"Debt{s}") - F.col(f"Cash{s}") for s in ("_q", "_y") if f"Debt{s}" in df.columns and f"Cash{s}" in df.columns})


def finish_fundamentals(df: DataFrame, key: str = "ticker", digits: int = 1) -> DataFrame:
    """Millions from the first day with any metric on."""
    cols = [c for c in df.columns if c not in (key, "date")]
    first = F.min(F.when(F.coalesce(*cols).isNotNull(), F.col("date"))).over(Window.partitionBy(key))
    rows = df.withColumn("_first", first).filter("date >= _first").drop("_first")
    return rows.withColumns({c: F.round(F.col(c) / 1e6, digits) for c in cols})


def with_issue_size(df: DataFrame, sizes: DataFrame, key: str = "secid") -> DataFrame:
    """Add ``issue_size``: the last known of each key, null without one."""
    return df.join(last_sizes(sizes, key).withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left").drop("_k")


def last_sizes(sizes: DataFrame, key: str = "secid") -> DataFrame:
    return sizes.groupBy(key).agg(F.max_by("issue_size", "date").alias("issue_size"))


def financial_ratios(df: DataFrame, price: str = "close") -> DataFrame:
    """Add the 17 ratios of daily fundamentals in millions; missing inputs count as null columns."""
    for c in ("NetProfit_y", "Revenue_y", "EBITDA_y", "Assets_y", "Equity_q", "Equity_y", "Debt_q", "Debt_y", "NetDebt_q", "NetDebt_y", "issue_size"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    c = F.col
    per: Column = F.when(c("issue_size") > 0, c("issue_size"))
    df = df.withColumns({
        "ROE_y": safe_divide("NetProfit_y", "Equity_y") * 100, "ROA_y": safe_divide("NetProfit_y", "Assets_y") * 100,
        "EBITDA_Margin_y": safe_divide("EBITDA_y", "Revenue_y") * 100, "NetProfit_Margin_y": safe_divide("NetProfit_y", "Revenue_y") * 100,
        "Debt_Equity_q": safe_divide("Debt_q", "Equity_q"), "Debt_Equity_y": safe_divide("Debt_y", "Equity_y"),
        "NetDebt_EBITDA_y_q": safe_divide("NetDebt_q", "EBITDA_y"), "NetDebt_EBITDA_y_y": safe_divide("NetDebt_y", "EBITDA_y"),
        "EPS_y": c("NetProfit_y") / per * 1e6, "BVPS_q": c("Equity_q") / per * 1e6, "BVPS_y": c("Equity_y") / per * 1e6, "SPS_y": c("Revenue_y") / per * 1e6,
    })
    value = (c(price) * per + c("NetDebt_y") * 1e6) / 1e6
    return df.withColumns({"PE_y": safe_divide(price, "EPS_y"), "PB_q": safe_divide(price, "BVPS_q"), "PB_y": safe_divide(price, "BVPS_y"), "PS_y": safe_divide(price, "SPS_y"), "EV_EBITDA_y": safe_divide(value, "EBITDA_y")})


def ratio_coverage(df: DataFrame, key: str = "secid") -> DataFrame:
    """By key, the ratios with any value, those without, and whether all are there."""
    has = df.groupBy(key).agg(*[(F.count(r) > 0).alias(r) for r in RATIOS])
    names = F.array(*[F.lit(r) for r in RATIOS])
    have = F.filter(F.array(*[F.when(F.col(r), F.lit(r)) for r in RATIOS]), lambda x: x.isNotNull())
    return has.select(key, have.alias("present"), F.array_except(names, have).alias("missing"), (F.size(have) == len(RATIOS)).alias("complete"))
