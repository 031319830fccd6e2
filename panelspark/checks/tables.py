"""Queries of scalars, maintenance, fundamentals, macro, signals and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..operators import digest as dg
from ..operators import fundamentals as fu
from ..operators import indicators as ind
from ..operators import macro as ma
from ..operators import maintenance as mt
from ..operators import models as mo
from ..operators import signals as sg
from ..sources.views import bars, half_up, messages, near, reports, scores, series, table
from . import sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(text: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if text is not None:
            ORACLE_SQL[fn.__name__] = text
        return fn

    return add


# Scans, filters and scalars


@query(f"WITH {sql.BARS} SELECT secid, date, close FROM bars ORDER BY secid, date")
def panel_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("secid", "date", "close").orderBy("secid", "date")


@query(f"WITH {sql.BARS} SELECT secid, date, close FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.filter_dates(bars(spark, sf_dir), "1996-01-01", "1997-06-30").select("secid", "date", "close")


@query(f"WITH {sql.BARS} SELECT secid, date, close FROM bars WHERE date IN (DATE '1996-01-02', DATE '1998-03-04')")
def filter_date_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.filter_date_list(bars(spark, sf_dir), ["1996-01-02", "1998-03-04"]).select("secid", "date", "close")


@query(f"WITH {sql.MESSAGES} SELECT datetime, channel_name, views FROM messages WHERE channel_name NOT IN ('src0', 'src1')")
def exclude_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.exclude_values(messages(spark, sf_dir), "channel_name", ["src0", "src1"]).select("datetime", "channel_name", "views")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price FROM orders WHERE o_orderstatus = 'F'")
def drop_all_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("price"), F.lit(None).cast("double").alias("nothing"))
    return sc.drop_all_null_columns(sc.drop_all_null_rows(t, ["price", "nothing"]))


@query(f"""WITH {sql.BARS}, h AS (SELECT secid, date, CASE WHEN day(date) > 20 OR date > DATE '1995-06-01' THEN close END AS close FROM bars)
SELECT secid, date, close FROM (SELECT *, min(CASE WHEN close IS NOT NULL THEN date END) OVER (PARTITION BY secid) AS f FROM h) WHERE date >= f""")
def trim_leading_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bars(spark, sf_dir).select("secid", "date", F.when((F.dayofmonth("date") > 20) | (F.col("date") > F.lit("1995-06-01").cast("date")), F.col("close")).alias("close"))
    return sc.trim_leading_null(t, "close")


@query("SELECT s_suppkey, s_name, round(s_acctbal, 0) AS s_acctbal FROM supplier")
def round_and_order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "supplier").select("s_acctbal", "s_name", "s_suppkey")
    return sc.order_columns(sc.round_numeric(t, 0), first=["s_suppkey"], last=["s_acctbal"])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1000.0 / c_acctbal END AS ratio FROM customer")
def safe_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", sc.safe_divide(F.lit(1000.0), "c_acctbal").alias("ratio"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '"' || p_size || ' 500"' WHEN 1 THEN p_size || ',5' WHEN 2 THEN p_size || '%' WHEN 3 THEN ';' ELSE p_name END AS text FROM part)
SELECT p_partkey, text, CASE p_partkey % 5 WHEN 0 THEN cast(replace(replace(text, '"', ''), ' ', '') AS double) WHEN 1 THEN cast(replace(text, ',', '.') AS double) WHEN 2 THEN cast(replace(text, '%', '') AS double) / 100 END AS value FROM t""")
def clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit('"'), s, F.lit(' 500"'))).when(k == 1, F.concat(s, F.lit(",5"))).when(k == 2, F.concat(s, F.lit("%"))).when(k == 3, ";").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).withColumn("value", sc.clean_numeric("text"))


@query("""SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS ends,
  make_date(year(o_orderdate), 12, 31) AS year_ends, cast(o_orderdate AS date) AS published, CASE WHEN o_orderpriority LIKE '%HIGH%' THEN 1e9 WHEN o_orderpriority LIKE '%URGENT%' THEN 1e6 ELSE 1.0 END AS scale FROM orders""")
def period_and_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    period = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    label = F.when(F.col("o_orderpriority").contains("HIGH"), "Долг, млрд руб").when(F.col("o_orderpriority").contains("URGENT"), "Долг, Млн руб").otherwise("Долг")
    return t.select("o_orderkey", period.alias("period"), sc.period_end(period).alias("ends"), sc.period_end(F.year("o_orderdate").cast("string")).alias("year_ends"), sc.parse_pub_date(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("published"), sc.unit_scale(label).alias("scale"))


@query("""WITH t AS (SELECT event_id, 'date_' || strftime(ts, '%Y-%m-%d') || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '_chunk_' || event_id % 7 ELSE '_part_x' END AS custom_id, cast(ts AS date) AS d FROM events)
SELECT event_id, custom_id, d AS day, CASE WHEN event_id % 3 = 1 THEN cast(event_id % 7 AS integer) END AS chunk FROM t""")
def id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    cid = F.concat(F.lit("date_"), F.date_format("ts", "yyyy-MM-dd"), F.when(k == 0, "").when(k == 1, F.concat(F.lit("_chunk_"), (F.col("event_id") % 7).cast("string"))).otherwise("_part_x"))
    return table(spark, sf_dir, "events").select("event_id", cid.alias("custom_id")).select("*", sc.id_date("custom_id").alias("day"), sc.id_chunk("custom_id").alias("chunk"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part""")
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").withColumn("text", F.concat(F.replace("p_type", F.lit(" "), F.lit(" ; ")), F.lit(";;")))
    return t.select("p_partkey", F.array_join(sc.split_list("text"), "|").alias("parts"))


@query(f"""WITH {sql.SERIES} SELECT series, date, {sql.near("CASE WHEN lag(value, 1) OVER w <> 0 THEN (value / lag(value, 1) OVER w - 1) * 100 END", 5)} AS value_pct_1,
  {sql.near("CASE WHEN lag(value, 7) OVER w <> 0 THEN (value / lag(value, 7) OVER w - 1) * 100 END", 5)} AS value_pct_7 FROM series WINDOW w AS (PARTITION BY series ORDER BY date)""")
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.pct_change(series(spark, sf_dir), ["value"], (1, 7))
    return out.select("series", "date", near("value_pct_1", 5).alias("value_pct_1"), near("value_pct_7", 5).alias("value_pct_7"))


@query("""SELECT s_suppkey, 'Ромашка ' || s_suppkey AS stripped, s_name AS cleaned, ['Большой ' || s_suppkey] AS aliases FROM supplier""")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey").cast("string")
    t = table(spark, sf_dir, "supplier")
    return t.select("s_suppkey", sc.strip_legal_form(F.concat(F.lit("ПАО  Ромашка ао "), n)).alias("stripped"), sc.clean_name(F.concat(F.lit("«"), "s_name", F.lit('"'))).alias("cleaned"), sc.extract_aliases(F.concat(F.lit("АО «Большой  "), n, F.lit("» (abc) «Большой "), n, F.lit("»"))).alias("aliases"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.tail_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 20, ["o_totalprice", "o_orderkey"])


# Maintenance


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored and new rows that overlap: even keys are stored, keys divisible by three are new."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("date_"), F.date_format("ts", "yyyy-MM-dd"), F.lit("_chunk_"), (F.col("event_id") % 40).cast("string")).alias("id"), F.col("event_id").alias("seq"), "value", F.to_date("ts").alias("date"))
    return e.filter("seq % 2 = 0"), e.filter("seq % 3 = 0").withColumn("value", F.col("value") + 1000)


_HALVES = """e AS (SELECT 'date_' || strftime(ts, '%Y-%m-%d') || '_chunk_' || event_id % 40 AS id, event_id AS seq, value, cast(ts AS date) AS date FROM events),
a AS (SELECT * FROM e WHERE seq % 2 = 0), b AS (SELECT id, seq, value + 1000 AS value, date FROM e WHERE seq % 3 = 0)"""


@query(f"WITH {sql.BARS} SELECT max(date) AS mark FROM bars")
def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.high_water_mark(bars(spark, sf_dir), "date")


@query(f"WITH {_HALVES} SELECT id, seq, value, date FROM a UNION ALL SELECT id, seq, value, date FROM b WHERE id NOT IN (SELECT id FROM a)")
def append_new_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return mt.append_new_dates(b, a, ["id"])


@query(f"WITH {_HALVES}, o AS (SELECT * FROM a WHERE date < DATE '2024-01-20') SELECT * FROM o UNION ALL SELECT * FROM b WHERE date > (SELECT max(date) FROM o)")
def append_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return mt.append_newer(b, a.filter("date < DATE '2024-01-20'"), "date")


@query(f"WITH {_HALVES}, u AS (SELECT *, 0 AS v FROM a UNION ALL SELECT *, 1 FROM b) SELECT id, seq, value, date FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, seq DESC) AS n FROM u) WHERE n = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.upsert_latest(*_halves(spark, sf_dir), "id", "seq")


@query(f"""WITH {_HALVES}, u AS (SELECT *, 0 AS v FROM a UNION ALL SELECT *, 1 FROM b), p AS (SELECT id, seq, value, date FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v, seq) AS n FROM u) WHERE n = 1)
SELECT *, cast(row_number() OVER (ORDER BY cast(string_split(id, '_')[2] AS date), cast(string_split(id, '_')[4] AS integer), id) AS integer) AS position FROM p""")
def merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.merge_first(list(_halves(spark, sf_dir)), "id", "seq")


@query(f"WITH {_HALVES}, u AS (SELECT *, 0 AS v FROM a UNION ALL SELECT *, 1 FROM b) SELECT id, seq, value, date FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v, seq) AS n FROM u) WHERE n = 1")
def merge_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.merge_representatives(*_halves(spark, sf_dir), key="id", time="seq")


@query(f"WITH {_HALVES} SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.merge_clusters(*_halves(spark, sf_dir), key="id")


@query(f"""WITH {_HALVES}, o AS (SELECT * FROM a WHERE date <= DATE '2024-01-15'), m AS (SELECT max(date) AS d FROM o), k AS (SELECT * FROM b WHERE date >= DATE '2024-01-15')
SELECT * FROM o WHERE NOT (date = (SELECT d FROM m) AND EXISTS (SELECT 1 FROM k WHERE date = (SELECT d FROM m))) UNION ALL SELECT * FROM k""")
def replace_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return mt.replace_last_day(a.filter("date <= DATE '2024-01-15'"), b.filter("date >= DATE '2024-01-15'"))


@query(f"WITH {_HALVES} SELECT * FROM a UNION ALL SELECT * FROM b")
def append_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.append_results(*_halves(spark, sf_dir))


@query(f"WITH {_HALVES}, n AS (SELECT id, seq, row_number() OVER (ORDER BY date, seq) - 1 AS n FROM e) SELECT id, seq, cast(CASE WHEN n < 525 THEN 0 ELSE floor((n - 525) / 300.0) + 1 END AS integer) AS part FROM n")
def assign_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("date_"), F.date_format("ts", "yyyy-MM-dd"), F.lit("_chunk_"), (F.col("event_id") % 40).cast("string")).alias("id"), F.col("event_id").alias("seq"), F.to_date("ts").alias("date"))
    return mt.assign_parts(e, 525, 300, "date", ["seq"]).select("id", "seq", "part")


@query(f"WITH {sql.BARS} SELECT secid, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, 'ok' AS status FROM bars GROUP BY secid")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.run_report(bars(spark, sf_dir))


@query("SELECT cast(user_id AS varchar) || '_' || strftime(ts, '%Y-%m-%d') AS id, event_id AS seq, value FROM events WHERE cast(user_id AS varchar) || '_' || strftime(ts, '%Y-%m-%d') NOT IN (SELECT cast(user_id AS varchar) || '_' || strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'error')")
def missing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users on days without an error of theirs."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("id"), F.col("event_id").alias("seq"), "value", "event_type")
    return mt.missing_records(e.drop("event_type"), e.filter("event_type = 'error'").select("id"), "id")


# Fundamentals, macro, calendar

_METRICS = ["Revenue", "NetProfit", "EBITDA", "Assets", "Equity", "Debt", "Cash"]
_LAST = "(SELECT cast(max(l_shipdate) AS timestamp) FROM lineitem)"


def _end(spark: SparkSession, sf_dir: str) -> str:
    """The last day of any bar."""
    return str(table(spark, sf_dir, "lineitem").agg(F.max(F.to_date("l_shipdate"))).first()[0])


_PIVOT = ", ".join(f"avg(CASE WHEN metric = '{m}' AND report_type = '{r}' THEN value END) AS \"{m}{s}\"" for m in _METRICS for s, r in (("_q", "quarterly"), ("_y", "yearly")))
_NAMES = [f"{m}{s}" for m in _METRICS for s in ("_q", "_y")]
_WIDE = f"wide AS (SELECT ticker, publication_date AS date, {_PIVOT} FROM reports GROUP BY ALL)"
_CARRY = ", ".join(f'last_value("{n}" IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS "{n}"' for n in _NAMES)
_DAYS = f"""days AS (SELECT ticker, unnest(generate_series(cast(min(date) AS timestamp), {_LAST}, INTERVAL 1 DAY))::date AS date FROM (SELECT ticker, min(date) AS date FROM wide GROUP BY ticker) GROUP BY ticker),
dense AS (SELECT d.ticker, d.date, {", ".join(f'w."{n}"' for n in _NAMES)} FROM days d LEFT JOIN wide w USING (ticker, date)),
daily AS (SELECT ticker, date, {_CARRY} FROM dense),
fin AS (SELECT ticker, date, {", ".join(f'round("{n}" / 1e6, 1) AS "{n}"' for n in _NAMES)}, round(("Debt_q" - "Cash_q") / 1e6, 1) AS "NetDebt_q", round(("Debt_y" - "Cash_y") / 1e6, 1) AS "NetDebt_y" FROM daily)"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fu.pivot_metrics(fu.latest_restatement(reports(spark, sf_dir)), _METRICS)
    return fu.finish_fundamentals(fu.net_debt(fu.daily_asof(wide, _end(spark, sf_dir))))


@query(f"""WITH {sql.REPORTS}, d AS (SELECT * FROM reports UNION ALL SELECT ticker, report_type, period_end, cast(publication_date + to_days(20) AS date), metric, value * 2 FROM reports WHERE metric = 'Debt')
SELECT ticker, report_type, period_end, publication_date, metric, value FROM (SELECT *, row_number() OVER (PARTITION BY ticker, report_type, period_end, metric ORDER BY publication_date DESC, value DESC) AS n FROM d) WHERE n = 1""")
def latest_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    again = r.filter("metric = 'Debt'").withColumns({"publication_date": F.date_add("publication_date", 20), "value": F.col("value") * 2})
    return fu.latest_restatement(r.unionByName(again))


_CENTS = "cast(round(value * 100) AS bigint)"
_PUBLISHED = "CASE year(period_end) % 3 WHEN 0 THEN period_end - 10 WHEN 1 THEN publication_date + 5 END"


def _report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as cells of sheets: labels with units, numbers with comma, a row of dates in part, and
    further rows whose labels begin as a metric's do."""
    r = reports(spark, sf_dir)
    of = F.create_map(*[F.lit(x) for m in _METRICS for x in (m, fu.METRIC_LABELS[m][0])])
    at = F.create_map(*[F.lit(x) for i, m in enumerate(_METRICS) for x in (m, 10 + i)])
    period = F.when(F.col("report_type") == "yearly", F.year("period_end").cast("string")).otherwise(F.concat(F.year("period_end"), F.lit("Q"), F.quarter("period_end")))
    r = r.withColumns({"file": F.concat_ws("-", "ticker", "report_type"), "period": period, "cents": F.expr(_CENTS), "published": F.expr(_PUBLISHED)})
    text = F.concat(F.when(F.col("cents") < 0, "-").otherwise(" "), F.expr("cast(abs(cents) div 100 AS string)"), F.lit(","), F.expr("lpad(cast(abs(cents) % 100 AS string), 2, '0')"))
    keys = ["file", "ticker", "report_type"]
    cells = r.select(*keys, at[F.col("metric")].alias("row_no"), F.concat(of[F.col("metric")], F.lit(", млн руб")).alias("label"), "period", text.alias("text"))
    other = r.select(*keys, (at[F.col("metric")] + 50).alias("row_no"), F.concat(of[F.col("metric")], F.lit(" на акцию")).alias("label"), "period", F.lit("1").alias("text"))
    dates = r.select(*keys, F.lit(1).alias("row_no"), F.lit(fu.DATE_LABEL).alias("label"), "period", F.date_format("published", "dd.MM.yyyy").alias("text")).distinct()
    return cells.unionByName(other).unionByName(dates)


@query(f"""WITH {sql.REPORTS}, p AS (SELECT *, cast({_PUBLISHED} AS date) AS published, {_CENTS} AS cents FROM reports WHERE year(period_end) >= 1996)
SELECT ticker, report_type, period_end, coalesce(published, cast(period_end + CASE WHEN report_type = 'yearly' THEN 90 ELSE 45 END AS date)) AS publication_date, metric, (cents / 100.0)::double * 1e6 AS value FROM p WHERE published IS NULL OR published >= period_end""")
def parse_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of all report sheets, with their dates of publication."""
    return fu.reports_long(_report_cells(spark, sf_dir), 1996)


@query(f"WITH {sql.REPORTS}, {_WIDE} SELECT * FROM wide")
def pivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.pivot_metrics(reports(spark, sf_dir), _METRICS)


@query(f"WITH {sql.REPORTS}, {_WIDE}, {_DAYS} SELECT * FROM daily")
def daily_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.daily_asof(fu.pivot_metrics(reports(spark, sf_dir), _METRICS), _end(spark, sf_dir))


@query(f"WITH {sql.REPORTS}, {_WIDE}, {_DAYS} SELECT * FROM fin")
def daily_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir)


@query(f"""WITH {sql.BARS}, {sql.REPORTS}, {_WIDE}, {_DAYS}, l AS (SELECT secid, date, close, cast(cast(secid AS integer) % 25 AS varchar) AS ticker FROM bars)
SELECT l.secid, l.date, l.close, l.ticker, w."Revenue_q", w."Debt_y" FROM l ASOF LEFT JOIN daily w ON l.ticker = w.ticker AND l.date >= w.date""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = bars(spark, sf_dir).select("secid", "date", "close", (F.col("secid").cast("int") % 25).cast("string").alias("ticker"))
    return fu.asof_join(left, fu.pivot_metrics(reports(spark, sf_dir), _METRICS).select("ticker", "date", "Revenue_q", "Debt_y"), "ticker")


_RATIO_SQL = {
    "ROE_y": ('"NetProfit_y"', '"Equity_y"', 100), "ROA_y": ('"NetProfit_y"', '"Assets_y"', 100), "EBITDA_Margin_y": ('"EBITDA_y"', '"Revenue_y"', 100), "NetProfit_Margin_y": ('"NetProfit_y"', '"Revenue_y"', 100),
    "Debt_Equity_q": ('"Debt_q"', '"Equity_q"', 1), "Debt_Equity_y": ('"Debt_y"', '"Equity_y"', 1), "NetDebt_EBITDA_y_q": ('"NetDebt_q"', '"EBITDA_y"', 1), "NetDebt_EBITDA_y_y": ('"NetDebt_y"', '"EBITDA_y"', 1),
}
_SD = lambda n, d, k=1: f"(CASE WHEN {d} > 0 THEN {n} / {d} END * {k})"
_PER = {"EPS_y": '"NetProfit_y"', "BVPS_q": '"Equity_q"', "BVPS_y": '"Equity_y"', "SPS_y": '"Revenue_y"'}
_RATIOS_CTE = f"""priced AS (SELECT f.*, b.close, CASE WHEN n.n > 0 THEN n.n END AS size FROM fin f JOIN (SELECT secid AS ticker, date, close FROM bars) b USING (ticker, date) LEFT JOIN (SELECT cast(c_nationkey AS varchar) AS ticker, count(*) * 100.0 - 300 AS n FROM customer GROUP BY ALL) n USING (ticker)),
per AS (SELECT *, {", ".join(f'{_SD(n, d, k)} AS "{r}"' for r, (n, d, k) in _RATIO_SQL.items())}, {", ".join(f'{x} / size * 1e6 AS "{r}"' for r, x in _PER.items())} FROM priced),
ratios AS (SELECT *, {_SD("close", '"EPS_y"')} AS "PE_y", {_SD("close", '"BVPS_q"')} AS "PB_q", {_SD("close", '"BVPS_y"')} AS "PB_y", {_SD("close", '"SPS_y"')} AS "PS_y", {_SD('((close * size + "NetDebt_y" * 1e6) / 1e6)', '"EBITDA_y"')} AS "EV_EBITDA_y" FROM per)"""


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir).join(bars(spark, sf_dir).select(F.col("secid").alias("ticker"), "date", "close"), ["ticker", "date"])
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("ticker")).agg((F.count("*") * 100.0 - 300).alias("issue_size")).withColumn("date", F.lit("1990-01-01").cast("date"))
    return fu.financial_ratios(fu.with_issue_size(daily, sizes, "ticker"))


@query(f"WITH {sql.BARS}, {sql.REPORTS}, {_WIDE}, {_DAYS}, {_RATIOS_CTE} SELECT ticker, date, {', '.join(f'{sql.near(chr(34) + r + chr(34), 4)} AS {chr(34)}{r}{chr(34)}' for r in fu.RATIOS)} FROM ratios")
def financial_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir).select("ticker", "date", *[near(r, 4).alias(r) for r in fu.RATIOS])


@query(f"WITH {sql.BARS}, {sql.REPORTS}, {_WIDE}, {_DAYS}, {_RATIOS_CTE}, c AS (SELECT ticker, {' + '.join(f'cast(count({chr(34)}{r}{chr(34)}) > 0 AS integer)' for r in fu.RATIOS)} AS n_present FROM ratios GROUP BY ticker) SELECT ticker, n_present, n_present = 17 AS complete FROM c")
def ratio_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fu.ratio_coverage(_ratios(spark, sf_dir), "ticker")
    return out.select("ticker", F.size("present").alias("n_present"), "complete")


_SERIES_NAMES = ["1_urgent", "2_high", "3_medium", "4_not_specified", "5_low"]
_MACRO = "macro AS (SELECT date, " + ", ".join(f"max(CASE WHEN series = '{n}' THEN value END) AS \"{n}\"" for n in _SERIES_NAMES) + " FROM series GROUP BY date)"


@query(f"WITH {sql.SERIES}, {_MACRO} SELECT * FROM macro")
def macro_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ma.macro_table(series(spark, sf_dir), _SERIES_NAMES)


@query(f"""WITH {sql.SERIES}, m AS (SELECT date_trunc('month', date)::date AS date, {sql.near("avg(value)", 2)} AS cpi FROM series GROUP BY 1),
d AS (SELECT unnest(generate_series(cast(min(date) AS timestamp), {_LAST}, INTERVAL 1 DAY))::date AS date FROM m) SELECT d.date, m.cpi FROM d ASOF JOIN m ON d.date >= m.date""")
def monthly_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = series(spark, sf_dir).groupBy(F.date_format("date", "MM.yyyy").alias("month")).agg(near(F.avg("value"), 2).alias("cpi"))
    return ma.monthly_to_daily(m, _end(spark, sf_dir))


@query(f"""WITH {sql.BARS}, {sql.SERIES}, {sql.REPORTS}, {_WIDE}, {_DAYS}, {_MACRO}
SELECT b.secid, b.date, b.close, f."Revenue_q", f."NetDebt_y", m."1_urgent", m."5_low" FROM bars b LEFT JOIN fin f ON f.ticker = b.secid AND f.date = b.date LEFT JOIN macro m ON m.date = b.date""")
def merge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    fin = _daily(spark, sf_dir).select(F.col("ticker").alias("secid"), "date", "Revenue_q", "NetDebt_y")
    out = ma.merge_features(bars(spark, sf_dir).select("secid", "date", "close"), fin, ma.macro_table(series(spark, sf_dir), _SERIES_NAMES))
    return out.select("secid", "date", "close", "Revenue_q", "NetDebt_y", "1_urgent", "5_low")


@query(f"""WITH {sql.BARS}, p AS (SELECT DISTINCT date FROM bars), n AS (SELECT cast(o_orderdate AS date) AS date, count(*) AS n FROM orders GROUP BY 1),
h AS (SELECT date + 2557 AS date FROM n WHERE n < 0.9 * (SELECT avg(n) FROM n)), s AS (SELECT min(date) AS lo, max(date) AS hi FROM p),
d AS (SELECT unnest(generate_series(cast(lo - 30 AS timestamp), cast(hi + 400 AS timestamp), INTERVAL 1 DAY))::date AS date FROM s)
SELECT date, CASE WHEN date > hi THEN isodow(date) < 6 AND date NOT IN (SELECT date FROM h) WHEN date >= lo THEN date IN (SELECT date FROM p) ELSE false END AS is_trading_day FROM d, s""")
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of all bars, and a year after them whose holidays are the quiet order days seven years before."""
    p = bars(spark, sf_dir).select("date").distinct()
    n = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    h = n.join(F.broadcast(n.agg(F.avg("n").alias("mean")))).filter("n < 0.9 * mean").select(F.date_add("date", 2557).alias("date"))
    lo, hi = p.agg(F.date_sub(F.min("date"), 30).cast("string"), F.date_add(F.max("date"), 400).cast("string")).first()
    return ma.trading_calendar(spark, p, h, lo, hi)


# Signals, targets, evaluation

_ROLL = f"""{sql.SCORES}, r AS (SELECT *, isodow(date) < 6 AS open, max(CASE WHEN isodow(date) < 6 THEN date END) OVER (PARTITION BY source, secid ORDER BY date ROWS UNBOUNDED PRECEDING) AS day FROM scores),
g AS (SELECT source, secid, day AS date, max(CASE WHEN open THEN score END) AS own, avg(CASE WHEN NOT open THEN score END) AS b FROM r WHERE day IS NOT NULL GROUP BY ALL),
rolled AS (SELECT source, secid, date, {sql.round_half("(CASE WHEN b IS NULL THEN own WHEN own IS NULL OR own = 0 THEN b ELSE (1 - 0.6) * own + 0.6 * b END)", 2)} AS score FROM g)"""
_NONZERO = lambda c, n, keys: sql.round_half(f"(avg(CASE WHEN {c} <> 0 THEN {c} END) OVER (PARTITION BY {keys} ORDER BY date ROWS {n - 1} PRECEDING))", 2)


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("date").distinct().withColumn("is_trading_day", ~F.dayofweek("date").isin(1, 7))


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user relates to the indices of the next two users; the third is the market."""
    ids = scores(spark, sf_dir).select("secid").distinct()
    at = F.col("secid").cast("long")
    return ids.select("secid", F.concat_ws("; ", (at + 1).cast("string"), (at + 2).cast("string"), F.lit("3")).alias("indices"))


@query(f"WITH {_ROLL} SELECT * FROM rolled")
def rollup_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.rollup_scores(scores(spark, sf_dir), _calendar(spark, sf_dir))


@query(f"WITH {_ROLL} SELECT *, {_NONZERO('score', 15, 'source, secid')} AS score_roll_15, {_NONZERO('score', 50, 'source, secid')} AS score_roll_50 FROM rolled")
def rolling_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.rolling_nonzero(sg.rollup_scores(scores(spark, sf_dir), _calendar(spark, sf_dir)), "score")


_INDEX = f"""m AS (SELECT DISTINCT secid, unnest([cast(cast(secid AS bigint) + 1 AS varchar), cast(cast(secid AS bigint) + 2 AS varchar), '3']) AS index FROM scores),
idx AS (SELECT m.secid, r.source, r.date, max(CASE WHEN m.index = '3' THEN r.score END) AS market_score, {sql.round_half("avg(CASE WHEN m.index <> '3' THEN r.score END)", 2)} AS index_score FROM m JOIN rolled r ON r.secid = m.index GROUP BY ALL)"""


@query(f"WITH {_ROLL}, {_INDEX} SELECT * FROM idx")
def index_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = sg.rollup_scores(scores(spark, sf_dir), _calendar(spark, sf_dir))
    return sg.index_scores(rolled, _mapping(spark, sf_dir), market="3")


@query(f"""WITH {_ROLL}, p AS (SELECT DISTINCT secid, date FROM scores), o AS (SELECT *, {_NONZERO('score', 15, 'source, secid')} AS r15 FROM rolled)
SELECT p.secid, p.date, b.score AS blog_score, b.r15 AS blog_score_roll_15, n.score AS news_score, n.r15 AS news_score_roll_15 FROM p LEFT JOIN (SELECT * FROM o WHERE source = 'blog') b USING (secid, date) LEFT JOIN (SELECT * FROM o WHERE source = 'news') n USING (secid, date)""")
def signal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    out = sg.signal_features(s.select("secid", "date").distinct(), s, _calendar(spark, sf_dir), _mapping(spark, sf_dir))
    return out.select("secid", "date", "blog_score", "blog_score_roll_15", "news_score", "news_score_roll_15")


_GROUPS = [f"T{i}" for i in range(10)]
_GROUP = "'T' || cast(secid AS bigint) % 10"


@query(f"WITH {sql.SCORES} SELECT date, 'news' AS source, {_GROUP} AS secid, max(score) AS score FROM scores GROUP BY ALL HAVING max(score) IS NOT NULL")
def load_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest score of ten groups of users, one column each, read back as rows."""
    return sg.load_scores(grouped_scores(scores(spark, sf_dir)).withColumn("summary", F.lit("x")), "news")


def grouped_scores(rows: DataFrame) -> DataFrame:
    """One row a day with the largest score of each of ten groups of users."""
    return rows.withColumn("group", F.expr("concat('T', cast(secid AS bigint) % 10)")).groupBy("date").pivot("group", _GROUPS).agg(F.max("score"))


_LEAD = lambda h: f"(lead(close, {h}) OVER (PARTITION BY secid ORDER BY date) / close - 1)"


@query(f"WITH {sql.BARS} SELECT secid, date, {', '.join(f'{sql.near(_LEAD(h), 6)} AS target_{h}d' for h in (1, 3, 7, 30, 180))} FROM bars")
def ratio_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.ratio_targets(bars(spark, sf_dir)).select("secid", "date", *[near(f"target_{h}d", 6).alias(f"target_{h}d") for h in (1, 3, 7, 30, 180)])


@query(f"WITH {sql.BARS} SELECT secid, date, {', '.join(f'{sql.near(_LEAD(h) + chr(32) + chr(42) + chr(32) + chr(49) + chr(48) + chr(48), 3)} AS target_{h}d, cast(coalesce({_LEAD(h)} > 0, false) AS integer) AS target_{h}d_binary' for h in (1, 30, 365))} FROM bars")
def pct_and_binary_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hs = (1, 30, 365)
    t = sg.binary_targets(sg.pct_targets(bars(spark, sf_dir), hs, digits=12), hs)
    return t.select("secid", "date", *[near(f"target_{h}d", 3).alias(f"target_{h}d") for h in hs], *[f"target_{h}d_binary" for h in hs])


@query(f"WITH {sql.BARS} SELECT secid, date, close, cast(NULL AS double) AS target_pred FROM bars")
def ensure_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.ensure_columns(bars(spark, sf_dir).select("secid", "date", "close"), ["close", "target_pred"])


@query(f"WITH {sql.BARS}, w AS (SELECT * FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31') SELECT secid, date, close, {sql.near(_LEAD(7), 6)} AS target_7d FROM w")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sg.training_set(bars(spark, sf_dir), "1996-01-01", "1999-12-31", (7,))
    return t.select("secid", "date", "close", near("target_7d", 6).alias("target_7d"))


@query(f"""WITH {sql.BARS}, d AS (SELECT date, count(*) AS n FROM bars GROUP BY date), s AS (SELECT date, (sum(n) OVER (ORDER BY date) - n) / cast(sum(n) OVER () AS double) AS share FROM d)
SELECT secid, date, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.85 THEN 'val' ELSE 'test' END AS part FROM bars JOIN s USING (date)""")
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.ordered_split(bars(spark, sf_dir).select("secid", "date"), 0.7, 0.15)


@query(f"WITH {sql.BARS}, d AS (SELECT date, cast(ntile(6) OVER (ORDER BY date) - 1 AS integer) AS fold FROM (SELECT DISTINCT date FROM bars)) SELECT secid, date, fold FROM bars JOIN d USING (date)")
def time_series_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.time_series_folds(bars(spark, sf_dir).select("secid", "date"))


@query("""WITH r AS (SELECT toxic AS truth, (doc_id * 37 % 101) / 101.0 AS score, quality FROM labels), c AS (SELECT count(*) FILTER (truth = 1 AND score >= 0.5) AS tp, count(*) FILTER (truth = 0 AND score >= 0.5) AS fp, count(*) FILTER (truth = 1 AND score < 0.5) AS fn, count(*) FILTER (truth = 0 AND score < 0.5) AS tn FROM r),
a AS (SELECT sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM r p, r q WHERE p.truth = 1 AND q.truth = 0)
SELECT tp + fp + fn + tn AS n, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(auc, 6) AS roc_auc FROM c, a""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels").select(F.col("toxic").alias("truth"), (F.col("doc_id") * 37 % 101 / 101.0).alias("score"))
    return mo.classification_metrics(t, "truth", "score").select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@query(f"""WITH {sql.BARS}, t AS (SELECT secid, {_LEAD(1)} * 100 AS y, (close / open - 1) * 100 AS p FROM bars), r AS (SELECT * FROM t WHERE y IS NOT NULL)
SELECT secid, count(*) AS n, {sql.near("avg(abs(y - p))", 5)} AS mae, {sql.near("sqrt(avg((y - p) * (y - p)))", 5)} AS rmse, {sql.near("1 - avg((y - p) * (y - p)) / var_pop(y)", 5)} AS r2, {sql.near("avg(cast(sign(y) = sign(p) AS integer))", 5)} AS sign_accuracy FROM r GROUP BY secid""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ind.before  # noqa: F841  same ordering as the indicators
    w = Window.partitionBy("secid").orderBy("date")
    rows = bars(spark, sf_dir).select("secid", ((F.lead("close").over(w) / F.col("close") - 1) * 100).alias("y"), ((F.col("close") / F.col("open") - 1) * 100).alias("p"))
    return mo.regression_metrics(rows, "y", "p", ["secid"]).select("secid", "n", *[near(c, 5).alias(c) for c in ("mae", "rmse", "r2", "sign_accuracy")])


@query("""WITH r AS (SELECT cast(p_size AS varchar) AS target, CASE p_partkey % 2 WHEN 0 THEN 'base' ELSE 'extended' END AS fs, p_retailprice AS m FROM part), w AS (SELECT target, avg(m) FILTER (fs = 'base') AS base, avg(m) FILTER (fs = 'extended') AS extended FROM r GROUP BY target)
SELECT target, round(base, 4) AS base, round(extended, 4) AS extended, round((extended / base - 1) * 100, 4) AS extended_gain FROM w""")
def summarize_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("target"), F.when(F.col("p_partkey") % 2 == 0, "base").otherwise("extended").alias("feature_set"), F.col("p_retailprice").cast("string").alias("m"))
    out = mo.summarize_results(t, "m", "base", names=["base", "extended"])
    return out.select("target", *[F.round(c, 4).alias(c) for c in ("base", "extended", "extended_gain")])


# Digests


@query(f"""WITH {sql.SCORES}, s AS (SELECT date, source, CASE WHEN cast(secid AS integer) % 10 = 0 THEN 'MOEX' || secid ELSE 'T' || secid END AS secid, score FROM scores),
v AS (SELECT *, row_number() OVER (PARTITION BY date, source ORDER BY starts_with(secid, 'MOEX') DESC, abs(score) DESC, secid) AS n FROM s WHERE score <> 0),
k AS (SELECT date, source, n, '#' || secid || ' : ' || CASE WHEN score > 0 THEN '+' ELSE '-' END || format('{{:.1f}}', abs(score)) AS t FROM v WHERE n <= 5),
l AS (SELECT date, source, (n - 1) // 3 AS line, string_agg(t, ' | ' ORDER BY n) AS x FROM k GROUP BY ALL), a AS (SELECT date, source, string_agg(x, chr(10) ORDER BY line) || chr(10) AS top FROM l GROUP BY ALL)
SELECT d.date, d.source, coalesce(a.top, 'Нет оценок') AS top FROM (SELECT DISTINCT date, source FROM s) d LEFT JOIN a USING (date, source)""")
def top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("secid").cast("int") % 10 == 0, F.concat(F.lit("MOEX"), "secid")).otherwise(F.concat(F.lit("T"), "secid"))
    return dg.top_scores(scores(spark, sf_dir).withColumn("secid", name), 5)


@query(f"""WITH {sql.SCORES}, d AS (SELECT date, source, count(*) AS n, max(score) AS best FROM scores GROUP BY ALL), t AS ({ORACLE_SQL["top_scores"]})
SELECT date, source, '📰 ' || strftime(date, '%d.%m.%Y') || ' (' || source || ')' || chr(10) || chr(10) || '🔹 ' || n || ' млн. Scores.' || chr(10) || chr(10) || '🔹 Best ' || cast(best AS integer) || '!' || chr(10) || chr(10) || top AS message FROM d JOIN t USING (date, source)""")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole messages of every day and source: title, a summary's sentences, the best scores."""
    name = F.when(F.col("secid").cast("int") % 10 == 0, F.concat(F.lit("MOEX"), "secid")).otherwise(F.concat(F.lit("T"), "secid"))
    s = scores(spark, sf_dir)
    days = s.groupBy("date", "source").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    summary = F.concat(F.col("n").cast("string"), F.lit(" млн. Scores. Best "), F.col("best").cast("int").cast("string"), F.lit("!"))
    return dg.digest(days.select("date", "source", summary.alias("summary")), s.withColumn("secid", name), 5)


@query("""WITH t AS (SELECT conv_id, turn, str_split(regexp_replace(' Рост 5 млн. руб. за год.  ' || text, '([.!?])[ \\t\\n]+([A-ZА-Я"''«])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS x FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_transform(x, lambda s: trim(s, ' ' || chr(10) || chr(9))), lambda s: s <> ''), lambda s: '🔹 ' || s), chr(10) || chr(10)) AS summary FROM t""")
def format_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's sentences as bullets, after a first sentence with two abbreviations."""
    raw = F.concat(F.lit(" Рост 5 млн. руб. за год.  "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", dg.format_summary(raw).alias("summary"))


@query("""SELECT doc_id, 'see [SRC' || n || '](https://x/' || n || ') now' || chr(10) || '_Оценки (auto)_' AS text FROM (SELECT doc_id, doc_id % 3 AS n FROM documents)""")
def linkify_italicize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("see SRC"), (F.col("doc_id") % 3).cast("string"), F.lit(" now\nОценки (auto)"))
    return table(spark, sf_dir, "documents").select("doc_id", dg.italicize(dg.linkify(raw, {f"src{i}": f"https://x/{i}" for i in range(3)})).alias("text"))


@query(f"WITH {sql.SCORES}, d AS (SELECT DISTINCT date, source FROM scores) SELECT date, source, CASE WHEN source = 'news' THEN 0 ELSE 1 END AS rank FROM d WHERE NOT (source = 'blog' AND day(date) < 11)")
def unpublished(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scores(spark, sf_dir).select("date", "source").distinct()
    return dg.unpublished(d, d.filter((F.col("source") == "blog") & (F.dayofmonth("date") < 11)))


# Text


@query(f"WITH {sql.MESSAGES} SELECT datetime, channel_name, 'https://' || message_link AS message_link, views, trim(regexp_replace(news, '\\s+', ' ', 'g')) AS news FROM messages")
def normalize_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.normalize_messages(messages(spark, sf_dir))


_CLEAN_CFG = tx.CleanConfig(filter_words=("zzzz",), obscene=("worthless",), rm_substrings=("License",))
_EMOJI_SQL = "[" + "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in (("1F1E0", "1F1FF"), ("1F300", "1F5FF"), ("1F600", "1F64F"), ("1F680", "1F6FF"), ("1F700", "1F77F"), ("1F780", "1F7FF"), ("1F800", "1F8FF"), ("1F900", "1F9FF"), ("1FA00", "1FAFF"), ("2300", "2BFF"), ("FE0E", "FE0F"))) + "]"


@query(None)
def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned messages; the steps have queries with SQL of their own, and tests cover the whole."""
    return tx.process_messages(messages(spark, sf_dir), _CLEAN_CFG)[0]


@query(f"""SELECT doc_id, regexp_replace(text, '{_EMOJI_SQL}', '', 'g') AS no_emoji, regexp_replace(text, '#[\\p{{L}}\\p{{N}}_]+', '', 'g') AS no_tags, regexp_replace(text, '\\s@[\\p{{L}}\\p{{N}}_]+', '', 'g') AS no_users,
  regexp_replace(regexp_replace(text, 'http[^\\s]+|www\\.[^\\s]+', '', 'g'), '[^\\s]+\\.(ru|me|com|org)/[^\\s]+', '', 'g') AS no_urls,
  replace(replace(replace(replace(replace(replace(text, '. .', '.'), '..', '.'), '« ', '«'), ' »', '»'), ' :', ':'), chr(160), ' ') AS punct,
  array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: length(p) >= 3), chr(10)) AS paragraphs FROM documents""")
def clean_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.remove_emoji(t).alias("no_emoji"), tx.remove_hashtags(t).alias("no_tags"), tx.remove_users(t).alias("no_users"), tx.remove_urls(t).alias("no_urls"), tx.fix_punct(t).alias("punct"), tx.fix_paragraphs(t).alias("paragraphs"))


@query("SELECT s_suppkey, 'cbershch' || regexp_replace(lower(s_name), '[-_. ]', '', 'g') || 'byu' AS name FROM supplier")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names between letters that map to one, two and no Latin ones."""
    raw = F.concat(F.lit("Сбер-Ш.Чь "), F.col("s_name"), F.lit("_ВЮ"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", tx.normalize_name(raw).alias("name"))


@query("SELECT doc_id, cast(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS integer) AS n_tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_count(F.col("text")).alias("n_tokens"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM documents) GROUP BY token")
def corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(tx.lower_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
