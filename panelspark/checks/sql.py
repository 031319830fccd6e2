"""SQL of the table views and of exponentially weighted means, for comparison on another engine."""

from __future__ import annotations


def half_up(x: str, digits: int) -> str:
    p = float(10**digits)
    return f"(floor(({x}) * {p} + 0.5) / {p})"


def near(x: str, digits: int) -> str:
    """Rounded with the tie point moved off decimal fractions, so that sums in another order agree."""
    p = float(10**digits)
    return f"(floor(({x}) * {p} + 0.4567) / {p})"


def round_half(x: str, digits: int) -> str:
    p = float(10**digits)
    return f"(sign({x}) * floor(abs({x}) * {p} + 0.500000001) / {p})"


_PRICE = half_up("l_extendedprice / l_quantity", 2)
BARS = f"""bars AS (
  SELECT cast(l_suppkey AS varchar) AS secid, cast(l_shipdate AS date) AS date,
    arg_min({_PRICE}, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open, max({_PRICE}) AS high, min({_PRICE}) AS low,
    arg_max({_PRICE}, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close,
    sum(l_quantity) AS volume, {half_up("sum(l_extendedprice) / sum(l_quantity)", 2)} AS waprice
  FROM lineitem GROUP BY ALL)"""
SERIES = f"""series AS (
  SELECT cast(o_orderdate AS date) AS date, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') AS series, {half_up("avg(o_totalprice)", 2)} AS value
  FROM orders GROUP BY ALL)"""
MESSAGES = """messages AS (
  SELECT make_timestamp((1704067200 + doc_id * 60) * 1000000) AS datetime, source AS channel_name, 't.me/c/' || doc_id AS message_link, n_chars AS views, text AS news
  FROM documents)"""
SCORES = """scores AS (
  SELECT cast(ts AS date) AS date, CASE WHEN event_type IN ('click', 'view') THEN 'blog' ELSE 'news' END AS source, cast(user_id AS varchar) AS secid,
    max(cast(cast(floor(value) AS bigint) % 7 - 3 AS double)) AS score
  FROM events GROUP BY ALL)"""
def _part(status: str) -> str:
    return half_up(f"sum(CASE WHEN o_orderstatus = '{status}' THEN o_totalprice ELSE 0 END)", 2)


REPORTS = f"""reports AS (
  WITH t AS (SELECT cast(c_nationkey AS varchar) AS ticker, cast(o_orderdate AS date) AS d, o_totalprice, c_acctbal, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey),
  b AS (
    SELECT *, 'quarterly' AS report_type, last_day(make_date(year(d), quarter(d) * 3, 1)) AS period_end FROM t
    UNION ALL SELECT *, 'yearly', make_date(year(d), 12, 31) FROM t),
  g AS (
    SELECT ticker, report_type, period_end, {half_up("sum(o_totalprice)", 2)} AS "Revenue", {half_up("sum(c_acctbal) * 20", 2)} AS "NetProfit", {_part("P")} AS "EBITDA",
      {half_up("max(o_totalprice) * 100", 2)} AS "Assets", {half_up("min(o_totalprice) * 100", 2)} AS "Equity", {_part("F")} AS "Debt", {_part("O")} AS "Cash"
    FROM b GROUP BY ALL)
  SELECT ticker, report_type, period_end, cast(period_end + to_days(CASE WHEN report_type = 'yearly' THEN 90 ELSE 45 END) AS date) AS publication_date, metric, value
  FROM (UNPIVOT g ON "Revenue", "NetProfit", "EBITDA", "Assets", "Equity", "Debt", "Cash" INTO NAME metric VALUE value))"""


def ewm(name: str, source: str, specs: dict[str, tuple[str, float]]) -> str:
    """CTEs ``name(secid, date, <out>...)``: the direct recursion, row by row, with the gap rule."""
    xs = {o: f"x_{i}" for i, o in enumerate(specs)}
    seq = ", ".join(f"{c} AS {xs[o]}" for o, (c, _) in specs.items())
    first = ", ".join(f"cast({x} AS double) AS y_{x}, 0 AS g_{x}" for x in xs.values())
    step = ", ".join(
        f"CASE WHEN s.{x} IS NULL THEN y_{x} WHEN y_{x} IS NULL THEN s.{x} ELSE (pow({1.0 - a!r}, g_{x} + 1) * y_{x} + {a!r} * s.{x}) / (pow({1.0 - a!r}, g_{x} + 1) + {a!r}) END, CASE WHEN s.{x} IS NULL THEN g_{x} + 1 ELSE 0 END"
        for x, (_, a) in zip(xs.values(), specs.values(), strict=True)
    )
    out = ", ".join(f'y_{x} AS "{o}"' for o, x in xs.items())
    return f"""{name}_s AS MATERIALIZED (SELECT secid, date, row_number() OVER (PARTITION BY secid ORDER BY date) AS r, {seq} FROM {source}),
{name}_r AS (
  SELECT secid, date, r, {first} FROM {name}_s WHERE r = 1
  UNION ALL SELECT s.secid, s.date, s.r, {step} FROM {name}_r p JOIN {name}_s s ON s.secid = p.secid AND s.r = p.r + 1),
{name} AS (SELECT secid, date, {out} FROM {name}_r)"""


def full(x: str, n: int, fn: str) -> str:
    w = f"OVER (PARTITION BY secid ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {w} = {n} THEN {fn}({x}) {w} END)"


def lag(x: str, k: int = 1) -> str:
    return f"(lag({x}, {k}) OVER (PARTITION BY secid ORDER BY date))"


def so_far(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN sum({x}) OVER (PARTITION BY secid ORDER BY date ROWS UNBOUNDED PRECEDING) END)"


def shown(cols: list[str], source: str, digits: int = 4) -> str:
    """Final SELECT of rounded columns."""
    return "SELECT secid, date, " + ", ".join(f'{near(chr(34) + c + chr(34), digits)} AS "{c}"' for c in cols) + f" FROM {source}"
