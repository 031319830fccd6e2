"""Scalar cleaning and table-shape helpers. Missing is null; text that can't be read is null too."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half(c: Column | str, digits: int) -> Column:
    """Round halves away from zero, where a half is judged to a billionth as in decimal text."""
    p = F.lit(float(10**digits))
    return F.signum(_c(c)) * F.floor(F.abs(_c(c)) * p + 0.500000001) / p


def no_nan(c: Column | str) -> Column:
    """NaN becomes null, at every boundary where numbers enter."""
    return F.nullif(_c(c), F.lit(float("nan")))


def filter_dates(df: DataFrame, start: str | None = None, end: str | None = None, col: str = "date") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an open side has no limit."""
    if start is not None:
        df = df.filter(F.col(col) >= F.lit(start).cast("date"))
    return df if end is None else df.filter(F.col(col) <= F.lit(end).cast("date"))


def filter_date_list(df: DataFrame, dates: list[str], col: str = "date") -> DataFrame:
    return df.filter(F.col(col).isin([date.fromisoformat(d) for d in dates]))


def exclude_values(df: DataFrame, col: str, values: list) -> DataFrame:
    """Rows whose value is none of ``values``; nulls stay."""
    return df.filter(~F.coalesce(F.col(col).isin(values), F.lit(False)))


def drop_all_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("all", subset=subset)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """One pass counts the values of all columns; those without any go."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select([c for c in df.columns if n[c]])


def trim_leading_null(df: DataFrame, col: str, key: str = "secid", order: str = "date") -> DataFrame:
    """Rows from the first one with a value on, by key; keys without any value go."""
    first = F.min(F.when(F.col(col).isNotNull(), F.col(order))).over(Window.partitionBy(key))
    return df.withColumn("_first", first).filter(F.col(order) >= F.col("_first")).drop("_first")


def order_columns(df: DataFrame, first: list[str] = (), last: list[str] = (), rest_sorted: bool = False) -> DataFrame:
    """Named columns, where present, at the front and the back."""
    rest = [c for c in df.columns if c not in first and c not in last]
    rest = sorted(rest) if rest_sorted else rest
    return df.select([c for c in first if c in df.columns] + rest + [c for c in last if c in df.columns])


def round_numeric(df: DataFrame, digits: int, strings: bool = True) -> DataFrame:
    """Round every fractional column half up; strings too, when all their values are numbers."""
    fractional = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)] if strings else []
    if texts:
        ok = df.agg(*[(F.count(c) == F.count(F.expr(f"try_cast(`{c}` AS double)"))).alias(c) for c in texts]).first()
        texts = [c for c in texts if ok[c]]
    shown = {c: F.round(c, digits) for c in fractional} | {c: F.round(F.expr(f"try_cast(`{c}` AS double)"), digits) for c in texts}
    return df.withColumns(shown) if shown else df


def safe_divide(n: Column | str, d: Column | str) -> Column:
    """Null for a denominator of zero, below zero or null."""
    return F.when(_c(d) > 0, _c(n) / _c(d))


def clean_numeric(c: Column | str) -> Column:
    """Number of report text: quotes and blanks dropped, comma as point, ``;`` null, ``x%`` divided by 100."""
    t = F.translate(F.translate(_c(c).cast("string"), "\"'  ", ""), ",", ".")
    value = F.when(t.endswith("%"), _try_double(F.regexp_replace(t, "%$", "")) / 100).otherwise(_try_double(t))
    return F.when(t.isin("", ";"), None).otherwise(value)


def _try_double(t: Column) -> Column:
    good = t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?$")
    return F.when(good, t).cast("double")


def period_end(c: Column | str) -> Column:
    """Last day of ``YYYYQn`` or ``YYYY``; null for anything else."""
    t = F.trim(_c(c))
    quarter = F.regexp_extract(t, r"^(\d{4})Q([1-4])$", 2)
    year = F.regexp_extract(t, r"^(\d{4})(?:Q[1-4])?$", 1)
    month = F.when(quarter != "", quarter.cast("int") * 3).otherwise(12)
    return F.when(year != "", F.last_day(F.make_date(F.when(year != "", year).cast("int"), month, F.lit(1))))


def parse_pub_date(c: Column | str) -> Column:
    """``dd.MM.yyyy`` as a date; null when it is no day of the calendar."""
    return F.try_to_timestamp(F.trim(_c(c)), F.lit("dd.MM.yyyy")).cast("date")


def unit_scale(label: Column | str) -> Column:
    t = F.lower(_c(label))
    return F.when(t.contains("млрд"), 1e9).when(t.contains("млн"), 1e6).otherwise(1.0)


def id_date(c: Column | str) -> Column:
    """Date of ``date_YYYY-MM-DD`` and ``date_YYYY-MM-DD_chunk_N`` ids, else null."""
    text = F.regexp_extract(_c(c), r"^date_(\d{4}-\d{2}-\d{2})(?:_|$)", 1)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def id_chunk(c: Column | str) -> Column:
    text = F.regexp_extract(_c(c), r"^date_[^_]*_chunk_(\d{1,9})$", 1)
    return F.when(text != "", text).cast("int")


def split_list(c: Column | str, sep: str = ";") -> Column:
    """Trimmed parts of a list in text, empty ones dropped; null gives an empty list."""
    return F.coalesce(F.filter(F.transform(F.split(_c(c), sep), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def pct_change(df: DataFrame, cols: list[str], periods: tuple[int, ...] = (1, 3, 7, 30), key: str = "series", order: str = "date") -> DataFrame:
    """Add ``<col>_pct_<k>``: change over k rows in percent; null on a zero base."""
    w = Window.partitionBy(key).orderBy(order)
    change = lambda c, k: F.when(F.lag(c, k).over(w) != 0, (F.col(c) / F.lag(c, k).over(w) - 1) * 100)
    return df.withColumns({f"{c}_pct_{k}": change(c, k) for c in cols for k in periods})


def strip_legal_form(c: Column | str) -> Column:
    """Company name without the legal form as a whole word, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"(?iU)\bп?ао\b", " "), r"(?U)\s+", " "))


def clean_name(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), "[\"'«»“”„]", ""))


def extract_aliases(c: Column | str) -> Column:
    """Distinct texts of 4 to 79 characters in quotes or brackets, blanks collapsed."""
    found = F.regexp_extract_all(_c(c), F.lit(r"[«\"“(]([^«»\"“”()]{4,79})[»\"”)]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: F.length(x) >= 4))


def find_json_array_column(df: DataFrame) -> str | None:
    """The only string column with values that look like a list; null without or with several."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return None
    hit = df.agg(*[F.max(F.col(c).rlike(r"(?s)^\[.*\]$")).alias(c) for c in texts]).first()
    found = [c for c in texts if hit[c]]
    return found[0] if len(found) == 1 else None


def parse_embedding(c: Column | str) -> Column:
    return F.from_json(_c(c), "array<float>")


def tail_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows by ``order``, which should be total for a stable answer."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def effective_end_date(now: datetime, cutoff: int = 19, inclusive: bool = False) -> date:
    """Today once the local hour is past the cut-off (or at it, if inclusive), else yesterday."""
    past = now.hour >= cutoff if inclusive else now.hour > cutoff
    return now.date() if past else now.date() - timedelta(days=1)
