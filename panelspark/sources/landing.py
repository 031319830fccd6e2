"""Landing payloads to typed rows. Text that can't be read becomes null or a row of the quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let

BAR_SCHEMA = T.StructType([T.StructField("TRADEDATE", T.StringType()), T.StructField("SECID", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("OPEN", "HIGH", "LOW", "CLOSE", "VOLUME", "WAPRICE")]])
#: Names that may hold the date of an index file, in order.
DATE_NAMES = ("DATE", "TRADEDATE", "date", "Date", "begin", "end")


def _number(c: Column) -> Column:
    """A plain number, else null; texts such as NaN and inf are null as well."""
    return F.when(c.rlike(r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,3})?\s*$"), F.trim(c)).cast("double")


def to_day(c: Column) -> Column:
    """ISO or day-first date text as a date, else null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("dd.MM.yyyy"))).cast("date")


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType = BAR_SCHEMA) -> DataFrame:
    """Bars of CSV files: unreadable dates and numbers are null, columns lower-cased."""
    raw = spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE").csv(path)
    cols = {f.name.lower(): F.col(f.name) for f in schema}
    return raw.select(to_day(cols.pop("tradedate")).alias("date"), cols.pop("secid").alias("secid"), *[_number(c).alias(n) for n, c in cols.items()])


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Text columns of a file with header: tabs for ``.tsv``, commas otherwise."""
    return spark.read.option("header", "true").option("sep", "\t" if path.rstrip("/").lower().endswith(".tsv") else ",").option("multiLine", "true").option("escape", '"').csv(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report cells ``file, ticker, report_type, row_no, label, period, text`` of ``;``-separated files.

    The first line of a file names the periods. Ticker and type come from the file's name and folder.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\R")).alias("row_no", "line"))
    cells = lines.filter(F.trim("line") != "").select("file", "row_no", F.split("line", ";").alias("c"))
    heads = cells.groupBy("file").agg(F.min_by("c", "row_no").alias("head"), F.min("row_no").alias("first"))
    rows = cells.join(heads, "file").filter("row_no > first")
    pairs = F.transform(F.sequence(F.lit(1), F.size("head") - 1), lambda i: F.struct(F.trim(F.get("head", i)).alias("period"), F.get("c", i).alias("text")))
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    kind = F.when(F.lower("file").contains("year"), "yearly").otherwise("quarterly")
    out = rows.filter(F.size("head") > 1).select("file", F.regexp_extract(name, r"^([A-Z0-9]+)_", 1).alias("ticker"), kind.alias("report_type"), "row_no", F.get("c", F.lit(0)).alias("label"), F.explode(pairs).alias("p"))
    return out.select("file", "ticker", "report_type", "row_no", "label", "p.period", "p.text")


def resolve_date_column(df: DataFrame, expected: str = "DATE", candidates: tuple[str, ...] = ()) -> str | None:
    """The column with dates: the expected one, else of ``candidates`` the first that can be read,
    else the first whose name speaks of a date, day, time or period; null without any."""
    if expected in df.columns:
        return expected
    there = [c for c in candidates if c in df.columns]
    if there:
        ok = df.agg(*[(F.count(to_day(F.col(c).cast("string"))) > 0).alias(c) for c in there]).first()
        good = [c for c in there if ok[c]]
        if good:
            return good[0]
    return next((c for c in df.columns if any(w in c.lower() for w in ("date", "day", "time", "period"))), None)


def read_panel_dir(spark: SparkSession, path: str) -> DataFrame:
    """One panel of many CSV files with ``DATE`` and ``SECID``; rows without either are skipped.

    Files may have other columns in another order: each distinct header is one scan, and the scans
    are united by name. A header is the first line of a file's first block, which one task reads in order.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("head"), F.monotonically_increasing_id().alias("n"))
    heads = lines.filter("at = 0").groupBy("file").agg(F.min_by("head", "n").alias("head")).filter(F.col("head").contains("DATE") & F.col("head").contains("SECID"))
    groups = heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()
    out = None
    for g in groups:
        part = spark.read.option("header", "true").csv(g["files"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "DATE date, SECID string")
    return out.withColumn("DATE", to_day(F.col("DATE"))).filter("DATE IS NOT NULL AND SECID IS NOT NULL").orderBy("SECID", "DATE")


def read_jsonl_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Readable records with a ``custom_id``, and the rejected lines with the reason."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select("value", F.try_parse_json("value").isNotNull().alias("ok"), F.from_json("value", schema).alias("r"))
    reason = F.when(~F.col("ok"), "malformed").when(F.col("r.custom_id").isNull(), "no id")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason IS NULL").select("r.*"), rows.filter("reason IS NOT NULL").select("value", "reason")


def _block(df: DataFrame, block: str) -> DataFrame:
    """Rows of the ``columns`` and ``data`` arrays of a payload block ``df(value)``; one map per row."""
    schema = f"struct<{block}:struct<columns:array<string>,data:array<array<string>>>>"
    b = df.select(F.monotonically_increasing_id().alias("_p"), F.from_json("value", schema)[block].alias("b"))
    rows = b.select("_p", F.col("b.columns").alias("n"), F.posexplode("b.data").alias("seq", "d"))
    return rows.filter(F.size("n") == F.size("d")).select("_p", "seq", F.map_from_arrays("n", "d").alias("m"))


def parse_history_json(df: DataFrame, board: str = "TQBR") -> DataFrame:
    """Bars of exchange history payloads on one board; columns are looked up once a payload."""
    numbers = ("OPEN", "HIGH", "LOW", "CLOSE", "VOLUME", "WAPRICE")
    b = F.from_json("value", "struct<history:struct<columns:array<string>,data:array<array<string>>>>")["history"]

    def rows_of(b: Column) -> Column:
        places = F.transform(F.array(*[F.lit(c) for c in ("BOARDID", "TRADEDATE", "SECID", *numbers)]), lambda c: (F.coalesce(F.array_position(b["columns"], c), F.lit(0)) - 1).cast("int"))
        cell = lambda d, at, i: F.get(d, F.get(at, F.lit(i)))
        kept = lambda at: F.filter(b["data"], lambda d: (F.size(d) == F.size(b["columns"])) & (cell(d, at, 0) == board))
        return let(places, lambda at: F.transform(kept(at), lambda d: F.struct(*[cell(d, at, i).alias(f"c{i}") for i in range(1, 9)])))

    rows = df.select(F.explode(let(b, rows_of)).alias("r"))
    return rows.select(to_day(F.col("r.c1")).alias("date"), F.col("r.c2").alias("secid"), *[_number(F.col(f"r.c{i}")).alias(c.lower()) for i, c in enumerate(numbers, 3)])


def parse_index_json(df: DataFrame) -> DataFrame:
    """``date, series, value`` of index histories; rows without date or close go."""
    m = lambda k: F.try_element_at("m", F.lit(k))
    return _block(df, "history").select(to_day(m("TRADEDATE")).alias("date"), m("SECID").alias("series"), _number(m("CLOSE")).alias("value")).filter("date IS NOT NULL AND value IS NOT NULL")


def parse_metal_json(df: DataFrame, board: str = "CETS") -> DataFrame:
    """The last positive close of each day and metal on one board."""
    m = lambda k: F.try_element_at("m", F.lit(k))
    rows = _block(df, "history").filter(m("BOARDID") == board).select("_p", "seq", to_day(m("TRADEDATE")).alias("date"), m("SECID").alias("series"), _number(m("CLOSE")).alias("value"))
    return rows.filter("value > 0 AND date IS NOT NULL").groupBy("date", "series").agg(F.max_by("value", F.struct("_p", "seq")).alias("value"))


def parse_commodity_json(df: DataFrame, start: str, end: str) -> DataFrame:
    """``date, value`` of ``data[{date, value}]`` payloads within both days."""
    rows = df.select(F.explode(F.from_json("value", "struct<data:array<struct<date:string,value:string>>>")["data"]).alias("r"))
    rows = rows.select(to_day(F.col("r.date")).alias("date"), _number(F.col("r.value")).alias("value"))
    return rows.filter(F.col("value").isNotNull() & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def parse_fx_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``date, value`` per unit of currency, and the nominals seen; a nominal may be a child or an attribute."""
    schema = "_Date string, _Nominal string, Nominal string, Value string"
    raw = spark.read.format("xml").option("rowTag", "Record").schema(schema).load(path)
    nominal = F.coalesce(_number(F.col("Nominal")), _number(F.col("_Nominal")), F.lit(1.0))
    rows = raw.select(to_day(F.col("_Date")).alias("date"), nominal.alias("nominal"), F.try_divide(_number(F.translate("Value", ",", ".")), nominal).alias("value"))
    return rows.select("date", "value"), rows.groupBy("nominal").agg(F.min("date").alias("first"), F.count(F.lit(1)).alias("n"))


def parse_html_rate_table(df: DataFrame) -> DataFrame:
    """``date, key_rate`` of the first two cells of table rows in html ``df(value)``; bad rows go."""
    cells = F.regexp_extract_all(F.col("tr"), F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    rows = df.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("tr")).select(F.transform(cells, lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>|&nbsp;", ""))).alias("c"))
    rows = rows.select(F.try_to_timestamp(F.get("c", F.lit(0)), F.lit("dd.MM.yyyy")).cast("date").alias("date"), _number(F.translate(F.get("c", F.lit(1)), ",", ".")).alias("key_rate"))
    return rows.filter("date IS NOT NULL AND key_rate IS NOT NULL")


def parse_issue_size_json(df: DataFrame) -> DataFrame:
    """``secid, issue_size`` of security descriptions ``df(secid, value)``; null without the entry."""
    schema = "struct<description:struct<columns:array<string>,data:array<array<string>>>>"
    rows = df.select("secid", F.from_json("value", schema)["description"].alias("b"))
    name, value = F.array_position("b.columns", "name").cast("int") - 1, F.array_position("b.columns", "value").cast("int") - 1
    rows = rows.withColumns({"_n": name, "_v": value})
    hit = F.get(F.filter("b.data", lambda r: F.get(r, F.col("_n")) == "ISSUESIZE"), F.lit(0))
    return rows.select("secid", _number(F.get(hit, F.col("_v"))).alias("issue_size"))


def parse_listing_json(df: DataFrame) -> DataFrame:
    """``secid, short_name`` of listed securities with a previous price."""
    m = lambda k: F.try_element_at("m", F.lit(k))
    rows = _block(df, "securities").filter(m("PREVPRICE").isNotNull())
    return rows.select(m("SECID").alias("secid"), m("SHORTNAME").alias("short_name"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """``cluster_id, cluster_date, member`` rows of a cluster document with parallel arrays."""
    schema = "cluster_id string, cluster_date date, news array<string>, datetime array<string>, channel_name array<string>, message_link array<string>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    zipped = F.arrays_zip("datetime", "channel_name", "message_link", "news")
    rows = raw.select("cluster_id", "cluster_date", F.posexplode(zipped).alias("seq", "m"))
    return rows.select("cluster_id", "cluster_date", "seq", F.try_to_timestamp("m.datetime").alias("datetime"), "m.channel_name", "m.message_link", "m.news")
