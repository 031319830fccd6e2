"""Incremental jobs as streams that read what has landed and stop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import BinaryType, DateType, StructField, StructType

from ..functions.text import CleanConfig, clean_text, normalize_messages
from ..operators.clustering import ClusterConfig, cluster_windows, representatives, windows_from
from ..scratch import Scratch

MESSAGE = "datetime timestamp, channel_name string, message_link string, views long, news string"
BAR = "secid string, date date, open double, high double, low double, close double, volume double, waprice double"


def clean_message_stream(spark: SparkSession, source: str, target: str, checkpoint: str, cfg: CleanConfig = CleanConfig()) -> StreamingQuery:
    """New message files, cleaned, once per link; messages at or before the committed mark are left out.

    The mark is the latest time of all committed batches (see ``commit_batch``).
    """
    raw = spark.readStream.schema(MESSAGE).json(source)
    rows = normalize_messages(raw).withColumn("news", clean_text(F.col("news"), cfg)).filter("datetime IS NOT NULL AND news <> ''")
    commit = lambda batch, number: commit_batch(batch.dropDuplicates(["message_link"]), number, target, "datetime")
    return rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _marks(spark: SparkSession, target: str) -> DataFrame | None:
    return spark.read.schema("batch long, mark timestamp").parquet(f"{target}/marks") if _exists(spark, f"{target}/marks") else None


def commit_batch(rows: DataFrame, number: int, target: str, at: str) -> bool:
    """Write what of a batch is later than the committed mark, then commit its number and mark.

    Rows go to a folder of the batch, which a repetition after a crash replaces; the mark is written
    last, by a rename, and readers (``committed``) leave out batches without one. A batch that is
    committed already adds nothing. Tells whether it was committed now.
    """
    spark = rows.sparkSession
    marks = _marks(spark, target)
    mark = None
    if marks is not None:
        if not marks.filter(F.col("batch") == number).isEmpty():
            return False
        mark = marks.agg(F.max("mark")).first()[0]
    fresh = rows if mark is None else rows.filter(F.col(at) > F.lit(mark))
    where = f"{target}/rows/batch={number}"
    fresh.write.mode("overwrite").parquet(where)
    latest = spark.read.schema(fresh.schema).parquet(where).agg(F.lit(number).cast("long").alias("batch"), F.greatest(F.max(at), F.lit(mark).cast("timestamp")).alias("mark"))
    latest.coalesce(1).write.mode("overwrite").parquet(f"{target}/marks/number={number}")
    return True


def committed(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all committed batches."""
    marks = _marks(spark, target)
    rows = spark.read.parquet(f"{target}/rows")
    return rows.join(F.broadcast(marks.select("batch")), "batch", "left_semi").drop("batch") if marks is not None else rows.limit(0).drop("batch")


class _OpenWindow(StatefulProcessor):
    """Keeps the messages of a window until the watermark passes its end, then lets them go.

    Messages that come together are one element of the state, in Arrow's stream format.
    """

    def __init__(self, schema: StructType, days: int):
        self.schema, self.days = schema, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", StructType([StructField("part", BinaryType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            table, sink = pa.Table.from_pandas(part[self.schema.names], preserve_index=False), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            self.rows.appendValue((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(pd.Timestamp(key[0], tz="UTC").timestamp() + self.days * 86_400) * 1000)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [pa.ipc.open_stream(bytes(row[0])).read_pandas() for row in self.rows.get()]
        self.rows.clear()
        for held in parts:
            held.insert(0, "window", key[0])
            yield held

    def close(self) -> None:
        pass


#: Shares of a window's messages, each a state of its own.
SHARES = 16


def representative_stream(spark: SparkSession, source: str, target: str, checkpoint: str, cfg: ClusterConfig = ClusterConfig(), first: str = "1970-01-01") -> StreamingQuery:
    """Representatives of the clusters of every window that is over, each message read once.

    Windows count from ``first``. Their messages wait in the state, in ``SHARES`` shares, until a later
    message shows that they are over; then the window is clustered as a whole and its folder written,
    which a repeated batch replaces. Messages of a window that is over are late and left out;
    ``finish_windows`` takes the window that is still open.
    """
    schema = spark.read.parquet(source).schema
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(schema).parquet(source).withWatermark("datetime", "0 seconds")
        starts = windows_from(F.lit(first).cast("date"), F.col("datetime"), cfg.window_days, cfg.step_days)
        rows = rows.withColumn("window", F.explode(starts)).withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int"))
        over = rows.groupBy("window", "share").transformWithStateInPandas(_OpenWindow(schema, cfg.window_days), StructType([StructField("window", DateType()), *schema.fields]), "Append", "EventTime")
        return over.writeStream.foreachBatch(lambda batch, _: _write_representatives(batch, target, cfg)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)


_STORE = "spark.sql.streaming.stateStore.providerClass"


def _write_representatives(rows: DataFrame, target: str, cfg: ClusterConfig) -> None:
    rows = Scratch(rows.sparkSession, "windows").table(rows, "over")
    if rows.isEmpty():
        return
    best = representatives(cluster_windows(rows.sparkSession, rows, cfg).join(rows, ["window", "id"]))
    best.drop("embedding").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window").parquet(target)


def finish_windows(spark: SparkSession, source: str, target: str, cfg: ClusterConfig = ClusterConfig(), first: str = "1970-01-01") -> None:
    """Cluster the window that the last message leaves open, from its start on."""
    rows = spark.read.parquet(source)
    last = rows.agg(F.max("datetime").alias("last"))
    begin = last.select(F.element_at(windows_from(F.lit(first).cast("date"), F.col("last"), cfg.window_days, cfg.step_days, F.col("last")), -1).alias("window")).first()[0]
    if begin is not None:
        _write_representatives(rows.filter(F.col("datetime") >= F.lit(begin).cast("timestamp")).withColumn("window", F.lit(begin)), target, cfg)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def bar_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append bars of tickers and days that the target lacks."""

    def append(batch: DataFrame, _: int) -> None:
        s = batch.sparkSession
        fresh = batch.dropDuplicates(["secid", "date"])
        if _exists(s, target):
            fresh = fresh.join(s.read.schema(BAR).parquet(target).select("secid", "date"), ["secid", "date"], "left_anti")
        fresh.write.mode("append").parquet(target)

    return spark.readStream.schema(BAR).parquet(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
