"""Tables of one run in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run in the folder that ``spark.checkpoint.dir`` names.

    Writing a table cuts the lineage: lost executors cost a re-read, never a recomputation of
    earlier stages. Where the setting is missing, a local session gets a temporary folder and any
    other is refused.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.live: list[str] = []

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return the table read back, with the schema that was written.

        The shuffle files of the write go when it ends, as the table takes their place.
        """
        path = self.path(name)
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.live.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables of this run that nothing reads any more."""
        for df in tables:
            self._delete(df.scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables of this run but these."""
        kept = {df.scratch_path for df in tables}
        for path in [p for p in self.live if p not in kept]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.live = [p for p in self.live if p != path]
