"""From raw documents to token files: five stages, each one of the training-data operators.

Every stage takes the whole table that its predecessor kept and returns the columns of
``documents`` again, but for the last, which returns the index of the token files. Nulls, empty
texts and repeated rows follow the rules of the operators. Stages decide by row, not by doc_id,
which may be null or repeated: the operators get a 64-bit hash of the whole row as its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import WORD, Scratch
from panelspark.llm.decontam import decontaminate
from panelspark.llm.mixing import mix
from panelspark.llm.ngram_jaccard import jaccard_components
from panelspark.llm.quality import quality_verdicts
from panelspark.llm.queries import tokenizer
from panelspark.llm.token_files import tokens_through_files


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, a hash of all columns; rows that share it are equal."""
    return docs.withColumn("row", F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns]))


def _as_ids(rows: DataFrame) -> DataFrame:
    """Numbered rows with their number in place of doc_id."""
    return rows.withColumn("doc_id", F.col("row")).drop("row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the limits and aren't outliers of their language and source."""
    return quality_verdicts(spark, docs, carry=True).filter("kept").select([F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; null is the largest.

    Different texts under one doc_id, or without one, stay. Equal rows count as one, but for rows
    without doc_id and words, which all stay. Equal rows meet as partial aggregates.
    """
    rows = _numbered(docs)
    group = jaccard_components(spark, _as_ids(rows)).groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component_id"))
    ids = rows.groupBy("row").agg(F.min("doc_id").alias("doc_id"))
    first = group.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x"))
    first = Scratch(spark, "first").table(first.select("x.row"), "ids")
    alone = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = rows.filter(~alone).dropDuplicates(["row"]).join(first, "row", "left_semi").select(docs.columns)
    return kept.unionByName(docs.filter(alone))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that equals or nearly equals a benchmark item."""
    return decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: up to three times, or not at all.

    Equal rows, drawn one by one, appear as often as their draws add up to.
    """
    rows = _numbered(docs)
    taken = mix(spark, _as_ids(rows)).groupBy(F.col("doc_id").alias("row")).agg(F.sum("copies").alias("copies"))
    taken = Scratch(spark, "taken").table(taken.filter("copies > 0"), "ids")
    rows = rows.dropDuplicates(["row"]).join(taken, "row")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Index of the ORC files with the ids of all documents."""
    return tokens_through_files(spark, docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]
#: The near-duplicate and mixing stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
