"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import decontaminate, mixing, ngram_jaccard, quality_rules, sharding
from tidebar.llm.common import shared_folder, table

SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go.

    Null, empty and blank texts have no words and go; rows are judged each, whatever their ids; no rows give no rows.
    """
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    return quality_rules.judged(rows, rules, keep=("_row",)).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the least id, null last.

    Rows that repeat id and text count as one; null and empty texts stay, once for each id; no rows give no rows.
    """
    return ngram_jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null texts stay; rows are judged each, whatever their ids; an empty benchmark or no rows change nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: documents appear as often as the mix takes them.

    A null source is a source; repeated rows count each; no rows give no rows.
    """
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row of the mix, whatever its id and text; no rows give no rows."""
    return sharding.shard(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: A learned decision list is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again. A stage's folder is
    removed as soon as the next one's is written; the last stays, as the result is read from it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            at = spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return docs
