"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

U64 = np.uint64
_P1, _P2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between stages: the cluster's; a local one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder. Shuffle files stay on the executors' disks until the driver
    happens to collect its garbage; as nothing needs those behind a checkpoint, it is asked to do so now."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: Column, id_col: str, text_col: str, max_labels: int, max_bytes: int) -> DataFrame:
    """id, text and label of at most max_labels labelled documents of at most max_bytes in all, those with the least hashes
    of their ids. Null ids and labels are left out; of several labels of an id the least counts; rows that repeat both id
    and text are one document, and different texts of one id are documents of their own, within the same limits."""
    order = [F.xxhash64("_id"), F.col("_id")]
    some = labels.select(F.col(id_col).cast("long").alias("_id"), label.alias("_label")).where("_id is not null and _label is not null").groupBy("_id").agg(F.min("_label").alias("_label"))
    some = F.broadcast(some.orderBy(*order).limit(max_labels))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), text.alias("_text"), F.xxhash64(text).alias("_hash")).join(some, F.col("_doc") == F.col("_id")).drop("_doc")
    sizes = rows.groupBy("_id", "_hash").agg(F.max(F.octet_length("_text").cast("long")).alias("_bytes")).orderBy(*order, "_hash").limit(max_labels)
    upto = F.sum("_bytes").over(W.orderBy(*order, "_hash").rowsBetween(W.unboundedPreceding, 0))  # max_labels rows at most
    picked = sizes.withColumn("_upto", upto).where(F.col("_upto") <= max_bytes).select(F.col("_id").alias("_p"), F.col("_hash").alias("_q"))
    found = rows.join(F.broadcast(picked), (F.col("_id") == F.col("_p")) & (F.col("_hash") == F.col("_q")))
    return found.groupBy("_id", "_hash").agg(F.min("_text").alias("text"), F.min("_label").alias("label")).select(F.col("_id").alias("id"), "text", "label")


def word_count(text: Column) -> Column:
    """Words in a text, without a user-defined function; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text as an array, unchanged; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U64(30))) * _P2
    x = (x ^ (x >> U64(27))) * _P1
    return x ^ (x >> U64(31))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def window_hashes(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of every n consecutive values of h; the caller drops windows that span two texts."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, U64)
    for k in range(n):
        out *= U64(base)
        out += h[k : k + size]
    return mix(out)
