"""A global order over rows, and prefix sums over it, from per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import durable

#: monotonically_increasing_id() is the partition's number shifted by this, plus the row's number in the partition.
SHIFT = 33


def ordered(rows: DataFrame, *order: str) -> DataFrame:
    """rows in range partitions of the order, with part and place (number of the row in its part).

    Rows are fixed by a checkpoint: range bounds come from a sample, and every later step must see the same ones. Rows
    that tie in the whole order are dealt by where they were read, so that no crowd of equal rows fills one partition.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = rows.withColumn("_read", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(n, *order, "_read").sortWithinPartitions(*order, "_read").drop("_read")
    at = dealt.withColumn("_at", F.monotonically_increasing_id())
    fixed = durable(at)
    return fixed.select("*", F.shiftright("_at", SHIFT).alias("part"), F.col("_at").bitwiseAND((1 << SHIFT) - 1).alias("place")).drop("_at")


def before(parts: DataFrame, *values: str, by: list[Column | str] | None = None) -> DataFrame:
    """parts (a row for each part) with before_<value>: the sum over earlier parts. One row a partition, never more."""
    w = W.partitionBy(*(by or [])).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select("*", *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"before_{v}") for v in values))
