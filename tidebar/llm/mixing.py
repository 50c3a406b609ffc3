"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import word_count
from tidebar.llm.ordering import before, ordered

OUT = ["doc_id", "size", "source_size", "target", "taken"]


def offset(seed: int) -> float:
    """The random offset that a seed gives."""
    return random.Random(seed).random()


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sources (source, source_size) with target: share of all sizes, dealt by weight, at most cap times a source's size.

    What sources at their cap leave over is dealt among the others by weight again. With sources in order of
    cap / weight, the level at which the rest stand is found from running sums, without repeating the deal.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("w", weight.cast("double")).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    earlier = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    full, weightless = (F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) for c in ("most", "w"))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(every) - full) / (F.sum("w").over(every) - weightless))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"])
    return rows.select("source", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("w")), F.col("most")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size (words), source_size, target (both the source's), taken (words taken) and copies of each row of docs;
    also text_hash, to find the row again.

    Weights go to the sources in code point order, null last, and repeat. Each row of a source expects target /
    source_size copies; expectations are summed along the source in order of size and id, one offset is added, and a row
    is taken once for each whole number that its stretch of the sum crosses. Order by size makes the words taken, not
    only the rows, come near the target. Null and empty texts have size 0 and may be taken, which adds no words. The same
    seed gives the same mix. Rows that repeat count each on its own. An empty table gives no rows.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    fixed = ordered(rows, "source", "size", "doc_id", "text_hash")
    parts = fixed.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.sum("size").alias("words"))
    parts = before(parts, "n", by=["source"])
    sources = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    aims = targets(sources, weights, share, cap).withColumnRenamed("source", "aim")
    parts = parts.select(F.col("part").alias("in_part"), F.col("source").alias("of"), "first", "before_n").join(aims, F.col("of").eqNullSafe(F.col("aim")))
    known = fixed.join(parts, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("before_n") + F.col("place") - F.col("first")).cast("double")
    u = F.lit(offset(seed))
    copies = F.floor(each * (rank + 1.0) + u) - F.floor(each * rank + u)
    return known.withColumn("copies", copies.cast("long")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "text_hash")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of docs, all columns, each as often as mix_plan takes it.

    Rows that are equal in id, source and text are told apart by a hash of the whole row, so that a task that runs again
    takes the same ones.
    """
    same = ["_id", "_source", "_hash"]
    nth = lambda order: F.row_number().over(W.partitionBy(*same).orderBy(order)).alias("_nth")
    plan = mix_plan(docs, id_col, text_col, source_col, **options)
    plan = plan.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), "copies").select(*same, nth("copies"), F.col("copies").alias("_copies"))
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_source"), F.xxhash64(text_col).alias("_hash")).select("_row", *same, nth(F.xxhash64(*(F.col(f"_row.`{c}`") for c in docs.columns))))
    plan = plan.select(*(F.col(c).alias(f"{c}2") for c in [*same, "_nth"]), "_copies")
    match = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in [*same, "_nth"]]
    taken = keyed.join(plan, match).where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy"))
    return taken.select("_row.*")
