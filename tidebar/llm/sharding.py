"""Contiguous shards of near equal bytes, from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import utf8_bytes
from tidebar.llm.ordering import before, ordered

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: Equal texts of up to this share of a shard stay together where a cut would part them.
WHOLE = 0.05


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs.

    The order is by the text's MD5 and then by id: equal texts stand side by side, and shards are a mix of all sources.
    Sizes (UTF-8 bytes plus 16) are summed along the order from per-partition totals, and a row goes to the shard in
    which its middle byte falls when the sum is cut into equal parts. Where a cut falls into a group of equal texts that
    is at most a twentieth of a shard, the group goes whole to the shard of its own middle; a larger one is parted there,
    as sizes would differ otherwise. Shards therefore differ by a twentieth of their size, or one row's, at most.
    slot counts a shard's rows from 0. Null and empty texts have size 16 and CRC 0; null ids come first among equal
    texts; repeated rows follow each other. Other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (utf8_bytes(text) + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("_key"))
    fixed = ordered(rows, "_key", "doc_id")
    parts = before(fixed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "bytes", "rows")
    # twice the bytes of a shard, as middles are counted in halves
    parts = parts.withColumn("cut", F.expr(f"div(2 * sum(bytes) over () + {shards - 1}, {shards})"))
    sums = fixed.join(parts, "part").withColumn("upto", F.col("before_bytes") + F.sum("size").over(W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
    same = sums.groupBy("_key").agg(F.min(F.col("upto") - F.col("size")).alias("lo"), F.max("upto").alias("hi"), F.first("cut").alias("c"))
    parted = same.where(f"div(2 * lo, c) < div(2 * hi - 1, c) and 2 * (hi - lo) <= {WHOLE} * c")
    parted = F.broadcast(parted.select(F.col("_key").alias("_whole"), F.expr("div(lo + hi, c)").alias("to")))  # fewer rows than shards: a cut is in one group
    own = F.expr("div(2 * upto - size, cut)")
    placed = sums.join(parted, F.col("_key") == F.col("_whole"), "left").select("doc_id", "size", "text_crc32", F.coalesce("to", own).cast("int").alias("shard"), (F.col("before_rows") + F.col("place")).alias("rank"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # no more rows than shards
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
