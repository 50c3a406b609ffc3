"""Connected components and spanning forests of link tables, without any of them in the driver."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's; a local one only under a local master where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark.sparkContext.getCheckpointDir()


def fixed(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of a link; root is the smallest node of its component. Nulls and loops are ignored.

    Alternating large and small stars: a round links every node with the smallest one around it, so that the number of
    rounds grows with the logarithm of a component's size and no node gets more links than it had.
    """
    edges = fixed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = edges.select("u", F.lit(1).alias("n"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("low")))
        open_ = ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("low").alias("low")).where("n > 1 or n > 0 and low > 0")
        if not open_.limit(1).count():
            break
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("u").alias("far"), F.col("v").alias("u")).join(least, "u").select(F.col("far").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        edges = fixed(small.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight") -> DataFrame:
    """a, b, weight of a minimum spanning forest of edges, by Boruvka's rounds.

    In a round every component takes its lightest edge to another (ties by weight, then ends, which is a total order and
    leaves no cycles), and components joined by those edges become one: at most half as many remain.
    """
    rows = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(weight).cast("double").alias("weight")).where("a < b").groupBy("a", "b").agg(F.min("weight").alias("weight"))
    left = fixed(rows.select("*", F.col("a").alias("ra"), F.col("b").alias("rb")))
    out = left.select("a", "b", "weight").limit(0)
    while True:
        edge = F.struct("weight", "a", "b", "ra", "rb")
        ends = left.select(F.explode(F.array("ra", "rb")).alias("root"), edge.alias("e"))
        taken = fixed(ends.groupBy("root").agg(F.min("e").alias("e")).select("e.*").distinct())
        if not taken.limit(1).count():
            return out
        out = out.unionByName(taken.select("a", "b", "weight"))
        roots = components(taken, "ra", "rb")
        to = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"new_{side}"))
        moved = left.join(to("ra"), "ra", "left").join(to("rb"), "rb", "left").select("a", "b", "weight", F.coalesce("new_ra", "ra").alias("ra"), F.coalesce("new_rb", "rb").alias("rb")).where("ra <> rb")
        between = moved.groupBy(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).agg(F.min(F.struct("weight", "a", "b")).alias("e"))
        left = fixed(between.select("e.a", "e.b", "e.weight", "ra", "rb"))
