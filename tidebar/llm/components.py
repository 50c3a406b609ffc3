"""Connected components of a link table, without any of it in the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import durable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of a link; root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris and others, 2014): the number of rounds grows with the logarithm
    of a component's size, and no node gets more links than it had. It ends as soon as all links are stars around a
    component's smallest node, at once if they are so from the start. Nulls, loops and repeated links are ignored.
    """
    edges = durable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while not _stars(edges):
        # large star: each node tells its larger neighbours (and itself) of the smallest node around it
        around = edges.select(F.inline(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m")))))
        least = around.groupBy("n").agg(F.min("m").alias("m")).select(F.col("n").alias("v"), F.least("n", "m").alias("least"))
        large = edges.join(least, "v").select("u", F.col("least").alias("v"))
        # small star: each node tells its smaller neighbours of the smallest, and links with that one itself
        low = large.groupBy("u").agg(F.min("v").alias("least"))
        told = F.when(F.col("v") > F.col("least"), F.col("v")).otherwise(F.col("u"))
        edges = durable(large.join(low, "u").select(told.alias("u"), F.col("least").alias("v")).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end has one link and is no other link's smaller end."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("open")).first()["open"]
