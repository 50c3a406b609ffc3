"""Clustering and its scores."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators.joins import all_pairs


#: Most labels that are broadcast to the pairs of symbols.
MOST_LABELS = 1_000_000


def clusters(vectors: DataFrame, id_col: str, col: str, k: int, method: str = "kmeans", seed: int = 1) -> DataFrame:
    """id and cluster of each row. vectors: array column. Methods: kmeans, bisecting (hierarchical, from the top)."""
    rows = vectors.select(id_col, array_to_vector(F.col(col).cast("array<double>")).alias("features"))
    model = {"kmeans": KMeans, "bisecting": BisectingKMeans}[method](k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select(id_col, "cluster")


def spectral(similar: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """id and cluster by power iteration over similarities (a, b, similarity; numeric ids)."""
    return PowerIterationClustering(k=k, maxIter=rounds, srcCol="a", dstCol="b", weightCol="similarity").assignClusters(similar)


def principal(vectors: DataFrame, id_col: str, col: str, k: int) -> DataFrame:
    rows = vectors.select(id_col, array_to_vector(F.col(col).cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="p").fit(rows).transform(rows).select(id_col, vector_to_array("p").alias("components"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def rand_index(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings."""
    c = contingency(rows, a, b)
    two = lambda x: x * (x - 1) / 2
    sums = lambda d, n: d.agg(F.sum(two(F.col("n"))).alias(n))
    parts = sums(c, "ij").join(sums(c.groupBy("a").agg(F.sum("n").alias("n")), "i"), F.lit(True)).join(sums(c.groupBy("b").agg(F.sum("n").alias("n")), "j"), F.lit(True)).join(c.agg(F.sum("n").alias("total")), F.lit(True))
    expected = F.col("i") * F.col("j") / two(F.col("total"))
    return parts.select(((F.col("ij") - expected) / F.nullif((F.col("i") + F.col("j")) / 2 - expected, F.lit(0.0))).alias("adjusted_rand"))


def _chance(x: int, y: int, n: int) -> float:
    """Of two groups of x and y among n rows: the mutual information that their overlap gives by chance."""
    k = np.arange(max(1, x + y - n), min(x, y) + 1)
    fixed = lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1)
    log_p = np.array([fixed - lgamma(v + 1) - lgamma(x - v + 1) - lgamma(y - v + 1) - lgamma(n - x - y + v + 1) for v in k.tolist()])
    return float((k / n * np.log(n * k / (x * y)) * np.exp(log_p)).sum())


def adjusted_mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted mutual information of two labellings, with the arithmetic mean of their entropies; 1 if both
    have one value. What chance gives is summed over the distinct sizes of groups, of which n rows have at most the root of
    2 n on each side."""

    @F.pandas_udf("double")
    def chance(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_chance(*map(int, v)) for v in zip(x, y, n)], dtype=float)

    c = contingency(rows, a, b)
    x, y = c.groupBy("a").agg(F.sum("n").alias("x")), c.groupBy("b").agg(F.sum("n").alias("y"))
    total = c.agg(F.sum("n").alias("total"))
    one = lambda df: df.join(F.broadcast(total), F.lit(True))  # noqa: E731  # one row
    share = lambda v: F.col(v) / F.col("total")
    cells = one(c.join(x, "a").join(y, "b"))
    mi = cells.agg(F.sum(share("n") * F.log(F.col("n") / F.col("x") * F.col("total") / F.col("y"))).alias("mi"))
    entropy = lambda df, v, name: one(df).agg((-F.sum(share(v) * F.log(share(v)))).alias(f"h_{name}"), F.count("*").alias(f"n_{name}"))
    sizes = all_pairs(x.groupBy("x").agg(F.count("*").alias("nx")), y.groupBy("y").agg(F.count("*").alias("ny")))
    expected = one(sizes).agg(F.sum(F.col("nx") * F.col("ny") * chance("x", "y", "total")).alias("e"))
    parts = mi.join(entropy(x, "x", "a"), F.lit(True)).join(entropy(y, "y", "b"), F.lit(True)).join(expected, F.lit(True))
    bottom = (F.col("h_a") + F.col("h_b")) / 2 - F.col("e")
    alike = (F.col("n_a") == 1) & (F.col("n_b") == 1) | (F.abs(bottom) < 1e-15)
    return parts.select(F.when(alike, 1.0).otherwise((F.col("mi") - F.col("e")) / bottom).alias("adjusted_mutual_information"))


def cluster_metrics(labels: DataFrame, distances: DataFrame, details: DataFrame) -> DataFrame:
    """Per cluster: size, mean similarity (1 - the mean over members of their mean distance, zeros left out), purity of
    sector and industry (one over the number of values), and the most frequent of each (the least of ties); with the members'
    symbols in order, their names if details has them, and the means of range_value_pct and dollar_total if it has those."""
    have = set(details.columns)
    more = [F.array_sort(F.collect_list("symbol")).alias("symbols")] + ([F.transform(F.array_sort(F.collect_list(F.struct("symbol", "name"))), lambda x: x["name"]).alias("names")] if "name" in have else [])
    more += [F.avg(c).alias(f"{c}_mean") for c in ("range_value_pct", "dollar_total") if c in have]
    # pairs are many more than labels: these go to them as long as they fit, and only pairs within a cluster are turned round
    few = labels.select("symbol").limit(MOST_LABELS + 1).count() <= MOST_LABELS
    label = lambda s, c: (F.broadcast if few else lambda d: d)(labels.select(F.col("symbol").alias(s), F.col("cluster").alias(c)))
    within = distances.join(label("a", "cluster"), "a").join(label("b", "cb"), "b").where("cluster = cb")
    ends = F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("node")
    near = within.select("cluster", ends, "distance").groupBy("cluster", "node").agg(F.avg(F.nullif("distance", F.lit(0.0))).alias("m")).groupBy("cluster").agg((1 - F.avg("m")).alias("similarity"))
    info = labels.join(details, "symbol", "left").groupBy("cluster").agg(
        F.count("*").alias("size"), (1 / F.nullif(F.count_distinct("sector"), F.lit(0))).alias("sector_purity"), (1 / F.nullif(F.count_distinct("industry"), F.lit(0))).alias("industry_purity"),
        F.mode("sector", True).alias("top_sector"), F.mode("industry", True).alias("top_industry"), *more,
    )
    return info.join(near, "cluster", "left")


def top_clusters(metrics: DataFrame, least_size: int = 5, quantile: float = 0.25, n: int = 9) -> DataFrame:
    """The n most similar clusters of more than least_size members whose similarity exceeds a quantile of all."""
    cut = F.broadcast(metrics.agg(F.percentile("similarity", quantile).alias("_q")))
    return metrics.join(cut, (F.col("similarity") > F.col("_q")) & (F.col("size") > least_size)).drop("_q").orderBy(F.desc("similarity"), "cluster").limit(n)
