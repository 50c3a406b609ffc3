"""Augmented Dickey-Fuller tests of many series and fractional orders at once, by normal equations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidebar.functions.scalars import fracdiff_weights

#: The 5% point of the test with a constant for n rows: b0 + b1 / n + b2 / n^2 + b3 / n^3 (MacKinnon, 2010). Fixed values.
CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.04)


def critical(n: Column) -> Column:
    return sum((F.lit(b) / F.pow(n, F.lit(k)) for k, b in enumerate(CRITICAL_5)), F.lit(0.0))


@F.pandas_udf(DoubleType())
def _t_value(n: pd.Series, products: pd.Series) -> pd.Series:
    """The t-value of the first regressor. products: centred, means of all pairs (i <= j) of the regressand and regressors."""

    def one(n: float, upper: np.ndarray) -> float | None:
        size = int((2 * len(upper)) ** 0.5)
        s = np.zeros((size, size))
        s[np.triu_indices(size)] = np.asarray(upper, float) * n
        s = s + np.triu(s, 1).T
        free = n - size  # the constant takes one, and the regressand none
        if free <= 0 or np.linalg.matrix_rank(s[1:, 1:]) < size - 1:
            return None
        inverse = np.linalg.inv(s[1:, 1:])
        beta = inverse @ s[1:, 0]
        rest = s[0, 0] - beta @ s[1:, 0]
        return beta[0] / (rest / free * inverse[0, 0]) ** 0.5 if rest > 0 else None

    return pd.Series([one(a, b) for a, b in zip(n, products)], dtype="float64")


def dickey_fuller(rows: DataFrame, keys: list[str], order: list[str], col: str, orders: list[float], size: int, lags: int = 1) -> DataFrame:
    """keys, d, n, adf, critical and stationary for each key and fractional order d.

    The fractional difference (``size`` weights) is regressed: its change on a constant, its last value and its last ``lags``
    changes; adf is the last value's t-value, stationary whether it is below the 5% point for n rows. All of a row's
    regressors are weighted sums of the values up to it, so one window serves all orders, and each key and order is a grouped
    sum of products. Nulls of col are left out first. adf is null where rows are too few or regressors depend on each other.
    """
    width = size + lags + 1
    w = W.partitionBy(*keys).orderBy(*order)
    past = rows.where(F.col(col).isNotNull()).select(*keys, F.reverse(F.collect_list(F.col(col).cast("double")).over(w.rowsBetween(1 - width, 0))).alias("_p")).where(F.size("_p") == width)

    def weighted(d: float, back: int) -> Column:
        weights = F.array(*map(F.lit, fracdiff_weights(d, size)))
        return F.aggregate(F.zip_with(F.slice("_p", back + 1, size), weights, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    series = F.array(*(F.struct(F.lit(float(d)).alias("d"), F.array(*(weighted(d, k) for k in range(lags + 2))).alias("f")) for d in orders))
    each = past.select(*keys, F.explode(series).alias("s")).select(*keys, "s.d", "s.f")
    change = lambda k: F.col("f")[k] - F.col("f")[k + 1]
    names = [f"_{k}" for k in range(lags + 2)]
    each = each.select(*keys, "d", change(0).alias("_0"), F.col("f")[1].alias("_1"), *(change(k).alias(f"_{k + 1}") for k in range(1, lags + 1)))
    pairs = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = each.groupBy(*keys, "d").agg(F.count("*").cast("double").alias("n"), F.array(*pairs).alias("_s"))
    out = sums.select(*keys, "d", F.col("n").cast("long").alias("n"), _t_value("n", "_s").alias("adf"), critical(F.col("n")).alias("critical"))
    return out.withColumn("adf", F.nanvl("adf", F.lit(None).cast("double"))).withColumn("stationary", F.coalesce(F.col("adf") < F.col("critical"), F.lit(False)))


def least_order(tests: DataFrame, keys: list[str]) -> DataFrame:
    """keys and d: the smallest order that passes for each key, null where none does."""
    return tests.groupBy(*keys).agg(F.min(F.when(F.col("stationary"), F.col("d"))).alias("d"))
