"""The minimum covariance determinant: mean and covariance of the tightest part of the rows, from several starts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators.graph import fixed

#: Most coordinates: a few matrices of that size are in the driver and in every task.
MAX_COORDINATES = 512


@dataclass
class Fit:
    """A start's state: mean, covariance of its support, and the logarithm of the determinant after each step."""

    mean: np.ndarray
    cov: np.ndarray
    log_det: list[float]

    def whitener(self) -> np.ndarray:
        """W with d2 = |W (x - mean)|^2."""
        values, vectors = np.linalg.eigh(self.cov)
        values = np.maximum(values, max(values.max(), 1e-300) * 1e-12)
        return (vectors / np.sqrt(values)).T


def _log_det(cov: np.ndarray) -> float:
    values = np.linalg.eigvalsh(cov)
    return float(np.log(np.maximum(values, max(values.max(), 1e-300) * 1e-12)).sum())


def chi2_quantile(share: float, k: int) -> float:
    """The value that a chi-squared variable of k degrees of freedom stays below with this probability."""

    def below(x: float) -> float:
        if x <= 0:
            return 0.0
        a, h = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= h / n
            total += term
        return total * exp(a * log(h) - h - lgamma(a))

    lo, hi = 0.0, max(10.0, 4.0 * k)
    while below(hi) < share:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < share else (lo, mid)
    return (lo + hi) / 2


def with_distances(points: DataFrame, fits: list[Fit]) -> DataFrame:
    """points (id, v) with d2: the squared Mahalanobis distance from each fit."""
    params = [(f.mean, f.whitener()) for f in fits]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_list())
                yield f.assign(d2=list(np.stack([(((x - m) @ w.T) ** 2).sum(1) for m, w in params], axis=1)))

    kinds = dict(points.dtypes)
    return points.select("id", "v").mapInPandas(run, f"id {kinds['id']}, v array<double>, d2 array<double>")


def order_statistic(rows: DataFrame, of: str, n: int, rank: int) -> list[tuple[float, int, int]]:
    """For each place of an array of n numbers that are not negative: the rank-th smallest (from 1), exactly; how many are
    smaller; and how many are equal to it.

    As doubles that are not negative sort as their bits do, the value is found sixteen bits at a time: four counts of at most
    65,536 groups each, made in every partition from the arrays as they are, however many rows there are.
    """
    arrays, found, below = rows.select(F.col(of).alias("x")), [0] * n, [0] * n
    for shift in (48, 32, 16, 0):
        counts = arrays.mapInPandas(_digits(shift, list(found)), "k int, p int, n long").groupBy("k", "p").agg(F.sum("n").alias("n")).toPandas()
        for k in range(n):
            left = rank - below[k]
            for p, c in counts.loc[counts["k"] == k, ["p", "n"]].sort_values("p").itertuples(index=False):
                if left <= c:
                    found[k], equal = found[k] << 16 | int(p), int(c)
                    break
                left -= int(c)
                below[k] += int(c)
            else:
                raise ValueError("fewer rows than the rank")
            if shift == 0:
                found[k] = (float(np.int64(found[k]).view(np.float64)), below[k], equal)
    return found


def _digits(shift: int, found: list[int]):
    """What counts, for each place of the arrays, the sixteen bits above a shift of the numbers that begin with those found."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(found), 1 << 16), np.int64)
        for f in frames:
            if len(f):
                bits = (np.stack(f["x"].to_list()) + 0.0).view(np.int64)
                for k, prefix in enumerate(found):
                    mine = bits[:, k] if shift == 48 else bits[bits[:, k] >> (shift + 16) == prefix, k]
                    total[k] += np.bincount((mine >> shift) & 0xFFFF, minlength=1 << 16)
        k, p = np.nonzero(total)
        yield pd.DataFrame({"k": k.astype(np.int32), "p": p.astype(np.int32), "n": total[k, p]})

    return run


def _moments(rows: DataFrame, limits: list[tuple[float, float]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each start, the weight, weighted sum and weighted products of the rows within its limit: whole below it, a share at
    it. Summed within partitions, then over groups of them, then over those."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = None
        for f in frames:
            if not len(f):
                continue
            x, d2 = np.stack(f["v"].to_list()), np.stack(f["d2"].to_list())
            x1 = np.c_[np.ones(len(x)), x]
            each = []
            for k, (limit, share) in enumerate(limits):
                w = np.where(d2[:, k] < limit, 1.0, np.where(d2[:, k] == limit, share, 0.0))
                each.append((x1 * w[:, None]).T @ x1)
            sums = each if sums is None else [s + e for s, e in zip(sums, each)]
        if sums is not None:
            yield pd.DataFrame({"start": range(len(sums)), "m": [s.ravel() for s in sums]})

    def total(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"start": f["start"][:1], "m": [np.sum(np.stack(f["m"].to_list()), axis=0)]})

    parts = rows.select("v", "d2").mapInPandas(part, "start int, m array<double>").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64)))
    sums = parts.groupBy("start", "g").applyInPandas(lambda f: total(f), "start int, m array<double>").groupBy("start").applyInPandas(lambda f: total(f), "start int, m array<double>").orderBy("start").collect()
    out = []
    for r in sums:
        m = np.array(r["m"])
        size = int(round(len(m) ** 0.5))
        m = m.reshape(size, size)
        out.append((m[0, 0], m[0, 1:], m[1:, 1:]))
    return out


def concentrated(points: DataFrame, fits: list[Fit], support: int) -> list[Fit]:
    """One concentration step of every start: the ``support`` rows nearest to its fit make its next mean and covariance, whose
    determinant is never larger. Of rows at the same distance as the last, each counts with the share that is missing."""
    rows = fixed(with_distances(points, fits))
    limits = [(v, (support - below) / equal) for v, below, equal in order_statistic(rows, "d2", len(fits), support)]
    out = []
    for f, (n, s, ss) in zip(fits, _moments(rows, limits)):
        mean = s / n
        cov = ss / n - np.outer(mean, mean)
        out.append(Fit(mean, cov, [*f.log_det, _log_det(cov)]))
    return out


def minimum_covariance_determinant(rows: DataFrame, id_col: str, col: str, support: int | None = None, starts: int = 8, finalists: int = 2, steps: int = 30) -> tuple[DataFrame, Fit]:
    """(rows, fit). rows: id, distance and weight of each row with an id and a vector (an array column); fit: the mean and
    covariance without outliers.

    FAST-MCD (Rousseeuw and van Driessen, 1999): starts from random subsets of twice the coordinates and two more, rows by a
    hash of their id; two concentration steps for all starts at once; the finalists of the least determinant go on until it
    stays. The covariance is made consistent with the median distance, rows beyond the 97.5th percentile of their
    chi-squared distance get weight 0, and the fit is that of the others, from whose own distances nothing is cut again.
    support: rows that must fit, by default (n + p + 1) / 2. Rows of null ids or vectors are left out; no rows raise.
    """
    v = F.col(col).cast("array<double>")
    points = fixed(rows.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).alias("id"), v.alias("v")))
    shape = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("p")).first()
    n, p = shape["n"], shape["p"]
    if not n or p > MAX_COORDINATES:
        raise ValueError(f"{n} rows of {p} coordinates: rows are needed, and at most {MAX_COORDINATES} coordinates")
    support = support or min(n, (n + p + 1) // 2)
    each = min(n, 2 * p + 2)
    picked = points.orderBy(F.xxhash64("id"), "id").limit(each * starts).collect()  # a few times p rows
    fits = []
    for k in range(starts):
        x = np.array([r["v"] for r in picked[k * each : (k + 1) * each]])
        if len(x) > 1 or not fits:
            fits.append(Fit(x.mean(0), np.cov(x.T, bias=True).reshape(p, p), []))
    for _ in range(2):
        fits = concentrated(points, fits, support)
    fits = sorted(fits, key=lambda f: f.log_det[-1])[:finalists]
    for _ in range(steps):
        fits = concentrated(points, fits, support)
        if all(f.log_det[-2] - f.log_det[-1] < 1e-10 for f in fits):
            break
    best = min(fits, key=lambda f: f.log_det[-1])
    measured = fixed(with_distances(points, [best]))
    (median, *_), (cut, share) = order_statistic(measured, "d2", 1, (n + 1) // 2)[0], (chi2_quantile(0.975, p), 1.0)
    scale = median / chi2_quantile(0.5, p) or 1.0
    m, s, ss = _moments(measured, [(cut * scale, share)])[0]
    mean = s / m
    fit = Fit(mean, ss / m - np.outer(mean, mean), best.log_det)
    d2 = F.col("d2")[0] / F.lit(float(scale))
    return measured.select("id", F.sqrt(d2).alias("distance"), F.when(d2 <= cut, 1).otherwise(0).alias("weight")), fit
