"""Cleaning and classifying ticks. Columns: symbol, ts, seq, price, volume, conditions, exchange_ts (all times UTC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.scalars import local_time, session
from tidebar.operators.folds import MAD_BOUNDS, fold, full_mad_step, mad_step

#: Trade condition codes that make a tick irregular. Fixed values.
IRREGULAR = [2, 5, 7, 10, 13, 15, 16, 20, 21, 22, 29, 33, 38, 52, 53]
#: Widest window that is computed by a frame; wider ones use a sorted window that moves along.
FRAME_MAX = 64


def ordered(*keys: str) -> W:
    """The total order of a key's ticks."""
    return W.partitionBy(*keys).orderBy("ts", "seq")


def irregular(conditions: str = "conditions") -> Column:
    """True if a condition code is irregular; false for none and null."""
    return F.coalesce(F.arrays_overlap(F.col(conditions), F.array(*map(F.lit, IRREGULAR))), F.lit(False))


def stamps_differ(seconds: float = 3.0) -> Column:
    """True if the two time stamps lie more than so many seconds apart; null stamps do not."""
    gap = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("exchange_ts").cast("timestamp")))
    return F.coalesce(gap > int(seconds * 1e6), F.lit(False))


def with_session(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("local_ts", local_time("ts")).withColumn("session", session("local_ts"))


def mad_rolling(ticks: DataFrame, keys: list[str], col: str = "price", value_winlen: int = 22, deviation_winlen: int = 1111, k: float = 11, kind: str = "simple", centred: bool = False) -> DataFrame:
    """{col}_median, {col}_dev, {col}_mad and mad_outlier over full windows: null until a window is full.

    The median needs value_winlen rows, the median deviation three times as many; it is bounded, and a row is an outlier
    if its deviation exceeds k times it (false where null). centred: windows lie around a row (half of them, rounded down,
    before it) instead of ending with it. Windows wider than a frame should be are sorted ones that move along.
    """
    names = [f"{col}_median", f"{col}_dev", f"{col}_mad"]
    x, m, d, mad = F.col(col), *map(F.col, names)
    if not centred and max(value_winlen, deviation_winlen) > FRAME_MAX:
        kept = ticks.withColumn("_x", x.cast("double"))
        out = fold(kept, keys, ["ts", "seq"], ["_x"], full_mad_step(value_winlen, deviation_winlen, kind), dict.fromkeys(names, "double")).drop("_x")
        return out.withColumn("mad_outlier", F.coalesce(d > mad * k, F.lit(False)))
    w = ordered(*keys)
    frame, wide = (w.rowsBetween(-(n // 2), n - 1 - n // 2) if centred else w.rowsBetween(-(n - 1), 0) for n in (value_winlen, deviation_winlen))
    low, high = MAD_BOUNDS[kind]
    out = ticks.withColumn(names[0], F.when(F.count(x).over(frame) >= value_winlen, F.percentile(x, 0.5).over(frame)))
    out = out.withColumn(names[1], F.abs(x - m) if kind == "simple" else F.abs((x - m) / F.nullif(m, F.lit(0.0))) * 100)
    typical = F.when(F.count(d).over(wide) >= 3 * value_winlen, F.percentile(d, 0.5).over(wide))
    out = out.withColumn(names[2], F.when(typical.isNotNull(), F.least(F.greatest(typical, F.lit(low)), F.lit(high))))
    return out.withColumn("mad_outlier", F.coalesce(d > mad * k, F.lit(False)))


def mad_running(ticks: DataFrame, keys: list[str], value_winlen: int = 22, deviation_winlen: int = 333, k: float = 11) -> DataFrame:
    """median, mad and mad_status from the first tick on, over as many rows as there are up to the window's length. A null
    price is a row without a value and no outlier."""
    if max(value_winlen, deviation_winlen) > FRAME_MAX:
        return fold(ticks, keys, ["ts", "seq"], ["price"], mad_step(value_winlen, deviation_winlen, k), {"median": "double", "mad": "double", "mad_status": "string"})
    w = ordered(*keys)
    low, high = MAD_BOUNDS["simple"]
    out = ticks.withColumn("median", F.percentile("price", 0.5).over(w.rowsBetween(-(value_winlen - 1), 0))).withColumn("_off", F.abs(F.col("price") - F.col("median")))
    out = out.withColumn("mad", F.least(F.greatest(F.percentile("_off", 0.5).over(w.rowsBetween(-(deviation_winlen - 1), 0)), F.lit(low)), F.lit(high)))
    status = F.when(F.least(F.row_number().over(w), F.lit(deviation_winlen)) < value_winlen, "mad_warmup").when(F.col("_off") > F.col("mad") * k, "mad_outlier").otherwise("mad_clean")
    return out.withColumn("mad_status", status).drop("_off")


def status_running(ticks: DataFrame, keys: list[str], value_winlen: int = 22, deviation_winlen: int = 333, k: float = 11) -> DataFrame:
    """mad_running with status: the first that fits of zero volume, irregular condition, differing stamps, warm-up, outlier
    and no price; else clean with the session. Every tick moves the medians, whatever its status."""
    out = with_session(mad_running(ticks, keys, value_winlen, deviation_winlen, k))
    status = (
        F.when(F.coalesce(F.col("volume"), F.lit(0)) < 1, "filtered: zero volume")
        .when(irregular(), "filtered: irregular condition")
        .when(stamps_differ(), "filtered: ts diff")
        .when(F.col("mad_status") != "mad_clean", F.concat(F.lit("filtered: "), "mad_status"))
        .when(F.col("price").isNull(), "filtered: no price")
        .otherwise(F.concat(F.lit("clean: "), "session"))
    )
    return out.withColumn("status", status)


def status_rolling(ticks: DataFrame, keys: list[str], value_winlen: int = 22, deviation_winlen: int = 1111, k: float = 11) -> DataFrame:
    """mad_rolling with status: the last that fits of no price, differing stamps, irregular condition, zero volume, warm-up
    and outlier."""
    out = mad_rolling(ticks, keys, "price", value_winlen, deviation_winlen, k)
    place = F.row_number().over(ordered(*keys)) - 1
    status = (
        F.when(F.col("mad_outlier"), "filtered: MAD outlier")
        .when(place <= 3 * value_winlen, "filtered: MAD warm-up")
        .when(F.col("volume") == 0, "filtered: zero volume")
        .when(irregular(), "filtered: irregular condition")
        .when(stamps_differ(), "filtered: ts diff")
        .when(F.col("price").isNull(), "filtered: no price")
        .otherwise("clean")
    )
    return out.withColumn("status", status)


def clean(ticks: DataFrame, sessions: list[str] | None = None) -> DataFrame:
    """Ticks whose status is not filtered, of the given sessions or all."""
    out = ticks.where(~F.col("status").startswith("filtered"))
    return out if sessions is None else out.where(F.col("status").isin(*(f"clean: {s}" for s in sessions)))


def with_side(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """side: the sign of the last price change; 0 before the first."""
    w = ordered(*keys)
    change = F.signum(F.col("price") - F.lag("price").over(w))
    out = ticks.withColumn("_sign", F.nullif(change, F.lit(0.0)))
    last = F.last("_sign", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("side", F.coalesce(last, F.lit(0.0)).cast("int")).drop("_sign")
