"""Features of bars: gaps between dates, renko tags, date statistics, daily statistics, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.scalars import fracdiff_weights, linspace
from tidebar.operators.folds import fold, jma, jma_step


def gap_fillers(bars: DataFrame, symbol: str, date: str, col: str, least: float = 0.005) -> DataFrame:
    """Filler rows (symbol, date of the earlier bars, place, col, bar_trigger) between consecutive dates of a symbol.

    From the last value of a date to the first of the next, in steps of half the median return (absolute, but no less than
    ``least``) of the earlier date: both ends, and the end once more. A gap of no step has only the last row, of one step
    the start and the last row. bars: order within a date by open_at.
    """
    d = bars.groupBy(symbol, date).agg(F.min_by(col, "open_at").alias("_first"), F.max_by(col, "open_at").alias("_last"), F.median("price_return").alias("_m"))
    d = d.withColumn("_next", F.lead("_first").over(W.partitionBy(symbol).orderBy(date))).where("_next is not null")
    size = F.greatest(F.abs(F.col("_m")) / 2, F.lit(least))
    n = F.bround(F.abs(F.col("_last") - F.col("_next")) / size).cast("int")
    filled = F.concat(linspace(F.col("_last"), F.col("_next"), n), F.array("_next"))
    return d.select(symbol, date, F.posexplode(filled).alias("place", col)).withColumn("bar_trigger", F.lit("gap_filler"))


def stacked(bars: DataFrame, symbol: str, date: str, col: str, least: float = 0.005) -> DataFrame:
    """Bars and fillers in one table; order by date, is_filler, open_at, place."""
    fill = gap_fillers(bars, symbol, date, col, least).withColumn("is_filler", F.lit(1))
    return bars.withColumns({"is_filler": F.lit(0), "place": F.lit(0)}).unionByName(fill, allowMissingColumns=True)


def gap_aware_jma(bars: DataFrame, symbol: str, date: str, col: str, winlen: int, power: float = 1) -> DataFrame:
    """bars with {col}_jma{winlen}, its difference to the row before and the rest (value minus JMA), all computed over bars
    and gap fillers; windows above 99 use the expanding JMA. Fillers are dropped again."""
    name = f"{col}_jma{winlen}"
    rows = stacked(bars, symbol, date, col).withColumn("_open", F.coalesce("open_at", F.lit("9999-12-31").cast("timestamp_ntz")))
    order = [date, "is_filler", "_open", "place"]
    out = fold(rows, [symbol], order, [col], jma_step(winlen, power, 0.0, winlen > 99), {name: "double"})
    out = out.withColumn(f"{name}_diff", F.col(name) - F.lag(name).over(W.partitionBy(symbol).orderBy(*order))).withColumn(f"{name}_resid", F.col(col) - F.col(name))
    return out.where("is_filler = 0").drop("is_filler", "place", "_open")


def renko_tag(bars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """renko_type: trend if the trigger equals the one before, reversal if not (and for the first), duration after a
    duration bar."""
    before = F.lag("bar_trigger").over(W.partitionBy(*keys).orderBy(order))
    tag = F.when(before == "duration", "duration").when(F.col("bar_trigger") == before, "trend").otherwise("reversal")
    return bars.withColumn("renko_type", tag)


def time_features(bars: DataFrame, at: str, duration_us: str) -> DataFrame:
    """duration_10s (tenths of a minute and so on: seconds over 10, rounded half to even), min_in_day, day_of_week (Monday
    is 0)."""
    return bars.withColumns({"duration_10s": F.bround(F.col(duration_us) / 1e7).cast("long"), "min_in_day": F.hour(at) * 60 + F.minute(at), "day_of_week": F.weekday(at)})


def one_hot(df: DataFrame, col: str, values: list[str], drop_first: bool = True) -> DataFrame:
    """0/1 columns {col}_{value} for the values in order, the first left out if asked."""
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in sorted(values)[int(drop_first) :]})


def date_stats(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Per date: bars, median duration in minutes (the part below a day), mean range, first and last time; no fillers."""
    real = bars.where(F.coalesce(F.col("bar_trigger") != "gap_filler", F.lit(True)))
    minutes = F.floor(F.pmod(F.col("duration_us"), F.lit(86_400_000_000)) / 1_000_000) / 60
    return real.groupBy(*keys).agg(F.count("price_close").alias("bar_count"), F.median(minutes).alias("duration_min_median"), F.avg("price_range").alias("price_range_mean"), F.min("open_at").alias("first_at"), F.max("close_at").alias("last_at"))


def fractions(rows: DataFrame, keys: list[str], col: str, values: list[str]) -> DataFrame:
    """A column for each value: its share of all rows of the key, those with null included."""
    return rows.groupBy(*keys).agg(*((F.sum(F.when(F.col(col) == v, 1).otherwise(0)) / F.count("*")).alias(n) for v, n in zip(values, (v.replace(": ", "_").replace(" ", "_").replace("-", "_").lower() for v in values))))


def daily_stats(daily: DataFrame, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """range_jma_lag and vwap_jma_lag: JMA of 5 of the range and of 7 of the VWAP, as of the date before; rows without are
    dropped."""
    out = jma(jma(daily, [symbol], [date], "range", 5, name="range_jma"), [symbol], [date], "vwap", 7, name="vwap_jma")
    w = W.partitionBy(symbol).orderBy(date)
    return out.withColumns({"range_jma_lag": F.lag("range_jma").over(w), "vwap_jma_lag": F.lag("vwap_jma").over(w)}).where("range_jma_lag is not null and vwap_jma_lag is not null")


def renko_size(stats: DataFrame, range_frac: float, min_pct: float, max_frac: float = 0.005) -> Column:
    """max(range_jma_lag / range_frac, vwap_jma_lag * min_pct / 100), at most max_frac of vwap_jma_lag."""
    v = F.col("vwap_jma_lag")
    return F.least(F.greatest(F.col("range_jma_lag") / range_frac, v * min_pct / 100), v * max_frac)


def moving_average(df: DataFrame, keys: list[str], order: list[str], col: str, n: int) -> Column:
    """Mean of the last n rows; null before there are n."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(w) >= n, F.avg(col).over(w))


def stochastic(df: DataFrame, keys: list[str], order: list[str], high: str, low: str, close: str, n: int = 14, m: int = 3) -> DataFrame:
    """stoch_k and stoch_d; null until a window is full, and where the window has no range."""
    w = W.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(-(n - 1), 0)
    lo, hi = F.min(low).over(frame), F.max(high).over(frame)
    out = df.withColumn("stoch_k", F.when(F.count(close).over(frame) >= n, 100 * (F.col(close) - lo) / F.nullif(hi - lo, F.lit(0.0))))
    last = w.rowsBetween(-(m - 1), 0)
    return out.withColumn("stoch_d", F.when(F.count("stoch_k").over(last) >= m, F.avg("stoch_k").over(last)))


def fracdiff(df: DataFrame, keys: list[str], order: list[str], col: str, d: float, size: int) -> Column:
    """Fractional difference with a fixed window of ``size`` weights; null before there are as many rows."""
    w = W.partitionBy(*keys).orderBy(*order)
    total = None
    for k, weight in enumerate(fracdiff_weights(d, size)):
        term = F.lag(col, k).over(w) * weight
        total = term if total is None else total + term
    return total


def low_wick_markers(df: DataFrame, q: float = 0.99) -> DataFrame:
    """Rows whose lower wick exceeds the q-quantile of all wicks."""
    wick = F.least("open", "close") - F.col("low")
    rows = df.withColumn("wick", wick)
    return rows.join(F.broadcast(rows.agg(F.percentile("wick", q).alias("_cut"))), F.col("wick") > F.col("_cut")).drop("_cut")
