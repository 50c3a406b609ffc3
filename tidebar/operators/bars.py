"""Bars: by time, by what trades do, and in step with another symbol's bars."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.scalars import epoch_truncated, local_time, minute_of_day
from tidebar.operators.folds import Thresholds, fold, sampler_step

QUANTILES = {"wq05": 0.05, "wq25": 0.25, "wq50": 0.5, "wq75": 0.75, "wq95": 0.95}


def vwap(price: str = "price", weight: str = "volume") -> Column:
    """Weighted mean; null if the weights sum to 0."""
    return F.sum(F.col(price) * F.col(weight)) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0))


def weighted_quantiles(rows: DataFrame, keys: list[str], price: str = "price", weight: str = "volume", quantiles: dict[str, float] | None = None) -> DataFrame:
    """keys and a column for each quantile: with weights merged by value and summed in order, the first value at which the
    sum exceeds p of the total, averaged with the first at which it reaches it (they differ only on an exact hit)."""
    quantiles = quantiles or QUANTILES
    merged = rows.where(F.col(price).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, F.col(price).alias("_v")).agg(F.sum(weight).cast("double").alias("_w"))
    w = W.partitionBy(*keys)
    sums = merged.withColumn("_sum", F.sum("_w").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(w))
    v, s, total = F.col("_v"), F.col("_sum"), F.col("_all")
    return sums.groupBy(*keys).agg(*(((F.coalesce(F.min(F.when(s > p * total, v)), F.max(v)) + F.min(F.when(s >= p * total, v))) / 2).alias(name) for name, p in quantiles.items()))


def weighted_median(rows: DataFrame, keys: list[str], price: str = "price", weight: str = "volume") -> DataFrame:
    """The lower weighted median: the first value at which the sum of weights reaches half of the total."""
    w = W.partitionBy(*keys)
    sums = rows.where(F.col(weight) > 0).withColumn("_sum", F.sum(weight).over(w.orderBy(price).rangeBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(w))
    return sums.groupBy(*keys).agg(F.min(F.when(F.col("_sum") * 2 >= F.col("_all"), F.col(price))).alias("weighted_median"))


def summary(ticks: DataFrame, keys: list[str], at: str = "ts", seq: str = "seq", imbalances: bool = False, legacy: bool = False) -> DataFrame:
    """A bar for each key: times, counts, OHLC, range, return, VWAP and weighted quantiles.

    Quantiles come from running sums of weights in the order of price, beside the aggregates: a key's ticks are shuffled
    once, and quantiles that nobody selects are not computed. legacy gives two figures of synchronised bars as an older layout had them: dollar_value as volume times ticks, and the
    return from last to first.
    """
    first = F.struct(at, seq)
    value = F.sum(F.col("price") * F.col("volume"))
    ret = F.max_by("price", first) - F.min_by("price", first)
    aggs = [
        F.min(at).alias("open_at"),
        F.max(at).alias("close_at"),
        F.count("*").alias("tick_count"),
        F.sum("volume").cast("long").alias("volume"),
        (F.sum("volume") * F.count("*")).cast("double").alias("dollar_value") if legacy else value.alias("dollar_value"),
        F.max("price").alias("price_high"),
        F.min("price").alias("price_low"),
        F.min_by("price", first).alias("price_open"),
        F.max_by("price", first).alias("price_close"),
        (F.max("price") - F.min("price")).alias("price_range"),
        (-ret if legacy else ret).alias("price_return"),
        vwap().alias("price_vwap"),
    ]
    if imbalances:
        aggs += [F.sum("side").cast("long").alias("tick_imbalance"), F.sum(F.col("side") * F.col("volume")).cast("long").alias("volume_imbalance")]
    w = W.partitionBy(*keys)
    weight = F.when(F.col("price").isNotNull() & (F.col("volume") > 0), F.col("volume").cast("double"))
    sums = ticks.withColumn("_w", weight).withColumns({"_sum": F.sum("_w").over(w.orderBy("price")), "_all": F.sum("_w").over(w)})
    v, s, total = F.when(F.col("_w").isNotNull(), F.col("price")), F.col("_sum"), F.col("_all")
    aggs += [((F.coalesce(F.min(F.when(s > p * total, v)), F.max(v)) + F.min(F.when(s >= p * total, v))) / 2).alias(f"price_{q}") for q, p in QUANTILES.items()]
    return sums.groupBy(*keys).agg(*aggs).withColumn("duration_us", F.unix_micros(F.col("close_at").cast("timestamp")) - F.unix_micros(F.col("open_at").cast("timestamp")))


def bar_ids(ticks: DataFrame, keys: list[str], t: Thresholds, renko_size: str | None = None) -> DataFrame:
    """ticks (with price_jma and side) with bar_id and bar_trigger (on the tick that ends a bar). renko_size: a column that
    gives the size by row instead of one for all."""
    inputs = ["_us", "price", "volume", "side", "price_jma", "_n", "_size"]
    n = F.col("tick_count") if "tick_count" in ticks.columns else F.lit(1)
    size = F.col(renko_size).cast("double") if renko_size else F.lit(t.renko_size).cast("double")
    rows = ticks.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_n", n.cast("long")).withColumn("_size", size)
    return fold(rows, keys, ["ts", "seq"], inputs, sampler_step(t), {"bar_id": "long", "bar_trigger": "string"}).drop("_us", "_n", "_size")


def sampled_bars(ticks: DataFrame, keys: list[str], t: Thresholds, renko_size: str | None = None) -> DataFrame:
    """Bars that thresholds cut from the ticks. The unfinished last bar of a key and bars of too few ticks are left out."""
    cut = bar_ids(ticks, keys, t, renko_size)
    whole = cut.withColumn("bar_trigger", F.max("bar_trigger").over(W.partitionBy(*keys, "bar_id"))).where("bar_trigger is not null")
    return summary(whole, [*keys, "bar_id", "bar_trigger"], imbalances=True).where(F.col("tick_count") >= t.least_ticks)


def time_bins(ticks: DataFrame, keys: list[str], seconds: int = 3) -> DataFrame:
    """Fixed bins of the session 09:30 to 16:00 local time for each key and local date that has a tick in it: start
    included, end not; empty bins have null prices. Bins are numbered, so a bin is joined by equality. price is the
    volume-weighted mean, and price_jma that of the ticks' price_jma, if they have one; a bin of one tick has its own."""
    of_day = lambda c: minute_of_day(c) * 60 + F.second(c)
    local = ticks.withColumn("local_ts", local_time("ts")).withColumn("date", F.to_date("local_ts")).withColumn("bin", F.floor((of_day("local_ts") - 34_200) / seconds).cast("int"))
    bins = 23_400 // seconds
    inside = local.where((of_day("local_ts") >= 34_200) & (F.col("bin") < bins))
    n = F.count("*")
    mean = lambda c: F.when(n == 1, F.min(c)).otherwise(vwap(c)).alias(c)
    by_bin = inside.groupBy(*keys, "date", "bin").agg(
        n.alias("tick_count"), F.sum("volume").cast("long").alias("volume"), F.sum("side").cast("long").alias("side"), mean("price"),
        *([mean("price_jma")] if "price_jma" in ticks.columns else []),
        F.max("price").alias("price_high"), F.min("price").alias("price_low"), (F.max("price") - F.min("price")).alias("price_range"),
    )
    # a key's empty bins are laid beside those that have ticks, so that they are neither shuffled nor joined
    kinds = [(c, k) for c, k in by_bin.dtypes if c not in (*keys, "date")]
    known = F.when(F.coalesce(*(F.when(F.col(c).isNull(), True) for c in (*keys, "date")), F.lit(False)), F.slice("_have", 1, 0)).otherwise(F.col("_have"))
    packed = by_bin.groupBy(*keys, "date").agg(F.collect_list(F.struct(*(c for c, _ in kinds))).alias("_have")).withColumn("_have", known)
    empty = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(bins - 1)), F.col("_have.bin")), lambda x: F.struct(*(x.alias(c) if c == "bin" else F.lit(None).cast(k).alias(c) for c, k in kinds)))
    out = packed.select(*keys, "date", F.inline(F.concat("_have", empty))).fillna(0, ["tick_count", "volume", "side"])
    at = lambda s: F.col("date").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.lit(34_200) + s).cast("decimal(18,6)"))
    return out.withColumns({"open_at": at(F.col("bin") * seconds), "close_at": at((F.col("bin") + 1) * seconds)})


def epoch_groups(ticks: DataFrame, keys: list[str], unit: str, nanos: Column) -> DataFrame:
    """Count, mean and median price and volume by truncated epoch."""
    return ticks.withColumn(unit, epoch_truncated(nanos, unit)).groupBy(*keys, unit).agg(F.count("price").alias("price_count"), F.avg("price").alias("price_mean"), F.median("price").alias("price_median"), F.sum("volume").cast("long").alias("volume_sum"))


#: Into how many parts the symbols of a date are dealt, and the most pairs of a bar and a tick that a task has at once.
PARTS, PAIRS = 16, 1 << 17


def _micros(ts: str, kind: str) -> Column:
    """Microseconds of a time; of one without a zone, as if it were UTC, whatever the session's zone is."""
    if kind != "timestamp_ntz":
        return F.unix_micros(F.col(ts).cast("timestamp"))
    whole = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return whole * 1_000_000 + (F.date_part(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("long")


def _stamps(us: np.ndarray, kind: str) -> pd.Series:
    """The times of microseconds, for a column of type _stamped(kind)."""
    at = pd.Series(us.astype("datetime64[us]"))
    return at if kind == "timestamp_ntz" else at.dt.tz_localize("UTC")


def _stamped(kind: str) -> str:
    return kind if kind == "timestamp_ntz" else "timestamp"


def _summed(ts: np.ndarray, price: np.ndarray, volume: np.ndarray, starts: np.ndarray, quantiles: bool) -> dict[str, np.ndarray]:
    """What ``summary`` gives of ticks that lie group by group in order of time; NaN is null."""
    ends = np.append(starts[1:], len(ts)) - 1
    n = ends - starts + 1

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(np.nan_to_num(x), starts)
        return np.where(np.add.reduceat(~np.isnan(x), starts, dtype=int) > 0, sums, np.nan)

    out = {"_open": ts[starts], "_close": ts[ends], "tick_count": n, "volume": total(volume), "_value": total(price * volume)}
    out |= {"price_high": np.fmax.reduceat(price, starts), "price_low": np.fmin.reduceat(price, starts), "price_open": price[starts], "price_close": price[ends]}
    if quantiles:
        group = np.repeat(np.arange(len(starts)), n)
        weight = np.where(~np.isnan(price) & (volume > 0), volume, 0.0)
        order = np.lexsort((price, group))
        v, w = price[order], weight[order]
        running = np.cumsum(w)
        running -= np.repeat(running[starts] - w[starts], n)
        whole = running[ends]
        last = np.fmax.reduceat(np.where(weight > 0, price, np.nan), starts)
        for name, p in QUANTILES.items():
            cut = np.repeat(p * whole, n)
            above, upto = (np.add.reduceat(x, starts, dtype=int) for x in (running <= cut, running < cut))
            value = [np.where(k < n, v[starts + np.minimum(k, n - 1)], last) for k in (above, upto)]
            out[f"price_{name}"] = np.where(whole > 0, (value[0] + value[1]) / 2, np.nan)
    return out


def synchronised(clock: DataFrame, ticks: DataFrame, date: str, width_micros: int | None = None, legacy: bool = False, quantiles: bool = True) -> DataFrame:
    """Bars of other symbols' ticks inside the bars of clock (symbol, open_at, close_at, date): open_at < ts <= close_at, a
    symbol never by its own clock; bars without ticks are left out. Columns are those of ``summary``; without quantiles,
    those are left out.

    A pair of a clock's bar and a tick is never a row: symbols are dealt into PARTS, and the clocks of a date are copied to each,
    so that a bar's ticks of one symbol meet in one task, which sums them up, PAIRS at a time. Of the ticks, sorted by time, a
    bar touches only those inside, so that bars of any width cost what they hold (width_micros is of no use any more).
    """
    kinds, clocks = dict(ticks.dtypes), dict(clock.dtypes)
    part = F.pmod(F.xxhash64("symbol"), F.lit(PARTS))
    none = lambda kind: F.lit(None).cast(kind)
    side = ticks.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull()).select(
        date, part.alias("_part"), "symbol", _micros("ts", kinds["ts"]).alias("_at"), "seq", F.col("price").cast("double").alias("price"), F.col("volume").cast("double").alias("volume"),
        none(clocks["symbol"]).alias("clock_symbol"), none("long").alias("_from"), none("long").alias("_to"),
    )
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))
    copies = clock.where("symbol is not null and open_at is not null and close_at is not null").select(
        F.col(date).cast(kinds[date]).alias(date), parts.alias("_part"), none(kinds["symbol"]).alias("symbol"), none("long").alias("_at"), none(kinds["seq"]).alias("seq"), none("double").alias("price"), none("double").alias("volume"),
        F.col("symbol").alias("clock_symbol"), _micros("open_at", clocks["open_at"]).alias("_from"), _micros("close_at", clocks["close_at"]).alias("_to"),
    )
    names = ["volume", "_value", "price_high", "price_low", "price_open", "price_close", *(f"price_{q}" for q in QUANTILES if quantiles)]

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = pd.concat(list(frames), ignore_index=True)
        bars, dots = both[both["_from"].notna()], both[both["_from"].isna()].sort_values(["_at", "seq"], na_position="first")
        if not len(bars) or not len(dots):
            return
        at, price, volume = dots["_at"].to_numpy("int64"), dots["price"].to_numpy(float), dots["volume"].to_numpy(float)
        own, symbols = pd.factorize(dots["symbol"])
        clock = bars["clock_symbol"].to_numpy()
        self = pd.Index(symbols).get_indexer(clock)
        start, end = bars["_from"].to_numpy("int64"), bars["_to"].to_numpy("int64")
        lo = np.searchsorted(at, start, "right")
        hi = np.maximum(np.searchsorted(at, end, "right"), lo)
        slot = np.cumsum(hi - lo) // PAIRS
        for some in np.split(np.arange(len(bars)), np.flatnonzero(np.diff(slot)) + 1):
            count = hi[some] - lo[some]
            bar = np.repeat(some, count)
            tick = np.arange(len(bar)) - np.repeat(np.cumsum(count) - count, count) + lo[bar]
            other = own[tick] != self[bar]
            bar, tick = bar[other], tick[other]
            if not len(bar):
                continue
            group = bar * len(symbols) + own[tick]
            order = np.argsort(group, kind="stable")
            group, tick = group[order], tick[order]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            bar = group[starts] // len(symbols)
            found = _summed(at[tick], price[tick], volume[tick], starts, quantiles)
            out = {"clock_symbol": clock[bar], date: key[0], "clock_open_at": _stamps(start[bar], clocks["open_at"]), "clock_close_at": _stamps(end[bar], clocks["close_at"]), "symbol": np.asarray(symbols)[group[starts] % len(symbols)]}
            out |= {"open_at": _stamps(found["_open"], kinds["ts"]), "close_at": _stamps(found["_close"], kinds["ts"]), "duration_us": found["_close"] - found["_open"], "tick_count": found["tick_count"]}
            yield pd.DataFrame(out | {c: found[c] for c in names})

    # times are made by the task, as making them from numbers takes Spark longer than all else here
    opened, tick = _stamped(clocks["open_at"]), _stamped(kinds["ts"])
    schema = f"clock_symbol {clocks['symbol']}, {date} {kinds[date]}, clock_open_at {opened}, clock_close_at {_stamped(clocks['close_at'])}, symbol {kinds['symbol']}, open_at {tick}, close_at {tick}, duration_us long, tick_count long, " + ", ".join(f"{c} double" for c in names)
    rows = side.unionByName(copies).where(F.col(date).isNotNull()).repartition(4 * PARTS, date, "_part").groupBy(date, "_part").applyInPandas(run, schema)
    null = lambda c: F.nanvl(c, none("double"))
    value, volume, back = null("_value"), null("volume"), null("price_close") - null("price_open")
    out = rows.select(
        "clock_symbol", date, F.col("clock_open_at").cast(clocks["open_at"]).alias("clock_open_at"), F.col("clock_close_at").cast(clocks["close_at"]).alias("clock_close_at"), "symbol",
        F.col("open_at").cast(kinds["ts"]).alias("open_at"), F.col("close_at").cast(kinds["ts"]).alias("close_at"), "tick_count", volume.cast("long").alias("volume"),
        (volume * F.col("tick_count") if legacy else value).alias("dollar_value"), null("price_high").alias("price_high"), null("price_low").alias("price_low"),
        null("price_open").alias("price_open"), null("price_close").alias("price_close"), (null("price_high") - null("price_low")).alias("price_range"),
        (-back if legacy else back).alias("price_return"), (value / F.nullif(volume, F.lit(0.0))).alias("price_vwap"),
        *(null(f"price_{q}").alias(f"price_{q}") for q in QUANTILES if quantiles), "duration_us",
    )
    return out


def imbalance_runs(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of equal side: tick_run, volume_run and dollar_run since the run's first tick, which counts as 0."""
    w = W.partitionBy(*keys).orderBy("ts", "seq")
    new = F.when(F.col("side") == F.lag("side").over(w), 0).otherwise(1)
    out = ticks.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = W.partitionBy(*keys, "run").orderBy("ts", "seq")
    past = r.rowsBetween(W.unboundedPreceding, 0)
    counts = lambda x: F.sum(F.when(F.col("_new") == 1, 0).otherwise(x)).over(past)
    return out.withColumns({"tick_run": (F.row_number().over(r) - 1).cast("long"), "volume_run": counts(F.col("volume")).cast("long"), "dollar_run": counts(F.col("price") * F.col("volume")).cast("double")}).drop("_new")
