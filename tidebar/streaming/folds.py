"""The batch folds over streams: the same steps, with a key's state kept by Spark between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebar.operators.folds import JMA, MAD, BarSampler, Thresholds
from tidebar.operators.ticks import IRREGULAR, with_session

STATE = "known string, us long, seq long"
OUT = "symbol {symbol}, date date, seq long, us long, price double, volume long, status string, price_jma double, side int, bar_id long, bar_trigger string"


class TickChain:
    """MAD, status, JMA, side and bars of one key's ticks. What it knows is plain data, so that Spark can keep it."""

    def __init__(self, thresholds: Thresholds, mad: tuple[int, int, float], jma: tuple[int, float], known: dict | None = None):
        self.mad, self.jma, self.sampler = MAD(*mad), JMA(*jma), BarSampler(thresholds)
        self.price, self.side = None, 0
        if known:
            for window, values in zip((self.mad.values, self.mad.deviations), known["windows"]):
                for v in values:
                    window(v)
            self.mad.seen, self.price, self.side = known["seen"], known["price"], known["side"]
            self.jma.state = tuple(known["jma"]) if known["jma"] else None
            self.sampler.bar, self.sampler.last_return, self.sampler.open = known["bar"], known["last_return"], known["open"]

    def known(self) -> dict:
        s = self.sampler
        return {"windows": [list(self.mad.values.past), list(self.mad.deviations.past)], "seen": self.mad.seen, "jma": self.jma.state, "price": self.price, "side": self.side, "bar": s.bar, "last_return": s.last_return, "open": s.open}

    def __call__(self, us: int, price: float | None, volume: int | None, conditions, exchange_us: int | None, session: str = "market-open") -> dict:
        """status (clean with the session), and for clean ticks price_jma, side, bar_id and bar_trigger."""
        _, _, mad_status = self.mad(price)
        if volume is None or volume < 1:
            status = "filtered: zero volume"
        elif conditions is not None and any(c in IRREGULAR for c in conditions):
            status = "filtered: irregular condition"
        elif exchange_us is not None and abs(us - exchange_us) > 3_000_000:
            status = "filtered: ts diff"
        elif mad_status != "mad_clean":
            status = f"filtered: {mad_status}"
        elif price is None:
            status = "filtered: no price"
        else:
            status = f"clean: {session}"
        out = {"status": status, "price_jma": None, "side": None, "bar_id": None, "bar_trigger": None}
        if status.startswith("clean"):
            if self.price is not None and price != self.price:
                self.side = 1 if price > self.price else -1
            self.price = price
            average = self.jma(price)
            bar, trigger = self.sampler(us, price, volume, self.side, average)
            out |= {"price_jma": average, "side": self.side, "bar_id": bar, "bar_trigger": trigger}
        return out


def tick_stream(ticks: DataFrame, thresholds: Thresholds, mad: tuple[int, int, float] = (22, 333, 11), jma: tuple[int, float] = (7, 1), keep_hours: int = 48, late: str = "10 minutes") -> DataFrame:
    """symbol, date, ts, seq, price, volume, status, price_jma, side, bar_id and bar_trigger of each tick of a stream.

    As in a batch run, filters, averages and bars start anew with each symbol and local date, and a clean tick's status has
    its session. Rows of a micro-batch are put in order of (ts, seq); a tick that is not later than the last one handled is
    dropped as late, as are ticks behind the watermark. The state is a few windows and one open bar for each symbol and date;
    it goes when the watermark has passed its last tick by keep_hours.
    A task holds one symbol's ticks of a micro-batch. Symbols may be of any type. A null price is filtered.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = with_session(ticks).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).select("at", "symbol", F.to_date("local_ts").alias("date"), "seq", "price", "volume", "conditions", us("ts").alias("us"), us("exchange_ts").alias("exchange_us"), "session")
    names = [c.split()[0] for c in OUT.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, last = None, (-(1 << 62), -1)
        if state.exists:
            text, *last = state.get
            known, last = json.loads(text), tuple(last)
        chain = TickChain(thresholds, mad, jma, known)
        out = []
        batch = pd.concat(list(batches)).sort_values(["us", "seq"], kind="stable")
        for seq, price, volume, conditions, us, exchange_us, session in batch[["seq", "price", "volume", "conditions", "us", "exchange_us", "session"]].itertuples(index=False):
            if (us, seq) <= last:
                continue
            last = (int(us), int(seq))
            got = chain(int(us), None if pd.isna(price) else float(price), None if pd.isna(volume) else int(volume), conditions, None if pd.isna(exchange_us) else int(exchange_us), session)
            out.append({"symbol": key[0], "date": key[1], "seq": seq, "us": us, "price": price, "volume": volume, **got})
        state.update((json.dumps(chain.known()), *last))
        state.setTimeoutTimestamp(max(last[0] // 1000, state.getCurrentWatermarkMs()) + keep_hours * 3_600_000)
        yield pd.DataFrame(out, columns=names).astype({"side": "Int32", "bar_id": "Int64", "price_jma": "float64"})

    out = rows.groupBy("symbol", "date").applyInPandasWithState(update, OUT.format(symbol=dict(ticks.dtypes)["symbol"]), STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("symbol", "date", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "seq", "price", "volume", "status", "price_jma", "side", "bar_id", "bar_trigger")


def candles(ticks: DataFrame, width: str = "1 minute", late: str = "3 seconds") -> DataFrame:
    """Open, high, low, close and volume by symbol and window of a stream; in update mode the last candle is renewed as ticks
    come, until the watermark passes its end."""
    at = F.struct("ts", "seq")
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width)).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
