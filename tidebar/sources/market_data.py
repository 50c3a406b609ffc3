"""Market data from outside: captured logs, paged and cursor-paged interfaces, calendars, and synthetic prices.

Transports are passed in as functions (the tests bring recorded answers), so nothing here opens a connection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EVENT = "array<struct<ev:string,sym:string,x:int,i:string,z:int,p:double,s:bigint,c:array<int>,t:bigint,bp:double,ap:double,bs:bigint,`as`:bigint>>"


def parse_log(lines: DataFrame, kinds: tuple[str, ...] = ("T",)) -> DataFrame:
    """Trades of captured lines ``received_ns||[messages]`` (column value), batch or stream. Other kinds and broken lines
    give nothing; a missing size is 0; latency is in microseconds."""
    parts = F.split("value", r"\|\|", 2)
    rows = lines.select(parts[0].try_cast("bigint").alias("received_ns"), F.explode(F.from_json(F.get(parts, F.lit(1)), EVENT)).alias("m")).where(F.col("m.ev").isin(*kinds))
    at, received = F.timestamp_millis("m.t"), F.timestamp_micros(F.expr("div(received_ns, 1000)"))
    return rows.select(
        F.col("m.sym").alias("symbol"), F.col("m.c").alias("conditions"), F.col("m.x").alias("exchange_id"), F.col("m.i").alias("trade_id"), F.col("m.p").alias("price"),
        F.coalesce("m.s", F.lit(0)).alias("volume"), at.alias("trade_ts"), received.alias("received_ts"), (F.unix_micros(received) - F.unix_micros(at)).alias("latency_us"),
    )


class _Pages(DataSourceReader):
    def __init__(self, fetch: Callable[[int], list[tuple]], pages: int):
        self.fetch, self.pages = fetch, pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.fetch(partition.value)


def paged(spark: SparkSession, name: str, schema: str, fetch: Callable[[int], list[tuple]], pages: int) -> DataFrame:
    """A table of numbered pages, each fetched by its own task (and again if that task is lost)."""

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return _Pages(fetch, pages)

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def cursor_rows(fetch: Callable[[int, int], list[dict]], start: int, size: int, at: str = "sip_ns") -> Iterator[dict]:
    """Rows of an interface that gives up to size rows from a time on. The next page starts at the last row's time; the last
    row of a full page is left to it, so that nothing comes twice. Where a full page holds one time alone, larger pages are
    asked for; where these bring no later time and are not full, the rest of that time can't be told from the end: an error."""
    ask = size
    while True:
        page = fetch(start, ask)
        if len(page) < size:
            yield from page
            return
        last = page[-1][at]
        kept = [r for r in page if r[at] != last]
        if kept:
            yield from kept
            start, ask = last, size
        elif len(page) >= ask:
            ask *= 2
        else:
            raise ValueError(f"{len(page)} rows of time {last} for pages of {size}: later rows may be missing; take a larger size")


def day_ticks(spark: SparkSession, keys: DataFrame, fetch: Callable[[str, str, int, int], list[dict]], size: int, schema: str) -> DataFrame:
    """Ticks of each (symbol, date) in keys, fetched by the executors, a key after another and a page's worth of rows at a time;
    schema: of a tick."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for symbol, date in zip(pdf["symbol"], pdf["date"]):
                day = cursor_rows(lambda start, n, s=symbol, d=date: fetch(s, d, start, n), 0, size)
                while rows := list(islice(day, size)):
                    yield pd.DataFrame([{"symbol": symbol, "date": date, **{c: x.get(c) for c in names}} for x in rows], columns=["symbol", "date", *names])

    return keys.select(F.col("symbol").cast("string"), F.col("date").cast("string")).mapInPandas(run, f"symbol string, date string, {schema}")


def map_of_maps(answers: DataFrame, col: str, field: str, key: str = "at") -> DataFrame:
    """A JSON object of objects, one row for each inner object: key and its fields as strings."""
    inner = F.from_json(F.get_json_object(col, f"$['{field}']"), "map<string,map<string,string>>")
    return answers.select(*(c for c in answers.columns if c != col), F.explode(inner).alias(key, "fields"))


def checked(answer: dict, field: str = "results") -> list:
    """The list that an answer must bring."""
    if answer.get("status", "OK") not in ("OK", "success") or not isinstance(answer.get(field), list):
        raise ValueError(f"bad answer: {json.dumps(answer)[:200]}")
    return answer[field]


def open_dates(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Weekdays from start to end, both included, without holidays (column date)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")).where(F.weekday("date") < 5)
    return days if holidays is None else days.join(holidays.select(F.col("date").cast("date")), "date", "left_anti")


def random_walk(spark: SparkSession, steps: int, share_outliers: float, origin: float = 0.0, outlier_mult: float = 20.0, seed: int = 42, stretch: int = 1 << 20) -> DataFrame:
    """id, value, is_outlier: a walk of unit steps with single values thrown off by up to outlier_mult steps. The seed and the
    row's number give each draw, so that the table is the same however Spark deals it. Steps are summed within stretches of
    rows, and stretches start from the sum of those before."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed * 10 + k)), F.lit(1 << 32)) / float(1 << 32)
    rows = spark.range(steps).withColumn("step", F.when(draw(0) < 0.5, -1.0).otherwise(1.0)).withColumn("is_outlier", draw(1) < share_outliers)
    rows = rows.withColumn("part", F.floor(F.col("id") / stretch))
    totals = rows.groupBy("part").agg(F.sum("step").alias("sum"))  # a row a stretch
    earlier = totals.select("part", F.coalesce(F.sum("sum").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    walk = F.col("before") + F.sum("step").over(W.partitionBy("part").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    thrown = F.when(F.col("is_outlier"), (draw(2) * 2 - 1) * outlier_mult).otherwise(0.0)
    return rows.join(earlier, "part").select("id", (F.lit(origin) + walk + thrown).alias("value"), "is_outlier")


# --- vendors' answers as tables -------------------------------------------------------------------------------------------------

#: Names of the fields of vendors' ticks and daily bars. Fixed values.
TRADE_FIELDS = {"p": "price", "s": "size", "x": "exchange_id", "q": "sequence", "i": "trade_id", "c": "conditions"}
QUOTE_FIELDS = {"p": "bid_price", "P": "ask_price", "s": "bid_size", "S": "ask_size", "x": "bid_exchange_id", "X": "ask_exchange_id", "q": "sequence"}
DAILY_FIELDS = {"T": "symbol", "v": "volume", "o": "open", "c": "close", "h": "high", "l": "low", "vw": "vwap"}
_KINDS = {"price": "float", "bid_price": "float", "ask_price": "float", "size": "bigint", "bid_size": "bigint", "ask_size": "bigint", "exchange_id": "int", "bid_exchange_id": "int", "ask_exchange_id": "int", "sequence": "bigint", "trade_id": "string", "volume": "bigint"}


def _named(raw: DataFrame, fields: dict[str, str]) -> list[Column]:
    # Spark's names ignore case, fields do not: each is taken from the schema as it is written there
    at = {f.name: k for k, f in enumerate(raw.schema.fields)}
    cells = F.struct(*(F.col(f"_{k}") for k in range(len(at))))
    return [(cells[f"_{at[old]}"].cast(_KINDS[new]) if new in _KINDS else cells[f"_{at[old]}"]).alias(new) if old in at else F.lit(None).cast(_KINDS.get(new, "string")).alias(new) for old, new in fields.items()]


def _numbered(raw: DataFrame) -> DataFrame:
    return raw.toDF(*(f"_{k}" for k in range(len(raw.columns))))


def normalised_ticks(raw: DataFrame, kind: str = "trades") -> DataFrame:
    """Vendor's trades or quotes (fields of one letter; t and y are epochs in nanoseconds) with names, types, sip_ns, sip_dt
    and exchange_dt (UTC, to the microsecond). Fields that are missing are null; others, such as the tape, are dropped."""
    if kind not in ("trades", "quotes"):
        raise ValueError(f"unknown kind {kind!r}")
    at = {f.name: F.col(f"_{k}").cast("bigint") for k, f in enumerate(raw.schema.fields)}
    time = lambda f, n: F.timestamp_micros(F.call_function("div", at[f], F.lit(1000))).cast("timestamp_ntz").alias(n)
    rest = [F.col(f"_{k}").alias(f.name) for k, f in enumerate(raw.schema.fields) if f.name in ("symbol", "date")]
    return _numbered(raw).select(*rest, *_named(raw, TRADE_FIELDS if kind == "trades" else QUOTE_FIELDS), at["t"].alias("sip_ns"), time("t", "sip_dt"), time("y", "exchange_dt"))


def normalised_daily(raw: DataFrame) -> DataFrame:
    """Vendor's grouped daily bars with names and types; t is an epoch in milliseconds, of which the date stays."""
    at = {f.name: F.col(f"_{k}") for k, f in enumerate(raw.schema.fields)}
    return _numbered(raw).select(*_named(raw, DAILY_FIELDS), F.to_date(F.timestamp_millis(at["t"].cast("bigint")).cast("timestamp_ntz")).alias("date"))


def fetched(keys: DataFrame, fetch: Callable[..., list[dict] | dict | None], schema: str) -> DataFrame:
    """keys with the rows that fetch(*key) brings for each: a list, a single answer, or None for nothing. Executors fetch, a
    key after another; schema: of an answer's columns, where fields that it lacks are null. With dates as keys these are
    grouped daily bars, with symbols their details, with names of lists reference lists."""
    names = [f.name for f in keys.sparkSession.createDataFrame([], schema).schema]
    kinds = ", ".join(f"`{c}` {t}" for c, t in keys.dtypes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                found = fetch(*row.values()) or []
                rows = [{**row, **{c: x.get(c) for c in names}} for x in (found if isinstance(found, list) else [found]) if x]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = keys.sparkSession.createDataFrame([], f"{kinds}, {schema}").toArrow().schema
    return keys.mapInArrow(run, f"{kinds}, {schema}")


def pages_until_short(spark: SparkSession, fetch: Callable[[int], list[dict]], size: int, schema: str, first: int = 1, last: int | None = None, tasks: int = 8) -> DataFrame:
    """Rows of pages of up to size rows, from page first until one that is not full (or to page last). Each of the tasks takes
    every tasks-th page until it meets a page that is not full, so that no page before the end is left out."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in batch["id"].to_pylist():
                page = first + start
                while last is None or page <= last:
                    rows = fetch(page)
                    if rows:
                        yield pa.RecordBatch.from_pylist([{c: x.get(c) for c in names} for x in rows], arrow)
                    if len(rows) < size:
                        break
                    page += tasks

    arrow = spark.createDataFrame([], schema).toArrow().schema
    return spark.range(tasks).repartition(tasks, "id").mapInArrow(run, schema)


def vendor_table(answers: DataFrame, col: str, field: str, columns: dict[str, tuple[str, str]], key: str = "at") -> DataFrame:
    """map_of_maps with named and typed columns: columns gives new name, and (name in the answer, Spark type)."""
    rows = map_of_maps(answers, col, field, key)
    kept = [c for c in rows.columns if c != "fields"]
    return rows.select(*kept, *(F.col("fields")[old].try_cast(kind).alias(new) for new, (old, kind) in columns.items()))


def resampled(daily: DataFrame, unit: str = "week") -> DataFrame:
    """Daily bars by symbol and week, month, quarter or year, dated by its first day: first open, last close, highest high,
    lowest low, all volume, and the volume-weighted mean of vwap."""
    at = F.to_date(F.date_trunc(unit, F.col("date").cast("timestamp_ntz")))
    return daily.groupBy("symbol", at.alias("date")).agg(
        F.min_by("open", "date").alias("open"), F.max_by("close", "date").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("volume").cast("long").alias("volume"), (F.sum(F.col("vwap") * F.col("volume")) / F.nullif(F.sum("volume").cast("double"), F.lit(0.0))).alias("vwap"),
    )


def dated(keys: DataFrame, kind: str, fetch_daily: Callable[[str], list[dict]], fetch_ticks: Callable[[str, str], list[dict]], schema: str) -> DataFrame:
    """What a kind of data is fetched by: daily by date alone, trades and quotes by symbol and date; normalised."""
    if kind == "daily":
        return normalised_daily(fetched(keys.select(F.col("date").alias("for_date")).distinct(), fetch_daily, schema))
    return normalised_ticks(fetched(keys.select("symbol", "date"), fetch_ticks, schema), kind)
