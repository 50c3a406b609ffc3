"""Queries over the test tables, and SQL that gives the same rows.

The test tables hold some 70 ticks a symbol over 30 days, so bar sizes, windows and horizons are set to days, not minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions import scalars
from tidebar.operators import balanced, bars, birch, cluster, density, exemplars, features, folds, graph, joins, labels, linkage, matrix, modes, robust, spectrum, stationarity, ticks, universe
from tidebar.operators.folds import Thresholds
from tidebar.plans import runs
from tidebar.sources import fixtures, market_data
from tidebar.sources.fixtures import SQL_DAILY, SQL_DETAILS, SQL_TICKS, table
from tidebar.streaming import folds as stream_folds

QUERIES = {}
ORACLE_SQL = {}
FLAGSHIP = "renko_bars"
DAY = 86_400_000_000
RENKO = Thresholds(renko_size=60.0, reversal=2.0, max_duration=10 * DAY, min_tick_count=3, least_ticks=3)
IMBALANCE = Thresholds(volume_imbalance=300, max_duration=12 * DAY, min_tick_count=2, least_ticks=2)
DURATION = Thresholds(max_duration=3 * DAY, min_duration=DAY // 24, min_tick_count=2, least_ticks=2)
JMA_WIN, JMA_POWER = 7, 2


def query(sql: str | None, date: bool = False):
    """Registers a query under its name, with the SQL that gives the same rows (None where SQL cannot). date: the result has
    a date, which both sides give as text."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(spark, sf_dir).withColumn("date", F.col("date").cast("string"))) if date else f
        if sql:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({sql})" if date else sql
        return f

    return add


def r(x, digits: int = 6):
    return F.round(x, digits)


def r_fast(x, digits: int = 6):
    """x rounded half away from 0 by doubles, as DuckDB does; F.round makes a decimal of each number, which takes most of the
    time where a row is a pair. For |x| below 10 ** (18 - digits)."""
    x, ten = F.col(x) if isinstance(x, str) else x, 10.0**digits
    n = F.floor(F.abs(x) * ten + 0.5)
    return F.when(x < 0, -n).otherwise(n).cast("double") / ten


def rounded_pairs(df: DataFrame) -> DataFrame:
    """a, b and the covariance, rounded."""
    return df.select("a", "b", r_fast("cov").alias("cov"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums in another order differ in the last bits."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql_round(select: str, columns: list[str], digits: int = 6) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in columns)}) FROM ({select})"


# --- ticks -----------------------------------------------------------------------------------------------------------------

SQL_LOCAL = "local AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local_ts FROM ticks)"
SQL_SESSION = "CASE WHEN m < 570 THEN 'pre-market' WHEN m >= 960 THEN 'after-hours' ELSE 'market-open' END"
_M = "CAST(hour(local_ts) * 60 + minute(local_ts) AS INTEGER)"


@query(f"""WITH {SQL_TICKS}, {SQL_LOCAL} SELECT symbol, seq, m AS minute, {SQL_SESSION} AS session FROM (SELECT *, {_M} AS m FROM local)""")
def tick_session_tag(spark, sf_dir):
    t = ticks.with_session(fixtures.ticks(spark, sf_dir))
    return t.select("symbol", "seq", scalars.minute_of_day("local_ts").alias("minute"), "session")


SQL_MAD_RUNNING = """m1 AS (SELECT *, quantile_cont(price, 0.5) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 4 PRECEDING) AS median,
    row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM ticks),
m2 AS (SELECT *, abs(price - median) AS off FROM m1),
m3 AS (SELECT *, least(greatest(quantile_cont(off, 0.5) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 10 PRECEDING), 0.0025), 0.05) AS mad FROM m2),
m4 AS (SELECT *, CASE WHEN least(rn, 11) < 5 THEN 'mad_warmup' WHEN off > mad * 2000 THEN 'mad_outlier' ELSE 'mad_clean' END AS mad_status FROM m3)"""


@query(f"WITH {SQL_TICKS}, {SQL_MAD_RUNNING} SELECT symbol, seq, round(median, 6) AS median, round(mad, 6) AS mad, mad_status FROM m4")
def mad_rolling_stream(spark, sf_dir):
    return rounded(ticks.mad_running(fixtures.ticks(spark, sf_dir), ["symbol"], 5, 11, 2000).select("symbol", "seq", "median", "mad", "mad_status"))


@query(f"WITH {SQL_TICKS}, {SQL_MAD_RUNNING.replace('ROWS 10 PRECEDING', 'ROWS 99 PRECEDING').replace('least(rn, 11)', 'least(rn, 100)')} SELECT symbol, seq, round(median, 6) AS median, round(mad, 6) AS mad, mad_status FROM m4")
def mad_rolling_wide(spark, sf_dir):
    """A window wider than a frame should be: the sorted window that moves along."""
    return rounded(ticks.mad_running(fixtures.ticks(spark, sf_dir), ["symbol"], 5, 100, 2000).select("symbol", "seq", "median", "mad", "mad_status"))


@query(f"""WITH {SQL_TICKS}, {SQL_MAD_RUNNING}, {SQL_LOCAL.replace('FROM ticks', 'FROM m4')} SELECT symbol, seq,
  CASE WHEN volume < 1 THEN 'filtered: zero volume' WHEN cond IN (2, 5, 7, 10, 13, 15, 16, 20, 21, 22, 29, 33, 38, 52, 53) THEN 'filtered: irregular condition'
       WHEN abs(epoch_us(ts) - epoch_us(exchange_ts)) > 3000000 THEN 'filtered: ts diff' WHEN mad_status <> 'mad_clean' THEN 'filtered: ' || mad_status
       ELSE 'clean: ' || {SQL_SESSION} END AS status FROM (SELECT *, {_M} AS m FROM local)""")
def tick_status_stream(spark, sf_dir):
    return ticks.status_running(fixtures.ticks(spark, sf_dir), ["symbol"], 5, 11, 2000).select("symbol", "seq", "status")


SQL_MAD_ROLLING = """b1 AS (SELECT *, row_number() OVER w - 1 AS place, CASE WHEN count(price) OVER w5 >= 5 THEN quantile_cont(price, 0.5) OVER w5 END AS price_median FROM ticks
    WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq), w5 AS (PARTITION BY symbol ORDER BY ts, seq ROWS 4 PRECEDING)),
b2 AS (SELECT *, abs(price - price_median) AS price_dev FROM b1),
b3 AS (SELECT *, CASE WHEN count(price_dev) OVER w >= 15 THEN quantile_cont(price_dev, 0.5) OVER w END AS d FROM b2 WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS 19 PRECEDING)),
b4 AS (SELECT *, CASE WHEN d IS NOT NULL THEN least(greatest(d, 0.0025), 0.05) END AS price_mad FROM b3),
b5 AS (SELECT *, coalesce(price_dev > price_mad * 2000, false) AS mad_outlier FROM b4)"""


@query(f"WITH {SQL_TICKS}, {SQL_MAD_ROLLING} SELECT symbol, seq, round(price_median, 6) AS price_median, round(price_dev, 6) AS price_dev, round(price_mad, 6) AS price_mad, mad_outlier FROM b5")
def mad_rolling_batch(spark, sf_dir):
    return rounded(ticks.mad_rolling(fixtures.ticks(spark, sf_dir), ["symbol"], "price", 5, 20, 2000).select("symbol", "seq", "price_median", "price_dev", "price_mad", "mad_outlier"))


_MAD_TO = {"ROWS 4 PRECEDING": "ROWS 21 PRECEDING", ">= 5 THEN": ">= 22 THEN", ">= 15 THEN": ">= 66 THEN", "ROWS 19 PRECEDING": "ROWS 1110 PRECEDING", "* 2000": "* 11"}


def _sql_mad(changes: dict[str, str]) -> str:
    out = SQL_MAD_ROLLING
    for a, b in changes.items():
        out = out.replace(a, b)
    return out


@query(f"WITH {SQL_TICKS}, {_sql_mad(_MAD_TO)} SELECT symbol, seq, round(price_median, 6) AS price_median, round(price_dev, 6) AS price_dev, round(price_mad, 6) AS price_mad, mad_outlier FROM b5")
def mad_rolling_batch_wide(spark, sf_dir):
    """The usual windows, 22 and 1,111 rows: sorted windows that move along."""
    return rounded(ticks.mad_rolling(fixtures.ticks(spark, sf_dir), ["symbol"]).select("symbol", "seq", "price_median", "price_dev", "price_mad", "mad_outlier"))


@query(f"WITH {SQL_TICKS}, {_sql_mad({'ROWS 4 PRECEDING': 'ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING', 'ROWS 19 PRECEDING': 'ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING'})} SELECT symbol, seq, round(price_median, 6) AS price_median, round(price_mad, 6) AS price_mad, mad_outlier FROM b5")
def mad_rolling_centred(spark, sf_dir):
    return rounded(ticks.mad_rolling(fixtures.ticks(spark, sf_dir), ["symbol"], "price", 5, 20, 2000, centred=True).select("symbol", "seq", "price_median", "price_mad", "mad_outlier"))


@query(f"""WITH {SQL_TICKS}, {SQL_MAD_ROLLING} SELECT symbol, seq,
  CASE WHEN mad_outlier THEN 'filtered: MAD outlier' WHEN place <= 15 THEN 'filtered: MAD warm-up' WHEN volume = 0 THEN 'filtered: zero volume'
       WHEN cond IN (2, 5, 7, 10, 13, 15, 16, 20, 21, 22, 29, 33, 38, 52, 53) THEN 'filtered: irregular condition'
       WHEN abs(epoch_us(ts) - epoch_us(exchange_ts)) > 3000000 THEN 'filtered: ts diff' ELSE 'clean' END AS status FROM b5""")
def tick_status_batch(spark, sf_dir):
    return ticks.status_rolling(fixtures.ticks(spark, sf_dir), ["symbol"], 5, 20, 2000).select("symbol", "seq", "status")


SQL_SIDED = """s1 AS (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)), 0) AS sg FROM ticks),
sided AS (SELECT *, CAST(coalesce(last_value(sg IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS side,
          row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM s1)"""


def sided(spark, sf_dir) -> DataFrame:
    return ticks.with_side(fixtures.ticks(spark, sf_dir), ["symbol"])


@query(f"WITH {SQL_TICKS}, {SQL_SIDED} SELECT symbol, seq, side FROM sided")
def tick_rule_side(spark, sf_dir):
    return sided(spark, sf_dir).select("symbol", "seq", "side")


def sql_jma(source: str, key: str, value: str, winlen: int, power: float, name: str = "j", phase: float = 0.0) -> str:
    """A recursive table name(key, rn, e0, e1, e2, jma) over source, which numbers each key's rows by rn."""
    f = folds.JMA(winlen, power, phase)
    a, b, ratio = repr(f.alpha), repr(f.beta), repr(float(f.ratio))
    step = f"""SELECT {key}, rn, n0 AS e0, n1 AS e1, n2 AS e2, n2 + jma AS jma FROM (
      SELECT *, (n0 + {ratio}::DOUBLE * n1 - jma) * (1 - {a}::DOUBLE) ** 2 + ({a}::DOUBLE) ** 2 * e2 AS n2 FROM (
      SELECT *, (v - n0) * (1 - {b}::DOUBLE) + {b}::DOUBLE * e1 AS n1 FROM (
      SELECT *, (1 - {a}::DOUBLE) * v + {a}::DOUBLE * e0 AS n0 FROM ({{0}}))))"""
    first = step.format(f"SELECT {key}, rn, {value} AS v, {value} AS e0, 0.0::DOUBLE AS e1, 0.0::DOUBLE AS e2, {value} AS jma FROM {source} WHERE rn = 1")
    later = step.format(f"SELECT s.{key}, s.rn, s.{value} AS v, p.e0, p.e1, p.e2, p.jma FROM {name} p JOIN {source} s ON s.{key} = p.{key} AND s.rn = p.rn + 1")
    return f"{name} AS ({first} UNION ALL {later})"


@query(f"WITH RECURSIVE {SQL_TICKS}, {SQL_SIDED}, {sql_jma('sided', 'symbol', 'price', 7, 2)} SELECT symbol, seq, CASE WHEN rn >= 7 THEN round(j.jma, 6) END AS price_jma7 FROM sided JOIN j USING (symbol, rn)")
def jma_rolling(spark, sf_dir):
    return rounded(folds.jma(fixtures.ticks(spark, sf_dir), ["symbol"], ["ts", "seq"], "price", 7, 2).select("symbol", "seq", "price_jma7"))


def _sql_expanding(n: int) -> str:
    tables = ", ".join(sql_jma("sided", "symbol", "price", k, 1, f"j{k}") for k in range(1, n + 1))
    case = " ".join(f"WHEN rn = {k} THEN j{k}.jma" for k in range(1, n))
    return f"WITH RECURSIVE {SQL_TICKS}, {SQL_SIDED}, {tables} SELECT symbol, seq, round(CASE {case} ELSE j{n}.jma END, 6) AS price_jma{n} FROM sided {' '.join(f'JOIN j{k} USING (symbol, rn)' for k in range(1, n + 1))}"


@query(_sql_expanding(4))
def jma_expanding(spark, sf_dir):
    return rounded(folds.jma(fixtures.ticks(spark, sf_dir), ["symbol"], ["ts", "seq"], "price", 4, 1, expand=True).select("symbol", "seq", "price_jma4"))


@query(f"WITH {SQL_TICKS} SELECT symbol, round(sum(price * volume) / nullif(sum(volume), 0), 6) AS vwap, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n FROM ticks GROUP BY symbol")
def vwap_by_key(spark, sf_dir):
    return fixtures.ticks(spark, sf_dir).groupBy("symbol").agg(r(bars.vwap()).alias("vwap"), F.sum("volume").cast("long").alias("volume"), F.count("*").alias("n"))


@query(f"""WITH {SQL_TICKS}, c AS (SELECT symbol, price, sum(volume) OVER (PARTITION BY symbol ORDER BY price) AS s, sum(volume) OVER (PARTITION BY symbol) AS a FROM ticks WHERE volume > 0)
SELECT symbol, min(price) AS weighted_median FROM c WHERE 2 * s >= a GROUP BY symbol""")
def weighted_median(spark, sf_dir):
    return bars.weighted_median(fixtures.ticks(spark, sf_dir), ["symbol"])


SQL_JT = f"""{sql_jma('sided', 'symbol', 'price', JMA_WIN, JMA_POWER)}, jt AS (SELECT s.*, j.jma AS price_jma, epoch_us(ts) AS us FROM sided s JOIN j USING (symbol, rn))"""


def sql_quantiles(source: str, keys: str, name: str = "wq", prefix: str = "") -> str:
    """Tables that end in name(keys, quantile columns)."""
    each = ", ".join(f"(coalesce(min(CASE WHEN s > {p} * a THEN price END), max(price)) + min(CASE WHEN s >= {p} * a THEN price END)) / 2 AS {prefix}{q}" for q, p in bars.QUANTILES.items())
    return f"""{name}_v AS (SELECT {keys}, price, CAST(sum(volume) AS DOUBLE) AS w FROM {source} WHERE volume > 0 GROUP BY {keys}, price),
{name}_s AS (SELECT {keys}, price, sum(w) OVER (PARTITION BY {keys} ORDER BY price) AS s, sum(w) OVER (PARTITION BY {keys}) AS a FROM {name}_v),
{name} AS (SELECT {keys}, {each} FROM {name}_s GROUP BY {keys})"""


@query(f"WITH {SQL_TICKS}, {sql_quantiles('ticks', 'symbol')} {sql_round('SELECT * FROM wq', list(bars.QUANTILES))}")
def weighted_quantiles(spark, sf_dir):
    return rounded(bars.weighted_quantiles(fixtures.ticks(spark, sf_dir), ["symbol"]))


@query(f"WITH {SQL_TICKS} SELECT symbol, CAST(epoch_us(ts) * 1000 // 3600000000000 AS BIGINT) AS epoch_hour, count(price) AS price_count, round(avg(price), 6) AS price_mean, round(median(price), 6) AS price_median, CAST(sum(volume) AS BIGINT) AS volume_sum FROM ticks GROUP BY ALL")
def epoch_trunc_groupby(spark, sf_dir):
    return rounded(bars.epoch_groups(fixtures.ticks(spark, sf_dir), ["symbol"], "epoch_hour", scalars.epoch_nanos("ts")))


@query(f"WITH {SQL_TICKS} SELECT seq, {', '.join(f'CAST(epoch_us(ts) * 1000 // {v} AS BIGINT) AS {k}' for k, v in scalars.EPOCH_UNITS.items())} FROM ticks")
def epoch_units(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir).withColumn("ns", scalars.epoch_nanos("ts"))
    return t.select("seq", *(scalars.epoch_truncated("ns", u).alias(u) for u in scalars.EPOCH_UNITS))


@query(f"WITH {SQL_TICKS} SELECT seq, date_trunc('millisecond', ts) AS ts_ms, date_trunc('second', ts) AS ts_sec, date_trunc('minute', ts) AS ts_min, date_trunc('hour', ts) AS ts_hour FROM ticks")
def datetime_trunc(spark, sf_dir):
    return fixtures.ticks(spark, sf_dir).select("seq", *(F.date_trunc(u, "ts").cast("timestamp_ntz").alias(n) for n, u in (("ts_ms", "MILLISECOND"), ("ts_sec", "SECOND"), ("ts_min", "MINUTE"), ("ts_hour", "HOUR"))))


@query(f"""WITH {SQL_TICKS}, {SQL_SIDED}, {SQL_LOCAL.replace('FROM ticks', 'FROM sided')}, i AS (SELECT *, CAST(local_ts AS DATE) AS date, CAST((m - 570) // 30 AS INTEGER) AS bin FROM (SELECT *, {_M} AS m FROM local) WHERE m >= 570 AND m < 960),
spine AS (SELECT symbol, date, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT symbol, date FROM i), (SELECT unnest(range(13)) AS b)),
g AS (SELECT symbol, date, bin, count(*) AS n, sum(volume) AS v, sum(side) AS sd, CASE WHEN count(*) = 1 THEN min(price) ELSE sum(price * volume) / nullif(sum(volume), 0) END AS p, max(price) AS h, min(price) AS l FROM i GROUP BY ALL)
SELECT symbol, date, bin, CAST(coalesce(n, 0) AS BIGINT) AS tick_count, CAST(coalesce(v, 0) AS BIGINT) AS volume, CAST(coalesce(sd, 0) AS BIGINT) AS side, round(p, 6) AS price, h AS price_high, l AS price_low, round(h - l, 6) AS price_range,
  date + to_minutes(570 + bin * 30) AS open_at, date + to_minutes(600 + bin * 30) AS close_at FROM spine LEFT JOIN g USING (symbol, date, bin)""", date=True)
def timebin_bars(spark, sf_dir):
    return rounded(bars.time_bins(sided(spark, sf_dir), ["symbol"], 1800))


@query(f"""WITH RECURSIVE {SQL_TICKS}, {SQL_SIDED}, {SQL_JT}, {SQL_LOCAL.replace('FROM ticks', 'FROM jt')}, i AS (SELECT *, CAST(local_ts AS DATE) AS date, CAST((s - 34200) // 100 AS INTEGER) AS bin FROM (SELECT *, {_M} * 60 + CAST(second(local_ts) AS INTEGER) AS s FROM local) WHERE s >= 34200 AND s < 57600),
spine AS (SELECT symbol, date, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT symbol, date FROM i), (SELECT unnest(range(234)) AS b)),
mean AS (SELECT symbol, date, bin, count(*) AS n, CASE WHEN count(*) = 1 THEN min(price) ELSE sum(price * volume) / nullif(sum(volume), 0) END AS p, CASE WHEN count(*) = 1 THEN min(price_jma) ELSE sum(price_jma * volume) / nullif(sum(volume), 0) END AS j FROM i GROUP BY ALL)
SELECT symbol, date, bin, CAST(coalesce(n, 0) AS BIGINT) AS tick_count, round(p, 6) AS price, round(j, 6) AS price_jma, date + to_seconds(34200 + bin * 100) AS open_at FROM spine LEFT JOIN mean USING (symbol, date, bin)""", date=True)
def second_bins(spark, sf_dir):
    """Bins of 100 seconds, with the volume-weighted average of the ticks' moving average."""
    out = bars.time_bins(fold_jma(sided(spark, sf_dir)), ["symbol"], 100)
    return rounded(out.select("symbol", "date", "bin", "tick_count", "price", "price_jma", "open_at"))


# --- sampled bars ------------------------------------------------------------------------------------------------------------


def fold_jma(t: DataFrame) -> DataFrame:
    """price_jma from the first tick on, as the sampler wants it."""
    return folds.fold(t, ["symbol"], ["ts", "seq"], ["price"], lambda: _jma_now(folds.JMA(JMA_WIN, JMA_POWER)), {"price_jma": "double"})


def _jma_now(f):
    return lambda value: (f(value),)


def sql_sampler(t: Thresholds, source: str = "jt", name: str = "cut") -> str:
    """A recursive table with bar and trigger of each tick of source (symbol, rn, us, price, volume, side, price_jma)."""
    trigger = "NULL"
    if t.renko_size is not None:
        up, turn = repr(float(t.renko_size)), repr(float(t.renko_size * t.reversal))
        trigger = f"CASE WHEN jret < -(CASE WHEN last >= 0 THEN {turn} ELSE {up} END) THEN 'renko_down' WHEN jret >= (CASE WHEN last >= 0 THEN {up} ELSE {turn} END) THEN 'renko_up' ELSE {trigger} END"
    if t.volume_imbalance is not None:
        trigger = f"CASE WHEN abs(imb) >= {t.volume_imbalance} THEN 'volume_imbalance' ELSE {trigger} END"
    if t.max_duration is not None:
        trigger = f"CASE WHEN us - us0 > {t.max_duration} THEN 'duration' ELSE {trigger} END"
    if t.min_duration is not None:
        trigger = f"CASE WHEN us - us0 < {t.min_duration} THEN NULL ELSE {trigger} END"
    if t.min_tick_count is not None:
        trigger = f"CASE WHEN n < {t.min_tick_count} THEN NULL ELSE {trigger} END"
    cols = "symbol, rn, bar, us0, p0, j0, n, ret, imb, last"
    wrap = f"SELECT {cols}, CAST({trigger} AS VARCHAR) AS trigger FROM (SELECT *, price - p0 AS ret, price_jma - j0 AS jret FROM ({{0}}))"
    first = wrap.format(f"SELECT symbol, rn, us, price, price_jma, CAST(0 AS BIGINT) AS bar, us AS us0, price AS p0, price_jma AS j0, CAST(1 AS BIGINT) AS n, CAST(side * volume AS BIGINT) AS imb, CAST(0 AS DOUBLE) AS last FROM {source} WHERE rn = 1")
    later = wrap.format(f"""SELECT s.symbol, s.rn, s.us, s.price, s.price_jma, CASE WHEN e THEN bar + 1 ELSE bar END AS bar, CASE WHEN e THEN s.us ELSE us0 END AS us0, CASE WHEN e THEN s.price ELSE p0 END AS p0,
      CASE WHEN e THEN s.price_jma ELSE j0 END AS j0, CASE WHEN e THEN 1 ELSE n + 1 END AS n, CAST(CASE WHEN e THEN s.side * s.volume ELSE imb + s.side * s.volume END AS BIGINT) AS imb,
      CASE WHEN e AND n >= {t.least_ticks} THEN ret ELSE last END AS last FROM (SELECT *, trigger IS NOT NULL AS e FROM {name}) p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1""")
    return f"{name} AS ({first} UNION ALL {later})"


def sql_bars(t: Thresholds) -> str:
    """Tables that end in sb: sampled bars."""
    return f"""{SQL_TICKS}, {SQL_SIDED}, {SQL_JT}, {sql_sampler(t)},
tb AS (SELECT jt.*, cut.bar AS bar_id FROM jt JOIN cut USING (symbol, rn)),
ends AS (SELECT symbol, bar AS bar_id, trigger AS bar_trigger FROM cut WHERE trigger IS NOT NULL),
inb AS (SELECT * FROM tb SEMI JOIN ends USING (symbol, bar_id)), {sql_quantiles('inb', 'symbol, bar_id', prefix='price_')},
agg AS (SELECT symbol, bar_id, min(ts) AS open_at, max(ts) AS close_at, count(*) AS tick_count, CAST(sum(volume) AS BIGINT) AS volume, sum(price * volume) AS dollar_value, max(price) AS price_high, min(price) AS price_low,
  first(price ORDER BY ts, seq) AS price_open, last(price ORDER BY ts, seq) AS price_close, max(price) - min(price) AS price_range, last(price ORDER BY ts, seq) - first(price ORDER BY ts, seq) AS price_return,
  sum(price * volume) / nullif(sum(volume), 0) AS price_vwap, CAST(sum(side) AS BIGINT) AS tick_imbalance, CAST(sum(side * volume) AS BIGINT) AS volume_imbalance, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM inb GROUP BY symbol, bar_id),
sb AS (SELECT * FROM agg JOIN ends USING (symbol, bar_id) LEFT JOIN wq USING (symbol, bar_id) WHERE tick_count >= {t.least_ticks})"""


_BAR_DOUBLES = ["dollar_value", "price_high", "price_low", "price_open", "price_close", "price_range", "price_return", "price_vwap", *(f"price_{q}" for q in bars.QUANTILES)]


@query(f"WITH RECURSIVE {SQL_TICKS}, {SQL_SIDED}, {SQL_JT}, {sql_sampler(RENKO)} SELECT symbol, seq, bar AS bar_id, trigger AS bar_trigger FROM cut JOIN jt USING (symbol, rn)")
def renko_bar_ids(spark, sf_dir):
    return bars.bar_ids(fold_jma(sided(spark, sf_dir)), ["symbol"], RENKO).select("symbol", "seq", "bar_id", "bar_trigger")


def renko(spark, sf_dir) -> DataFrame:
    return bars.sampled_bars(fold_jma(sided(spark, sf_dir)), ["symbol"], RENKO)


@query(f"WITH RECURSIVE {sql_bars(RENKO)} {sql_round('SELECT * FROM sb', _BAR_DOUBLES, 4)}")
def renko_bars(spark, sf_dir):
    return rounded(renko(spark, sf_dir), 4)


@query(f"WITH RECURSIVE {sql_bars(IMBALANCE)} {sql_round('SELECT * FROM sb', _BAR_DOUBLES, 4)}")
def imbalance_bars(spark, sf_dir):
    return rounded(bars.sampled_bars(fold_jma(sided(spark, sf_dir)), ["symbol"], IMBALANCE), 4)


@query(f"WITH RECURSIVE {sql_bars(DURATION)} {sql_round('SELECT * FROM sb', _BAR_DOUBLES, 4)}")
def duration_bars(spark, sf_dir):
    return rounded(bars.sampled_bars(fold_jma(sided(spark, sf_dir)), ["symbol"], DURATION), 4)


@query(f"""WITH {SQL_TICKS}, {SQL_SIDED}, n AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY symbol ORDER BY rn) THEN 0 ELSE 1 END AS new FROM sided),
g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY rn) AS run FROM n)
SELECT symbol, seq, row_number() OVER w - 1 AS tick_run, CAST(sum(CASE WHEN new = 1 THEN 0 ELSE volume END) OVER w AS BIGINT) AS volume_run, round(sum(CASE WHEN new = 1 THEN 0.0::DOUBLE ELSE price * volume END) OVER w, 4) AS dollar_run FROM g WINDOW w AS (PARTITION BY symbol, run ORDER BY rn)""")
def imbalance_runs(spark, sf_dir):
    return rounded(bars.imbalance_runs(sided(spark, sf_dir), ["symbol"]).select("symbol", "seq", "tick_run", "volume_run", "dollar_run"), 4)


SQL_DAYBARS = """db AS (SELECT symbol, CAST(ts AS DATE) AS date, CAST(ts AS DATE) - DATE '1970-01-01' AS bar_id, min(ts) AS open_at, max(ts) AS close_at, count(*) AS tick_count, first(price ORDER BY ts, seq) AS price_open,
  last(price ORDER BY ts, seq) AS price_close, max(price) AS price_high, min(price) AS price_low, last(price ORDER BY ts, seq) - first(price ORDER BY ts, seq) AS price_return, max(price) - min(price) AS price_range FROM ticks GROUP BY ALL)"""
#: The clocks of synchronised bars: day bars of the symbols in the large segment.
SQL_CLOCKS = """dv AS (SELECT symbol, avg(v) AS d FROM (SELECT symbol, sum(price * volume) AS v FROM ticks GROUP BY symbol, CAST(ts AS DATE)) GROUP BY symbol),
large AS (SELECT db.* FROM db JOIN dv USING (symbol) WHERE d > (SELECT quantile_cont(d, 0.8) FROM dv) AND tick_count >= 2)"""


def day_bars(spark, sf_dir) -> DataFrame:
    """One bar a symbol and date, numbered by the date."""
    t = fixtures.ticks(spark, sf_dir).withColumn("date", F.to_date("ts"))
    return bars.summary(t, ["symbol", "date"]).withColumn("bar_id", F.unix_date("date").cast("long"))


def clocks(spark, sf_dir) -> DataFrame:
    """Day bars of two ticks or more of the large symbols."""
    b = day_bars(spark, sf_dir)
    daily = b.select("symbol", F.col("dollar_value").alias("dollar_total"), (F.col("price_range") / F.col("price_vwap")).alias("range_value_pct"))
    large = universe.segments(daily).where("segment = 'large'").select("symbol")
    return b.where("tick_count >= 2").join(large, "symbol", "left_semi")


@query(f"""WITH {SQL_TICKS}, {SQL_DAYBARS}, {SQL_CLOCKS}, t AS (SELECT *, CAST(ts AS DATE) AS date FROM ticks),
i AS (SELECT c.symbol AS clock_symbol, c.date, c.open_at AS clock_open_at, c.close_at AS clock_close_at, t.symbol, t.ts, t.seq, t.price, t.volume FROM large c JOIN t ON c.date = t.date AND t.ts > c.open_at AND t.ts <= c.close_at AND t.symbol <> c.symbol)
SELECT clock_symbol, date, clock_open_at, symbol, count(*) AS tick_count, CAST(sum(volume) AS BIGINT) AS volume, round(sum(price * volume), 4) AS dollar_value, round(last(price ORDER BY ts, seq) - first(price ORDER BY ts, seq), 6) AS price_return, min(ts) AS open_at, max(ts) AS close_at FROM i GROUP BY clock_symbol, date, clock_open_at, symbol""", date=True)
def sync_bars(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir).withColumn("date", F.to_date("ts"))
    clock = clocks(spark, sf_dir)
    out = bars.synchronised(clock, t, "date", DAY // 8, quantiles=False)
    return out.select("clock_symbol", "date", "clock_open_at", "symbol", "tick_count", "volume", r_fast("dollar_value", 4).alias("dollar_value"), r_fast("price_return").alias("price_return"), "open_at", "close_at")


# --- labels --------------------------------------------------------------------------------------------------------------------

HORIZON = 10 * 24 * 60
REWARDS = (0.5, 1.0, 1.5, 2.0)
RISK = 60.0
LABEL_JMA = 3


@query(f"""WITH {SQL_TICKS}, {SQL_DAYBARS} SELECT b.symbol, b.bar_id, count(*) AS n, min(t.ts) AS first_at, max(t.ts) AS last_at FROM db b JOIN ticks t ON t.symbol = b.symbol AND t.ts >= b.close_at + INTERVAL 3 SECOND AND t.ts < b.close_at + INTERVAL {HORIZON} MINUTE GROUP BY b.symbol, b.bar_id""")
def label_window_ticks(spark, sf_dir):
    inside = labels.label_ticks(day_bars(spark, sf_dir).select("symbol", "bar_id", "close_at"), fixtures.ticks(spark, sf_dir), ["symbol"], HORIZON, 5 * DAY)
    return inside.groupBy("symbol", "bar_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


SQL_LABEL_TICKS = f"{SQL_TICKS}, {SQL_SIDED}, {sql_jma('sided', 'symbol', 'price', LABEL_JMA, 1)}, lt AS (SELECT s.*, j.jma FROM sided s JOIN j USING (symbol, rn))"


def label_ticks(spark, sf_dir) -> DataFrame:
    """Ticks with their moving average: barriers are measured on it, from the first price."""
    return folds.fold(fixtures.ticks(spark, sf_dir), ["symbol"], ["ts", "seq"], ["price"], lambda: _jma_now(folds.JMA(LABEL_JMA, 1)), {"price_jma": "double"})


def _sql_barrier(risk: str = f"{RISK}::DOUBLE") -> str:
    at = ", ".join(f"min(CASE WHEN jma >= entry + {risk} * {x}::DOUBLE THEN ts END) AS long_{k}, min(CASE WHEN jma <= entry - {risk} * {x}::DOUBLE THEN ts END) AS short_{k}" for k, x in enumerate(REWARDS))
    best = {s: "CASE " + " ".join(f"WHEN {s}_{k} IS NOT NULL AND ({s}_stop IS NULL OR {s}_{k} < {s}_stop) THEN {REWARDS[k]}" for k in reversed(range(len(REWARDS)))) + " END" for s in ("long", "short")}
    when = {s: "CASE " + " ".join(f"WHEN {s}_{k} IS NOT NULL AND ({s}_stop IS NULL OR {s}_{k} < {s}_stop) THEN {s}_{k}" for k in reversed(range(len(REWARDS)))) + f" ELSE coalesce({s}_stop, label_end_at) END" for s in ("long", "short")}
    kind = lambda s: f"CASE WHEN {s}_best IS NOT NULL THEN 'profit' WHEN {s}_stop IS NOT NULL THEN 'stop' ELSE 'neutral' END"
    return f"""WITH RECURSIVE {SQL_LABEL_TICKS}, {SQL_DAYBARS},
i AS (SELECT b.symbol, b.bar_id, b.close_at, b.close_at + INTERVAL {HORIZON} MINUTE AS label_end_at, t.ts, t.price, t.jma, first_value(t.price) OVER (PARTITION BY b.symbol, b.bar_id ORDER BY t.ts, t.seq) AS entry
  FROM (SELECT * FROM db WHERE {risk} IS NOT NULL) b JOIN lt t ON t.symbol = b.symbol AND t.ts >= b.close_at + INTERVAL 3 SECOND AND t.ts < b.close_at + INTERVAL {HORIZON} MINUTE),
h AS (SELECT symbol, bar_id, min(close_at) AS label_start_at, min(label_end_at) AS label_end_at, min(CASE WHEN jma < entry - {risk} THEN ts END) AS long_stop, min(CASE WHEN jma > entry + {risk} THEN ts END) AS short_stop, {at} FROM i GROUP BY symbol, bar_id),
k AS (SELECT *, {best['long']} AS long_best, {best['short']} AS short_best, {when['long']} AS long_at, {when['short']} AS short_at FROM h),
l AS (SELECT *, {kind('long')} AS lk, {kind('short')} AS sk FROM k),
o AS (SELECT *, CASE WHEN lk = 'profit' AND sk = 'stop' THEN 'long' WHEN sk = 'profit' AND lk = 'stop' THEN 'short' WHEN lk <> 'profit' AND sk <> 'profit' THEN 'neutral' END AS label_side FROM l)
SELECT db.symbol, db.bar_id, label_side, CASE WHEN o.symbol IS NULL THEN NULL WHEN label_side IS NULL THEN 'unknown' WHEN label_side = 'neutral' THEN 'neutral' ELSE 'profit' END AS label_outcome,
  CASE label_side WHEN 'long' THEN long_best WHEN 'short' THEN -short_best WHEN 'neutral' THEN 0.0 END::DOUBLE AS label_rrr,
  CASE label_side WHEN 'long' THEN long_at WHEN 'short' THEN short_at WHEN 'neutral' THEN greatest(long_at, short_at) END AS label_outcome_at, label_start_at, label_end_at
FROM db LEFT JOIN o USING (symbol, bar_id)"""


@query(_sql_barrier())
def triple_barrier_labels(spark, sf_dir):
    t = label_ticks(spark, sf_dir)
    b = day_bars(spark, sf_dir).select("symbol", "bar_id", "close_at")
    return labels.triple_barrier(b, t, ["symbol"], RISK, HORIZON, 5 * DAY, REWARDS).drop("close_at")


@query(_sql_barrier("CASE WHEN symbol % 3 = 0 THEN 25.0::DOUBLE WHEN symbol % 3 = 1 THEN 90.0::DOUBLE END"))
def barrier_labels_by_size(spark, sf_dir):
    """What a label risks is its bar's own size; bars without one stay without label."""
    size = F.when(F.col("symbol") % 3 == 0, 25.0).when(F.col("symbol") % 3 == 1, 90.0)
    b = day_bars(spark, sf_dir).select("symbol", "bar_id", "close_at", size.alias("renko_size"))
    return labels.triple_barrier(b, label_ticks(spark, sf_dir), ["symbol"], "renko_size", HORIZON, 5 * DAY, REWARDS).drop("close_at", "renko_size")


@query(f"""WITH {SQL_TICKS}, {SQL_SIDED}, f AS (SELECT symbol, count(*) AS n, regr_slope(price, rn - 1) AS b, regr_intercept(price, rn - 1) AS a, regr_r2(price, rn - 1) AS r2, regr_sxx(price, rn - 1) AS sxx, regr_syy(price, rn - 1) AS syy, avg(rn - 1) AS mx FROM sided GROUP BY symbol HAVING count(*) >= 30),
e AS (SELECT *, sqrt((syy - b * b * sxx) / (n - 2)) AS err FROM f)
SELECT symbol, n, round(b, 6) AS trend_slope, round(a, 6) AS trend_const, round(r2, 6) AS trend_r2, round(a / (err * sqrt(1.0::DOUBLE / n + mx * mx / sxx)), 6) AS trend_const_t, round(b / (err / sqrt(sxx)), 6) AS trend_slope_t FROM e""")
def trend_labels(spark, sf_dir):
    return rounded(labels.trend(fixtures.ticks(spark, sf_dir), ["symbol"]))


@query(f"""WITH {SQL_TICKS}, {SQL_DAYBARS}, l AS (SELECT symbol, bar_id, open_at AS t0, open_at + INTERVAL 5 DAY AS t1 FROM db), c AS (SELECT l.symbol, l.bar_id, b.close_at FROM l JOIN db b ON b.symbol = l.symbol AND b.close_at >= l.t0 AND b.close_at <= l.t1),
k AS (SELECT symbol, close_at, count(*) AS n FROM c GROUP BY ALL) SELECT symbol, bar_id AS label_id, round(avg(1.0::DOUBLE / n), 6) AS uniqueness FROM c JOIN k USING (symbol, close_at) GROUP BY symbol, bar_id""")
def label_uniqueness(spark, sf_dir):
    b = day_bars(spark, sf_dir)
    spans = b.select("symbol", F.col("bar_id").alias("label_id"), F.col("open_at").alias("t0"), (F.col("open_at") + F.expr("interval 5 days")).alias("t1"))
    return rounded(labels.uniqueness(spans, b, ["symbol"], "t0", "t1", "close_at", 3 * DAY).select("symbol", "label_id", "uniqueness"))


# --- features --------------------------------------------------------------------------------------------------------------------

SQL_GAPS = f"""{SQL_DAYBARS}, d AS (SELECT symbol, date, price_close AS last_v, lead(price_close) OVER (PARTITION BY symbol ORDER BY date) AS next_v, greatest(abs(price_return) / 2, 5.0) AS size FROM db),
g AS (SELECT *, CAST(round_even(abs(last_v - next_v) / size, 0) AS BIGINT) AS n FROM d WHERE next_v IS NOT NULL)"""


@query(f"""WITH {SQL_TICKS}, {SQL_GAPS}, f AS (SELECT symbol, date, CAST(i AS INTEGER) AS place, CASE WHEN i = n THEN next_v ELSE last_v + (next_v - last_v) * i / greatest(n - 1, 1) END AS price_close FROM (SELECT *, unnest(range(n + 1)) AS i FROM g))
SELECT symbol, date, place, round(price_close, 6) AS price_close, 'gap_filler' AS bar_trigger FROM f""", date=True)
def gap_fill(spark, sf_dir):
    return rounded(features.gap_fillers(day_bars(spark, sf_dir), "symbol", "date", "price_close", 5.0))


@query(f"""WITH RECURSIVE {SQL_TICKS}, {SQL_GAPS}, f AS (SELECT symbol, date, i AS place, CASE WHEN i = n THEN next_v ELSE last_v + (next_v - last_v) * i / greatest(n - 1, 1) END AS v FROM (SELECT *, unnest(range(n + 1)) AS i FROM g)),
u AS (SELECT symbol, date, 0 AS fill, 0 AS place, bar_id, price_close AS v FROM db UNION ALL SELECT symbol, date, 1, place, NULL, v FROM f), st AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date, fill, place) AS rn FROM u),
{sql_jma('st', 'symbol', 'v', 5, 1)}, q AS (SELECT st.*, CASE WHEN rn >= 5 THEN j.jma END AS m FROM st JOIN j USING (symbol, rn)), w AS (SELECT *, m - lag(m) OVER (PARTITION BY symbol ORDER BY rn) AS d FROM q)
SELECT symbol, bar_id, round(m, 6) AS price_close_jma5, round(d, 6) AS price_close_jma5_diff, round(v - m, 6) AS price_close_jma5_resid FROM w WHERE fill = 0""")
def gap_aware_jma(spark, sf_dir):
    b = day_bars(spark, sf_dir).select("symbol", "date", "bar_id", "open_at", "price_close", "price_return")
    return rounded(features.gap_aware_jma(_gap5(b), "symbol", "date", "price_close", 5).select("symbol", "bar_id", "price_close_jma5", "price_close_jma5_diff", "price_close_jma5_resid"))


def _gap5(b: DataFrame) -> DataFrame:
    """Returns of at least 10, so that gap steps are 5 or more."""
    return b.withColumn("price_return", F.greatest(F.abs("price_return"), F.lit(10.0)))


@query(f"""WITH RECURSIVE {sql_bars(RENKO)}, x AS (SELECT *, CAST(close_at AS DATE) AS date FROM sb)
SELECT symbol, date, count(price_close) AS bar_count, round(median((duration_us % 86400000000) // 1000000 / 60.0::DOUBLE), 6) AS duration_min_median, round(avg(price_range), 4) AS price_range_mean, min(open_at) AS first_at, max(close_at) AS last_at FROM x GROUP BY symbol, date""", date=True)
def stacked_date_stats(spark, sf_dir):
    out = features.date_stats(renko(spark, sf_dir).withColumn("date", F.to_date("close_at")), ["symbol", "date"])
    return out.select("symbol", "date", "bar_count", r("duration_min_median").alias("duration_min_median"), r("price_range_mean", 4).alias("price_range_mean"), "first_at", "last_at")


_STATUSES = ["clean", "filtered: zero volume", "filtered: irregular condition", "filtered: ts diff", "filtered: MAD warm-up", "filtered: MAD outlier"]


def _share(v: str) -> str:
    return v.replace(": ", "_").replace(" ", "_").replace("-", "_").lower()


@query(f"""WITH {SQL_TICKS}, {SQL_MAD_ROLLING}, z AS (SELECT symbol, CASE WHEN mad_outlier THEN 'filtered: MAD outlier' WHEN place <= 15 THEN 'filtered: MAD warm-up' WHEN volume = 0 THEN 'filtered: zero volume'
  WHEN cond IN (2, 5, 7, 10, 13, 15, 16, 20, 21, 22, 29, 33, 38, 52, 53) THEN 'filtered: irregular condition' WHEN abs(epoch_us(ts) - epoch_us(exchange_ts)) > 3000000 THEN 'filtered: ts diff' ELSE 'clean' END AS status FROM b5)
SELECT symbol, {', '.join(f"round(avg(CASE WHEN status = '{s}' THEN 1.0::DOUBLE ELSE 0 END), 6) AS {_share(s)}" for s in _STATUSES)} FROM z GROUP BY symbol""")
def status_fractions_pivot(spark, sf_dir):
    return rounded(features.fractions(ticks.status_rolling(fixtures.ticks(spark, sf_dir), ["symbol"], 5, 20, 2000), ["symbol"], "status", _STATUSES))


@query(f"""WITH RECURSIVE {sql_bars(RENKO)}, p AS (SELECT *, lag(bar_trigger) OVER (PARTITION BY symbol ORDER BY bar_id) AS b FROM sb)
SELECT symbol, bar_id, t AS renko_type, CAST(t = 'reversal' AS INTEGER) AS renko_type_reversal, CAST(t = 'trend' AS INTEGER) AS renko_type_trend FROM (SELECT *, CASE WHEN b = 'duration' THEN 'duration' WHEN b = bar_trigger THEN 'trend' ELSE 'reversal' END AS t FROM p)""")
def renko_type_tag(spark, sf_dir):
    tagged = features.renko_tag(renko(spark, sf_dir), ["symbol"], "bar_id")
    return features.one_hot(tagged, "renko_type", ["duration", "reversal", "trend"]).select("symbol", "bar_id", "renko_type", "renko_type_reversal", "renko_type_trend")


@query(f"""WITH RECURSIVE {sql_bars(RENKO)} SELECT symbol, bar_id, CAST(round_even(duration_us / 1e7::DOUBLE, 0) AS BIGINT) AS duration_10s, CAST(hour(close_at) * 60 + minute(close_at) AS INTEGER) AS min_in_day, CAST(isodow(close_at) - 1 AS INTEGER) AS day_of_week, round(price_wq95 - price_wq05, 4) AS price_wiqr FROM sb""")
def bar_time_features(spark, sf_dir):
    out = features.time_features(renko(spark, sf_dir), "close_at", "duration_us")
    return out.select("symbol", "bar_id", "duration_10s", F.col("min_in_day").cast("int").alias("min_in_day"), F.col("day_of_week").cast("int").alias("day_of_week"), r(F.col("price_wq95") - F.col("price_wq05"), 4).alias("price_wiqr"))


@query(f"WITH {SQL_TICKS}, n AS (SELECT count(DISTINCT isodow(ts)) AS n FROM ticks) SELECT seq, round(sin(2 * pi() * (isodow(ts) - 1) / n), 6) AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / n), 6) AS dow_cos FROM ticks, n")
def cyclic_features(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir).withColumn("dow", F.weekday("ts"))
    n = F.broadcast(t.agg(F.count_distinct("dow").cast("double").alias("n")))  # one row
    sine, cosine = scalars.cyclic("dow", "n")
    return t.join(n, F.lit(True)).select("seq", r(sine).alias("dow_sin"), r(cosine).alias("dow_cos"))


@query(f"WITH {SQL_TICKS}, z AS (SELECT seq, (price - 250) / 30 AS x FROM ticks), c AS (SELECT *, greatest(least(x, 4), -4) AS y FROM z) SELECT seq, round(y + tanh(x - y), 6) AS squeezed FROM c")
def outlier_squeeze(spark, sf_dir):
    return fixtures.ticks(spark, sf_dir).select("seq", r(scalars.squeezed((F.col("price") - 250) / 30)).alias("squeezed"))


@query("SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS event_type_click, CAST(event_type = 'error' AS INTEGER) AS event_type_error, CAST(event_type = 'signup' AS INTEGER) AS event_type_signup FROM events")
def onehot_event_type(spark, sf_dir):
    return features.one_hot(table(spark, sf_dir, "events"), "event_type", ["click", "error", "signup"], drop_first=False).select("event_id", "event_type_click", "event_type_error", "event_type_signup")


# --- universe --------------------------------------------------------------------------------------------------------------------

SQL_UNIVERSE = f"""{SQL_DAILY}, {SQL_DETAILS}, nd AS (SELECT symbol, date, open, close, high, low, volume, midprice, v AS vwap, v * volume AS dollar_total, high - low AS range, (high - low) / nullif(v, 0) AS range_value_pct
  FROM (SELECT *, CASE WHEN vwap BETWEEN low AND high THEN vwap ELSE midprice END AS v FROM (SELECT * REPLACE (CASE WHEN symbol % 7 = 0 THEN vwap * 100 ELSE vwap END AS vwap), (high + low + open + close) / 4 AS midprice FROM daily)))"""


def market(spark, sf_dir) -> DataFrame:
    """The daily table, normalised; every seventh symbol comes with a broken VWAP."""
    d = fixtures.daily(spark, sf_dir)
    broken = d.withColumn("vwap", F.when(F.col("symbol") % 7 == 0, F.col("vwap") * 100).otherwise(F.col("vwap")))
    return universe.with_range(universe.normalised(broken))


@query(f"WITH {SQL_UNIVERSE} SELECT symbol, date, round(midprice, 4) AS midprice, round(vwap, 6) AS vwap, round(dollar_total, 4) AS dollar_total FROM nd", date=True)
def daily_normalise_vwap_repair(spark, sf_dir):
    return market(spark, sf_dir).select("symbol", "date", r("midprice", 4).alias("midprice"), r("vwap", 6).alias("vwap"), r("dollar_total", 4).alias("dollar_total"))


@query(f"WITH {SQL_UNIVERSE} SELECT symbol, date, round(range, 4) AS range, round(range_value_pct, 6) AS range_value_pct FROM nd", date=True)
def add_range(spark, sf_dir):
    return market(spark, sf_dir).select("symbol", "date", r("range", 4).alias("range"), r("range_value_pct").alias("range_value_pct"))


SQL_FILTERS = f"""{SQL_UNIVERSE},
s1 AS (SELECT * FROM nd SEMI JOIN (SELECT symbol FROM nd GROUP BY symbol HAVING count(open) >= (SELECT max(n) FROM (SELECT count(*) AS n FROM nd GROUP BY symbol))) USING (symbol)),
s2 AS (SELECT * FROM s1 SEMI JOIN (SELECT symbol FROM s1 GROUP BY symbol HAVING avg(dollar_total) > 6000000) USING (symbol)),
s3 AS (SELECT * FROM s2 SEMI JOIN (SELECT symbol FROM s2 GROUP BY symbol HAVING median(range_value_pct) BETWEEN 0.5 AND 1.6) USING (symbol)),
s4 AS (SELECT * FROM s3 SEMI JOIN (SELECT symbol FROM s3 GROUP BY symbol HAVING median(close) > 30000) USING (symbol)),
s5 AS (SELECT * FROM s4 SEMI JOIN (SELECT symbol FROM details WHERE sector <> '' AND upper(type) = 'CS') USING (symbol))"""
_FILTER = {"cut": 6_000_000.0, "low": 0.5, "high": 1.6, "price": 30_000.0}


@query(f"WITH {SQL_UNIVERSE} SELECT DISTINCT symbol FROM nd SEMI JOIN (SELECT symbol FROM nd GROUP BY symbol HAVING count(open) >= (SELECT max(n) FROM (SELECT count(*) AS n FROM nd GROUP BY symbol))) USING (symbol)")
def all_dates_filter(spark, sf_dir):
    return universe.all_dates(market(spark, sf_dir)).select("symbol").distinct()


@query(f"WITH {SQL_UNIVERSE} SELECT symbol FROM nd GROUP BY symbol HAVING avg(dollar_total) > 6000000")
def liquidity_filter(spark, sf_dir):
    return universe.liquid(market(spark, sf_dir), 6_000_000.0).select("symbol").distinct()


@query(f"WITH {SQL_UNIVERSE} SELECT symbol FROM nd GROUP BY symbol HAVING avg(dollar_total) > (SELECT quantile_cont(dollar_total, 0.6) FROM nd)")
def liquidity_quantile_filter(spark, sf_dir):
    return universe.liquid(market(spark, sf_dir), quantile=0.6).select("symbol").distinct()


@query(f"WITH {SQL_UNIVERSE} SELECT symbol FROM nd GROUP BY symbol HAVING median(range_value_pct) BETWEEN 1.0 AND 1.5")
def range_value_filter(spark, sf_dir):
    return universe.volatile(market(spark, sf_dir), 1.0, 1.5).select("symbol").distinct()


@query(f"WITH {SQL_UNIVERSE} SELECT symbol FROM nd GROUP BY symbol HAVING median(close) > 36000")
def min_value_filter(spark, sf_dir):
    return universe.above(market(spark, sf_dir), 36_000.0).select("symbol").distinct()


@query(f"WITH {SQL_UNIVERSE} SELECT DISTINCT symbol FROM nd SEMI JOIN (SELECT symbol FROM details WHERE sector <> '' AND upper(type) = 'CS') USING (symbol)")
def details_semi_filter(spark, sf_dir):
    return universe.described(market(spark, sf_dir), fixtures.details(spark, sf_dir)).select("symbol").distinct()


@query(f"WITH {SQL_FILTERS} " + " UNION ALL ".join(f"SELECT {k} AS step_no, '{n}' AS step, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM {t}" for k, (n, t) in enumerate((("all", "nd"), ("all_dates", "s1"), ("liquid", "s2"), ("volatile", "s3"), ("above", "s4"), ("described", "s5")))))
def filter_market_counts(spark, sf_dir):
    return universe.step_counts(universe.symbol_steps(market(spark, sf_dir), fixtures.details(spark, sf_dir), **_FILTER))


@query(f"WITH {SQL_UNIVERSE}, m AS (SELECT symbol, median(range_value_pct) AS x, median(dollar_total) AS y FROM nd GROUP BY symbol) SELECT m.symbol, name, type, sector, industry, round(x, 6) AS range_value_pct_median, round(y, 3) AS dollar_total_median FROM details d RIGHT JOIN m ON d.symbol = m.symbol")
def symbol_stats_right_join(spark, sf_dir):
    out = universe.symbol_stats(market(spark, sf_dir), fixtures.details(spark, sf_dir))
    return out.select("symbol", "name", "type", "sector", "industry", r("range_value_pct_median").alias("range_value_pct_median"), r("dollar_total_median", 3).alias("dollar_total_median"))


SQL_RETURNS = f"""{SQL_UNIVERSE}, c0 AS (SELECT symbol, date, close AS value FROM nd SEMI JOIN (SELECT symbol FROM nd GROUP BY symbol HAVING count(open) >= (SELECT max(n) FROM (SELECT count(*) AS n FROM nd GROUP BY symbol))) USING (symbol)), c1 AS (SELECT * FROM c0 SEMI JOIN (SELECT date FROM c0 GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM c0)) USING (date)),
c2 AS (SELECT *, value - lag(value) OVER w AS diff, ln(value) - ln(lag(value) OVER w) AS log_return FROM c1 WINDOW w AS (PARTITION BY symbol ORDER BY date)), c3 AS (SELECT * FROM c2 WHERE log_return IS NOT NULL),
c4 AS (SELECT *, (log_return - avg(log_return) OVER (PARTITION BY symbol)) / nullif(stddev_pop(log_return) OVER (PARTITION BY symbol), 0) AS zscore FROM c3),
rt AS (SELECT *, greatest(least(zscore, 4), -4) + tanh(zscore - greatest(least(zscore, 4), -4)) AS squeezed FROM c4)"""


def price_returns(spark, sf_dir) -> DataFrame:
    """Returns of the universe that all_dates derives: a symbol without a row on some date would take that date from all."""
    return universe.returns(universe.all_dates(market(spark, sf_dir)))


@query(f"WITH {SQL_RETURNS} SELECT symbol, date, round(value, 4) AS value, round(diff, 4) AS diff, round(log_return, 6) AS log_return, round(zscore, 6) AS zscore, round(squeezed, 6) AS squeezed FROM rt", date=True)
def log_returns_zscore(spark, sf_dir):
    out = price_returns(spark, sf_dir)
    return out.select("symbol", "date", r("value", 4).alias("value"), r("diff", 4).alias("diff"), r("log_return").alias("log_return"), r("zscore").alias("zscore"), r("squeezed").alias("squeezed"))


@query(f"""WITH {SQL_RETURNS}, mk AS (SELECT date, avg(log_return) AS x FROM rt GROUP BY date), b AS (SELECT symbol, regr_intercept(log_return, x) AS alpha, regr_slope(log_return, x) AS beta FROM rt JOIN mk USING (date) GROUP BY symbol)
SELECT symbol, date, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(log_return - (alpha + beta * x), 6) AS residual FROM rt JOIN mk USING (date) JOIN b USING (symbol)""", date=True)
def beta_residuals(spark, sf_dir):
    v = price_returns(spark, sf_dir).select("symbol", "date", "log_return")
    return rounded(universe.residuals(v, v.groupBy("date").agg(F.avg("log_return").alias("log_return")), "log_return").drop("log_return"))


SQL_SEGMENTS = f"""{SQL_UNIVERSE}, mn AS (SELECT symbol, avg(dollar_total) AS d, avg(range_value_pct) AS x FROM nd GROUP BY symbol), cu AS (SELECT quantile_cont(d, 0.2) AS p20, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.8) AS p80, median(x) AS m FROM mn),
sg AS (SELECT symbol, CASE WHEN d > p80 THEN 'large' WHEN d > p20 AND d < p50 AND x > m THEN 'mid' END AS segment FROM mn, cu)"""


@query(f"WITH {SQL_SEGMENTS} SELECT symbol, segment FROM sg WHERE segment IS NOT NULL")
def segment_symbols(spark, sf_dir):
    return universe.segments(market(spark, sf_dir)).select("symbol", "segment")


@query(f"WITH {SQL_SEGMENTS} SELECT m.symbol, l.symbol AS clock_symbol FROM sg m, sg l WHERE m.segment = 'mid' AND l.segment = 'large' AND m.symbol <> l.symbol")
def clock_pairs(spark, sf_dir):
    return universe.clock_pairs(universe.segments(market(spark, sf_dir)))


_PAIRS = "p AS (SELECT a.symbol AS a, b.symbol AS b, a.date, a.log_return AS x, b.log_return AS y FROM rt a JOIN rt b ON a.date = b.date AND a.symbol <= b.symbol)"


@query(f"WITH {SQL_RETURNS}, {_PAIRS} SELECT a, b, round(covar_samp(x, y), 6) AS cov FROM p GROUP BY a, b")
def cov_pairs(spark, sf_dir):
    return rounded_pairs(matrix.covariance(price_returns(spark, sf_dir), "log_return"))


@query(f"WITH {SQL_RETURNS}, {_PAIRS} SELECT a, b, round(avg(least(x, 0) * least(y, 0)), 6) AS cov FROM p GROUP BY a, b")
def semi_cov_pairs(spark, sf_dir):
    return rounded_pairs(matrix.covariance(price_returns(spark, sf_dir), "log_return", "semi"))


@query(f"WITH {SQL_RETURNS}, {_PAIRS}, c AS (SELECT a, b, (x - avg(x) OVER w) * (y - avg(y) OVER w) AS xy, pow(1 - 2.0::DOUBLE / 61, row_number() OVER (PARTITION BY a, b ORDER BY date DESC) - 1) AS k FROM p WINDOW w AS (PARTITION BY a, b)) SELECT a, b, round(sum(xy * k) / sum(k), 6) AS cov FROM c GROUP BY a, b")
def exponential_cov_pairs(spark, sf_dir):
    return rounded_pairs(matrix.covariance(price_returns(spark, sf_dir), "log_return", "exponential"))


@query(f"WITH {SQL_RETURNS}, {_PAIRS}, c AS (SELECT a, b, greatest(least(corr(x, y), 1), -1) AS corr FROM p GROUP BY a, b) SELECT a, b, round(corr, 6) AS corr, round(sqrt(abs((1 - abs(round(corr, 9))) / 2)), 6) AS distance FROM c")
def corr_distance_pairs(spark, sf_dir):
    out = matrix.distances(price_returns(spark, sf_dir), "log_return")
    return out.select("a", "b", r_fast("corr").alias("corr"), r_fast(F.sqrt(F.abs((1 - F.abs(r_fast("corr", 9))) / 2))).alias("distance"))


SQL_SHRUNK = f"""{SQL_RETURNS}, {_PAIRS}, cm AS (SELECT symbol, avg(log_return) AS m FROM rt GROUP BY symbol),
sp AS (SELECT p.a, p.b, count(*) AS n, avg((x - u.m) * (y - v.m)) AS s, avg(pow(x - u.m, 2) * pow(y - v.m, 2)) AS q FROM p JOIN cm u ON u.symbol = p.a JOIN cm v ON v.symbol = p.b GROUP BY p.a, p.b),
ss AS (SELECT CAST(max(n) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE a = b) AS DOUBLE) AS k, sum(s) FILTER (WHERE a = b) AS trace, sum(CASE WHEN a = b THEN 1 ELSE 2 END * s * s) AS s2, sum(CASE WHEN a = b THEN 1 ELSE 2 END * q) AS q FROM sp),
sm AS (SELECT *, trace / k AS mu FROM ss)"""


def _sql_shrunk(share: str) -> str:
    return f"WITH {SQL_SHRUNK}, sh AS (SELECT mu, {share} AS share FROM sm) SELECT a, b, round((1 - share) * s + CASE WHEN a = b THEN share * mu ELSE 0 END, 7) AS cov, round(share, 6) AS shrinkage FROM sp, sh"


@query(_sql_shrunk("coalesce(least((q - s2) / n, s2 - k * mu * mu) / nullif(s2 - k * mu * mu, 0), 0)"))
def shrunk_cov_pairs(spark, sf_dir):
    out = matrix.shrunk_covariance(price_returns(spark, sf_dir), "log_return")
    return out.select("a", "b", r_fast("cov", 7).alias("cov"), r_fast("shrinkage").alias("shrinkage"))


@query(_sql_shrunk("least((s2 / (k * k) + mu * mu) / ((n + 1) * (s2 / (k * k) - mu * mu / k)), 1)"))
def oas_cov_pairs(spark, sf_dir):
    out = matrix.shrunk_covariance(price_returns(spark, sf_dir), "log_return", "oas")
    return out.select("a", "b", r_fast("cov", 7).alias("cov"), r_fast("shrinkage").alias("shrinkage"))


@query(None)
def denoised_distance_pairs(spark, sf_dir):
    """Shrunk, denoised and detoned correlations of the returns, and their distances."""
    return rounded(runs.denoised_distances(price_returns(spark, sf_dir), "log_return", detone=1))


@query(None)
def ward_merges(spark, sf_dir):
    """Ward's tree of the symbols by their returns."""
    return rounded(linkage.ward_of_values(price_returns(spark, sf_dir), "log_return"))


def _symbol_points(spark, sf_dir) -> DataFrame:
    """Each symbol's trade sizes and ranges as a point: in units in which the universe is a few wide."""
    each = market(spark, sf_dir).groupBy("symbol").agg(F.avg(F.log10("dollar_total")).alias("x"), F.avg("range_value_pct").alias("y"))
    return each.select("symbol", F.array(F.round(F.col("x") * 20, 4), F.round(F.col("y") * 20, 4)).alias("v"))


#: Distances from all pairs; clusters by repeated steps to the least core row.
SQL_DBSCAN = f"""{SQL_UNIVERSE}, pt AS MATERIALIZED (SELECT symbol, [round(avg(log10(dollar_total)) * 20, 4), round(avg(range_value_pct) * 20, 4)] AS v FROM nd GROUP BY symbol),
nb AS MATERIALIZED (SELECT a.symbol AS a, b.symbol AS b FROM pt a, pt b WHERE list_distance(a.v, b.v) <= 0.25), co AS MATERIALIZED (SELECT a AS symbol FROM nb GROUP BY a HAVING count(*) >= 4),
re AS (SELECT symbol AS a, symbol AS b FROM co UNION SELECT re.a, nb.b FROM re JOIN nb ON re.b = nb.a SEMI JOIN co ON co.symbol = nb.b), ro AS MATERIALIZED (SELECT a AS symbol, min(b) AS root FROM re GROUP BY a)"""


@query(f"""WITH RECURSIVE {SQL_DBSCAN} SELECT pt.symbol AS id, co.symbol IS NOT NULL AS core, coalesce(ro.root, (SELECT min(r2.root) FROM nb JOIN ro r2 ON r2.symbol = nb.b WHERE nb.a = pt.symbol)) AS cluster
FROM pt LEFT JOIN co USING (symbol) LEFT JOIN ro USING (symbol)""")
def dbscan_symbols(spark, sf_dir):
    return density.dbscan(_symbol_points(spark, sf_dir), "symbol", "v", 0.25, 4).select("id", "core", "cluster")


@query(f"""WITH RECURSIVE {SQL_DBSCAN}, cd AS (SELECT a.symbol AS id, list_sort(list(list_distance(a.v, b.v)))[4] AS d FROM pt a, pt b GROUP BY a.symbol)
SELECT id, round(CASE WHEN d <= 0.8 THEN d END, 6) AS core_distance, co.symbol IS NOT NULL AS core, ro.root AS cluster FROM cd LEFT JOIN co ON co.symbol = id LEFT JOIN ro ON ro.symbol = id""")
def optics_symbols(spark, sf_dir):
    """Core distances within a wide radius, and the forest cut at a narrow one."""
    core, forest = density.reachability_forest(_symbol_points(spark, sf_dir), "symbol", "v", 0.8, 4)
    return density.cut(core, forest, 0.25).join(core, "id").select("id", r("core_distance").alias("core_distance"), "core", "cluster")


@query(None)
def affinity_exemplars(spark, sf_dir):
    """Exemplars of the symbols by their points; each one's own preference is the median similarity."""
    return exemplars.affinity_of_points(_symbol_points(spark, sf_dir).withColumnRenamed("symbol", "id"), 0.7, 100)


@query(None)
def mean_shift_symbols(spark, sf_dir):
    labels, found = modes.mean_shift(_symbol_points(spark, sf_dir), "symbol", "v", 1.0, rounds=30, tolerance=0.02)
    return labels.join(found.withColumnRenamed("id", "cluster"), "cluster").select("id", "cluster", "n")


@query(None)
def balanced_symbols(spark, sf_dir):
    """Clusters of about a dozen symbols, none of under 5 or over 50."""
    points = graph.fixed(_symbol_points(spark, sf_dir))
    n = points.count()
    return balanced.balanced_kmeans(points, "symbol", "v", max(1, n // 12), min(5, n), 50, rounds=3)


@query(None)
def sparse_loadings(spark, sf_dir):
    """The few symbols that two components of the returns' covariance load on."""
    out = spectrum.sparse_components_of_values(price_returns(spark, sf_dir), "log_return", 2, cut=0.4, rounds=15)
    return out.select("symbol", *(r(F.col("v")[k]).alias(f"loading_{k}") for k in range(2))).where("loading_0 <> 0 or loading_1 <> 0")


#: In SQL, whatever the groups are, their counts and sums are those of all rows.
@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(list_sum(list_transform(v, lambda x: x))), 3) AS total, round(sum(list_sum(list_transform(v, lambda x: x * x))), 3) AS squares FROM (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)")
def birch_sums(spark, sf_dir):
    groups = birch.clustering_features(table(spark, sf_dir, "embeddings"), "embedding", 0.9)
    each = F.aggregate("total", F.lit(0.0), lambda s, x: s + x)
    return groups.agg(F.sum("n").alias("n"), r(F.sum(each), 3).alias("total"), r(F.sum("squares"), 3).alias("squares"))


@query(None)
def birch_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return birch.nearest_feature(rows, "vec_id", "embedding", birch.clustering_features(rows, "embedding", 0.9))


@query(None)
def mcd_weights(spark, sf_dir):
    """Which vectors the minimum covariance determinant leaves out."""
    out, _ = robust.minimum_covariance_determinant(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", starts=4)
    return rounded(out)


_SECTORS = "lb AS (SELECT symbol, CAST(symbol % 3 AS INTEGER) AS cluster FROM (SELECT DISTINCT symbol FROM rt))"


@query(f"""WITH {SQL_RETURNS}, {_PAIRS}, {_SECTORS}, ds AS (SELECT a, b, sqrt(abs((1 - abs(round(corr(x, y), 9))) / 2)) AS distance FROM p GROUP BY a, b), bt AS (SELECT a, b, distance FROM ds UNION ALL SELECT b, a, distance FROM ds WHERE a <> b),
nr AS (SELECT cluster, 1 - avg(m) AS similarity FROM (SELECT x.cluster, bt.b, avg(nullif(distance, 0)) AS m FROM bt JOIN lb x ON x.symbol = bt.a JOIN lb y ON y.symbol = bt.b WHERE x.cluster = y.cluster GROUP BY x.cluster, bt.b) GROUP BY cluster),
cn AS (SELECT cluster, sector, count(*) AS n FROM lb LEFT JOIN details USING (symbol) GROUP BY ALL), ci AS (SELECT cluster, industry, count(*) AS n FROM lb LEFT JOIN details USING (symbol) GROUP BY ALL)
SELECT lb.cluster, count(*) AS size, 1.0::DOUBLE / count(DISTINCT sector) AS sector_purity, 1.0::DOUBLE / count(DISTINCT industry) AS industry_purity, (SELECT sector FROM cn WHERE cn.cluster = lb.cluster ORDER BY n DESC, sector LIMIT 1) AS top_sector,
  (SELECT industry FROM ci WHERE ci.cluster = lb.cluster ORDER BY n DESC, industry LIMIT 1) AS top_industry, string_agg(CAST(symbol AS VARCHAR), ',' ORDER BY symbol) AS symbols, string_agg(name, ',' ORDER BY symbol) AS names,
  round(avg(x), 6) AS range_value_pct_mean, round(avg(y), 2) AS dollar_total_mean, round(any_value(similarity), 6) AS similarity FROM lb LEFT JOIN details USING (symbol) LEFT JOIN (SELECT symbol, median(range_value_pct) AS x, median(dollar_total) AS y FROM nd GROUP BY symbol) USING (symbol) LEFT JOIN nr ON nr.cluster = lb.cluster GROUP BY lb.cluster""")
def cluster_metrics(spark, sf_dir):
    v = price_returns(spark, sf_dir)
    d = matrix.distances(v, "log_return").withColumn("distance", F.sqrt(F.abs((1 - F.abs(F.round("corr", 9))) / 2)))
    lab = v.select("symbol").distinct().withColumn("cluster", (F.col("symbol") % 3).cast("int"))
    info = universe.symbol_stats(market(spark, sf_dir), fixtures.details(spark, sf_dir)).withColumnsRenamed({"range_value_pct_median": "range_value_pct", "dollar_total_median": "dollar_total"})
    out = cluster.cluster_metrics(lab, d, info)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("cluster", "size", "sector_purity", "industry_purity", "top_sector", "top_industry", joined("symbols"), joined("names"), r("range_value_pct_mean").alias("range_value_pct_mean"), r("dollar_total_mean", 2).alias("dollar_total_mean"), r("similarity").alias("similarity"))


@query("""WITH c AS (SELECT label AS a, vec_id % 4 AS b, count(*) AS n FROM embeddings GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t FROM c), y AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM c GROUP BY a)), z AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 6) AS adjusted_rand FROM x, y, z""")
def ari_score(spark, sf_dir):
    return rounded(cluster.rand_index(table(spark, sf_dir, "embeddings").withColumn("four", F.col("vec_id") % 4), "label", "four"))


@query("""WITH c AS (SELECT label AS a, vec_id % 4 AS b, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY ALL), x AS (SELECT a, sum(n) AS x FROM c GROUP BY a), y AS (SELECT b, sum(n) AS y FROM c GROUP BY b), t AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM c),
m AS (SELECT sum(c.n / t.n * ln(t.n * c.n / (x * y))) AS mi FROM c JOIN x USING (a) JOIN y USING (b), t), ha AS (SELECT -sum(x / n * ln(x / n)) AS h FROM x, t), hb AS (SELECT -sum(y / n * ln(y / n)) AS h FROM y, t),
k AS (SELECT x, y, n, unnest(range(CAST(greatest(1, x + y - n) AS BIGINT), CAST(least(x, y) + 1 AS BIGINT))) AS k FROM x, y, t),
e AS (SELECT sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) AS e FROM k)
SELECT round((mi - e) / ((ha.h + hb.h) / 2 - e), 6) AS adjusted_mutual_information FROM m, ha, hb, e""")
def ami_score(spark, sf_dir):
    return rounded(cluster.adjusted_mutual_information(table(spark, sf_dir, "embeddings").withColumn("four", F.col("vec_id") % 4), "label", "four"))


@query(None)
def kmeans_labels(spark, sf_dir):
    return cluster.clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query(None)
def bisecting_labels(spark, sf_dir):
    return cluster.clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, "bisecting")


@query(f"""WITH {SQL_UNIVERSE}, m AS (SELECT CAST(symbol % 12 AS INTEGER) AS cluster, count(*) AS size, avg(range_value_pct) AS similarity FROM nd GROUP BY 1) SELECT cluster, size, round(similarity, 6) AS similarity FROM m WHERE similarity > (SELECT quantile_cont(similarity, 0.25) FROM m) AND size > 5 ORDER BY similarity DESC, cluster LIMIT 5""")
def top_clusters(spark, sf_dir):
    m = market(spark, sf_dir).groupBy((F.col("symbol") % 12).cast("int").alias("cluster")).agg(F.count("*").alias("size"), F.avg("range_value_pct").alias("similarity"))
    return rounded(cluster.top_clusters(m, 5, 0.25, 5))


@query(f"""WITH {SQL_UNIVERSE}, m AS (SELECT date, symbol, max(close) AS v FROM nd WHERE close IS NOT NULL GROUP BY date, symbol)
SELECT date, count(*) AS symbols, string_agg(symbol || ':' || CAST(round(v * 10000) AS BIGINT), ' ' ORDER BY symbol) AS prices, round(max(v), 4) AS highest FROM m GROUP BY date""", date=True)
def price_pivot(spark, sf_dir):
    """A row for each date that has every symbol's price; the map as text, in ten thousandths."""
    out = universe.wide(market(spark, sf_dir), "close")
    text = F.transform(F.map_entries("values"), lambda e: F.concat_ws(":", e["key"].cast("string"), F.round(e["value"] * 10000).cast("long").cast("string")))
    return out.select("date", F.size("values").cast("long").alias("symbols"), F.array_join(text, " ").alias("prices"), r(F.array_max(F.map_values("values")), 4).alias("highest"))


# --- daily statistics, planning, joins ----------------------------------------------------------------------------------------------

SQL_STATS = f"""{SQL_UNIVERSE}, sn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM nd), {sql_jma('sn', 'symbol', 'range', 5, 1, 'jr')}, {sql_jma('sn', 'symbol', 'vwap', 7, 1, 'jv')},
ds AS (SELECT symbol, date, lag(CASE WHEN rn >= 5 THEN jr.jma END) OVER w AS range_jma_lag, lag(CASE WHEN rn >= 7 THEN jv.jma END) OVER w AS vwap_jma_lag FROM sn JOIN jr USING (symbol, rn) JOIN jv USING (symbol, rn) WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@query(f"WITH RECURSIVE {SQL_STATS} SELECT symbol, date, round(range_jma_lag, 4) AS range_jma_lag, round(vwap_jma_lag, 4) AS vwap_jma_lag FROM ds WHERE range_jma_lag IS NOT NULL AND vwap_jma_lag IS NOT NULL", date=True)
def daily_stats_lagged(spark, sf_dir):
    return rounded(features.daily_stats(market(spark, sf_dir)).select("symbol", "date", "range_jma_lag", "vwap_jma_lag"), 4)


@query(f"WITH RECURSIVE {SQL_STATS} SELECT symbol, date, round(least(greatest(range_jma_lag / 17, vwap_jma_lag * 0.07 / 100), vwap_jma_lag * 0.005), 4) AS renko_size FROM ds WHERE range_jma_lag IS NOT NULL AND vwap_jma_lag IS NOT NULL", date=True)
def dynamic_renko_size(spark, sf_dir):
    s = features.daily_stats(market(spark, sf_dir))
    return s.select("symbol", "date", r(features.renko_size(s, 17, 0.07), 4).alias("renko_size"))


@query(f"WITH {SQL_TICKS}, w AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS date FROM ticks) SELECT * FROM w WHERE NOT (symbol % 3 = 0 AND day(date) <= 20)", date=True)
def remaining_dates_anti(spark, sf_dir):
    wanted = fixtures.ticks(spark, sf_dir).withColumn("date", F.to_date("ts"))
    return universe.missing_keys(wanted, wanted.where((F.col("symbol") % 3 == 0) & (F.dayofmonth("date") <= 20)), ["symbol", "date"])


@query(f"WITH {SQL_TICKS} SELECT DISTINCT CAST(ts AS DATE) AS date FROM ticks WHERE symbol % 2 = 0 INTERSECT SELECT DISTINCT CAST(ts AS DATE) FROM ticks WHERE symbol % 5 = 0", date=True)
def backfilled_dates_intersect(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir).select("symbol", F.to_date("ts").alias("date"))
    return t.where("symbol % 2 = 0").select("date").intersect(t.where("symbol % 5 = 0").select("date"))


@query(f"WITH {SQL_TICKS} SELECT symbol, seq FROM ticks WHERE NOT (volume < 1 OR cond = 2)")
def filtered_ticks_anti_join(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir)
    bad = t.where((F.col("volume") < 1) | ticks.irregular()).select("symbol", "seq")
    return t.select("symbol", "seq").join(bad, ["symbol", "seq"], "left_anti")


@query(f"""WITH {SQL_TICKS}, {SQL_DAYBARS}, b AS (SELECT symbol, close_at, price_close FROM db) SELECT t.symbol, t.seq, b.close_at AS asof_close_at, b.price_close FROM ticks t ASOF LEFT JOIN b ON t.symbol = b.symbol AND t.ts >= b.close_at""")
def asof_prev_bar(spark, sf_dir):
    b = day_bars(spark, sf_dir).select("symbol", "close_at", "price_close")
    return joins.asof_join(fixtures.ticks(spark, sf_dir), b, ["symbol"], "ts", "close_at", ["price_close"]).select("symbol", "seq", "asof_close_at", "price_close")


# --- indicators -----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {SQL_TICKS} SELECT symbol, seq, CASE WHEN count(price) OVER w >= 25 THEN round(avg(price) OVER w, 6) END AS sma FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS 24 PRECEDING)")
def sma_gated(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir)
    return t.select("symbol", "seq", r(features.moving_average(t, ["symbol"], ["ts", "seq"], "price", 25)).alias("sma"))


@query(f"""WITH {SQL_TICKS}, k AS (SELECT symbol, ts, seq, CASE WHEN count(*) OVER w >= 14 THEN 100 * (price - min(price) OVER w) / nullif(max(price) OVER w - min(price) OVER w, 0) END AS k FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS 13 PRECEDING))
SELECT symbol, seq, round(k, 6) AS stoch_k, CASE WHEN count(k) OVER v >= 3 THEN round(avg(k) OVER v, 6) END AS stoch_d FROM k WINDOW v AS (PARTITION BY symbol ORDER BY ts, seq ROWS 2 PRECEDING)""")
def stochastic_osc(spark, sf_dir):
    return rounded(features.stochastic(fixtures.ticks(spark, sf_dir), ["symbol"], ["ts", "seq"], "price", "price", "price").select("symbol", "seq", "stoch_k", "stoch_d"))


def _folded(spark, sf_dir, make, name: str) -> DataFrame:
    return rounded(folds.fold(fixtures.ticks(spark, sf_dir), ["symbol"], ["ts", "seq"], ["price"], make, {name: "double"}).select("symbol", "seq", name))


@query(f"""WITH RECURSIVE {SQL_TICKS}, {SQL_SIDED}, d AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY rn) AS c FROM sided), gl AS (SELECT *, CASE WHEN c > 0 THEN c ELSE 0 END AS g, CASE WHEN -c > 0 THEN -c ELSE 1e-10::DOUBLE END AS l FROM d),
i0 AS (SELECT symbol, sum(g) / 14 AS g, sum(l) / 14 AS l FROM gl WHERE rn <= 14 GROUP BY symbol), w AS (SELECT symbol, CAST(15 AS BIGINT) AS rn, g, l FROM i0 UNION ALL SELECT s.symbol, s.rn, s.g / 14 + p.g * 13 / 14, s.l / 14 + p.l * 13 / 14 FROM w p JOIN gl s ON s.symbol = p.symbol AND s.rn = p.rn + 1)
SELECT s.symbol, s.seq, round(100 - 100 / (1 + w.g / w.l), 6) AS rsi FROM sided s LEFT JOIN w ON s.symbol = w.symbol AND s.rn = w.rn""")
def rsi_wilder(spark, sf_dir):
    return _folded(spark, sf_dir, folds.rsi_step(14), "rsi")


def _sql_supersmoother() -> str:
    from math import cos, exp, radians

    a = exp(-1.414 * 3.14159 / 10)
    c2, c3 = cos(radians(1.414 * 18)), -a * a
    c1 = 1 - c2 - c3
    return f"""WITH RECURSIVE {SQL_TICKS}, {SQL_SIDED}, w AS (SELECT symbol, rn, price AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM sided WHERE rn = 1
      UNION ALL SELECT s.symbol, s.rn, s.price, CASE WHEN s.rn <= 3 THEN 0.0::DOUBLE ELSE {c1!r}::DOUBLE * (s.price + p.x) / 2 + {c2!r}::DOUBLE * p.y + ({c3!r}::DOUBLE) * p.z END, p.y FROM w p JOIN sided s ON s.symbol = p.symbol AND s.rn = p.rn + 1)
      SELECT s.symbol, s.seq, round(w.y, 6) AS smooth FROM sided s JOIN w USING (symbol, rn)"""


@query(_sql_supersmoother())
def supersmoother(spark, sf_dir):
    return _folded(spark, sf_dir, folds.supersmoother_step(10), "smooth")


@query(f"""WITH RECURSIVE {SQL_TICKS}, {SQL_SIDED}, w AS (SELECT symbol, rn, price AS y, price AS z FROM sided WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, (p.y + (2.0::DOUBLE / 15) * (s.price - p.y) + 0.5::DOUBLE * (2 * p.y - p.z)) / 1.5::DOUBLE, p.y FROM w p JOIN sided s ON s.symbol = p.symbol AND s.rn = p.rn + 1)
SELECT s.symbol, s.seq, round(w.y, 6) AS rema FROM sided s JOIN w USING (symbol, rn)""")
def rema(spark, sf_dir):
    return _folded(spark, sf_dir, folds.rema_step(14, 0.5), "rema")


@query(f"""WITH RECURSIVE {SQL_TICKS}, {SQL_SIDED}, w AS (SELECT symbol, rn, price AS a, 1.0::DOUBLE AS b FROM sided WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, p.a * (1 - 2.0::DOUBLE / 25) + s.price, p.b * (1 - 2.0::DOUBLE / 25) + 1 FROM w p JOIN sided s ON s.symbol = p.symbol AND s.rn = p.rn + 1)
SELECT s.symbol, s.seq, round(w.a / w.b, 6) AS ewm FROM sided s JOIN w USING (symbol, rn)""")
def ewm_span(spark, sf_dir):
    return _folded(spark, sf_dir, folds.ewm_step(24), "ewm")


def _sql_sar(first: float = 0.02, step: float = 0.02, most: float = 0.2) -> str:
    cols = "symbol, date, rn, price_high, price_low, h1, l1"
    x = lambda v: f"{v!r}::DOUBLE"
    return f"""WITH RECURSIVE {SQL_TICKS}, {SQL_DAYBARS}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM db),
w AS (SELECT symbol, date, rn, price_high, price_low, NULL::DOUBLE AS h1, NULL::DOUBLE AS l1, true AS up, price_low AS stop, price_high AS best, {x(first)} AS factor FROM o WHERE rn = 1
UNION ALL SELECT {cols}, CASE WHEN through THEN NOT up ELSE up END, CASE WHEN through THEN best ELSE stop END,
  CASE WHEN through THEN CASE WHEN up THEN price_low ELSE price_high END WHEN up THEN greatest(best, price_high) ELSE least(best, price_low) END,
  CASE WHEN through THEN {x(first)} WHEN CASE WHEN up THEN price_high > best ELSE price_low < best END THEN least(factor + {x(step)}, {x(most)}) ELSE factor END
FROM (SELECT *, CASE WHEN up THEN price_low < stop ELSE price_high > stop END AS through FROM (
  SELECT s.symbol, s.date, s.rn, s.price_high, s.price_low, p.price_high AS h1, p.price_low AS l1, p.up, p.best, p.factor,
    CASE WHEN p.up THEN least(p.stop + p.factor * (p.best - p.stop), p.price_low, p.l1) ELSE greatest(p.stop + p.factor * (p.best - p.stop), p.price_high, p.h1) END AS stop
  FROM w p JOIN o s ON s.symbol = p.symbol AND s.rn = p.rn + 1)))
SELECT symbol, date, round(stop, 6) AS sar FROM w"""


@query(_sql_sar(), date=True)
def parabolic_sar(spark, sf_dir):
    b = day_bars(spark, sf_dir)
    return rounded(folds.fold(b, ["symbol"], ["date"], ["price_high", "price_low"], folds.sar_step(), {"sar": "double"}).select("symbol", "date", "sar"))


_WEIGHTS = scalars.fracdiff_weights(0.4, 6)


@query(f"WITH {SQL_TICKS} SELECT symbol, seq, round({' + '.join(f'lag(price, {k}) OVER w * ({x!r})::DOUBLE' for k, x in enumerate(_WEIGHTS))}, 6) AS fracdiff FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)")
def fracdiff(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir)
    return t.select("symbol", "seq", r(features.fracdiff(t, ["symbol"], ["ts", "seq"], "price", 0.4, 6)).alias("fracdiff"))


@query(f"WITH {SQL_DAILY}, w AS (SELECT *, least(open, close) - low AS wick FROM daily) SELECT symbol, date, round(wick, 4) AS wick FROM w WHERE wick > (SELECT quantile_cont(wick, 0.99) FROM w)", date=True)
def low_wick_markers(spark, sf_dir):
    return rounded(features.low_wick_markers(fixtures.daily(spark, sf_dir)).select("symbol", "date", "wick"), 4)


@query(f"WITH {SQL_TICKS}, f AS (SELECT symbol, price, {' + '.join(f'lag(price, {k}) OVER w * ({x!r})::DOUBLE' for k, x in enumerate(_WEIGHTS))} AS fd FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)) SELECT symbol, round(corr(price, fd), 6) AS corr FROM f WHERE fd IS NOT NULL GROUP BY symbol")
def fracdiff_correlation(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir)
    d = t.withColumn("fd", features.fracdiff(t, ["symbol"], ["ts", "seq"], "price", 0.4, 6)).where("fd is not null")
    return rounded(d.groupBy("symbol").agg(F.corr("price", "fd").alias("corr")))


_ORDERS, _FD = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], 5


def _sql_adf() -> str:
    """One lag: the normal equations of two regressors solved by hand."""
    term = lambda d, back: " + ".join(f"lag(price, {k + back}) OVER w * ({x!r})::DOUBLE" for k, x in enumerate(scalars.fracdiff_weights(d, _FD)))
    each = " UNION ALL ".join(f"SELECT symbol, {d}::DOUBLE AS d, {', '.join(f'{term(d, k)} AS f{k}' for k in range(3))} FROM fl WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)" for d in _ORDERS)
    c = [f"({b})::DOUBLE / pow(n, {k})" for k, b in enumerate(stationarity.CRITICAL_5)]
    return f"""{SQL_TICKS}, {SQL_SIDED}, fl AS (SELECT symbol, ts, seq, sum(side * price) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS price FROM sided), af AS ({each}), ax AS (SELECT symbol, d, f0 - f1 AS y, f1 AS u, f1 - f2 AS w FROM af WHERE f2 IS NOT NULL),
an AS (SELECT symbol, d, count(*) AS n, covar_pop(u, u) AS uu, covar_pop(w, w) AS ww, covar_pop(u, w) AS uw, covar_pop(u, y) AS uy, covar_pop(w, y) AS wy, covar_pop(y, y) AS yy FROM ax GROUP BY symbol, d),
ab AS (SELECT *, uu * ww - uw * uw AS det, (uy * ww - wy * uw) / (uu * ww - uw * uw) AS b, (wy * uu - uy * uw) / (uu * ww - uw * uw) AS c FROM an),
az AS (SELECT symbol, d, n, b / sqrt((yy - b * uy - c * wy) * n / (n - 3) * ww / (n * det)) AS adf, {' + '.join(c)} AS critical FROM ab)"""


def _flow(spark, sf_dir) -> DataFrame:
    """The signed prices of a symbol's ticks so far: a walk, unlike the prices themselves."""
    w = W.partitionBy("symbol").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    return sided(spark, sf_dir).select("symbol", "ts", "seq", F.sum(F.col("side") * F.col("price")).over(w).alias("flow"))


@query(f"WITH {_sql_adf()} SELECT symbol, d, n, round(adf, 5) AS adf, round(critical, 5) AS critical, adf < critical AS stationary FROM az")
def adf_orders(spark, sf_dir):
    return rounded(stationarity.dickey_fuller(_flow(spark, sf_dir), ["symbol"], ["ts", "seq"], "flow", _ORDERS, _FD), 5)


@query(f"WITH {_sql_adf()} SELECT symbol, min(CASE WHEN adf < critical THEN d END) AS d FROM az GROUP BY symbol")
def stationary_order(spark, sf_dir):
    return stationarity.least_order(stationarity.dickey_fuller(_flow(spark, sf_dir), ["symbol"], ["ts", "seq"], "flow", _ORDERS, _FD), ["symbol"])


@query(f"WITH l AS ({_sql_barrier()}) SELECT CAST(label_start_at AS DATE) AS date, {', '.join(f'''round(avg(CASE WHEN label_outcome = '{v}' THEN 1.0::DOUBLE ELSE 0 END), 6) AS {v}''' for v in ('profit', 'neutral', 'unknown'))} FROM l GROUP BY 1", date=True)
def label_fractions(spark, sf_dir):
    t = label_ticks(spark, sf_dir)
    out = labels.triple_barrier(day_bars(spark, sf_dir).select("symbol", "bar_id", "close_at"), t, ["symbol"], RISK, HORIZON, 5 * DAY, REWARDS)
    return rounded(features.fractions(out.withColumn("date", F.to_date("label_start_at")), ["date"], "label_outcome", ["profit", "neutral", "unknown"]))


@query("SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(event_id AS VARCHAR) AS trade_id, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume, epoch_us(ts) + 23000 - epoch_us(ts) // 1000 * 1000 AS latency_us FROM events WHERE event_type <> 'click'")
def ws_log_parse(spark, sf_dir):
    """Events as captured lines; clicks are messages of another kind."""
    t, us = table(spark, sf_dir, "events"), F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.when(F.col("event_type") == "click", "Q").otherwise("T")
    line = F.format_string('%d000||[{"ev":"%s","sym":"%d","x":4,"i":"%d","p":%s,"s":%d,"c":[14],"t":%d}]', us + 23_000, kind, F.col("user_id"), F.col("event_id"), F.col("value").cast("string"), F.get_json_object("props", "$.k").cast("long"), F.call_function("div", us, F.lit(1000)))
    return market_data.parse_log(t.select(line.alias("value"))).select("symbol", "trade_id", "price", "volume", "latency_us")


@query("SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-04-01', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6 AND CAST(d AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19', DATE '2024-03-29')", date=True)
def trading_calendar(spark, sf_dir):
    off = spark.createDataFrame([("2024-01-01",), ("2024-01-15",), ("2024-02-19",), ("2024-03-29",)], "date string")
    return market_data.open_dates(spark, "2024-01-01", "2024-03-31", off)


@query(f"WITH {SQL_TICKS} SELECT symbol, date_trunc('day', ts) AS start, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2")
def day_candles(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream_folds.candles(t, "1 day")
    return out.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "volume")


@query(f"WITH {SQL_TICKS}, {SQL_DAYBARS}, {SQL_CLOCKS}, t AS (SELECT *, CAST(ts AS DATE) AS date FROM ticks), i AS (SELECT c.symbol AS clock_symbol, c.date, t.symbol, t.ts, t.seq, t.price, t.volume FROM large c JOIN t ON c.date = t.date AND t.ts > c.open_at AND t.ts <= c.close_at AND t.symbol <> c.symbol) SELECT clock_symbol, date, symbol, CAST(sum(volume) * count(*) AS DOUBLE) AS dollar_value, round(first(price ORDER BY ts, seq) - last(price ORDER BY ts, seq), 6) AS price_return FROM i GROUP BY clock_symbol, date, symbol", date=True)
def sync_bars_legacy(spark, sf_dir):
    t = fixtures.ticks(spark, sf_dir).withColumn("date", F.to_date("ts"))
    clock = clocks(spark, sf_dir)
    return bars.synchronised(clock, t, "date", DAY // 8, legacy=True, quantiles=False).select("clock_symbol", "date", "symbol", "dollar_value", r_fast("price_return").alias("price_return"))


@query(f"WITH {SQL_SEGMENTS.replace('x > m', 'd > m')} SELECT symbol, segment FROM sg WHERE segment IS NOT NULL")
def segment_symbols_legacy(spark, sf_dir):
    return universe.segments(market(spark, sf_dir), legacy=True).select("symbol", "segment")


# --- vendors' answers -------------------------------------------------------------------------------------------------------------------


def _raw_ticks(spark, sf_dir) -> DataFrame:
    """Events as a vendor's trades: fields of one letter, epochs in nanoseconds."""
    t = fixtures.ticks(spark, sf_dir)
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000 + 7
    return t.select(F.col("symbol"), ns("ts").alias("t"), ns("exchange_ts").alias("y"), F.col("seq").alias("q"), F.col("seq").cast("string").alias("i"), F.lit(4).alias("x"), F.col("price").alias("p"), F.col("volume").alias("s"), F.col("conditions").alias("c"), F.lit(3).alias("z"))


_NS = "CAST(epoch_us({0}) * 1000 + 7 AS BIGINT)"


@query(f"WITH {SQL_TICKS} SELECT symbol, seq AS sequence, CAST(seq AS VARCHAR) AS trade_id, 4 AS exchange_id, round(CAST(CAST(price AS FLOAT) AS DOUBLE), 4) AS price, volume AS size, cond AS condition, {_NS.format('ts')} AS sip_ns, ts AS sip_dt, exchange_ts AS exchange_dt FROM ticks")
def trades_normalise(spark, sf_dir):
    out = market_data.normalised_ticks(_raw_ticks(spark, sf_dir), "trades")
    return out.select("symbol", "sequence", "trade_id", "exchange_id", r(F.col("price").cast("double"), 4).alias("price"), "size", F.col("conditions")[0].alias("condition"), "sip_ns", "sip_dt", "exchange_dt")


@query(f"WITH {SQL_TICKS} SELECT symbol, seq AS sequence, round(CAST(CAST(price AS FLOAT) AS DOUBLE), 4) AS bid_price, round(CAST(CAST(price + 1 AS FLOAT) AS DOUBLE), 4) AS ask_price, volume AS bid_size, volume * 2 AS ask_size, 4 AS bid_exchange_id, 5 AS ask_exchange_id, ts AS sip_dt, exchange_ts AS exchange_dt FROM ticks")
def quotes_normalise(spark, sf_dir):
    raw = _raw_ticks(spark, sf_dir)
    two = raw.select("symbol", "t", "y", "q", "x", F.lit(5), "p", F.col("p") + 1, "s", F.col("s") * 2).toDF("symbol", "t", "y", "q", "x", "X", "p", "P", "s", "S")
    out = market_data.normalised_ticks(two, "quotes")
    price = lambda c: r(F.col(c).cast("double"), 4).alias(c)
    return out.select("symbol", "sequence", price("bid_price"), price("ask_price"), "bid_size", "ask_size", "bid_exchange_id", "ask_exchange_id", "sip_dt", "exchange_dt")


@query(f"WITH {SQL_DAILY} SELECT symbol, CAST(date_trunc('quarter', date) AS DATE) AS date, first(open ORDER BY date) AS open, last(close ORDER BY date) AS close, max(high) AS high, min(low) AS low, CAST(sum(volume) AS BIGINT) AS volume, round(sum(vwap * volume) / sum(volume), 6) AS vwap FROM daily GROUP BY 1, 2", date=True)
def daily_resampled(spark, sf_dir):
    return market_data.resampled(fixtures.daily(spark, sf_dir), "quarter").withColumn("vwap", r("vwap", 6))
