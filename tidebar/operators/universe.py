"""The market universe: daily tables, symbol filters, returns, residuals and segments. Long tables: a row a symbol and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.scalars import squeezed, vwap_repaired
from tidebar.operators.graph import fixed
from tidebar.operators.joins import all_pairs


def normalised(daily: DataFrame) -> DataFrame:
    """daily with midprice, repaired vwap and dollar_total; symbols of ASCII only, without NUL."""
    mid = (F.col("high") + F.col("low") + F.col("open") + F.col("close")) / 4
    rows = daily.where(F.col("symbol").cast("string").rlike(r"^[\x00-\x7F]*$")).withColumn("midprice", mid)
    if dict(daily.dtypes)["symbol"] == "string":
        rows = rows.withColumn("symbol", F.translate("symbol", "\x00", ""))
    rows = rows.withColumn("vwap", vwap_repaired(F.col("vwap"), F.col("low"), F.col("high"), F.col("midprice")))
    return rows.withColumn("dollar_total", F.col("vwap") * F.col("volume"))


def with_range(daily: DataFrame) -> DataFrame:
    span = F.col("high") - F.col("low")
    return daily.withColumns({"range": span, "range_value_pct": span / F.nullif("vwap", F.lit(0.0))})


def _symbols(daily: DataFrame, value: Column, test) -> DataFrame:
    """Rows of the symbols whose aggregate passes. One grouped pass, then a semi join on the symbols that pass."""
    return daily.join(daily.groupBy("symbol").agg(value.alias("_v")).where(test(F.col("_v"))).select("symbol"), "symbol", "left_semi")


def all_dates(daily: DataFrame) -> DataFrame:
    """Symbols with an open on as many rows as any symbol has rows. The counts, a row a symbol, are fixed, as they are read
    twice."""
    counts = fixed(daily.groupBy("symbol").agg(F.count("open").alias("_n"), F.count("*").alias("_rows")))
    most = F.broadcast(counts.agg(F.max("_rows").alias("_most")))  # one row
    return daily.join(counts.join(most, F.col("_n") >= F.col("_most")).select("symbol"), "symbol", "left_semi")


def liquid(daily: DataFrame, cut: float | None = None, quantile: float | None = None) -> DataFrame:
    """Symbols whose mean dollar_total exceeds a cut, or a quantile of all rows."""
    if cut is not None:
        return _symbols(daily, F.avg("dollar_total"), lambda v: v > cut)
    limit = F.broadcast(daily.agg(F.percentile("dollar_total", quantile).alias("_q")))
    means = daily.groupBy("symbol").agg(F.avg("dollar_total").alias("_v"))
    return daily.join(means.join(limit, F.col("_v") > F.col("_q")).select("symbol"), "symbol", "left_semi")


def volatile(daily: DataFrame, low: float, high: float) -> DataFrame:
    return _symbols(daily, F.median("range_value_pct"), lambda v: v.between(low, high))


def above(daily: DataFrame, price: float) -> DataFrame:
    return _symbols(daily, F.median("close"), lambda v: v > price)


def described(daily: DataFrame, details: DataFrame, kind: str = "CS") -> DataFrame:
    """Symbols with a sector, of a type (case ignored)."""
    return daily.join(details.where((F.col("sector") != "") & (F.upper("type") == kind.upper())).select("symbol"), "symbol", "left_semi")


STEPS = ("all", "all_dates", "liquid", "volatile", "above", "described")


def symbol_steps(daily: DataFrame, details: DataFrame, cut: float, low: float, high: float, price: float) -> DataFrame:
    """symbol, rows, and passed: how many of the five filters, one after another, a symbol passes.

    Every filter asks about a symbol's own rows, so one grouped pass serves all of them.
    """
    stats = daily.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.count("open").alias("opens"), F.avg("dollar_total").alias("dollars"),
        F.median("range_value_pct").alias("moves"), F.median("close").alias("close"),
    )
    most = F.broadcast(stats.agg(F.max("rows").alias("most")))  # one row
    known = details.where((F.col("sector") != "") & (F.upper("type") == "CS")).select("symbol", F.lit(True).alias("known")).distinct()
    rows = stats.join(most, F.lit(True)).join(known, "symbol", "left")
    tests = [F.col("opens") >= F.col("most"), F.col("dollars") > cut, F.col("moves").between(low, high), F.col("close") > price, F.col("known")]
    failed = F.array_position(F.array(*(F.coalesce(t, F.lit(False)) for t in tests)), False)  # 0 if none
    return rows.select("symbol", "rows", F.when(failed == 0, len(tests)).otherwise(failed - 1).cast("int").alias("passed"))


def filtered(daily: DataFrame, details: DataFrame, **cuts) -> DataFrame:
    """Rows of the symbols that pass all filters."""
    stay = symbol_steps(daily, details, **cuts).where(F.col("passed") == len(STEPS) - 1).select("symbol")
    return daily.join(stay, "symbol", "left_semi")


def step_counts(symbols: DataFrame) -> DataFrame:
    """Of symbol_steps: the rows and symbols that are left after each filter."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(STEPS) - 1)), lambda k: F.struct(k.alias("step_no"), (F.col("passed") >= k).alias("left")))).alias("s")
    each = symbols.select("rows", at).select("rows", "s.*")
    sums = each.groupBy("step_no").agg(F.coalesce(F.sum(F.when(F.col("left"), F.col("rows"))), F.lit(0)).alias("rows"), F.count_if("left").alias("symbols"))
    return sums.select("step_no", F.element_at(F.array(*map(F.lit, STEPS)), F.col("step_no") + 1).alias("step"), "rows", "symbols")


def symbol_stats(daily: DataFrame, details: DataFrame) -> DataFrame:
    """Medians by symbol with details where there are any."""
    stats = daily.groupBy("symbol").agg(F.median("range_value_pct").alias("range_value_pct_median"), F.median("dollar_total").alias("dollar_total_median"))
    return details.join(stats, "symbol", "right")


def returns(daily: DataFrame, value: str = "close") -> DataFrame:
    """symbol, date, value, diff, log_return, zscore (population) and squeezed; only dates on which every symbol has a
    value and a return. daily is read once: its symbols, dates and values are fixed."""
    w = W.partitionBy("symbol").orderBy("date")
    rows = fixed(daily.where(F.col(value).isNotNull()).select("symbol", "date", F.col(value).alias("value")))
    n = F.broadcast(rows.agg(F.count_distinct("symbol").alias("_all")))
    whole = rows.join(rows.groupBy("date").agg(F.count("*").alias("_n")).join(n, F.col("_n") == F.col("_all")).select("date"), "date", "left_semi")
    moved = whole.withColumns({"diff": F.col("value") - F.lag("value").over(w), "log_return": F.log("value") - F.log(F.lag("value").over(w))}).where("log_return is not null")
    s = W.partitionBy("symbol")
    z = (F.col("log_return") - F.avg("log_return").over(s)) / F.nullif(F.stddev_pop("log_return").over(s), F.lit(0.0))
    return moved.withColumn("zscore", z).withColumn("squeezed", squeezed("zscore"))


def residuals(values: DataFrame, market: DataFrame, value: str) -> DataFrame:
    """values with alpha, beta and residual of each symbol's line on the market's value of the date."""
    x = market.select("date", F.col(value).alias("_x"))
    both = values.join(x, "date")
    line = both.groupBy("symbol").agg(F.regr_intercept(value, "_x").alias("alpha"), F.regr_slope(value, "_x").alias("beta"))
    return both.join(line, "symbol").withColumn("residual", F.col(value) - (F.col("alpha") + F.col("beta") * F.col("_x"))).drop("_x")


def segments(daily: DataFrame, legacy: bool = False) -> DataFrame:
    """symbol and segment: large above the 80th percentile of mean dollar_total; mid between the 20th and 50th with a mean
    range above the median (legacy compares dollar_total with that median, which lets all pass)."""
    means = daily.groupBy("symbol").agg(F.avg("dollar_total").alias("dollar_total"), F.avg("range_value_pct").alias("range_value_pct"))
    cuts = F.broadcast(means.agg(F.percentile("dollar_total", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias("_p"), F.median("range_value_pct").alias("_m")))
    d, p = F.col("dollar_total"), F.col("_p")
    moves = (d if legacy else F.col("range_value_pct")) > F.col("_m")
    segment = F.when(d > p[2], "large").when((d > p[0]) & (d < p[1]) & moves, "mid")
    return means.join(cuts, F.lit(True)).withColumn("segment", segment).where("segment is not null").drop("_p", "_m")


def clock_pairs(segmented: DataFrame) -> DataFrame:
    """Every mid symbol with every large one as its clock."""
    side = lambda segment, name: segmented.where(F.col("segment") == segment).select(F.col("symbol").alias(name))
    return all_pairs(side("mid", "symbol"), side("large", "clock_symbol")).where("symbol <> clock_symbol")


def wide(daily: DataFrame, value: str) -> DataFrame:
    """date and values: a map from symbol to the largest value of the date, in order of symbols. A map holds however many
    symbols there are, where a column for each would need their list in the driver. Null values are left out."""
    each = daily.where(F.col(value).isNotNull()).groupBy("date", "symbol").agg(F.max(value).alias("v"))
    return each.groupBy("date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", "v")))).alias("values"))


def missing_keys(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are wanted and not done."""
    return wanted.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")
