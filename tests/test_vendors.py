"""Vendors' interfaces with recorded answers, listings, CSV globs and the synthetic walk."""

import json

import pytest
from pyspark.sql import functions as F

from tidebar.operators import universe
from tidebar.sources import market_data, tables


def test_grouped_daily_details_and_lists(spark):
    def day(date):
        return [{"T": s, "v": 10.0, "o": 1.0, "c": 2.0, "h": 3.0, "l": 1.0, "vw": 2.0, "t": 1546405200000} for s in ("A", "B\x00", "Ü")] if date == "2019-01-02" else []

    dates = spark.createDataFrame([("2019-01-02",), ("2019-01-05",)], "for_date string")
    raw = market_data.fetched(dates, day, "T string, v double, o double, c double, h double, l double, vw double, t bigint")
    out = universe.normalised(market_data.normalised_daily(raw)).orderBy("symbol").collect()
    assert [(r.symbol, str(r.date), r.volume, r.dollar_total) for r in out] == [("A", "2019-01-02", 10, 20.0), ("B", "2019-01-02", 10, 20.0)]
    symbols = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    details = market_data.fetched(symbols, lambda s: {"name": f"{s} Inc", "sic": 1} if s != "B" else None, "name string, sic int, cik string")
    assert sorted(map(tuple, details.collect())) == [("A", "A Inc", 1, None), ("C", "C Inc", 1, None)]


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 1234])
def test_pages_until_a_short_one(spark, n):
    rows = [{"ticker": f"T{k}"} for k in range(n)]
    got = market_data.pages_until_short(spark, lambda page: rows[(page - 1) * 50 : page * 50], 50, "ticker string", tasks=3)
    assert sorted(r.ticker for r in got.collect()) == sorted(r["ticker"] for r in rows)
    assert market_data.pages_until_short(spark, lambda page: rows[(page - 1) * 50 : page * 50], 50, "ticker string", last=2).count() == min(n, 100)


def test_vendor_table(spark):
    text = json.dumps({"Series": {"2020-01-01": {"1. open": "1.5", "4. close": "x"}, "2020-01-02": {"1. open": "2"}}})
    answers = spark.createDataFrame([("BTC", text), ("ETH", "{}"), ("BAD", None)], "symbol string, answer string")
    out = market_data.vendor_table(answers, "answer", "Series", {"open": ("1. open", "double"), "close": ("4. close", "double")}, "date")
    assert sorted(map(tuple, out.collect())) == [("BTC", "2020-01-01", 1.5, None), ("BTC", "2020-01-02", 2.0, None)]


def test_dispatch_by_kind(spark):
    keys = spark.createDataFrame([("A", "2019-01-02"), ("B", "2019-01-02")], "symbol string, date string")
    tick = lambda s, d: [{"t": 1546405200000000123, "y": 1546405200000000000, "p": 1.5, "s": 2, "q": 1}]
    got = market_data.dated(keys, "trades", lambda d: [], tick, "t bigint, y bigint, p double, s bigint, q bigint").collect()
    assert {(r.symbol, r.price, r["size"], r.sip_ns) for r in got} == {("A", 1.5, 2, 1546405200000000123), ("B", 1.5, 2, 1546405200000000123)}
    daily = market_data.dated(keys, "daily", lambda d: [{"T": "A", "v": 5.0, "t": 1546405200000}], tick, "T string, v double, t bigint")
    assert [(r.symbol, r.volume, str(r.date)) for r in daily.collect()] == [("A", 5, "2019-01-02")]
    with pytest.raises(ValueError):
        market_data.normalised_ticks(spark.createDataFrame([(1, 1)], "t bigint, y bigint"), "news")


def test_listing_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([("A", "2020-01-01", 1), ("B/C", "2020-01-02", 2)], "symbol string, date string, x int")
    tables.write(rows, f"{tmp_path}/a", f"{tmp_path}/b")
    assert sorted(map(tuple, tables.keys(spark, f"{tmp_path}/b").collect())) == [("A", "2020-01-01"), ("B/C", "2020-01-02")]
    assert [r.symbol for r in tables.keys(spark, f"{tmp_path}/a", "symbol").orderBy("symbol").collect()] == ["A", "B/C"]
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text(f"a,b\n{k},x{k}\n")
    out = tables.read_matching(spark, f"{tmp_path}/part*.csv")
    assert sorted(map(tuple, out.collect())) == [(0, "x0"), (1, "x1"), (2, "x2")]


def test_walk_is_the_same_in_any_stretches(spark):
    a = market_data.random_walk(spark, 500, 0.05, stretch=64).orderBy("id").collect()
    assert a == market_data.random_walk(spark, 500, 0.05, stretch=1 << 20).orderBy("id").collect()
    plain = [r.value for r in a if not r.is_outlier]
    assert len(a) == 500 and all(v == int(v) for v in plain) and any(r.is_outlier for r in a)


def test_nul_and_foreign_symbols(spark):
    d = spark.createDataFrame([("A\x00B", 1.0, 1.0, 1.0, 1.0, 1.0, 1), ("É", 1.0, 1.0, 1.0, 1.0, 1.0, 1)], "symbol string, open double, close double, high double, low double, vwap double, volume bigint")
    assert [r.symbol for r in universe.normalised(d).collect()] == ["AB"]
