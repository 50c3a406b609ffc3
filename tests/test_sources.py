import pyarrow as pa
import pytest
from pyarrow import feather
from pyspark.sql import functions as F

from helpers import DATA
from tidebar.plans import runs
from tidebar.sources import fixtures, market_data, tables


def test_partitioned_tables(spark, tmp_path):
    df = spark.createDataFrame([("A", "2024-01-01", 1.0), ("A", "2024-01-02", 2.0), ("B", "2024-01-01", 3.0)], "symbol string, date string, price double")
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    tables.write(df, a, b)
    tables.write(df.where("symbol = 'A'"), a)  # the same again
    assert tables.read(spark, a).count() == 3 and tables.read(spark, b).count() == 3
    assert tables.read(spark, a, ["price"], ["A"], "2024-01-02", "2024-01-09").collect()[0].price == 2.0
    assert "PartitionFilters: [isnotnull" in tables.read(spark, a, None, ["A"])._jdf.queryExecution().toString()
    assert sorted(r.symbol for r in tables.keys(spark, a, "symbol").collect()) == ["A", "B"]
    assert tables.sizes(spark, a).where("bytes > 0 and size like '% Bytes' or size like '% KB'").count() == 3
    assert tables.remove(spark, a, "A", "2024-01-01") and not tables.remove(spark, a, "Z")
    assert tables.read(spark, a).count() == 2
    with pytest.raises(ValueError):
        tables.remove(spark, a, "../b")
    assert tables.read_first(spark, [f"{tmp_path}/none", b]).count() == 3
    assert tables.read_first(spark, [f"{tmp_path}/new"], lambda: df).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_first(spark, [f"{tmp_path}/nowhere"])


def test_feather(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"date={k}").mkdir()
        feather.write_feather(pa.table({"price": [1.0 * k, 2.0], "extra": ["x", "y"]}), f"{tmp_path}/date={k}/data.feather")
    got = tables.read_feather(spark, str(tmp_path), "price double, volume long").collect()
    assert sorted(r.price for r in got) == [0.0, 1.0, 2.0, 2.0, 2.0, 2.0] and all(r.volume is None for r in got)


def test_problems(spark):
    df = spark.createDataFrame([("A", 1.0, None), ("A", 2.0, None), ("B", 1.0, 3)], "symbol string, price double, volume long")
    assert [tuple(r) for r in tables.problems(df, ["symbol"], ["price", "volume"]).collect()] == [("A", "no volume")]


def test_captured_log(spark):
    lines = ['1700000000123000000||[{"ev":"T","sym":"X","x":4,"i":"9","p":10.5,"s":100,"c":[14],"t":1700000000100},{"ev":"Q","sym":"X","t":1}]', '1700000000123000000||[{"ev":"T","sym":"Y","p":1.0,"t":1700000000123}]', "broken", "1||nonsense", None]
    rows = market_data.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("symbol").collect()
    assert [(r.symbol, r.price, r.volume, r.latency_us, r.conditions) for r in rows] == [("X", 10.5, 100, 23000, [14]), ("Y", 1.0, 0, 0, None)]


def test_pages_and_cursor(spark):
    df = market_data.paged(spark, "pages_for_test", "n int, name string", lambda k: [(k * 2, "a"), (k * 2 + 1, "b")], 4)
    assert sorted(r.n for r in df.collect()) == list(range(8))
    day = [{"sip_ns": t, "p": float(k)} for k, t in enumerate([1, 2, 2, 3, 5, 8, 8, 9])]
    fetch = lambda start, n: [r for r in day if r["sip_ns"] >= start][:n]
    assert list(market_data.cursor_rows(fetch, 0, 3)) == day
    keys = spark.createDataFrame([("X", "2024-01-01"), ("Y", "2024-01-02")], "symbol string, date string")
    assert market_data.day_ticks(spark, keys, lambda s, d, start, n: fetch(start, n), 4, "sip_ns long, p double").count() == 16


def test_maps_answers_calendar_and_walk(spark):
    a = spark.createDataFrame([("BTC", '{"series": {"2024-01-01": {"open": "1", "close": "2"}, "2024-01-02": {"open": "3"}}}')], "symbol string, answer string")
    rows = market_data.map_of_maps(a, "answer", "series", "date").orderBy("date").collect()
    assert [(r.symbol, r.date, r.fields.get("close")) for r in rows] == [("BTC", "2024-01-01", "2"), ("BTC", "2024-01-02", None)]
    assert market_data.checked({"results": [1]}) == [1]
    with pytest.raises(ValueError):
        market_data.checked({"status": "ERROR", "results": []})
    off = spark.createDataFrame([("2024-01-01",)], "date string")
    assert market_data.open_dates(spark, "2023-12-29", "2024-01-08", off).count() == 6
    w = market_data.random_walk(spark, 500, 0.05)
    assert w.exceptAll(market_data.random_walk(spark, 500, 0.05)).count() == 0
    assert 5 < w.where("is_outlier").count() < 60


def test_tables_of_several_places(spark, tmp_path):
    a = spark.createDataFrame([("A", "2024-01-01", 1.0), ("B", "2024-01-02", 2.0)], "symbol string, date string, price double")
    b = spark.createDataFrame([("A", "2024-01-03", 3.0, 5)], "symbol string, date string, price double, volume int")
    tables.write(a, f"{tmp_path}/a")
    tables.write(b, f"{tmp_path}/b")
    both = tables.read_many(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], "place", symbols=["A"], end="2024-01-31")
    assert sorted((r.price, r.volume, r.place[-1]) for r in both.collect()) == [(1.0, None, "a"), (3.0, 5, "b")]
    with pytest.raises(ValueError):
        tables.read_many(spark, [])


def test_feather_decodes_only_what_is_asked_for(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.feather

    t = pa.table({"price": [1.0, 2.0, 3.0], "text": ["x", "y", "z"], "volume": [1, 2, 3]})
    pyarrow.feather.write_feather(t, f"{tmp_path}/t.feather", chunksize=2)
    got = tables.read_feather(spark, str(tmp_path), "volume long, price double, other string").orderBy("price").collect()
    assert [(r.volume, r.price, r.other) for r in got] == [(1, 1.0, None), (2, 2.0, None), (3, 3.0, None)]
    assert tables.read_feather(spark, str(tmp_path), "other string").count() == 3


def test_run_is_incremental(spark, tmp_path):
    t = fixtures.ticks(spark, DATA).where("symbol < 4").withColumn("symbol", F.col("symbol").cast("string"))
    c = runs.Config(config_id="test", mad=(3, 5, 1e6), thresholds=runs.Thresholds(renko_size=1.0, reversal=2, least_ticks=1), risk=1.0)
    first = runs.run(spark, t, c, str(tmp_path))
    n = first.count()
    todo = runs.remaining(t.withColumn("date", F.to_date("ts").cast("string")), t.withColumn("date", F.to_date("ts").cast("string")), f"{tmp_path}/bars/test")
    assert runs.run(spark, t, c, str(tmp_path)).count() == n and todo.count() >= 0
    assert spark.read.parquet(f"{tmp_path}/settings/test").count() == 1


def test_prepared_universe(spark):
    d, info = fixtures.daily(spark, DATA), fixtures.details(spark, DATA)
    out = runs.prepared(d, info, 1, cut=0.0, low=0.0, high=1e9, price=0.0)
    assert out["daily"].count() > 0
    assert out["residuals"].columns[-1] == "residual"
    values = out["returns"].select("symbol", "date", "log_return")
    if values.count():
        assert runs.denoised_distances(values, "log_return").where("distance < 0 or distance > 1").count() == 0
