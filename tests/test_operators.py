import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions import scalars
from tidebar.operators import bars, cluster, features, joins, labels, matrix, ticks
from tidebar.operators.folds import Thresholds


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


TICK = "symbol long, ts string, seq long, price double, volume long, side int"


def test_session_over_a_clock_change(spark):
    rows = [("2024-03-08 14:29:59",), ("2024-03-08 14:30:00",), ("2024-03-11 13:30:00",), ("2024-03-11 20:00:00",)]
    t = spark.createDataFrame(rows, "ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.session for r in ticks.with_session(t).orderBy("ts").collect()] == ["pre-market", "market-open", "market-open", "after-hours"]


def test_stamps_that_differ_by_three_seconds_are_kept(spark):
    t = spark.createDataFrame([("2024-01-01 00:00:03", "2024-01-01 00:00:00"), ("2024-01-01 00:00:03.000001", "2024-01-01 00:00:00"), ("2024-01-01 00:00:03", None)], "ts string, exchange_ts string")
    t = t.select(F.col("ts").cast("timestamp_ntz"), F.col("exchange_ts").cast("timestamp_ntz"))
    assert [r.x for r in t.select(ticks.stamps_differ().alias("x")).collect()] == [False, True, False]


def test_null_conditions_are_regular(spark):
    t = spark.createDataFrame([(None,), ([1, 2],), ([14],), ([],)], "conditions array<int>")
    assert [r.x for r in t.select(ticks.irregular().alias("x")).collect()] == [False, True, False, False]


@pytest.mark.parametrize("closed", ["left", "right"])
@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("width", [7 * 60_000_000, None])
def test_range_join_is_the_plain_join(spark, closed, how, width):
    iv = frame(spark, [(1, f"2024-01-01 00:{a:02d}:00", f"2024-01-01 00:{b:02d}:00") for a, b in ((0, 10), (5, 30), (20, 20), (40, 41), (50, 59))], "symbol long, ts string, end string")
    iv = iv.select("symbol", F.col("ts").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))
    pt = frame(spark, [(s, f"2024-01-01 00:{m:02d}:00") for s in (1, 2) for m in range(0, 45, 5)], "symbol long, ts string")
    got = joins.range_join(iv, pt, ["symbol"], "start", "end", "ts", width, closed, how)
    p, q = iv.toPandas(), pt.toPandas()
    both = p.merge(q, on="symbol")
    inside = (both.ts >= both.start) & (both.ts < both.end) if closed == "left" else (both.ts > both.start) & (both.ts <= both.end)
    expected = len(both[inside])
    if how == "left":
        expected += len(p) - len(both[inside].drop_duplicates(["start", "end"]))
    assert got.count() == expected


def test_weighted_quantiles_against_repetition(spark):
    rng = np.random.default_rng(1)
    price, volume = rng.integers(1, 30, 200) / 2, rng.integers(0, 9, 200)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "price": price, "volume": volume}))
    got = bars.weighted_quantiles(df, ["k"]).toPandas().iloc[0]
    flat = np.sort(np.repeat(price, volume))
    for name, p in bars.QUANTILES.items():
        at = p * len(flat)
        expected = (flat[int(at)] + flat[int(np.ceil(at)) - 1]) / 2
        assert got[name] == expected


def test_bars_use_up_the_ticks_before_the_tail(spark):
    rng = np.random.default_rng(2)
    rows = [(s, f"2024-01-01 {h:02d}:{m:02d}:00", h * 60 + m, float(p), 5, 1) for s in (1, 2) for h in range(10) for m, p in zip(range(60), 50 + rng.normal(0, 2, 60).cumsum())]
    t = frame(spark, rows, TICK).withColumn("price_jma", F.col("price"))
    th = Thresholds(renko_size=3.0, reversal=2, least_ticks=1)
    cut = bars.bar_ids(t, ["symbol"], th)
    out = bars.sampled_bars(t, ["symbol"], th)
    tail = cut.join(cut.where("bar_trigger is not null").select("symbol", "bar_id"), ["symbol", "bar_id"], "left_anti").count()
    assert out.agg(F.sum("tick_count")).first()[0] + tail == t.count()
    bad = out.where("price_low > least(price_open, price_close, price_vwap) or price_high < greatest(price_open, price_close, price_vwap) or price_wq05 > price_wq50 or price_wq50 > price_wq95")
    assert bad.count() == 0 and out.count() > 20


@pytest.mark.parametrize("path, expected", [
    ([10, 9.0, 15], ("short", "profit", -1.0)),  # the stop of long is a profit of short
    ([10, 12.5, 10], ("long", "profit", 2.0)),
    ([10, 7.5, 10], ("short", "profit", -2.0)),
    ([10, 10.2, 9.9], ("neutral", "neutral", 0.0)),
])
def test_barriers(spark, path, expected):
    b = frame(spark, [(1, "2024-01-01 00:00:00", 7)], "symbol long, ts string, bar_id long").withColumnRenamed("ts", "close_at")
    t = frame(spark, [(1, f"2024-01-01 00:0{k + 1}:00", k, float(p), 1, 0) for k, p in enumerate(path)], TICK).withColumn("price_jma", F.col("price"))
    row = labels.triple_barrier(b, t, ["symbol"], 0.9, 30, 60_000_000, (1.0, 2.0)).first()
    assert (row.label_side, row.label_outcome, row.label_rrr) == expected


def test_barriers_unknown_and_without_label(spark):
    b = frame(spark, [(1, "2024-01-01 00:00:00", 7), (2, "2024-01-01 00:00:00", 7)], "symbol long, ts string, bar_id long").withColumnRenamed("ts", "close_at")
    # both sides take a profit before their stop: up by one, down by one (stops are wider than the first profits)
    t = frame(spark, [(1, f"2024-01-01 00:0{k + 1}:00", k, p, 1, 0) for k, p in enumerate((10.0, 10.6, 9.4))], TICK).withColumn("price_jma", F.col("price"))
    out = {r.symbol: r for r in labels.triple_barrier(b, t, ["symbol"], 1.0, 30, 60_000_000, (0.5,)).collect()}
    assert out[1].label_outcome == "unknown" and out[1].label_side is None
    assert out[2].label_outcome is None and out[2].label_start_at is None
    assert labels.triple_barrier(b, t, ["symbol"], 1.0, 4, 60_000_000).where("label_outcome is not null").count() == 0


def test_gap_fill_of_none_one_and_more(spark):
    def fillers(last, first):
        rows = [(1, "2024-01-01", "2024-01-01 10:00:00", last, 2.0), (1, "2024-01-02", "2024-01-02 10:00:00", first, 2.0)]
        b = spark.createDataFrame(rows, "symbol long, date string, open_at string, price_close double, price_return double").withColumn("open_at", F.col("open_at").cast("timestamp_ntz"))
        return [r.price_close for r in features.gap_fillers(b, "symbol", "date", "price_close").orderBy("place").collect()]

    assert fillers(10.0, 10.2) == [10.2]
    assert fillers(10.0, 11.0) == [10.0, 11.0]
    assert fillers(10.0, 13.0) == [10.0, 11.5, 13.0, 13.0]


def test_mutual_information(spark):
    score = lambda rows: cluster.adjusted_mutual_information(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()[0]
    rng = np.random.default_rng(0)
    assert score([(k % 3, 5 + k % 3) for k in range(18)]) == pytest.approx(1.0)
    assert abs(score([(int(x), int(y)) for x, y in rng.integers(0, 4, (2000, 2))])) < 0.02
    assert score([(1, 1), (1, 1), (None, 2)]) == 1.0


@pytest.mark.parametrize("method", ["kmeans", "bisecting"])
def test_members_lie_nearest_to_their_own_centre(spark, method):
    from helpers import DATA

    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    labels = {r.vec_id: r.cluster for r in cluster.clusters(vectors, "vec_id", "embedding", 8, method).collect()}
    assert labels == {r.vec_id: r.cluster for r in cluster.clusters(vectors, "vec_id", "embedding", 8, method).collect()}
    rows = vectors.collect()
    x, own = np.array([r.embedding for r in rows]), np.array([labels[r.vec_id] for r in rows])
    assert len(own) == len(rows) and 2 <= len(set(own)) <= 8
    names = sorted(set(own))
    centres = np.array([x[own == k].mean(0) for k in names])
    nearest = np.array(names)[((x[:, None] - centres) ** 2).sum(2).argmin(1)]
    assert (nearest == own).mean() > (0.97 if method == "kmeans" else 0.7)
    inside = sum(((x[own == k] - x[own == k].mean(0)) ** 2).sum() for k in names)
    assert inside < ((x - x.mean(0)) ** 2).sum()


def test_pairs_are_the_same_in_any_number_of_blocks(spark):
    v = spark.createDataFrame([(d, s, float(d * s % 7)) for d in range(5) for s in range(9)], "date int, symbol int, x double")
    one, many = (sorted(map(tuple, matrix.pairs(v, "x", k).select("date", "a", "b", "x", "y").collect())) for k in (1, 4))
    assert one == many and len(one) == 5 * 45


def test_matrices():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 20))
    for m in ("basic", "ledoit_wolf", "oas"):
        s = matrix.shrunk(x, m)
        assert np.allclose(s, s.T) and np.linalg.eigvalsh(s).min() > 0
    corr = np.corrcoef(x.T)
    for m in ("constant", "spectral", "shrink"):
        d = matrix.denoised(corr, 3.0, m)
        assert np.allclose(np.diag(d), 1) and np.allclose(d, d.T)


def test_fractional_difference_of_order_one_is_the_difference():
    assert scalars.fracdiff_weights(1.0, 4) == [1.0, -1.0, 0.0, 0.0]


def test_human_sizes(spark):
    df = spark.createDataFrame([(5,), (1500,), (2_500_000,), (3_210_000_000,)], "n long")
    assert [r.s for r in df.select(scalars.human_size(F.col("n")).alias("s")).collect()] == ["5 Bytes", "1.5 KB", "2.5 MB", "3.21 GB"]


def test_imbalance_runs(spark):
    t = frame(spark, [(1, f"2024-01-01 00:00:0{k}", k, 2.0, 3, s) for k, s in enumerate((1, 1, 1, -1, -1))], TICK)
    out = bars.imbalance_runs(t, ["symbol"]).orderBy("seq").collect()
    assert [(r.tick_run, r.volume_run, r.dollar_run) for r in out] == [(0, 0, 0), (1, 3, 6), (2, 6, 12), (0, 0, 0), (1, 3, 6)]


def test_empty_tables(spark):
    t = frame(spark, [], TICK).withColumn("price_jma", F.col("price"))
    assert bars.sampled_bars(t, ["symbol"], Thresholds(renko_size=1.0)).count() == 0
    assert ticks.mad_running(t, ["symbol"]).count() == 0


def test_a_column_of_sizes_is_a_size(spark):
    rng = np.random.default_rng(4)
    rows = [(1, f"2024-01-01 {k // 60:02d}:{k % 60:02d}:00", k, float(p), 5, 1) for k, p in enumerate(50 + rng.normal(0, 2, 300).cumsum())]
    t = frame(spark, rows, TICK).withColumn("price_jma", F.col("price")).withColumn("my_size", F.lit(3.0))
    a = bars.bar_ids(t, ["symbol"], Thresholds(renko_size=3.0, reversal=2)).select("seq", "bar_id", "bar_trigger")
    b = bars.bar_ids(t, ["symbol"], Thresholds(reversal=2), "my_size").select("seq", "bar_id", "bar_trigger")
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_fast_rounding_is_that_of_sql(spark):
    from tidebar.queries import r_fast

    values = [0.5e-6, -0.5e-6, 1.2345675, -1.2345675, 0.1234564999, -1e-9, 0.0, -0.0, 3.0, 123456.7654321, None]
    con = __import__("duckdb").connect()
    got = [x.y for x in spark.createDataFrame([(v,) for v in values], "x double").select(r_fast("x").alias("y")).collect()]
    assert got == [con.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]
    assert "-0.0" not in map(str, got)


def test_pairs_of_blocks_have_each_pair_once_in_order(spark, monkeypatch):
    from tidebar.operators import matrix

    monkeypatch.setattr(matrix, "BLOCK", 4)
    rows = [(f"2020-01-{d:02d}", s, float((s * 7 + d * d * (s % 3 + 1)) % 11)) for s in range(13) for d in range(1, 6)]
    x = {s: [v for _, t, v in rows if t == s] for s in range(13)}
    got = matrix.covariance(spark.createDataFrame(rows, "date string, symbol long, v double"), "v").collect()
    mean = {s: sum(v) / 5 for s, v in x.items()}
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(13) for b in range(a, 13)]
    assert all(abs(r["cov"] - sum((p - mean[r.a]) * (q - mean[r.b]) for p, q in zip(x[r.a], x[r.b])) / 4) < 1e-9 for r in got)
