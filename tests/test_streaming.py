import pytest
from pyspark.sql import functions as F

from helpers import DATA
from tidebar.operators import bars, folds, ticks
from tidebar.operators.folds import Thresholds
from tidebar.sources import fixtures
from tidebar.streaming.folds import candles, tick_stream

TH = Thresholds(renko_size=20.0, reversal=2.0, min_tick_count=2, least_ticks=2)
MAD = (2, 3, 2000)


@pytest.mark.parametrize("files", [1, 5])
def test_stream_is_the_batch_fold(spark, tmp_path, files):
    t = fixtures.ticks(spark, DATA)
    src = f"{tmp_path}/in"
    t.repartitionByRange(files, "ts").write.parquet(src)
    # files are read in the order of their times, one a micro-batch
    import os
    import time

    for k, name in enumerate(sorted(x for x in os.listdir(src) if x.endswith(".parquet"))):
        os.utime(f"{src}/{name}", (time.time() - 1000 + k, time.time() - 1000 + k))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = tick_stream(stream, TH, MAD, (7, 2)).writeStream.format("memory").queryName(f"out{files}").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r.symbol, r.seq): r for r in spark.table(f"out{files}").collect()}
    dated = ticks.with_session(t).withColumn("date", F.to_date("local_ts")).drop("local_ts", "session")
    known = ticks.status_running(dated, ["symbol", "date"], *MAD)
    good = ticks.with_side(ticks.clean(known), ["symbol", "date"])

    def average():
        f = folds.JMA(7, 2)
        return lambda v: (f(v),)

    good = folds.fold(good, ["symbol", "date"], ["ts", "seq"], ["price"], average, {"price_jma": "double"})
    cut = bars.bar_ids(good, ["symbol", "date"], TH).collect()
    assert len(got) == t.count()
    assert all(got[r.symbol, r.seq].status == r.status for r in known.select("symbol", "seq", "status").collect())
    assert {r.status.split(": ")[0] for r in got.values()} == {"clean", "filtered"}
    for r in cut:
        g = got[r.symbol, r.seq]
        assert (g.side, g.bar_id, g.bar_trigger) == (r.side, r.bar_id, r.bar_trigger) and g.price_jma == pytest.approx(r.price_jma)


def test_candles(spark, tmp_path):
    t = fixtures.ticks(spark, DATA)
    t.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    q = candles(stream, "1 day").writeStream.outputMode("update").format("memory").queryName("candles").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert spark.table("candles").agg(F.sum("volume")).first()[0] == t.agg(F.sum("volume")).first()[0]
