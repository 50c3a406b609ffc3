"""Synchronised bars without a row for each pair of a bar and a tick."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import bars


@pytest.mark.parametrize("pairs", [1 << 19, 7])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_same_as_summed_pairs(spark, monkeypatch, pairs, kind):
    monkeypatch.setattr(bars, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    ticks = [(int(rng.integers(6)), 1, int(rng.integers(0, 9_000_000_000)), k, None if rng.random() < 0.1 else float(rng.integers(1, 9)), None if rng.random() < 0.1 else int(rng.integers(0, 4))) for k in range(150)]
    at = lambda c: F.timestamp_micros(F.lit(1_710_054_000_000_000) + F.col(c)).cast(kind).alias(c)  # noqa: E731  # over a change of the clock
    t = spark.createDataFrame(ticks, "symbol long, date int, ts long, seq long, price double, volume long").select("symbol", "date", at("ts"), "seq", "price", "volume")
    c = [(s, 1, o, o + int(rng.integers(0, 3_000_000_000))) for s in (0, 2, 9) for o in range(0, 9_000_000_000, 1_500_000_000)] + [(1, 2, 0, 9_000_000_000), (1, 1, None, 5)]
    clock = spark.createDataFrame(c, "symbol long, date int, open_at long, close_at long").select("symbol", "date", at("open_at"), at("close_at"))
    each = clock.select(F.col("symbol").alias("clock_symbol"), "date", F.col("open_at").alias("clock_open_at"), F.col("close_at").alias("clock_close_at"))
    inside = each.join(t, "date").where("ts > clock_open_at and ts <= clock_close_at and clock_symbol <> symbol")
    for legacy in (False, True):
        plain = bars.summary(inside, ["clock_symbol", "date", "clock_open_at", "clock_close_at", "symbol"], legacy=legacy)
        got = bars.synchronised(clock, t, "date", legacy=legacy)
        assert got.dtypes == plain.dtypes
        rows = lambda d: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=repr)
        assert rows(got) == rows(plain) and len(rows(got)) > 30
        assert "JOIN" not in got._jdf.queryExecution().toString().upper()


def test_times_and_sums_are_made_by_the_task(spark, monkeypatch):
    """Spark makes no time from numbers and no decimal for each row, and small batches give the same rows."""
    from helpers import DATA
    from tidebar import queries

    for name in ("sync_bars", "sync_bars_legacy"):
        out = queries.QUERIES[name](spark, DATA)
        above = out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")[0]
        assert "make_dt_interval" not in above and "decimal" not in above and "round(" not in above
        whole = sorted(map(tuple, out.collect()))
        monkeypatch.setattr(bars, "PAIRS", 50)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert sorted(map(tuple, queries.QUERIES[name](spark, DATA).collect())) == whole and len(whole) > 50
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        monkeypatch.undo()
