"""Capture to numbered files, and streams over them that break off and start again."""

import json

import pytest

from tidebar.sources import live, market_data


def messages(lo, hi):
    return [json.dumps([{"ev": "T", "sym": "ABC", "x": 1, "i": str(k), "z": 1, "p": 10 + k / 100, "s": k, "c": [], "t": 1_700_000_000_000 + k}]) for k in range(lo, hi)]


def run(spark, folder, tmp_path):
    q = market_data.parse_log(live.live(spark, folder)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return sorted(int(r.trade_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_each_message_comes_once_over_restarts(spark, tmp_path):
    folder = f"{tmp_path}/log"
    assert live.capture(messages(0, 2500), folder, 1000, lambda: 1_700_000_000_000_000_000) == 2500
    assert [f[:2] for f in live.captured_files(folder)] == [(0, 1000), (1000, 1000), (2000, 500)]
    assert run(spark, folder, tmp_path) == list(range(2500))
    assert live.capture(messages(2500, 2501), folder) == 1 and live.capture([], folder) == 0
    live.capture(messages(2501, 4000), folder, 400)
    assert run(spark, folder, tmp_path) == list(range(4000))
    assert run(spark, folder, tmp_path) == list(range(4000))


def test_a_batch_starts_and_ends_within_files(tmp_path):
    folder = f"{tmp_path}/log"
    live.capture(messages(0, 25), folder, 10)
    reader = live._Reader(folder)
    parts = reader.partitions({"message": 7}, {"message": 22})
    assert [n for p in parts for n, _ in reader.read(p)] == list(range(7, 22))
    assert all(json.loads(v.split("||", 1)[1])[0]["i"] == str(n) for p in parts for n, v in reader.read(p))
    assert reader.partitions({"message": 25}, {"message": 25}) == [] and reader.latestOffset() == {"message": 25}


def test_unfinished_files_are_not_seen_and_missing_ones_are(tmp_path):
    folder = tmp_path / "log"
    live.capture(messages(0, 30), str(folder), 10)
    (folder / "000000000000030-000000010.log.open").write_text("half")
    assert live.captured(str(folder)) == 30 and live.captured(f"{tmp_path}/none") == 0
    (folder / "000000000000010-000000010.log").unlink()
    with pytest.raises(ValueError, match="missing"):
        live.captured(str(folder))
    with pytest.raises(ValueError, match="line break"):
        live.capture(["a\nb"], f"{tmp_path}/other")
