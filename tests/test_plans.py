"""Steps that may not shuffle what they blow up."""

from pyspark.sql import functions as F

from tidebar.operators import bars, cluster


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_empty_bins_are_not_joined(spark):
    ts = F.lit("2024-03-11 15:00:00").cast("timestamp")
    t = spark.range(3).select(F.col("id").alias("symbol"), ts.alias("ts"), F.lit(2.0).alias("price"), F.lit(3).alias("volume"), F.lit(1).alias("side"))
    out = bars.time_bins(t, ["symbol"], 1800)
    assert "Join" not in plan(out)
    assert out.count() == 39 and out.where("tick_count = 1 and price = 2.0").count() == 3 and out.where("tick_count = 0 and price is null").count() == 36


def test_pairs_are_not_shuffled_to_their_labels(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "symbol long, cluster int")
        pairs = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.4), (1, 3, 0.9), (2, 2, 0.0), (2, 3, 0.8), (3, 3, 0.0)], "a long, b long, distance double")
        details = spark.createDataFrame([(1, "x", "y")], "symbol long, sector string, industry string")
        out = cluster.cluster_metrics(labels, pairs, details)
        assert plan(out).count("BroadcastHashJoin") >= 2
        got = {r.cluster: r.similarity for r in out.collect()}
        assert abs(got[0] - 0.6) < 1e-12 and got[1] is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
