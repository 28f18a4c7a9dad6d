"""Signals that are folded over a session."""

from pyspark.sql import functions as F

from gridloom.operators import signals


def test_smoothing_carries_one_value_over_a_long_session(spark):
    rows = spark.range(25_000).select(F.when(F.col("id") < 24_990, 1).alias("session"), F.col("id").alias("ord"), (F.col("id") * 7919 % 1000 - 100.0).alias("level"))
    got = signals.smooth(rows)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want, shown = {}, 0.0
    for i in (*range(24_990), *range(24_990, 25_000)):
        level = i * 7919 % 1000 - 100.0
        shown = 0.0 if i == 24_990 else shown
        shown = level if level >= shown else shown * 0.8 + level * (1 - 0.8)
        want[i] = shown
    assert {r["ord"]: r["shown"] for r in got.collect()} == want
