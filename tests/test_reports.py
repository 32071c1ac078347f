"""Frames and places over keys that are longer than a task should hold."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sealbook.operators.reports import corrections_in_order, lane, trailing_usage


def plain(rows, step, span):
    sums = {}
    for key, t, q in rows:
        at = t - t % step
        sums[key, at] = sums.get((key, at), 0) + q
    out = []
    for (key, at), _ in sums.items():
        before = [b for k, b in sums if k == key and b < at]
        out.append((key, at, sum(q for (k, b), q in sums.items() if k == key and at - span <= b <= at), at - max(before) if before else None))
    return sorted(out)


@pytest.mark.parametrize("step,span,rows_per_task", [(10, 100, 3), (10, 100, 11), (10, 0, 2), (10, 95, 10), (10, 100, 10**6), (1, 7, 1)])
def test_trailing_usage_in_stretches(spark, step, span, rows_per_task):
    r = random.Random(step * span + rows_per_task)
    rows = [(r.choice("aab"), r.randint(-300, 300) + r.choice([0, 0, 5000]), r.randint(-5, 50)) for _ in range(150)] + [("c", 7, 1)]
    events = spark.createDataFrame(rows, "customer_id string, event_time_ms long, quantity_micros long")
    found = trailing_usage(events, step, span, rows_per_task=rows_per_task).collect()
    assert sorted((r.customer_id, r.at_ms, int(r.trailing_micros), r.gap_ms) for r in found) == plain(rows, step, span)


def test_a_long_key_is_spread_over_tasks(spark):
    """One key with 300,000 steps: the same as one window over it, in many stretches."""
    events = spark.range(300_000).select(F.lit("k").alias("customer_id"), (F.col("id") * 10).alias("event_time_ms"), (F.col("id") % 97).alias("quantity_micros"))
    found = trailing_usage(events, 10, 500, rows_per_task=20_000)
    order = Window.partitionBy("customer_id").orderBy("event_time_ms")
    whole = events.select(
        "customer_id", F.col("event_time_ms").alias("at_ms"), F.sum("quantity_micros").over(order.rangeBetween(-500, 0)).cast("decimal(38,0)").alias("trailing_micros"),
        (F.col("event_time_ms") - F.lag("event_time_ms").over(order)).alias("gap_ms"))
    assert found.count() == 300_000 and found.exceptAll(whole).isEmpty()


def test_places_in_long_groups(spark):
    windows = spark.range(500).select(F.lit("c").alias("customer_id"), F.lit("m").alias("metric"), (F.col("id") * 7 % 500).alias("window_open_ms"), F.col("id").cast("string").alias("window_key"))
    assert all(r.place == r.window_open_ms + 1 for r in lane(windows, rows_per_task=40).collect())
    corrections = spark.range(500).select(F.lit("w").alias("window_key"), (F.col("id") % 5).alias("event_time_ms"), F.format_string("%03d", "id").alias("event_id"))
    found = corrections_in_order(corrections, rows_per_task=40).orderBy("place").collect()
    assert [(r.event_time_ms, r.event_id) for r in found] == sorted((i % 5, f"{i:03d}") for i in range(500)) and found[-1].place == 500
