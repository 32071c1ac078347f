"""Proofs over arrival orders: what must not change a bill, and what would."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealbook.functions.ids import hash_order, time_ordered_id
from sealbook.functions.quantity import exact_sum, format_micros
from sealbook.functions.windows import STREAM, with_window
from sealbook.operators.ingest import Admission, State, applied, ingest
from sealbook.operators.parity import agreement
from sealbook.operators.sealing import seal_due_windows
from sealbook.operators.totals import window_totals
from sealbook.settings import Settings
from sealbook.sources.store import MeteringStore


def hostile_arrivals(deliveries: DataFrame, seed: str | Column, share: float) -> DataFrame:
    """Every delivery once, a share of them twice, in the shuffled order of ``seed``.

    Which are doubled and where each copy lands follows from hashes, so a seed always gives the
    same arrivals. One pass; nothing is sorted until an order is needed.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    twice = hash_order(F.concat(seed, F.lit("/twice")), F.col("event_id"))
    draw = F.conv(F.substring(twice, 1, 4), 16, 10).cast("bigint")
    top = F.when(draw < int(share * 65536), 1).otherwise(0)
    copies = deliveries.withColumn("copy", F.explode(F.sequence(F.lit(0), top)))
    return copies.withColumn("arrival", hash_order(seed, F.col("event_id"), F.col("copy")))


def expected_totals(deliveries: DataFrame, settings: Settings) -> DataFrame:
    """Totals of counters straight from the set of events, without any of the ingest steps.

    One row counts per id, the smallest by stream, time and quantity; ids that say one thing only do not care.
    """
    one = F.min(F.struct(*STREAM, "event_time_ms", "quantity_micros")).alias("one")
    unique = deliveries.groupBy("event_id").agg(one).select("event_id", "one.*")
    return with_window(unique, settings.window_ms).groupBy("window_key").agg(
        exact_sum(F.col("quantity_micros")).alias("expected_micros")
    )


def sealed_at_end(admission: Admission, state: State, settings: Settings, now_ms: int) -> DataFrame:
    """Totals of all windows after one call and one seal."""
    after = applied(state, admission)
    windows = seal_due_windows(after.windows, after.watermarks, now_ms)
    return window_totals(after.log, windows, settings)


def replay_runs(deliveries: DataFrame, seeds: list[str], settings: Settings, now_ms: int, share: float = 0.25) -> DataFrame:
    """Totals per run and window for several arrival orders, all runs in one plan and one scan.

    Each run gets its own customers and event ids by a prefix, so runs share nothing.
    """
    each = deliveries.withColumn("run", F.explode(F.array(*[F.lit(seed) for seed in seeds])))
    prefix = F.concat("run", F.lit("/"))
    runs = (
        hostile_arrivals(each, F.col("run"), share)
        .withColumn("event_id", F.concat(prefix, "event_id"))
        .withColumn("customer_id", F.concat(prefix, "customer_id"))
        .drop("run")
    )
    totals = sealed_at_end(ingest(runs, State(), settings), State(), settings, now_ms)
    slash = F.lit("/")
    return totals.withColumn("run", F.split_part("window_key", slash, F.lit(1))).withColumn(
        "window_key", F.split_part("window_key", slash, F.lit(2))
    )


def replay_invariance(deliveries: DataFrame, seeds: list[str], settings: Settings, now_ms: int) -> DataFrame:
    """Per window: the runs, and whether every one of them billed the same text."""
    return agreement(replay_runs(deliveries, seeds, settings, now_ms), ["window_key"], "billed_total")


def crash_replay(deliveries: DataFrame, settings: Settings, now_ms: int, share: float = 0.25) -> DataFrame:
    """Part of the arrivals, a crash, then everything again in another order; against one clean pass."""
    before = hostile_arrivals(deliveries, "before", share).where(F.col("arrival") < "8")
    state = applied(State(), ingest(before, State(), settings))
    again = ingest(hostile_arrivals(deliveries, "again", share), state, settings)
    clean = ingest(hostile_arrivals(deliveries, "clean", share), State(), settings)
    return _side_by_side(
        sealed_at_end(clean, State(), settings, now_ms), sealed_at_end(again, state, settings, now_ms)
    )


def redelivery_convergence(deliveries: DataFrame, times: int, settings: Settings, now_ms: int) -> DataFrame:
    """The same set delivered ``times`` over in one interleaved batch; against a single delivery."""
    copies = deliveries.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    storm = copies.withColumn("arrival", hash_order("storm", F.col("event_id"), F.col("copy")))
    return _side_by_side(
        sealed_at_end(ingest(deliveries, State(), settings), State(), settings, now_ms),
        sealed_at_end(ingest(storm, State(), settings), State(), settings, now_ms),
    )


def _side_by_side(expected: DataFrame, found: DataFrame) -> DataFrame:
    a = expected.select("window_key", F.col("billed_total").alias("expected"), F.col("sealed").alias("expect_sealed"))
    b = found.select("window_key", F.col("billed_total").alias("found"), F.col("sealed").alias("found_sealed"))
    same = F.col("expected").eqNullSafe(F.col("found")) & F.col("expect_sealed").eqNullSafe(F.col("found_sealed"))
    return a.join(b, "window_key", "full").select("window_key", "expected", "found", same.alias("same"))


def stragglers(windows: DataFrame, quantity: str) -> DataFrame:
    """One late delivery into the middle of every sealed window."""
    middle = F.col("window_open_ms") + ((F.col("window_close_ms") - F.col("window_open_ms")) / 2).cast("bigint")
    return windows.where(F.col("state") == "sealed").select(
        time_ordered_id(middle, F.col("window_key"), F.lit("straggler")).alias("event_id"),
        *STREAM,
        F.lit(quantity).alias("quantity"),
        middle.alias("event_time_ms"),
        F.col("sealed_at_ms").alias("ingest_time_ms"),
        F.lit("{}").alias("payload"),
        F.col("window_key").alias("arrival"),
    )


def tie_sensitivity(events: DataFrame, seeds: list[str], settings: Settings) -> DataFrame:
    """Windows whose last time is shared: the gauge value with the id as tie-break, and how many
    values the arrival orders of ``seeds`` would give without it."""
    by_arrival = [
        F.max_by("quantity_micros", hash_order(seed, F.col("event_id"))).alias(f"v{i}") for i, seed in enumerate(seeds)
    ]
    # The hashes of the arrival orders are only taken of what shares the last time of its window.
    rows = with_window(events, settings.window_ms).select("window_key", "event_time_ms", "event_id", "quantity_micros")
    last = rows.groupBy("window_key").agg(F.max("event_time_ms").alias("event_time_ms"))
    values = F.array_distinct(F.array(*[f"v{i}" for i in range(len(seeds))]))
    ties = rows.join(last, ["window_key", "event_time_ms"]).groupBy("window_key").agg(
        F.count(F.lit(1)).alias("tied"), F.max_by("quantity_micros", "event_id").alias("billed"), *by_arrival
    )
    return ties.where(F.col("tied") > 1).withColumn("distinct_values", F.size(values)).select(
        "window_key",
        "tied",
        format_micros(F.col("billed")).alias("billed_total"),
        "distinct_values",
        (F.col("distinct_values") == 1).alias("stable"),
    )


class Interrupted(MeteringStore):
    """A writer whose first commit comes after another writer's: ``between`` is called just before it."""

    def __init__(self, *args, between: Callable[[], object], **kwargs):
        super().__init__(*args, **kwargs)
        self._between_once = between

    def _commit(self, snapshot, entry):
        between, self._between_once = self._between_once, None
        if between is not None:
            between()
        return super()._commit(snapshot, entry)


def concurrent_ingest(spark: SparkSession, deliveries: DataFrame, root: str, writers: int, settings: Settings, now_ms: int) -> MeteringStore:
    """The same deliveries ingested by several writers at once, and sealed: a store that has to hold them once."""
    with ThreadPoolExecutor(writers) as pool:
        list(pool.map(lambda _: MeteringStore(spark, root, settings).ingest(deliveries, now_ms), range(writers)))
    store = MeteringStore(spark, root, settings)
    store.seal(now_ms)
    return store
