"""Admitting one batch of deliveries: dedup, conflict audit, quarantine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealbook.functions.ids import time_ordered_id
from sealbook.functions.quantity import money
from sealbook.functions.windows import STREAM, event_timestamp, window_close, window_key, window_open, with_window
from sealbook.operators.skew import ROWS_PER_SALT, join_hot
from sealbook.operators.watermarks import advance_watermarks, stream_watermarks
from sealbook.settings import Settings

# What a delivery says about a bill.
STATED = ["quantity_micros", *STREAM, "event_time_ms"]
BILLED = [*STATED, "window_key"]
WINDOW_COLUMNS = ["window_key", *STREAM, "window_open_ms", "window_close_ms"]
# What is told of a delivery; a caller that keeps judged deliveries may leave some of it out.
DISPOSITION = ["event_id", "arrival", *BILLED, "ingest_time_ms", "disposition", "conflict"]
# Ids are counted by so many hashes to find the hot ones; a hash with more than ROWS_PER_SALT rows is hot.
HASHES = 1 << 18


@dataclass(frozen=True)
class State:
    """The tables of one installation; a table that does not exist yet is None."""

    log: DataFrame | None = None
    windows: DataFrame | None = None
    watermarks: DataFrame | None = None
    corrections: DataFrame | None = None
    receipts: DataFrame | None = None


@dataclass(frozen=True)
class Admission:
    """What one ingest call adds. ``dispositions`` has one row per delivery."""

    dispositions: DataFrame
    accepted: DataFrame
    corrections: DataFrame
    windows: DataFrame
    watermarks: DataFrame


def ingest(
    deliveries: DataFrame,
    state: State,
    settings: Settings,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    rows_per_task: int | None = None,
) -> Admission:
    """Admit valid deliveries in ``arrival`` order against the state before this call.

    ``arrival`` is any sortable column that is unique within an event id. Sealing happens after
    the call, so the set of sealed windows stays fixed during it. All deliveries of an id are judged
    together in one window after one shuffle; a store writes that down by ``keep``. Ids with very many
    deliveries, found by a count beforehand, are reduced to an aggregate instead and spread over tasks.
    """
    hot = _hot_hashes(deliveries, rows_per_task or ROWS_PER_SALT)
    arrivals = _flag_sealed(with_window(deliveries, settings.window_ms), state.windows)
    known = None if state.log is None else known_events(arrivals, state.log, settings)
    usual = arrivals.where(~_hash().isin(hot)) if hot else arrivals
    judged = keep(_judge(usual, known, settings))
    accepted = judged.where("admitted").select("event_id", *BILLED, "ingest_time_ms", "payload")
    dispositions = judged.select(*[c for c in DISPOSITION if c in judged.columns])
    filed = judged.where("filed is not null").select("event_id", "filed.*")
    if hot:
        many = arrivals.where(_hash().isin(hot))
        prior = keep(_prior(_per_id(many), known))
        new = prior.where(~F.col("known") & F.col("first").isNotNull())
        told = _dispose(many, prior, rows_per_task)
        accepted = accepted.unionByName(new.select("event_id", "first.*").select(*accepted.columns))
        dispositions = dispositions.unionByName(told.select(*dispositions.columns))
        filed = filed.unionByName(_first_filed(told).select(*filed.columns))
    accepted = log_rows(accepted)
    windows = insert_if_absent(
        distinct_windows(accepted, settings.window_ms), state.windows, ["window_key"]
    )
    return Admission(
        dispositions=dispositions,
        accepted=accepted,
        corrections=_corrections(filed, state.corrections),
        windows=open_windows(windows),
        watermarks=advance_watermarks(state.watermarks, stream_watermarks(accepted, settings.grace_ms)),
    )


def _hash() -> Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(HASHES))


def _hot_hashes(deliveries: DataFrame, limit: int) -> list[int]:
    """The hashes with more deliveries than one task should judge: those of hot ids, at most one for each ``limit`` rows."""
    counted = deliveries.groupBy(_hash().alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.hash for r in counted.where(F.col("n") > limit).select("hash").collect())


def applied(state: State, admission: Admission) -> State:
    """The state after the call, before sealing."""
    return replace(
        state,
        log=append(state.log, admission.accepted),
        windows=append(state.windows, admission.windows),
        corrections=append(state.corrections, admission.corrections),
        watermarks=admission.watermarks,
    )


def append(table: DataFrame | None, rows: DataFrame) -> DataFrame:
    return rows if table is None else table.unionByName(rows)


def insert_if_absent(
    rows: DataFrame, table: DataFrame | None, key: list[str], few_rows: bool = False
) -> DataFrame:
    """The rows whose key the table does not hold yet.

    With ``few_rows`` the table is first cut down to the keys of the rows: they are broadcast
    and a long table is only scanned. That reads the rows twice.
    """
    if table is None:
        return rows
    held = table.select(*key)
    if few_rows:
        held = held.join(rows.select(*key).distinct(), key, "left_semi")
    return rows.join(held, key, "left_anti")


def first_deliveries(arrivals: DataFrame, carried: list[str]) -> DataFrame:
    """One row per event id: the delivery that arrived first, as a struct of ``carried``.

    A minimum, so copies of one id are reduced before the shuffle, however many there are.
    """
    return arrivals.groupBy("event_id").agg(F.min(F.struct("arrival", *carried)).alias("first"))


def _flag_sealed(arrivals: DataFrame, windows: DataFrame | None) -> DataFrame:
    if windows is None:
        return arrivals.withColumn("sealed", F.lit(False))
    return sealed_hits(arrivals, windows)


def sealed_hits(arrivals: DataFrame, windows: DataFrame) -> DataFrame:
    """Add ``sealed``: does the delivery aim at a window that is sealed already?"""
    sealed = windows.where(F.col("state") == "sealed").select("window_key", F.lit(True).alias("sealed"))
    return arrivals.join(sealed, "window_key", "left").withColumn("sealed", F.coalesce("sealed", F.lit(False)))


def known_events(arrivals: DataFrame, log: DataFrame, settings: Settings) -> DataFrame:
    """The log rows that share an id with a delivery.

    A semi join from the log: a small batch is broadcast and the log is only scanned, three
    columns and the time of it; a large batch shuffles both.
    """
    ids = arrivals.select("event_id").distinct()
    columns = log.select("event_id", "quantity_micros", *STREAM, "event_time_ms")
    return with_window(columns.join(ids, "event_id", "left_semi"), settings.window_ms)


def _judge(arrivals: DataFrame, known: DataFrame | None, settings: Settings) -> DataFrame:
    """Every delivery with its disposition, each id in one task.

    ``admitted`` marks the one that enters the log, ``filed`` is the correction of the id, on the same row as the
    first of its deliveries. Window keys follow from the other columns, so they are not shuffled.
    """
    whole = Window.partitionBy("event_id")
    in_turn = whole.orderBy("sealed", "arrival", *STATED, "ingest_time_ms", "payload")
    rows = arrivals.select("event_id", "arrival", *STATED, "ingest_time_ms", "payload", "sealed")
    is_known, original = F.lit(False), F.col("first")
    if known is not None:
        rows = rows.join(known.select("event_id", F.struct(*STATED).alias("logged")), "event_id", "left")
        is_known, original = F.col("logged").isNotNull(), F.when(F.col("logged").isNull(), F.col("first").dropFields("arrival")).otherwise(F.col("logged"))
    rows = rows.withColumn("place", F.row_number().over(in_turn)).withColumn(
        "first", F.min(F.when(~F.col("sealed"), F.struct("arrival", *STATED))).over(whole)
    )

    def key(of=""):
        return window_key(F.col(f"{of}customer_id"), F.col(f"{of}metric"), window_open(F.col(f"{of}event_time_ms"), settings.window_ms))

    rows = rows.withColumn("original", original).withColumn("window_key", key())
    rows = rows.withColumn("original", F.col("original").withField("window_key", key("original.")))
    told = _with_disposition(rows, is_known, F.col("first.arrival"))
    admitted = (F.col("place") == 1) & ~F.col("sealed") & ~is_known
    return told.select(
        *DISPOSITION,
        admitted.alias("admitted"),
        F.when(admitted, F.col("payload")).alias("payload"),
        F.when(F.col("place") == 1, F.min(F.when(_wanted(), _correction())).over(whole)).alias("filed"),
    )


def _per_id(arrivals: DataFrame) -> DataFrame:
    """Per event id: the first delivery that aims at an open window, and how many deliveries there are."""
    whole = F.struct("arrival", *BILLED, "ingest_time_ms", "payload")
    return arrivals.groupBy("event_id").agg(
        F.min(F.when(~F.col("sealed"), whole)).alias("first"), F.count(F.lit(1)).alias("copies")
    )


def _billed(name: str) -> Column:
    """What bills out of a delivery, null if there is none."""
    return F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{name}.{c}").alias(c) for c in BILLED]))


def _prior(firsts: DataFrame, known: DataFrame | None) -> DataFrame:
    """Per event id, the admitted event that its deliveries are measured against."""
    rows = firsts.select("event_id", "first", "copies", _billed("first").alias("own"))
    if known is None:
        return rows.select("event_id", "first", "copies", F.lit(False).alias("known"), F.col("own").alias("original"))
    logged = known.select("event_id", F.struct(*BILLED).alias("logged"))
    return rows.join(logged, "event_id", "left").select(
        "event_id", "first", "copies", F.col("logged").isNotNull().alias("known"), F.coalesce("logged", "own").alias("original")
    )


def _dispose(arrivals: DataFrame, prior: DataFrame, rows_per_salt: int | None = None) -> DataFrame:
    # Payloads stay behind: a disposition needs only what identifies and bills a delivery.
    narrow = arrivals.select("event_id", "arrival", *BILLED, "ingest_time_ms")
    measure = prior.select("event_id", "copies", "known", "original", F.col("first.arrival").alias("first_arrival"))
    joined = join_hot(narrow, measure, "event_id", F.col("arrival"), "copies", rows_per_salt)
    return _with_disposition(joined, F.coalesce("known", F.lit(False)), F.col("first_arrival"))


def _with_disposition(rows: DataFrame, known: Column, first_arrival: Column) -> DataFrame:
    """Dedup comes before quarantine: an admitted event sent again is a duplicate, even after the seal."""
    new = ~known & (first_arrival.isNull() | (F.col("arrival") < first_arrival))
    disposition = (
        F.when(new, "quarantined")
        .when(~known & (F.col("arrival") == first_arrival), "accepted")
        .otherwise("deduped")
    )
    differs = F.col("quantity_micros") != F.col("original.quantity_micros")
    return rows.withColumn("disposition", disposition).withColumn(
        "conflict", (F.col("disposition") == "deduped") & differs
    )


def _wanted() -> Column:
    """Whether a delivery calls for a correction."""
    return F.col("conflict") | (F.col("disposition") == "quarantined")


def _correction() -> Column:
    """What is filed of a delivery. A conflict is filed under the window of the original with the rejected quantity."""
    conflict = F.col("conflict")

    def from_original(name):
        return F.when(conflict, F.col(f"original.{name}")).otherwise(F.col(name)).alias(name)

    return F.struct(
        "arrival",
        from_original("window_key"),
        from_original("customer_id"),
        from_original("metric"),
        "quantity_micros",
        from_original("event_time_ms"),
        F.col("ingest_time_ms").alias("quarantined_at_ms"),
        F.when(conflict, "payload_conflict").otherwise("late_after_seal").alias("reason"),
    )


def _first_filed(dispositions: DataFrame) -> DataFrame:
    """The first delivery of each id that calls for a correction."""
    first = dispositions.where(_wanted()).groupBy("event_id").agg(F.min(_correction()).alias("filed"))
    return first.select("event_id", "filed.*")


def _corrections(filed: DataFrame, held: DataFrame | None) -> DataFrame:
    """One correction per event id, ever: the first delivery that calls for one."""
    return insert_if_absent(filed, held, ["event_id"]).select(
        time_ordered_id(F.col("quarantined_at_ms"), F.col("event_id"), F.col("reason")).alias("correction_id"),
        "window_key",
        "event_id",
        *STREAM,
        money(F.col("quantity_micros")).alias("quantity"),
        "quantity_micros",
        "event_time_ms",
        "quarantined_at_ms",
        "reason",
    )


def log_rows(rows: DataFrame) -> DataFrame:
    """Shape admitted rows as the event log, with the derived timestamps."""
    return rows.select(
        "event_id",
        *STREAM,
        money(F.col("quantity_micros")).alias("quantity"),
        "quantity_micros",
        "event_time_ms",
        "ingest_time_ms",
        event_timestamp(F.col("event_time_ms")).alias("event_time"),
        event_timestamp(F.col("ingest_time_ms")).alias("ingest_time"),
        "payload",
    )


def distinct_windows(events: DataFrame, window_ms: int | str) -> DataFrame:
    """The windows of some events. Key and close follow from stream and open time, so those alone are shuffled."""
    opened = F.col("window_open_ms")
    starts = events.select(*STREAM, window_open(F.col("event_time_ms"), window_ms).alias("window_open_ms")).distinct()
    keyed = starts.withColumn("window_key", window_key(F.col("customer_id"), F.col("metric"), opened))
    return keyed.withColumn("window_close_ms", window_close(opened, window_ms)).select(*WINDOW_COLUMNS)


def open_windows(specs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return specs.select(
        *WINDOW_COLUMNS,
        F.lit("open").alias("state"),
        none.alias("sealed_at_ms"),
        none.alias("sealed_watermark_ms"),
    )


def ingest_counts(dispositions: DataFrame) -> DataFrame:
    return dispositions.groupBy("disposition").agg(F.count(F.lit(1)).alias("deliveries"))
