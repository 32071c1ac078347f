"""The registered queries' inputs: which deliveries, which settings, which stored state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealbook.operators.durable import durable, shared_folder
from sealbook.operators.ingest import log_rows, open_windows
from sealbook.operators.receipts import build_receipts, bundles, sealed_leaves
from sealbook.operators.totals import windows_of_log
from sealbook.operators.validate import check_deliveries
from sealbook.operators.watermarks import stream_watermarks
from sealbook.settings import DAY_MS, Settings
from sealbook.sources.adapters import events_as_deliveries, lineitem_as_deliveries
from sealbook.sources.store import MeteringStore

NOW_MS = 1_750_000_000_000
DAILY = Settings(window_ms=DAY_MS, grace_ms=2 * 3_600_000)
WEEKLY = Settings(window_ms=7 * DAY_MS, grace_ms=2 * 3_600_000)
LINES = Settings(window_ms=30 * DAY_MS, grace_ms=7 * DAY_MS)
DEEP_CUSTOMERS = 10
# The two batches of the late-arrival runs part at this ingest time: 2024-01-16 00:00 UTC.
CUT_MS = 1_705_363_200_000


def events(spark: SparkSession, folder: str, customers: int | None = None) -> DataFrame:
    return _normal(events_as_deliveries(spark, folder, customers))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return _normal(lineitem_as_deliveries(spark, folder))


def _normal(deliveries: DataFrame) -> DataFrame:
    return check_deliveries(deliveries, NOW_MS).where(F.col("reject_reason").isNull()).drop("reject_reason")


@dataclass(frozen=True)
class SealedLog:
    log: DataFrame
    opened: DataFrame
    watermarks: DataFrame
    windows: DataFrame
    settings: Settings


def sealed_log(deliveries: DataFrame, settings: Settings) -> SealedLog:
    """Deliveries with unique ids as a finished log, sealed once at its end."""
    windows = windows_of_log(deliveries, settings, NOW_MS)
    return SealedLog(
        log=log_rows(deliveries),
        opened=open_windows(windows),
        watermarks=stream_watermarks(deliveries, settings.grace_ms),
        windows=windows,
        settings=settings,
    )


def daily(spark: SparkSession, folder: str) -> SealedLog:
    """Shallow windows: one day of one event type of one user."""
    return sealed_log(events(spark, folder), DAILY)


def weekly(spark: SparkSession, folder: str) -> SealedLog:
    """Deep windows: users folded into ten customers, one week each."""
    return sealed_log(events(spark, folder, DEEP_CUSTOMERS), WEEKLY)


@dataclass(frozen=True)
class Books:
    """What a month's end leaves behind, written once: receipts and their bundles."""

    receipts: DataFrame
    bundles: DataFrame


_books: dict[tuple, Books] = {}


def weekly_books(spark: SparkSession, folder: str) -> Books:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _books:
        s = weekly(spark, folder)
        leaves = sealed_leaves(s.log, s.windows, s.settings)
        receipts = durable(build_receipts(leaves, s.settings, NOW_MS))
        _books[key] = Books(receipts, durable(bundles(receipts, leaves.rows)))
    return _books[key]


_stores: dict[tuple, MeteringStore] = {}


def _stored(spark: SparkSession, folder: str, name: str, settings: Settings, batches) -> MeteringStore:
    """A store filled with all rows of the table in batches, sealed after each; filled once per session."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stores:
        store = MeteringStore(spark, shared_folder(spark), settings)
        for rows in batches():
            store.ingest(rows, NOW_MS, auto_seal=True)
        _stores[key] = store
    return _stores[key]


def line_store(spark: SparkSession, folder: str) -> MeteringStore:
    """Order lines, the filled ones first: re-deliveries, conflicts and late lines across batches."""

    def batches():
        rows = lineitem_as_deliveries(spark, folder)
        return [rows.where(F.col("part") == "F"), rows.where(F.col("part") != "F")]

    return _stored(spark, folder, "lines", LINES, batches)


def late_store(spark: SparkSession, folder: str) -> MeteringStore:
    """Events in two batches by ingest time; what comes late hits windows sealed by the first."""
    return _stored(spark, folder, "late", DAILY, lambda: late_batches(spark, folder))


def late_batches(spark: SparkSession, folder: str) -> list[DataFrame]:
    rows = events_as_deliveries(spark, folder)
    return [rows.where(F.col("ingest_time_ms") < CUT_MS), rows.where(F.col("ingest_time_ms") >= CUT_MS)]
