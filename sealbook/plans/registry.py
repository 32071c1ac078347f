"""The registered queries: each takes a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealbook.functions.hashing import leaf_text
from sealbook.functions.quantity import format_micros, micros_from_text, pretty_micros
from sealbook.functions.windows import STREAM, billing_mode, with_window
from sealbook.operators import parity, receipts, reports, sealing, totals, verify, watermarks
from sealbook.operators.durable import shared_folder
from sealbook.operators.ingest import (
    STATED,
    State,
    WINDOW_COLUMNS,
    applied,
    first_deliveries,
    ingest,
    insert_if_absent,
    log_rows,
    open_windows,
    sealed_hits,
)
from sealbook.operators.merkle import merkle_roots
from sealbook.operators.ordering import in_order
from sealbook.operators.validate import check_deliveries
from sealbook.plans import invoices, proofs
from sealbook.plans.scenarios import (
    CUT_MS,
    DAILY,
    DEEP_CUSTOMERS,
    LINES,
    NOW_MS,
    WEEKLY,
    daily,
    events,
    late_batches,
    late_store,
    line_store,
    lines,
    weekly,
    weekly_books,
)
from sealbook.settings import DAY_MS, Settings
from sealbook.sources import adapters, bundle_files, deliveries, store, tagged_log
from sealbook.sources.adapters import lineitem_as_deliveries
from sealbook.streaming.micro_batch import start_metering

SEEDS = ["one", "two", "three"]

_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    _registry[f.__name__] = f
    return f


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registry)


def _text(name: str):
    return F.col(name).cast("string").alias(name)


# -- sources and columns -------------------------------------------------------------------


@query
def usage_from_events(spark, folder):
    return adapters.events_as_deliveries(spark, folder).select(
        "event_id", "customer_id", "metric", format_micros((F.col("quantity") * 1_000_000).cast("bigint")).alias("quantity"),
        "event_time_ms", "ingest_time_ms", "payload",
    )


@query
def validate_deliveries(spark, folder):
    """Defects made from the data: no metric for errors, no time for late ones, odd quantities."""
    raw = adapters.events_as_deliveries(spark, folder)
    text = format_micros((F.col("quantity") * 1_000_000).cast("bigint"))
    broken = (
        raw.withColumn("metric", F.when(F.col("metric") == "error", "").otherwise(F.col("metric")))
        .withColumn("event_time_ms", F.when(F.length("payload") != 9, F.col("event_time_ms")))
        .withColumn("quantity", F.when(F.col("metric") == "signup", F.concat(text, F.lit("e1"))).otherwise(text))
    )
    checked = check_deliveries(broken, NOW_MS)
    return checked.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("deliveries"), F.sum("quantity_micros").cast("string").alias("micros")
    )


def _shaped(spark, folder) -> DataFrame:
    """Quantity texts in many shapes from prices; some are not numbers."""
    line = adapters.table(spark, folder, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(20,2)").cast("string")
    tax = F.col("l_tax").cast("decimal(20,2)").cast("string")
    digits = F.substring(tax, 3, 2)
    text = (
        F.when(F.col("l_linenumber") == 1, price)
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("-"), price, F.lit("0005"), digits))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit(" +."), digits, F.lit("  ")))
        .when(F.col("l_linenumber") == 4, F.concat(price, F.lit("0000"), digits))
        .when(F.col("l_linenumber") == 5, F.concat(price, F.lit("e2")))
        .when(F.col("l_linenumber") == 6, F.lit(" "))
        .otherwise(F.concat(F.split_part(price, F.lit("."), F.lit(1)), F.lit(".")))
    )
    return line.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("quantity"))


@query
def parse_micros(spark, folder):
    return _shaped(spark, folder).withColumn("micros", micros_from_text(F.col("quantity")))


@query
def format_micros_text(spark, folder):
    o = adapters.table(spark, folder, "orders")
    micros = (F.col("o_totalprice").cast("decimal(20,2)") * 10_000).cast("bigint") - 1_500_000_000
    return o.select("o_orderkey", micros.alias("micros"), format_micros(micros).alias("canonical"))


@query
def pretty_micros_text(spark, folder):
    o = adapters.table(spark, folder, "orders")
    micros = (F.col("o_totalprice").cast("decimal(20,2)") * 1_000_000).cast("bigint") * 1000 - 150_000_000_000_000
    return o.select("o_orderkey", pretty_micros(micros).alias("pretty"))


@query
def assign_windows(spark, folder):
    e = with_window(events(spark, folder), DAILY.window_ms)
    return e.select("event_id", "window_key", "window_open_ms", "window_close_ms")


@query
def calendar_windows(spark, folder):
    month = Settings(window_ms="month")
    t = totals.counter_totals(lines(spark, folder), month)
    return t.select("window_key", "window_open_ms", "window_close_ms", _text("total_micros"), "event_count")


@query
def leaf_hashes(spark, folder):
    e = with_window(events(spark, folder), DAILY.window_ms)
    text = leaf_text(F.col("event_id"), F.col("event_time_ms"), F.col("quantity_micros"))
    return receipts.leaf_hashes(e, DAILY).select("event_id", text.alias("leaf"), "hash")


@query
def clock_skew_profile(spark, folder):
    p = reports.clock_skew_profile(events(spark, folder))
    return p.select("customer_id", "metric", "events", "min_skew_ms", "max_skew_ms",
                    F.round("median_skew_ms", 3).alias("median_skew_ms"), F.round("p95_skew_ms", 3).alias("p95_skew_ms"))


# -- totals --------------------------------------------------------------------------------


def _total(t: DataFrame) -> DataFrame:
    return t.select("window_key", format_micros(F.col("total_micros")).alias("billed_total"), "event_count")


@query
def counter_totals(spark, folder):
    return _total(totals.counter_totals(events(spark, folder), DAILY))


@query
def gauge_totals(spark, folder):
    e = events(spark, folder, DEEP_CUSTOMERS)
    return _total(totals.gauge_totals(e.where(billing_mode(F.col("metric"), WEEKLY) == "gauge"), WEEKLY))


@query
def gauge_without_tiebreak(spark, folder):
    return _total(totals.gauge_totals_by_arrival(_first_lines(spark, folder), LINES))


def _first_lines(spark, folder) -> DataFrame:
    # Window keys follow from the other columns, so they are not shuffled.
    first = first_deliveries(lines(spark, folder), STATED)
    return with_window(first.select("event_id", "first.*"), LINES.window_ms)


@query
def window_totals(spark, folder):
    return totals.bill_log(events(spark, folder), DAILY).drop("window_open_ms", "window_close_ms")


@query
def range_window_join(spark, folder):
    """Hand-made windows: each customer's span halved at a watermark that cuts the second half short."""
    e = events(spark, folder, 25)
    made = _hand_made(spark, folder)
    t = totals.window_totals(e, made, WEEKLY, hand_made_windows=True)
    return t.select("window_key", "mode", "billed_total", "event_count", "sealed")


def _hand_made(spark, folder) -> DataFrame:
    n = adapters.table(spark, folder, "nation")
    kinds = F.array(*[F.lit(m) for m in ("click", "view_gauge", "purchase", "signup", "error")])
    opened = F.lit(1_704_067_200_000) + F.col("n_nationkey") * 3_600_007
    return n.select(
        F.col("n_nationkey").cast("string").alias("customer_id"), F.explode(kinds).alias("metric"),
        opened.cast("bigint").alias("window_open_ms"), F.col("n_nationkey"),
    ).select(
        F.concat_ws("/", "customer_id", "metric").alias("window_key"), "customer_id", "metric", "window_open_ms",
        (F.col("window_open_ms") + 20 * DAY_MS).alias("window_close_ms"),
        F.when(F.col("n_nationkey") % 2 == 0, "sealed").otherwise("open").alias("state"),
        F.lit(NOW_MS).cast("bigint").alias("sealed_at_ms"),
        (F.col("window_open_ms") + 9 * DAY_MS).alias("sealed_watermark_ms"),
    )


@query
def running_totals(spark, folder):
    r = totals.running_totals(events(spark, folder, DEEP_CUSTOMERS), WEEKLY)
    return r.select("window_key", "event_id", "position", _text("running_micros"))


@query
def latest_event(spark, folder):
    e = totals.latest_events(events(spark, folder, DEEP_CUSTOMERS), WEEKLY)
    return e.select("window_key", "event_id", "event_time_ms", "quantity_micros")


@query
def totals_for_keys(spark, folder):
    """Totals asked for by key: every user and type for one day, most of them without a window."""
    e = events(spark, folder)
    asked = e.select("customer_id", "metric").distinct().select(
        F.concat_ws(":", "customer_id", "metric", F.lit("1704067200000")).alias("window_key")
    )
    return totals.totals_for_keys(asked, totals.bill_log(e, DAILY), DAILY)


@query
def invoice_totals(spark, folder):
    t = totals.bill_log(events(spark, folder, DEEP_CUSTOMERS), WEEKLY)
    return totals.invoice_totals(t, ["customer_id"])


@query
def expected_totals(spark, folder):
    return proofs.expected_totals(events(spark, folder), DAILY).select("window_key", _text("expected_micros"))


@query
def trailing_usage(spark, folder):
    """Per customer and ten minutes with usage: what was used in the six hours up to then, and the time since the last."""
    e = events(spark, folder, DEEP_CUSTOMERS)
    return reports.trailing_usage(e, 600_000, 6 * 3_600_000).withColumn("trailing_micros", F.col("trailing_micros").cast("string"))


@query
def billed_as_expected(spark, folder):
    """Windows whose counter bill differs from the totals straight from the set of events: none, and the grand total."""
    e = events(spark, folder).where(billing_mode(F.col("metric"), DAILY) == "counter")
    expected = proofs.expected_totals(e, DAILY)
    billed = totals.counter_totals(e, DAILY).select("window_key", "total_micros")
    both = expected.join(billed, "window_key", "full")
    differs = ~F.col("expected_micros").eqNullSafe(F.col("total_micros"))
    return both.agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(differs).alias("different"),
        F.sum(F.col("expected_micros")).cast("decimal(38,0)").cast("string").alias("grand_total_micros"),
    )


# -- ingest --------------------------------------------------------------------------------


@query
def dedup_first_delivery(spark, folder):
    return _first_lines(spark, folder).select("event_id", "window_key", "event_time_ms", "quantity_micros")


@query
def ingest_dispositions(spark, folder):
    """Every order line as one delivery of a single batch into an empty state."""
    d = ingest(lines(spark, folder), State(), LINES).dispositions
    return d.select("event_id", "window_key", "disposition", "conflict", "quantity_micros", F.col("arrival.l_partkey").alias("l_partkey"))


@query
def ingest_counts(spark, folder):
    d = line_store(spark, folder).table("dispositions")
    return d.groupBy("batch_id", "disposition").agg(F.count(F.lit(1)).alias("deliveries"))


@query
def ingest_counts_of_copies(spark, folder):
    """Order lines in one batch, a tenth of the orders a second time byte for byte: a copy is never accepted twice."""
    rows = lineitem_as_deliveries(spark, folder)
    again = F.pmod(F.conv(F.right("event_id", F.lit(8)), 16, 10).cast("bigint"), F.lit(10)) == 0
    books = store.MeteringStore(spark, shared_folder(spark), LINES)
    return books.counts(books.ingest(rows.unionByName(rows.where(again)), NOW_MS))


@query
def payload_conflicts(spark, folder):
    c = ingest(lines(spark, folder), State(), LINES).corrections
    return c.select("correction_id", "event_id", "window_key", "customer_id", "metric", _text("quantity"), "quantity_micros",
                    "event_time_ms", "quarantined_at_ms", "reason")


@query
def late_quarantine(spark, folder):
    c = late_store(spark, folder).corrections()
    return c.where(F.col("reason") == "late_after_seal").select(
        "event_id", "window_key", "quantity_micros", "event_time_ms", "quarantined_at_ms"
    )


@query
def sealed_window_hits(spark, folder):
    """Deliveries of the second batch that aim at windows the first batch sealed."""
    e = events(spark, folder)
    before = e.where(F.col("ingest_time_ms") < CUT_MS)
    opened = open_windows(with_window(before, DAILY.window_ms).select(*WINDOW_COLUMNS).distinct())
    windows = sealing.seal_due_windows(opened, watermarks.stream_watermarks(before, DAILY.grace_ms), NOW_MS)
    after = with_window(e.where(F.col("ingest_time_ms") >= CUT_MS), DAILY.window_ms)
    return sealed_hits(after, windows).select("event_id", "window_key", "sealed")


@query
def insert_if_absent_events(spark, folder):
    """Late line statuses whose order line was not seen under the first status."""
    all_lines = lines(spark, folder)
    held = all_lines.where(F.col("part") == "F")
    new = all_lines.where(F.col("part") != "F")
    absent = insert_if_absent(new.select("event_id").distinct(), held, ["event_id"])
    return absent.select("event_id")


@query
def correction_summary(spark, folder):
    c = reports.correction_summary(line_store(spark, folder).corrections())
    return c.select("window_key", "reason", "corrections", _text("micros"))


@query
def recent_corrections(spark, folder):
    c = reports.recent_corrections(line_store(spark, folder).corrections())
    return c.select("event_id", "window_key", "quantity_micros", "quarantined_at_ms", "reason")


# -- windows, watermarks, seals ------------------------------------------------------------


@query
def window_registry(spark, folder):
    w = line_store(spark, folder).windows()
    return w.select("window_key", "customer_id", "metric", "window_open_ms", "window_close_ms", "state")


@query
def stream_watermarks(spark, folder):
    return watermarks.stream_watermarks(events(spark, folder), DAILY.grace_ms)


@query
def watermark_upsert(spark, folder):
    """The second half of the events in ingest order, merged into the watermarks of the first."""
    e = events(spark, folder)
    held = watermarks.stream_watermarks(e.where(F.col("ingest_time_ms") < CUT_MS), DAILY.grace_ms)
    seen = watermarks.stream_watermarks(e.where(F.col("ingest_time_ms") >= CUT_MS), 2 * DAILY.grace_ms)
    return watermarks.advance_watermarks(held, seen)


@query
def seal_due_windows(spark, folder):
    s = daily(spark, folder)
    w = sealing.seal_due_windows(s.opened, s.watermarks, NOW_MS)
    return w.select("window_key", "state", "sealed_at_ms", "sealed_watermark_ms")


@query
def newly_sealed(spark, folder):
    """Windows sealed with all events in and not yet with the first half in ingest order."""
    e = events(spark, folder)
    half = watermarks.stream_watermarks(e.where(F.col("ingest_time_ms") < CUT_MS), DAILY.grace_ms)
    s = daily(spark, folder)
    before = sealing.seal_due_windows(s.opened, half, NOW_MS)
    return sealing.newly_sealed(s.windows, before).select("window_key", "sealed_watermark_ms")


@query
def watermark_timeline(spark, folder):
    s = daily(spark, folder)
    t = reports.watermark_timeline(s.windows, s.watermarks)
    places = [F.round(c, 9).alias(c) for c in ("open_at", "close_at", "watermark_at")]
    return t.select("window_key", "customer_short", "metric", "state", "watermark_ms", "axis_min_ms", "axis_max_ms", *places)


@query
def window_by_key(spark, folder):
    """The earliest window of every metric: its total, corrections, its stream's watermark and its leaves, all by key."""
    books = late_store(spark, folder)
    keys = books.windows().groupBy("metric").agg(F.min("window_key").alias("window_key")).select("window_key")
    asked = totals.totals_for_keys(keys, books.totals(), DAILY).select("window_key", "billed_total", "event_count", "sealed")
    stream = books.windows().join(keys, "window_key", "left_semi").select("window_key", *STREAM).join(books.watermarks(), STREAM)
    filed = books.corrections().join(keys, "window_key", "left_semi").groupBy("window_key").agg(F.count(F.lit(1)).alias("corrections"))
    leaves = books.bundles().withColumn("window_key", F.col("receipt.windowKey")).join(keys, "window_key", "left_semi")
    leaves = leaves.groupBy("window_key").agg(F.sum(F.size("leaves")).alias("leaves"))
    return asked.join(stream, "window_key").join(filed, "window_key", "left").join(leaves, "window_key", "left").select(
        "window_key", "billed_total", "event_count", "sealed", "watermark_ms",
        F.coalesce("corrections", F.lit(0)).alias("corrections"), F.coalesce("leaves", F.lit(0)).alias("leaves"))


@query
def window_lanes(spark, folder):
    """Every stream's windows in order of opening."""
    return reports.lane(daily(spark, folder).windows).select("window_key", "customer_id", "metric", "place")


@query
def corrections_in_order(spark, folder):
    """The corrections of each window by time, then id."""
    c = reports.corrections_in_order(line_store(spark, folder).corrections())
    return c.select("window_key", "event_id", "event_time_ms", "place")


@query
def event_timestamps(spark, folder):
    rows = log_rows(events(spark, folder))
    return rows.select("event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS").alias("event_time"))


@query
def window_state(spark, folder):
    """The combined view after both batches: windows, state, totals and watermarks."""
    s = late_store(spark, folder)
    marks = s.watermarks().select("customer_id", "metric", "watermark_ms")
    view = reports.state_snapshot(s.totals(), marks, s.corrections())["windows"]
    return view.join(marks, ["customer_id", "metric"]).select(
        "window_key", "mode", "billed_total", "event_count", "sealed", "sealed_watermark_ms", "watermark_ms"
    )


@query
def billing_summary(spark, folder):
    s = line_store(spark, folder)
    return reports.billing_summary(s.totals(), s.corrections())


@query
def log_replay_state(spark, folder):
    """Tables written as tagged lines, read back and rebuilt: the windows with their totals."""
    s = late_store(spark, folder)
    path = shared_folder(spark)
    tagged_log.write_tagged_log(s.state(), path)
    state = tagged_log.replay_state(tagged_log.read_tagged_log(spark, path), DAILY)
    return totals.window_totals(state.log, state.windows, DAILY).select(
        "window_key", "billed_total", "event_count", "sealed", "sealed_watermark_ms"
    )


@query
def purge_customers(spark, folder):
    """All tables without the suppliers that owe money; what is left of each."""
    s = line_store(spark, folder)
    tables = {
        "billing_window": s.windows(), "correction_epoch": s.corrections(), "event_log": s.log(),
        "stream_watermark": s.watermarks(), "window_receipt": s.receipts(),
    }
    return _rows_left(store.purge_customers(tables, _in_debt(spark, folder)))


def _in_debt(spark, folder):
    suppliers = spark.read.parquet(f"{folder}/supplier.parquet").where(F.col("s_acctbal") < 0)
    return suppliers.select(F.col("s_suppkey").cast("string").alias("customer_id"))


def _rows_left(tables):
    parts = [rows.select(F.lit(name).alias("name"), "customer_id") for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("name").agg(
        F.count(F.lit(1)).alias("rows_left"), F.count_distinct("customer_id").alias("customers_left")
    )


@query
def purge_in_place(spark, folder):
    """The same purge within a store: only files that hold one of the suppliers are written again."""
    s = line_store(spark, folder).rewrite(shared_folder(spark))
    s.purge(_in_debt(spark, folder))
    tables = {
        "billing_window": s.windows(), "correction_epoch": s.corrections(), "event_log": s.log(),
        "stream_watermark": s.watermarks(), "window_receipt": s.receipts(),
    }
    return _rows_left(tables)


@query
def open_window_index(spark, folder):
    """Windows that are still open after both batches, from the index that seals read."""
    return late_store(spark, folder).still_open().select("window_key", "customer_id", "metric", "window_open_ms", "window_close_ms")


@query
def log_by_day(spark, folder):
    """What was admitted day by day in the middle of the month; the log's other days are not read."""
    rows = late_store(spark, folder).log_between(CUT_MS - 5 * DAY_MS, CUT_MS + 5 * DAY_MS)
    day = F.date_format("event_time", "yyyy-MM-dd").alias("day")
    return rows.groupBy(day).agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("quantity_micros").cast("decimal(28,0)")).cast("string").alias("micros"))


@query
def concurrent_ingest(spark, folder):
    """Four writers send all events at once into one store: its bill, and what became of the deliveries."""
    s = proofs.concurrent_ingest(spark, adapters.events_as_deliveries(spark, folder, DEEP_CUSTOMERS), shared_folder(spark), 4, WEEKLY, NOW_MS)
    seen = s.table("dispositions").groupBy("window_key").agg(
        F.count_if(F.col("disposition") == "accepted").alias("accepted"), F.count_if(F.col("disposition") == "deduped").alias("deduped"))
    return s.totals().join(seen, "window_key").select("window_key", "billed_total", "event_count", "sealed", "accepted", "deduped")


@query
def interleaved_writers(spark, folder):
    """The later half of the events is admitted, then another writer commits the earlier half with its seals, then the
    first tries to commit: it finds windows sealed under it and files what came too late."""
    early, late = late_batches(spark, folder)
    root = shared_folder(spark)
    other = store.MeteringStore(spark, root, DAILY)
    writer = proofs.Interrupted(spark, root, DAILY, between=lambda: other.ingest(early, NOW_MS, auto_seal=True))
    writer.ingest(late, NOW_MS, auto_seal=True)
    filed = other.corrections().groupBy("window_key").agg(F.count(F.lit(1)).alias("late"))
    return other.totals().join(filed, "window_key", "left").select(
        "window_key", "billed_total", "event_count", "sealed", F.coalesce("late", F.lit(0)).alias("late"))


@query
def store_of_many_batches(spark, folder):
    """Seven small batches into a store that merges after every third commit, sealed at the end."""
    rows = adapters.events_as_deliveries(spark, folder)
    part = F.pmod(F.conv(F.substring("event_id", 29, 8), 16, 10).cast("bigint"), F.lit(7))
    s = store.MeteringStore(spark, shared_folder(spark), DAILY, keep_dispositions=False, fold_every=3)
    for k in range(7):
        s.ingest(rows.where(part == k), NOW_MS)
    s.seal(NOW_MS)
    return s.totals().drop("window_open_ms", "window_close_ms")


@query
def scattered_ids(spark, folder):
    """Events under ids in no order of time; then all sign-ups once more, with other quantities: what became of each."""
    rows = adapters.events_as_deliveries(spark, folder)
    hashed = F.md5("event_id")
    parts = [F.substring(hashed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    rows = rows.withColumn("event_id", F.concat_ws("-", *parts))
    s = store.MeteringStore(spark, shared_folder(spark), DAILY)
    s.ingest(rows, NOW_MS)
    again = rows.where(F.col("metric") == "signup").withColumn("quantity", F.col("quantity") + 1)
    batch = s.ingest(again, NOW_MS)
    found = s.table("dispositions").where(F.col("batch_id") == batch).select("event_id", "disposition", "conflict")
    return found.join(s.corrections().select("event_id", "quantity_micros"), "event_id")


@query
def streams_and_customers(spark, folder):
    """The other outputs of the combined view: per customer its streams, windows, corrections among the latest, and watermarks."""
    s = late_store(spark, folder)
    view = reports.state_snapshot(s.totals(), s.watermarks(), s.corrections())
    count = F.count(F.lit(1))
    streams = view["streams"].groupBy("customer_id").agg(count.alias("streams"))
    windows = view["windows"].groupBy("customer_id").agg(count.alias("windows"))
    marks = view["watermarks"].groupBy("customer_id").agg(F.max("watermark_ms").alias("watermark_ms"))
    latest = view["corrections"].groupBy("customer_id").agg(count.alias("latest"))
    return view["customers"].join(streams, "customer_id").join(windows, "customer_id").join(marks, "customer_id").join(
        latest, "customer_id", "left").select("customer_id", "streams", "windows", "watermark_ms", F.coalesce("latest", F.lit(0)).alias("latest"))


@query
def windows_of_a_metric(spark, folder):
    """The window list of one metric with its place in key order."""
    rows = late_store(spark, folder).select_windows(metric="purchase")
    return in_order(rows, [], ["window_key"]).rows.select("window_key", "customer_id", "state", "position")


# -- receipts ------------------------------------------------------------------------------


def _leaves(s):
    return receipts.sealed_leaves(s.log, s.windows, s.settings)


@query
def merkle_roots_of_windows(spark, folder):
    s = weekly(spark, folder)
    leaves = _leaves(s)
    return merkle_roots(receipts.leaf_hashes(leaves.rows, WEEKLY), ["window_key"], leaves.largest, WEEKLY.domain)


@query
def receipt_signatures(spark, folder):
    e = receipts.leaf_hashes(events(spark, folder), DAILY)
    return e.select("event_id", receipts.signature(F.col("hash"), DAILY).alias("signature"))


@query
def receipts_of_windows(spark, folder):
    s = weekly(spark, folder)
    r = receipts.build_receipts(_leaves(s), WEEKLY, NOW_MS)
    return r.withColumn("billed_total_micros", F.col("billed_total_micros").cast("string"))


@query
def invoice_bundles(spark, folder):
    """Bundles written as JSON lines and read back, one row per leaf."""
    path = shared_folder(spark)
    bundle_files.write_bundles(weekly_books(spark, folder).bundles, path)
    b = bundle_files.read_bundles(spark, path)
    claims = b.select(F.col("receipt.windowKey").alias("window_key"), F.col("receipt.merkleRoot").alias("merkle_root"),
                      F.col("receipt.billedTotal").alias("billed_total"), F.col("receipt.mode").alias("mode"))
    return verify.bundle_leaves(b).join(claims, "window_key").select(
        "window_key", "position", F.col("eventId").alias("event_id"), F.col("eventTimeMs").alias("event_time_ms"),
        F.col("quantityMicros").alias("quantity_micros"), "mode", "merkle_root", "billed_total",
    )


@query
def verify_receipts(spark, folder):
    v = verify.verify_bundles(weekly_books(spark, folder).bundles, WEEKLY.domain, WEEKLY.receipt_key)
    return v.drop("parts_ok", "window_once")


@query
def verify_broken_bundles(spark, folder):
    """Bundles in parts of eight leaves; some without their first part, some without their last, some twice."""
    s = weekly(spark, folder)
    whole = receipts.bundles(weekly_books(spark, folder).receipts, _leaves(s).rows, bundle_leaves=8)
    customer, n, first = F.col("receipt.customerId"), F.col("receipt.eventCount"), F.col("firstLeaf")
    long = n > 8
    orphaned = (customer == "0") & long & (first == 0)
    cut_short = (customer == "1") & long & (first + 8 >= n)
    twice = whole.where(customer == "2")
    broken = whole.where(~orphaned & ~cut_short).unionByName(twice)
    v = verify.verify_bundles(broken, WEEKLY.domain, WEEKLY.receipt_key)
    return v.select("window_key", "parts_ok", "window_once", "ok")


@query
def verify_invoice(spark, folder):
    v = verify.verify_bundles(weekly_books(spark, folder).bundles, WEEKLY.domain, WEEKLY.receipt_key)
    return verify.verify_invoices(v, [], WEEKLY.domain)


@query
def invoice_root(spark, folder):
    """One root per customer over the recomputed roots of all its windows."""
    v = verify.verify_bundles(weekly_books(spark, folder).bundles, WEEKLY.domain, WEEKLY.receipt_key)
    return verify.verify_invoices(v, ["customer_id"], WEEKLY.domain)


@query
def tamper_detection(spark, folder):
    """The first leaf of every window changed: what the verifier still lets through."""
    changed = verify.tamper_first_leaf(weekly_books(spark, folder).bundles, "999999000000")
    v = verify.verify_bundles(changed, WEEKLY.domain, WEEKLY.receipt_key)
    return verify.tampered(v).select("window_key", "root_ok", "total_ok", "signature_ok", "recomputed_total_micros", "ok")


@query
def customer_invoices(spark, folder):
    return invoices.customer_invoices(weekly_books(spark, folder).receipts, WEEKLY)


# -- proofs --------------------------------------------------------------------------------


@query
def hostile_arrivals(spark, folder):
    return proofs.hostile_arrivals(events(spark, folder), "one", 0.25).select("event_id", "copy", "arrival")


@query
def replay_invariance(spark, folder):
    return proofs.replay_invariance(events(spark, folder, DEEP_CUSTOMERS), SEEDS, WEEKLY, NOW_MS)


@query
def parity_diff(spark, folder):
    """Bills of the first delivery per id against bills of the last: the windows that differ."""
    rows = lines(spark, folder)
    first = _first_lines(spark, folder)
    last = rows.groupBy("event_id").agg(F.max_by(
        F.struct("customer_id", "metric", "event_time_ms", "quantity_micros"), "arrival").alias("l")).select("event_id", "l.*")
    a = _total(totals.counter_totals(first, LINES))
    b = _total(totals.counter_totals(last, LINES))
    return parity.differences(a, b, "window_key", "billed_total")


@query
def crash_replay(spark, folder):
    return proofs.crash_replay(events(spark, folder, DEEP_CUSTOMERS), WEEKLY, NOW_MS)


@query
def redelivery_convergence(spark, folder):
    return proofs.redelivery_convergence(events(spark, folder, DEEP_CUSTOMERS), 6, WEEKLY, NOW_MS)


@query
def straggler_probe(spark, folder):
    """One late event into every sealed window: all are filed, no total moves."""
    s = daily(spark, folder)
    state = State(log=s.log, windows=s.windows, watermarks=s.watermarks)
    probe = check_deliveries(proofs.stragglers(s.windows, "77.25"), NOW_MS).drop("reject_reason")
    admission = ingest(probe, state, DAILY)
    before = totals.window_totals(s.log, s.windows, DAILY).select("window_key", F.col("billed_total").alias("before"))
    after = applied(state, admission)
    now = totals.window_totals(after.log, after.windows, DAILY).select("window_key", F.col("billed_total").alias("after"))
    filed = admission.corrections.select("window_key", "event_id", "reason", "event_time_ms", "quantity_micros")
    return filed.join(before, "window_key").join(now, "window_key")


@query
def tie_sensitivity(spark, folder):
    return proofs.tie_sensitivity(_first_lines(spark, folder), SEEDS, LINES)


# -- streaming -----------------------------------------------------------------------------


@query
def stream_metering(spark, folder):
    """Shuffled and doubled events, delivered as files, metered batch by batch and sealed at the end."""
    base = shared_folder(spark)
    arrivals = proofs.hostile_arrivals(adapters.events_as_deliveries(spark, folder), "one", 0.25).drop("copy")
    arrivals.repartitionByRange("arrival").write.parquet(f"{base}/incoming")
    schema = arrivals.schema
    books = store.MeteringStore(spark, f"{base}/tables", DAILY)
    files = len(spark.read.parquet(f"{base}/incoming").inputFiles())
    incoming = deliveries.stream_parquet(spark, f"{base}/incoming", schema, max_files=-(-files // 2))
    start_metering(incoming, books, f"{base}/checkpoint", NOW_MS, auto_seal=False).awaitTermination()
    books.seal(NOW_MS)
    return books.totals().drop("window_open_ms", "window_close_ms")


@query
def stream_then_seal_then_stream(spark, folder):
    """One store, three sources of change: a batch load, a stream, a seal, and the stream again from its checkpoint.

    The first third of the ids comes as a batch, the second as the stream's first files, the last after the
    seal; what the seal made late is filed, as each batch seals at its end.
    """
    base = shared_folder(spark)
    arrivals = adapters.events_as_deliveries(spark, folder)
    third = F.pmod(F.conv(F.substring("event_id", 29, 8), 16, 10).cast("bigint"), F.lit(3))
    books = store.MeteringStore(spark, f"{base}/tables", DAILY)
    books.ingest(arrivals.where(third == 0), NOW_MS)
    for part in (1, 2):
        arrivals.where(third == part).write.mode("append").parquet(f"{base}/incoming")
        incoming = deliveries.stream_parquet(spark, f"{base}/incoming", arrivals.schema, max_files=1_000_000)
        start_metering(incoming, books, f"{base}/checkpoint", NOW_MS, auto_seal=part == 2).awaitTermination()
        if part == 1:
            books.seal(NOW_MS)
    late = books.corrections().groupBy("window_key").agg(F.count(F.lit(1)).alias("late"))
    return books.totals().join(late, "window_key", "left").select(
        "window_key", "billed_total", "event_count", "sealed", F.coalesce("late", F.lit(0)).alias("late")
    )
