"""State tables as Parquet folders that commits name.

A call writes parts, folders under ids of their own, and then tries to create the next commit, which names them
(`sealbook.sources.commits`). So what a lost call leaves behind is never seen, and any number of writers may call at a time: one
that loses the race for the next commit looks at what won. If that has an id, a seal or a correction that its own deliveries
meet, they are admitted anew; if not, what it has written stands. A call of a source with batches of its own (a
stream) also notes which batch it was, and is skipped if that batch of that source is committed already.

Three things keep the cost of a call from following the age of the store: small parts are merged as they add up; open windows
have a table of their own, in which an opened and its sealed window cancel out when merged; and the log is
cut by day of the event and carries Bloom filters of its ids.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, StringType, StructField, StructType

from sealbook import schemas
from sealbook.functions.windows import STREAM, window_close, with_window
from sealbook.operators.durable import Scratch
from sealbook.operators.ingest import (
    WINDOW_COLUMNS,
    State,
    ingest,
    distinct_windows,
    ingest_counts,
    insert_if_absent,
    open_windows,
)
from sealbook.operators.receipts import build_receipts, bundles, sealed_leaves
from sealbook.operators.reports import corrections_of
from sealbook.operators.sealing import seal_due_windows, select_windows
from sealbook.operators.totals import totals_for_keys, window_totals
from sealbook.operators.validate import check_deliveries, normal_id
from sealbook.operators.watermarks import stream_watermarks
from sealbook.settings import DAY_MS, Settings
from sealbook.sources.commits import CommitLog, Part, Snapshot
from sealbook.sources.files import Files

_SEAL_COLUMNS = ["window_key", "window_open_ms", "sealed_at_ms", "sealed_watermark_ms"]

_OPENED = StructType([f for f in schemas.BILLING_WINDOW.fields if f.name in WINDOW_COLUMNS])

_TABLES: dict[str, StructType] = {
    "event_log": StructType([*schemas.EVENT_LOG, StructField("event_day", IntegerType())]),
    "opened": _OPENED,
    "seals": StructType([f for f in schemas.BILLING_WINDOW.fields if f.name in _SEAL_COLUMNS]),
    # Open windows: one row as a window opens, and one with sign -1 as it is sealed.
    "open_index": StructType([*_OPENED, StructField("sign", ByteType())]),
    "watermarks": schemas.STREAM_WATERMARK,
    "corrections": schemas.CORRECTION,
    "receipts": schemas.RECEIPT,
    "dispositions": StructType().add("event_id", "string").add("customer_id", "string").add("window_key", "string")
    .add("disposition", "string").add("conflict", "boolean"),
    "rejects": StructType([*schemas.DELIVERY, StructField("reject_reason", StringType())]),
}

#: Tables of which a merge leaves one row per key, so that they are merged into one part each time.
_WHOLE = {"open_index", "watermarks"}

#: A batch of up to so many ids asks the log for exactly those, which Bloom filters answer.
FEW_IDS = 5_000
#: A batch of up to so many deliveries has its windows looked up in the registry by a broadcast.
FEW_WINDOWS = 100_000
#: Days up to this number are broadcast to prune the log.
FEW_DAYS = 20_000



def _bloom(ids: int) -> dict[str, str]:
    """Writer options for Bloom filters of files with about so many ids; FEW_IDS others then meet a file once in twenty times."""
    return {
        "parquet.bloom.filter.enabled#event_id": "true",
        "parquet.bloom.filter.fpp#event_id": "0.00001",
        "parquet.bloom.filter.expected.ndv#event_id": str(min(1_000_000, max(1_000, ids))),
        "parquet.bloom.filter.max.bytes": str(8 << 20),
    }


@dataclass(frozen=True)
class _Span:
    """How many deliveries a batch has, and from where to where they reach."""

    n: int
    first_id: str
    last_id: str
    first_open: int
    last_open: int
    days: int


@dataclass(frozen=True)
class _Written:
    """Parts written by a call and not yet committed, by table."""

    parts: dict[str, list[str]]

    def plus(self, **more: str) -> _Written:
        return _Written(self.parts | {name: [*self.parts.get(name, []), folder] for name, folder in more.items()})

    def without(self, *names: str) -> _Written:
        return _Written({name: folders for name, folders in self.parts.items() if name not in names})


def clock_ms() -> int:
    return time.time_ns() // 1_000_000


class MeteringStore:
    """The tables under one folder, with the calls that change them."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings, keep_dispositions: bool = True, fold_every: int = 16):
        self.spark = spark
        self.root = root
        self.settings = settings
        self.keep_dispositions = keep_dispositions
        self.files = Files(spark, root)
        self.commit_log = CommitLog(self.files, fold_every)
        # The log is cut by day, or where windows are longer by as many days as they have.
        self.days = 30 if settings.window_ms == "month" else max(1, settings.window_ms // DAY_MS)

    def _day(self, t) -> Column:
        """The first day (since the epoch, in UTC) of the part of the log that a time belongs to."""
        return (F.floor(t / F.lit(DAY_MS * self.days)) * self.days).cast("int")

    def _between(self, first_ms: int, end_ms: int) -> Column:
        """Which parts of the log hold the times from ``first_ms`` up to ``end_ms``."""
        first, last = (t // (DAY_MS * self.days) * self.days for t in (first_ms, end_ms - 1))
        return F.col("event_day").between(first, last)

    # -- reading ---------------------------------------------------------------------------

    def reset(self) -> MeteringStore:
        """Drop all rows: every table becomes empty. A new store does not need it."""
        for name in ("folds", "commits", *_TABLES):
            self.files.delete(name)
        return self

    def snapshot(self) -> Snapshot:
        """The parts of all tables after the last commit."""
        return self.commit_log.snapshot()

    def last_batch(self) -> int:
        """The last commit; -1 before the first."""
        return self.snapshot().version

    def _empty(self, name: str) -> DataFrame:
        # Known to be empty when a query is planned, so that joins with it fall away.
        fields = [*_TABLES[name], StructField("batch_id", LongType())]
        return self.spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])

    def _parts(self, name: str, parts: list[Part]) -> DataFrame:
        """Rows of the given parts with their ``batch_id``: by the commit that named the part, or, where merged, as written."""
        base, frames = f"{self.root}/{name}", []
        for fresh in (True, False):
            mine = [p for p in parts if (p.tier == 0) == fresh]
            if not mine:
                continue
            rows = self._alike(name, mine)
            if hidden := [h for p in mine for h in p.hidden]:
                rows = rows.where(~F.col("_metadata.file_path").isin(hidden))
            frames.append(rows.select(*_TABLES[name].names, "batch_id"))
        return reduce(DataFrame.unionByName, frames) if frames else self._empty(name)

    def _alike(self, name: str, parts: list[Part]) -> DataFrame:
        """All rows of parts that are all fresh or all merged."""
        base, fresh = f"{self.root}/{name}", parts[0].tier == 0
        more = [StructField("part", StringType())] if fresh else [StructField("batch_id", LongType())]
        read = self.spark.read.schema(StructType([*_TABLES[name], *more])).option("basePath", base)
        rows = read.parquet(*[f"{base}/part={p.folder}" for p in parts])
        if not fresh:
            return rows
        number = F.create_map(*[F.lit(x) for p in parts for x in (p.folder, p.first)])
        return rows.withColumn("batch_id", number[F.col("part")].cast("bigint"))

    def _read(self, snapshot: Snapshot, name: str, own: _Written | None = None, since: int = -1, upto: int | None = None) -> DataFrame:
        """A table as of a snapshot and what a call has written, ``own``; only commits after ``since``, up to ``upto``."""
        upto = snapshot.version if upto is None else upto
        parts = [p for p in snapshot.of(name) if p.last > since and p.first <= upto]
        cut = any(p.tier and (p.first <= since or p.last > upto) for p in parts)
        parts += [Part(name, folder, snapshot.version + 1, snapshot.version + 1) for folder in (own.parts.get(name, []) if own else [])]
        rows = self._parts(name, parts)
        number = F.col("batch_id")
        return rows.where((number > since) & ((number <= upto) | (number > snapshot.version))) if cut else rows

    def table(self, name: str, upto: int | None = None) -> DataFrame:
        """A table as of a commit. ``open_index`` and ``watermarks`` lose older versions as they are merged."""
        rows = self._read(self.snapshot(), name, upto=upto)
        return rows.drop("event_day")

    def log(self, upto: int | None = None) -> DataFrame:
        return self.table("event_log", upto).drop("batch_id")

    def log_between(self, first_ms: int, end_ms: int) -> DataFrame:
        """The log from one instant up to another; the folders of other days are not read."""
        t = F.col("event_time_ms")
        rows = self._read(self.snapshot(), "event_log").where(self._between(first_ms, end_ms) & (t >= first_ms) & (t < end_ms))
        return rows.drop("batch_id", "event_day")

    def windows(self, upto: int | None = None) -> DataFrame:
        """Every window with its state: what was opened, and whether a seal was written for it."""
        return self._windows(self.snapshot(), upto)

    def _windows(self, snapshot: Snapshot, upto: int | None = None) -> DataFrame:
        opened, seals = (self._read(snapshot, name, upto=upto).drop("batch_id") for name in ("opened", "seals"))
        return _with_seals(opened, seals)

    def still_open(self) -> DataFrame:
        """The windows that are not sealed, from the index of open windows: sealed ones are not read."""
        return _still_open(self._read(self.snapshot(), "open_index")).drop("batch_id")

    def watermarks(self, upto: int | None = None) -> DataFrame:
        """Batches append what they saw; the maximum is the watermark, so it never goes back."""
        return _latest(self.table("watermarks", upto)).drop("batch_id")

    def corrections(self, upto: int | None = None) -> DataFrame:
        return self.table("corrections", upto).drop("batch_id")

    def receipts(self, upto: int | None = None) -> DataFrame:
        return self.table("receipts", upto).drop("batch_id")

    def state(self, upto: int | None = None) -> State:
        snapshot = self.snapshot()
        if snapshot.version < 0 or (upto is not None and upto < 0):
            return State()
        return self._state(snapshot, upto)

    def _state(self, snapshot: Snapshot, upto: int | None = None) -> State:
        log, marks, corrections, receipts = (self._read(snapshot, n, upto=upto) for n in ("event_log", "watermarks", "corrections", "receipts"))
        return State(
            log=log.drop("batch_id", "event_day"),
            windows=self._windows(snapshot, upto),
            watermarks=_latest(marks).drop("batch_id"),
            corrections=corrections.drop("batch_id"),
            receipts=receipts.drop("batch_id"),
        )

    def totals(self) -> DataFrame:
        """Totals and window state from one version."""
        s = self.snapshot()
        return window_totals(self._read(s, "event_log").drop("batch_id", "event_day"), self._windows(s), self.settings)

    def bundles(self) -> DataFrame:
        s = self.snapshot()
        leaves = sealed_leaves(self._read(s, "event_log").drop("batch_id", "event_day"), self._windows(s), self.settings)
        return bundles(self._read(s, "receipts").drop("batch_id"), leaves.rows)

    # -- one window, one stream ------------------------------------------------------------

    def _window(self, key: str, upto: int) -> tuple[DataFrame, DataFrame]:
        """The registry row of a window, and the log rows of its stream and span.

        The key's parts become conditions on stored columns, which the scans push down; of the log only the
        window's days are read.
        """
        parts = key.rsplit(":", 2)
        s = self.snapshot()
        window, log = self._windows(s, upto).where(F.col("window_key") == key), self._read(s, "event_log", upto=upto).drop("batch_id")
        if len(parts) < 3 or not parts[2].lstrip("-").isdigit():
            return window, log.where(F.lit(False)).drop("event_day")
        here = (F.col("customer_id") == parts[0]) & (F.col("metric") == parts[1])
        opened = F.lit(int(parts[2])).cast("bigint")
        end = self.spark.range(1).select(window_close(opened, self.settings.window_ms)).first()[0]
        t, days = F.col("event_time_ms"), self._between(int(parts[2]), end)
        return window.where(here), log.where(days & here & (t >= int(parts[2])) & (t < end)).drop("event_day")

    def total(self, key: str) -> DataFrame:
        """The total of one window; an unknown window is open and zero."""
        window, log = self._window(key, self.last_batch())
        asked = self.spark.createDataFrame([(key,)], "window_key string")
        return totals_for_keys(asked, window_totals(log, window, self.settings), self.settings)

    def bundle(self, key: str) -> DataFrame:
        """Receipt and leaves of one sealed window; no row before the seal."""
        upto = self.last_batch()
        window, log = self._window(key, upto)
        leaves = sealed_leaves(log, window, self.settings)
        return bundles(self.receipts(upto).where(F.col("window_key") == key), leaves.rows)

    def corrections_of(self, key: str) -> DataFrame:
        return corrections_of(self.corrections(), key)

    def watermark(self, customer_id: str, metric: str) -> DataFrame:
        here = (F.col("customer_id") == customer_id) & (F.col("metric") == metric)
        return _latest(self.table("watermarks").where(here)).drop("batch_id")

    def select_windows(self, customer_id: str | None = None, metric: str | None = None) -> DataFrame:
        """Windows in key order, of one customer or metric if asked."""
        return select_windows(self.windows(), customer_id, metric)

    # -- changing --------------------------------------------------------------------------

    def ingest(
        self,
        deliveries: DataFrame,
        now_ms: int | None = None,
        auto_seal: bool = False,
        strict: bool = False,
        source: str | None = None,
        source_batch: int | None = None,
    ) -> int:
        """Admit one batch of deliveries and return the number of its commit.

        Calls of several writers at a time come out as if made one after the other, in the order of their commits.
        A batch of a named source that is committed already is skipped, which makes redelivered
        streaming batches safe (the number is that of a commit by which it was in); nothing else is ever skipped. ``strict`` fails the
        whole batch on an invalid delivery; otherwise those go to ``rejects``. Without ``now_ms`` the clock is read.
        """
        with Scratch(self.spark) as scratch:
            number = self._ingest(deliveries, now_ms, auto_seal, strict, source, source_batch, scratch.keep)
        self._merge_small()
        return number

    def _ingest(self, deliveries, now_ms, auto_seal, strict, source, source_batch, keep) -> int:
        snapshot = self.snapshot()
        if (held := snapshot.holds(source, source_batch)) is not None:
            return held
        now_ms = clock_ms() if now_ms is None else now_ms
        # The source is read and parsed once; what follows reads the checked columns it needs. The row
        # number, fixed by being written, tells equal deliveries apart and keeps their order.
        place = F.struct(F.col("arrival").alias("given"), F.monotonically_increasing_id().alias("row"))
        checked = keep(check_deliveries(deliveries, now_ms).withColumn("arrival", place))
        rejects = checked.where(F.col("reject_reason").isNotNull())
        if strict and (bad := rejects.first()):
            raise ValueError(bad.reject_reason)
        valid = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
        span, always = self._span(valid), _Written({})
        if not rejects.isEmpty():
            rejects = rejects.withColumn("quantity", F.col("quantity").cast("string"))
            always = always.plus(rejects=self._write("rejects", rejects.select(*_TABLES["rejects"].names)))

        admitted, seen = None, snapshot
        while True:
            if admitted is None or self._meets(valid, seen, snapshot):
                admitted = self._admit(valid, span, snapshot, keep)
            seen = snapshot
            written = self._open(admitted, span, snapshot)
            if auto_seal:
                with Scratch(self.spark) as scratch:
                    written = self._seal(snapshot, now_ms, written, scratch.keep, only_touched=snapshot.version < 0 or snapshot.sealed)
            parts = {**written.parts, **always.parts}
            entry = {"at": now_ms, "adds": parts, "sealed": auto_seal, "sources": [] if source is None else [(source, source_batch)]}
            if (after := self._commit(snapshot, entry)) is not None:
                return after.version
            snapshot = self.snapshot()
            if (held := snapshot.holds(source, source_batch)) is not None:
                return held

    def _span(self, valid: DataFrame) -> _Span:
        t = F.col("event_time_ms")
        low, high = F.min("window_open_ms"), F.max("window_open_ms")
        n, *ends, first, last = with_window(valid, self.settings.window_ms).agg(
            F.count(F.lit(1)), F.min("event_id"), F.max("event_id"), low, high, F.min(self._day(t)), F.max(self._day(t))
        ).first()
        return _Span(n, *ends, 1 + (last - first) // self.days if n else 1)

    def _admit(self, valid: DataFrame, span: _Span, snapshot: Snapshot, keep) -> _Written:
        """Write what the deliveries add to the log, its watermarks, dispositions and corrections."""
        # Judged deliveries are written down without what no table holds.
        admission = ingest(valid, self._state_near(valid, span, snapshot), self.settings, lambda judged: keep(_stored(judged)))
        written = _Written({}).plus(event_log=self._write("event_log", admission.accepted, ids=4 * span.n // span.days))
        if self.keep_dispositions:
            written = written.plus(dispositions=self._write("dispositions", admission.dispositions.select(*_TABLES["dispositions"].names)))
        written = written.plus(corrections=self._write("corrections", admission.corrections))
        # From here on the batch is read back, not computed again.
        mine = self._read(Snapshot(), "event_log", written)
        return written.plus(watermarks=self._write("watermarks", stream_watermarks(mine, self.settings.grace_ms)))

    def _open(self, admitted: _Written, span: _Span, snapshot: Snapshot) -> _Written:
        """Write the windows that the admitted events are the first of."""
        mine = self._read(Snapshot(), "event_log", admitted)
        specs = distinct_windows(mine, self.settings.window_ms)
        held = self._read(snapshot, "opened")
        if span.n:
            held = held.where(F.col("window_open_ms").between(span.first_open, span.last_open))
        opened = self._write("opened", insert_if_absent(specs, held, ["window_key"], few_rows=span.n <= FEW_WINDOWS))
        fresh = self._read(Snapshot(), "opened", _Written({"opened": [opened]})).drop("batch_id")
        return admitted.plus(opened=opened, open_index=self._write("open_index", fresh.withColumn("sign", F.lit(1).cast("byte"))))

    def _meets(self, valid: DataFrame, seen: Snapshot, now: Snapshot) -> bool:
        """Whether commits since ``seen`` change what becomes of the deliveries."""
        if now.purges != seen.purges:
            return True
        ids = valid.select("event_id")
        for name in ("event_log", "corrections"):
            if not self._read(now, name, since=seen.version).join(ids, "event_id", "left_semi").isEmpty():
                return True
        keys = with_window(valid, self.settings.window_ms).select("window_key")
        return not self._read(now, "seals", since=seen.version).join(keys, "window_key", "left_semi").isEmpty()

    def _state_near(self, valid: DataFrame, span: _Span, snapshot: Snapshot) -> State:
        """The state that the batch can touch.

        Up to FEW_IDS ids are asked for one by one: the log's Bloom filters then leave most files unread, however
        scattered the ids are. A larger batch reads what lies between its lowest and highest id. Of the windows those
        sealed between the batch's first and last are read.
        """
        if snapshot.version < 0:
            return State()
        state = self._state(snapshot)
        if 0 < span.n <= FEW_IDS:
            ids = F.col("event_id").isin([r.event_id for r in valid.select("event_id").distinct().collect()])
        else:
            ids = F.col("event_id").between(span.first_id, span.last_id)
        sealed = self._read(snapshot, "seals").where(F.col("window_open_ms").between(span.first_open, span.last_open))
        return replace(
            state,
            log=state.log.where(ids),
            corrections=state.corrections.where(ids),
            windows=sealed.select("window_key", F.lit("sealed").alias("state")),
        )

    def seal(self, now_ms: int | None = None) -> DataFrame:
        """Seal due windows with their receipts, as a call of its own; returns the new seals."""
        now_ms = clock_ms() if now_ms is None else now_ms
        while True:
            snapshot = self.snapshot()
            with Scratch(self.spark) as scratch:
                written = self._seal(snapshot, now_ms, _Written({}), scratch.keep)
            if (after := self._commit(snapshot, {"at": now_ms, "adds": written.parts, "sealed": True})) is not None:
                break
        self._merge_small()
        return self._read(Snapshot(), "seals", written).drop("batch_id")

    def _seal(self, snapshot: Snapshot, now_ms: int, own: _Written, keep, only_touched: bool = False) -> _Written:
        """Write seals and receipts of the due windows, ``own`` included.

        Only the index of open windows is read, and of it what closes by the highest watermark. If nothing was due before the
        call, only streams whose watermark it may have moved can have due windows.
        """
        marks = self._read(snapshot, "watermarks", own)
        held = self._read(snapshot, "open_index", own)
        if only_touched:
            touched = self._read(Snapshot(), "watermarks", own).select(*STREAM)
            held, marks = (t.join(touched, STREAM, "left_semi") for t in (held, marks))
        latest = keep(_latest(marks))
        top = latest.agg(F.max("watermark_ms")).first()[0]
        held = held.where(F.lit(False) if top is None else F.col("window_close_ms") <= top)
        after = keep(seal_due_windows(open_windows(_still_open(held)), latest, now_ms).where("newly_sealed"))
        span = after.agg(F.min("window_open_ms"), F.max("window_close_ms")).first()
        if span[0] is None:
            return own
        own = own.plus(seals=self._write("seals", after.select(*_SEAL_COLUMNS)))
        own = own.plus(open_index=self._write("open_index", after.select(*WINDOW_COLUMNS, F.lit(-1).cast("byte").alias("sign"))))
        leaves = sealed_leaves(self._log_of(after, span, snapshot, own), after, self.settings)
        return own.plus(receipts=self._write("receipts", build_receipts(leaves, self.settings, now_ms).select(*_TABLES["receipts"].names)))

    def log_of(self, windows: DataFrame) -> DataFrame:
        """The log of the days that some windows touch; folders of other days stay unread."""
        snapshot = self.snapshot()
        span = windows.agg(F.min("window_open_ms"), F.max("window_close_ms")).first()
        if span[0] is None:
            return self._read(snapshot, "event_log").where(F.lit(False)).drop("batch_id", "event_day")
        return self._log_of(windows, span, snapshot)

    def _log_of(self, sealed: DataFrame, span, snapshot: Snapshot, own: _Written | None = None) -> DataFrame:
        """That of windows between two instants. The days come from the windows while the query runs (dynamic partition pruning)."""
        log = self._read(snapshot, "event_log", own).drop("batch_id")
        t = F.col("event_time_ms")
        log = log.where((t >= span[0]) & (t < span[1]) & self._between(*span))
        inside = F.sequence(self._day(F.col("window_open_ms")), self._day(F.col("window_close_ms") - 1), F.lit(self.days))
        days = sealed.where(F.col("window_open_ms") >= span[0]).select(F.explode(inside).alias("event_day")).distinct()
        if (span[1] - span[0]) // DAY_MS <= FEW_DAYS:
            days = F.broadcast(days)
        return log.join(days, "event_day", "left_semi").drop("event_day")

    # -- upkeep ----------------------------------------------------------------------------

    def _merge_small(self) -> None:
        """Merge parts that have added up. Nothing is lost if another writer does it first, or this one dies."""
        snapshot = self.snapshot()
        while groups := self.commit_log.due_merges(snapshot, _WHOLE):
            if (snapshot := self.commit_log.merge(groups, self._merged)) is None:
                return

    def _merged(self, name: str, parts: list[Part]) -> str:
        rows = self._parts(name, parts)
        if name == "open_index":
            rows = _still_open(rows).select(*WINDOW_COLUMNS, F.lit(1).cast("byte").alias("sign"), "batch_id")
        if name == "watermarks":
            rows = _latest(rows)
        if name != "event_log":
            return self._write(name, rows, merged=True)
        n, days = rows.agg(F.count(F.lit(1)), F.count_distinct("event_day")).first()
        return self._write(name, rows, merged=True, ids=4 * n // max(1, days))

    def purge(self, customers: DataFrame) -> int:
        """Take customers out of every table; returns the number of the commit.

        Only files that hold a row of theirs are written again, without those rows; all others stay as they are. The old files
        are no longer read from then on, and go with the next `vacuum`.
        """
        gone = customers.select(normal_id("customer_id").alias("customer_id")).distinct()
        while True:
            snapshot = self.snapshot()
            merged, hides = [], {}
            theirs = self._read(snapshot, "opened").join(gone, "customer_id", "left_semi").select("window_key").distinct()
            for name, schema in _TABLES.items():
                side, key = (gone, "customer_id") if "customer_id" in schema.names else (theirs, "window_key")
                for fresh in (True, False):
                    parts = [p for p in snapshot.of(name) if (p.tier == 0) == fresh]
                    if not parts:
                        continue
                    rows = self._with_file(name, parts)
                    hit = sorted(r[0] for r in rows.join(side, key, "left_semi").select("_file").distinct().collect())
                    if not hit:
                        continue
                    left = rows.where(F.col("_file").isin(hit)).join(side, key, "left_anti")
                    folder = self._write(name, left.select(*schema.names, "batch_id"), merged=True, moved=False)
                    merged.append((name, folder, min(p.first for p in parts), max(p.last for p in parts), 1))
                    for p in parts:
                        if mine := [h for h in hit if f"/part={p.folder}/" in h]:
                            hides[p.folder] = mine
            if (after := self._commit(snapshot, {"at": clock_ms(), "merged": merged, "hides": hides, "purge": True})) is not None:
                return after.version

    def _with_file(self, name: str, parts: list[Part]) -> DataFrame:
        """Rows with the file that they are in, as ``_file``."""
        rows = self._alike(name, parts).withColumn("_file", F.col("_metadata.file_path"))
        hidden = [h for p in parts for h in p.hidden]
        return rows.where(~F.col("_file").isin(hidden)) if hidden else rows

    def vacuum(self, older_than_ms: int = 7 * DAY_MS, now_ms: int | None = None) -> int:
        """Delete files that no commit names any more and that have not changed for that long; returns how many folders and files went.

        The time has to exceed that of the longest call, as a call names its parts only at its end.
        """
        now_ms, snapshot, n = clock_ms() if now_ms is None else now_ms, self.snapshot(), 0
        for name in _TABLES:
            live = {f"part={p.folder}" for p in snapshot.of(name)}
            for part in self.files.names(name):
                if part not in live and self.files.age_ms(f"{name}/{part}", now_ms) >= older_than_ms:
                    self.files.delete(f"{name}/{part}")
                    n += 1
            for p in snapshot.of(name):
                for file in p.hidden:
                    relative = f"{name}/part={p.folder}/" + file.split(f"/part={p.folder}/", 1)[1]
                    if self.files.exists(relative) and self.files.age_ms(relative, now_ms) >= older_than_ms:
                        self.files.delete(relative)
                        n += 1
        return n

    def rewrite(self, target: str, without_customers: DataFrame | None = None) -> MeteringStore:
        """Copy all tables to another folder as one commit; optionally leave customers out of all of them."""
        copy = MeteringStore(self.spark, target, self.settings, self.keep_dispositions, self.commit_log.fold_every).reset()
        snapshot = self.snapshot()
        written = _Written({})
        for name in _TABLES:
            rows = self._read(snapshot, name)
            if name == "watermarks":
                rows = _latest(rows)
            if name == "open_index":
                rows = _still_open(rows).withColumn("sign", F.lit(1).cast("byte"))
            if without_customers is not None:
                rows = _without(rows, without_customers, self._read(snapshot, "opened"))
            written = written.plus(**{name: copy._write(name, rows.select(*_TABLES[name].names))})
        # The batches of sources stay known, so that a stream that goes on skips what the copy holds.
        known = [(source, batch) for source, first, last, _ in snapshot.sources for batch in range(first, last + 1)]
        copy._commit(copy.snapshot(), {"at": 0, "adds": written.parts, "sealed": snapshot.sealed, "sources": known})
        return copy

    def counts(self, batch: int) -> DataFrame:
        return ingest_counts(self.table("dispositions").where(F.col("batch_id") == batch))

    def _write(self, name: str, rows: DataFrame, merged: bool = False, ids: int = FEW_IDS, moved: bool = True) -> str:
        """Write a part and return its folder; ``ids`` is about how many events a file of the log will hold.

        Merged rows of other tables than the log are dealt anew to files, unless they are not to be ``moved`` as their files are well dealt.
        """
        folder = f"p{uuid4().hex}"
        path = f"{self.root}/{name}/part={folder}"
        if name == "event_log":
            # Files of even size within a day, sorted by id.
            rows = rows.withColumn("event_day", self._day(F.col("event_time_ms")))
            rows = rows.hint("rebalance", "event_day").sortWithinPartitions("event_day", "event_id")
            rows.write.options(compression="zstd", **_bloom(ids)).partitionBy("event_day").parquet(path)
            return folder
        if merged:
            order = {"open_index": "window_close_ms", "opened": "window_open_ms", "seals": "window_open_ms"}.get(name)
            if moved:
                rows = rows.hint("rebalance") if order is None else rows.repartitionByRange(order)
            rows = rows if order is None else rows.sortWithinPartitions(order)
        rows.write.option("compression", "zstd").parquet(path)
        return folder

    def _commit(self, snapshot: Snapshot, entry: dict) -> Snapshot | None:
        """Try to make the parts of ``entry`` part of the store; None if another writer was faster."""
        return self.commit_log.commit(snapshot, entry)


def _stored(judged: DataFrame) -> DataFrame:
    """Judged deliveries without the places they arrived at, which are only needed to judge them."""
    if "filed" not in judged.columns:
        return judged
    return judged.drop("arrival").withColumn("filed", F.col("filed").dropFields("arrival"))


def _still_open(index: DataFrame) -> DataFrame:
    """Windows that were opened and not sealed; ``batch_id`` is the commit that opened them."""
    left = index.groupBy(*WINDOW_COLUMNS).agg(F.sum(F.col("sign").cast("int")).alias("left"), F.min("batch_id").alias("batch_id"))
    return left.where("left > 0").drop("left")


def _latest(marks: DataFrame) -> DataFrame:
    return marks.groupBy(*STREAM).agg(
        F.max("watermark_ms").alias("watermark_ms"),
        F.max_by("lateness_grace_ms", "batch_id").alias("lateness_grace_ms"),
        F.max("batch_id").alias("batch_id"),
    )


def _with_seals(opened: DataFrame, seals: DataFrame) -> DataFrame:
    return opened.join(seals.drop("window_open_ms"), "window_key", "left").select(
        *WINDOW_COLUMNS,
        F.when(F.col("sealed_watermark_ms").isNotNull(), "sealed").otherwise("open").alias("state"),
        "sealed_at_ms",
        "sealed_watermark_ms",
    )


def _without(rows: DataFrame, customers: DataFrame, windows: DataFrame) -> DataFrame:
    gone = customers.select(normal_id("customer_id").alias("customer_id")).distinct()
    if "customer_id" in rows.columns:
        return rows.join(gone, "customer_id", "left_anti").select(*rows.columns)
    theirs = windows.join(gone, "customer_id", "left_semi").select("window_key")
    return rows.join(theirs, "window_key", "left_anti").select(*rows.columns)


def purge_customers(tables: dict[str, DataFrame], customers: DataFrame) -> dict[str, DataFrame]:
    """Every table that names a customer, without the given ones, receipts included."""
    gone = customers.select(normal_id("customer_id").alias("customer_id")).distinct()
    return {name: rows.join(gone, "customer_id", "left_anti") for name, rows in tables.items()}

