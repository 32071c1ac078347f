"""Several writers, long-lived stores, and what a call reads of an old store."""

import math
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sealbook.operators.durable import durable
from sealbook.plans.proofs import Interrupted
from sealbook.settings import DAY_MS, Settings
from sealbook.sources.commits import CommitLog, Part
from sealbook.sources.files import Files
from sealbook.sources.store import MeteringStore
from tests.conftest import BASE, NOW

S = Settings()
KIND = "event_id string, customer_id string, metric string, quantity string, event_time_ms long, ingest_time_ms long, payload string, arrival long"


def batch(spark, rows):
    """Deliveries from (id, customer, quantity, time)."""
    return spark.createDataFrame([(i, c, "api_calls", str(q), t, t, None, n) for n, (i, c, q, t) in enumerate(rows)], KIND)


def bill(store):
    return sorted((r.window_key, r.billed_total, r.event_count, r.sealed) for r in store.totals().collect())


def scanned(df):
    """Rows that the scans of the log gave in a query, before any filter."""
    df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        log = name == "FileSourceScanExec" and "/event_log/" in plan.relation().location().rootPaths().mkString(",")
        own = plan.metrics().get("numOutputRows").get().value() if log else 0
        return own + sum(walk(plan.children().apply(k)) for k in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_one_writer_wins_each_number(spark, tmp_path):
    def write(k):
        log = CommitLog(Files(spark, str(tmp_path)), fold_every=4)
        won = []
        while len(won) < 10:
            if after := log.commit(log.snapshot(), {"adds": {"t": [f"{k}-{len(won)}"]}}):
                won.append(after.version)
        return won

    with ThreadPoolExecutor(6) as pool:
        won = sorted(n for found in pool.map(write, range(6)) for n in found)
    assert won == list(range(60))
    parts = CommitLog(Files(spark, str(tmp_path)), fold_every=4).snapshot().of("t")
    assert sorted(p.folder for p in parts) == sorted(f"{k}-{n}" for k in range(6) for n in range(10))
    assert [p.first for p in parts] == list(range(60))


def test_two_thousand_commits_are_few_files_and_few_parts(spark, tmp_path):
    log, k = CommitLog(Files(spark, str(tmp_path)), fold_every=8), 8
    made, most_lines, most_parts = {}, 0, 0

    def write(table, parts):
        folder = f"m{len(made)}"
        made[folder] = [x for p in parts for x in made.get(p.folder, [p.folder])]
        return folder

    for n in range(2000):
        now = log.snapshot()
        most_lines, most_parts = max(most_lines, log.lines_read), max(most_parts, len(now.of("log")))
        after = log.commit(now, {"adds": {"log": [f"f{n}"], "index": [f"i{n}"]}, "sources": [("stream", n)]})
        while groups := log.due_merges(after, {"index"}):
            after = log.merge(groups, write)
    now = log.snapshot()
    assert most_lines <= k + 1 and most_parts <= k * (1 + math.log(2000, k)) and len(now.of("index")) <= k + 1
    assert sorted(x for p in now.of("log") for x in made.get(p.folder, [p.folder])) == sorted(f"f{n}" for n in range(2000))
    assert [(s, a, b) for s, a, b, _ in now.sources] == [("stream", 0, 1999)]
    assert now.holds("stream", 1234) is not None and now.holds("stream", 2000) is None and now.holds("other", 3) is None


def test_a_merge_gives_way_to_a_change_of_its_parts(spark, tmp_path):
    log = CommitLog(Files(spark, str(tmp_path)), fold_every=2)
    for n in range(2):
        log.commit(log.snapshot(), {"adds": {"t": [f"f{n}"]}})
    (group,) = log.due_merges(log.snapshot(), set())

    def write(table, parts):  # while it writes, another commit comes, then a purge
        log.commit(log.snapshot(), {"adds": {"t": ["late"]}})
        return "m0"

    assert log.merge([group], write).of("t")[-1].folder == "m0"
    (group,) = [[p for p in log.snapshot().of("t") if p.folder == "late"]]
    assert log.merge([group], lambda *_: log.commit(log.snapshot(), {"hides": {"late": ["x"]}, "purge": True}) and "m1") is None
    assert log.snapshot().of("t")[0] == Part("t", "late", 2, 2, 0, ("x",)) and log.snapshot().purges == 1


def test_files_elsewhere_than_on_local_disk(spark, tmp_path):
    """The way through Hadoop's file systems, here taken for a local folder."""
    files = Files(spark, str(tmp_path))
    files.local = None
    assert files.read("a/b.json") is None and files.names("a") == []
    assert files.create("a/b.json", "één") and not files.create("a/b.json", "two")
    assert files.read("a/b.json") == "één" and files.names("a") == ["b.json"]
    files.put("a/c", "1")
    files.put("a/c", "2")
    assert files.read("a/c") == "2" and files.exists("a/c") and files.age_ms("a/c", 10**15) > 0
    files.delete("a")
    assert not files.exists("a/c")


ROWS = [(f"e{i}", f"c{i % 2}", 1 + i, BASE + i * 4000) for i in range(12)]


def test_six_ingests_at_once_bill_like_one(spark, tmp_path):
    one = MeteringStore(spark, str(tmp_path / "one"), S)
    one.ingest(batch(spark, ROWS), NOW, auto_seal=True)
    root = str(tmp_path / "six")
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda _: MeteringStore(spark, root, S).ingest(batch(spark, ROWS), NOW), range(6)))
    six = MeteringStore(spark, root, S)
    six.seal(NOW)
    assert sorted(numbers) == list(range(6)) and bill(six) == bill(one)
    counts = {r.disposition: r.deliveries for r in six.table("dispositions").groupBy("disposition").agg(F.count("*").alias("deliveries")).collect()}
    assert counts == {"accepted": 12, "deduped": 60} and six.log().count() == 12
    assert six.receipts().count() == one.receipts().count() == len({r.window_key for r in six.receipts().collect()})


def test_a_lost_race_is_looked_at_again(spark, tmp_path):
    """Between a call's admission and its commit another writer sends one of its ids, and seals a window it aims at."""
    first = [("a", "c", 5, BASE), ("x", "c", 7, BASE + 40_000)]
    mine = [("a", "c", 6, BASE), ("b", "c", 1, BASE + 1), ("d", "c", 2, BASE + 45_000), ("e", "other", 3, BASE)]
    root = str(tmp_path / "t")
    other = lambda: MeteringStore(spark, root, S).ingest(batch(spark, first), NOW, auto_seal=True)
    late = Interrupted(spark, root, S, between=other)
    assert late.ingest(batch(spark, mine), NOW, auto_seal=True) == 1
    serial = MeteringStore(spark, str(tmp_path / "s"), S)
    for rows in (first, mine):
        serial.ingest(batch(spark, rows), NOW, auto_seal=True)
    what = lambda s: sorted((r.event_id, r.reason, r.window_key) for r in s.corrections().collect())
    assert what(late) == what(serial) == [("a", "payload_conflict", f"c:api_calls:{BASE}"), ("b", "late_after_seal", f"c:api_calls:{BASE}")]
    assert bill(late) == bill(serial) and late.log().count() == 4
    # What the first try wrote is there, and never seen; a vacuum takes it away.
    assert late.vacuum(0, NOW * 10) > 0 and bill(late) == bill(serial)


def test_a_race_that_changes_nothing_keeps_what_was_written(spark, tmp_path, monkeypatch):
    root, admitted = str(tmp_path / "t"), []
    monkeypatch.setattr(MeteringStore, "_admit", lambda self, *a, f=MeteringStore._admit: admitted.append(1) or f(self, *a))
    other = lambda: MeteringStore(spark, root, S).ingest(batch(spark, [("y", "c", 1, BASE), ("z", "q", 1, BASE)]), NOW)
    late = Interrupted(spark, root, S, between=other)
    assert late.ingest(batch(spark, [("w", "c", 2, BASE + 5)]), NOW) == 1
    assert len(admitted) == 2  # one each
    # Both opened the same window; it is there once.
    assert late.table("opened").count() == late.windows().count() == 2 and late.still_open().count() == 2


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    """Five batches with seals, in a store that merges every three commits and in one that never does."""
    stores = [MeteringStore(spark, str(tmp_path_factory.mktemp("m") / str(k)), S, fold_every=k) for k in (3, 1000)]
    for n in range(5):
        rows = [(f"e{n}-{i}", f"c{i}", n + i, BASE + n * 10_000 + i) for i in range(3)] + [("e0-0", "c0", n, BASE)]
        for s in stores:
            s.ingest(batch(spark, rows), NOW, auto_seal=n != 3, source="s", source_batch=n)
    return stores


def test_merged_parts_say_the_same(spark, merged):
    few, many = merged
    assert max(len(few.snapshot().of(t)) for t in ("event_log", "opened", "seals", "open_index")) < 5 == len(many.snapshot().of("event_log"))
    same = lambda f: sorted(map(tuple, f(few).collect())) == sorted(map(tuple, f(many).collect()))
    for read in (lambda s: s.totals(), lambda s: s.log(), lambda s: s.windows(), lambda s: s.watermarks(), lambda s: s.still_open(),
                 lambda s: s.receipts().drop("created_at_ms"), lambda s: s.corrections().drop("correction_id"), lambda s: s.table("dispositions").drop("batch_id")):
        assert same(read)
    assert sorted(r.window_key for r in few.still_open().collect()) == sorted(r.window_key for r in few.windows().where("state = 'open'").collect())
    # Commits of merges take numbers too, so versions differ, but each batch is found under the commit that brought it.
    assert few.table("event_log").groupBy("batch_id").count().count() == 5
    assert few.log(0).count() == 3
    # A source's batches stay known, before and after a fold.
    assert few.ingest(batch(spark, [("new", "c", 1, BASE)]), NOW, source="s", source_batch=2) <= few.last_batch() and few.log().count() == 15


def test_a_seal_reads_open_windows_and_not_all(spark, merged):
    few, _ = merged
    few._merge_small()
    index = few._read(few.snapshot(), "open_index")
    merged_rows = few._parts("open_index", [p for p in few.snapshot().of("open_index") if p.tier])
    assert {r.sign for r in merged_rows.collect()} == {1} and few.windows().count() == 15
    assert merged_rows.count() < 12 and index.count() < 2 * 15


def test_days_that_no_sealed_window_touches_are_not_read(spark, tmp_path, capsys):
    s = MeteringStore(spark, str(tmp_path), Settings(window_ms=DAY_MS, grace_ms=0))
    rows = [(f"e{d}-{i}", f"c{i}", 1, d * DAY_MS + i) for d in range(20_000, 20_030) for i in range(4)]
    s.ingest(batch(spark, rows), NOW)
    sealed = s.windows().where((F.col("window_open_ms") >= 20_003 * DAY_MS) & (F.col("window_open_ms") < 20_005 * DAY_MS) | (F.col("window_open_ms") == 20_020 * DAY_MS))
    sealed = durable(sealed)  # as a call of seal has them
    log = s.log_of(sealed)
    log.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "dynamicpruning" in plan
    assert log.count() == 12 and scanned(log) == 12
    between = s.log_between(20_007 * DAY_MS, 20_008 * DAY_MS)
    assert between.count() == 4 and scanned(between) == 4
    # A window of several days is cut by as many.
    assert MeteringStore(spark, str(tmp_path), Settings(window_ms=30 * DAY_MS)).days == 30


def test_scattered_ids_leave_most_of_the_log_unread(spark, tmp_path):
    s = MeteringStore(spark, str(tmp_path), Settings(window_ms=DAY_MS, grace_ms=0))
    ids = [str(uuid.uuid5(uuid.NAMESPACE_OID, str(k))) for k in range(4800)]
    s.ingest(batch(spark, [(i, "c", 1, (20_000 + k % 24) * DAY_MS + k) for k, i in enumerate(ids)]), NOW)
    again = [(ids[50], "c", 2, 20_002 * DAY_MS + 50)] + [(str(uuid.uuid5(uuid.NAMESPACE_OID, f"new{k}")), "c", 1, 20_000 * DAY_MS + k) for k in range(40)]
    rows = batch(spark, again)
    log = s._state_near(rows, s._span(rows), s.snapshot()).log
    assert [r.event_id for r in log.collect()] == [ids[50]]
    assert scanned(log) <= 4800 / 10
    assert scanned(s.log().where(F.col("event_id").between(min(a[0] for a in again), max(a[0] for a in again)))) == 4800
    s.ingest(rows, NOW)
    assert {r.disposition: r.deliveries for r in s.counts(1).collect()} == {"accepted": 40, "deduped": 1}
    assert [r.event_id for r in s.corrections().collect()] == [ids[50]]


def test_a_purge_writes_only_files_that_hold_a_customer(spark, tmp_path):
    s = MeteringStore(spark, str(tmp_path), S)
    for n, c in enumerate(["keep", "gone", "keep", "both"]):
        rows = [(f"{n}-{i}", c if c != "both" else ["keep", "gone"][i % 2], 1, BASE + n * 100 + i) for i in range(4)]
        s.ingest(batch(spark, rows + rows[:1]), NOW)
    s.ingest(batch(spark, [("far", "keep", 1, BASE + 50_000), ("far2", "gone", 1, BASE + 50_000)]), NOW, auto_seal=True)
    before, total = {p.folder for p in s.snapshot().of("event_log")}, bill(s)
    files = lambda: set(s.log().inputFiles())
    old = files()
    assert s.purge(spark.createDataFrame([("gone",)], "customer_id string")) == 5
    for rows in (s.log(), s.windows(), s.watermarks(), s.receipts(), s.still_open(), s.table("dispositions")):
        assert {r.customer_id for r in rows.select("customer_id").collect()} == {"keep"}
    assert bill(s) == [b for b in total if b[0].startswith("keep")]
    now = s.snapshot().of("event_log")
    assert before < {p.folder for p in now} and sum(bool(p.hidden) for p in now) == 3
    # The hidden files go with a vacuum; those without the customer keep their names.
    assert s.vacuum(0, NOW * 10) >= 3
    left = files()
    assert len(old & left) == len(old) - 3 and bill(s) == [b for b in total if b[0].startswith("keep")]
    s.ingest(batch(spark, [("0-0", "keep", 1, BASE), ("1-0", "gone", 1, BASE)]), NOW)
    assert {r.disposition: r.deliveries for r in s.counts(6).collect()} == {"deduped": 1, "accepted": 1}


def test_purged_files_are_written_without_a_shuffle(spark, tmp_path):
    """What a purge leaves of the other tables than the log is written where it was read: one stage each, in the order of the files."""
    s, stages = MeteringStore(spark, str(tmp_path / "s"), S), {}
    s.ingest(batch(spark, [(f"{k:03d}", "gone" if k % 3 == 0 else "keep", 1, BASE + 20_000 * k) for k in range(30)]), NOW, auto_seal=True)
    write, tracker = s._write, spark.sparkContext.statusTracker()

    def counted(name, rows, **how):
        group = f"purge {name} {tmp_path}"
        kept = durable(rows)
        spark.sparkContext.setJobGroup(group, name)
        folder = write(name, kept, **how)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages[name] = sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(group))
        return folder

    s._write = counted
    s.purge(spark.createDataFrame([("gone",)], "customer_id string"))
    assert {name for name, n in stages.items() if n != 1} <= {"event_log"} and len(stages) >= 6
    assert s.windows().count() == 20 and {r.customer_id for r in s.log().collect()} == {"keep"}
    assert s.still_open().count() == 1 and s.receipts().count() == 19
