import json

import pytest
from pyspark.sql import functions as F

from sealbook.operators.reports import corrections_of
from sealbook.operators.sealing import select_windows
from sealbook.operators.verify import verify_bundles
from sealbook.settings import Settings
from sealbook.sources.bundle_files import import_bundles, read_bundles, write_bundles
from sealbook.sources.deliveries import read_json, stream_json
from sealbook.sources.store import MeteringStore
from sealbook.sources.tagged_log import read_tagged_log, replay_state, write_tagged_log
from sealbook.streaming.micro_batch import start_metering
from tests.conftest import BASE, NOW

S = Settings()


def write_lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [
        {"eventId": i, "customerId": c, "metric": m, "quantity": q, "eventTime": t, "payload": {"n": n}}
        for n, (i, c, m, q, t) in enumerate(rows)
    ]
    (folder / name).write_text("".join(json.dumps(line) + "\n" for line in lines))


BATCH_1 = [
    ("a1", "c1", "api_calls", 100, BASE + 1000), ("a2", "c1", "api_calls", "50.5", BASE + 2000),
    ("a2", "c1", "api_calls", "51", BASE + 2000), ("a3", "c1", "api_calls", 999, BASE + 12_001),
    ("b1", "c2", "plan_tier", 3, BASE + 1), ("b2", "c2", "plan_tier", "x", BASE + 2), ("b3", "c2", "plan_tier", 4, BASE + 30_000),
]
BATCH_2 = [("a1", "c1", "api_calls", 100, BASE + 1000), ("a9", "c1", "api_calls", 777, BASE + 3000), ("b4", "c2", "plan_tier", 8, BASE + 31_000)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("store")
    write_lines(base / "in1", "1.json", BATCH_1)
    write_lines(base / "in2", "2.json", BATCH_2)
    s = MeteringStore(spark, str(base / "tables"), S)
    assert s.last_batch() == -1
    assert s.ingest(read_json(spark, str(base / "in1")), NOW, auto_seal=True) == 0
    before = {r.window_key: r.billed_total for r in s.totals().where("sealed").collect()}
    assert s.ingest(read_json(spark, str(base / "in2")), NOW + 1, auto_seal=True) == 1
    after = {r.window_key: r.billed_total for r in s.totals().collect()}
    assert before == {k: after[k] for k in before} and len(before) == 2
    s.base = base
    return s


def test_tables_after_two_batches(store):
    assert {r.disposition: r.deliveries for r in store.counts(0).collect()} == {"accepted": 5, "deduped": 1}
    assert {r.disposition: r.deliveries for r in store.counts(1).collect()} == {"accepted": 1, "deduped": 1, "quarantined": 1}
    reasons = {r.event_id: r.reason for r in store.corrections().collect()}
    assert reasons == {"a2": "payload_conflict", "a9": "late_after_seal"}
    assert [r.reject_reason for r in store.table("rejects").collect()] == ["not_a_quantity"]
    totals = {r.window_key: (r.billed_total, r.sealed) for r in store.totals().collect()}
    assert totals == {
        f"c1:api_calls:{BASE}": ("150.500000", True), f"c1:api_calls:{BASE + 10_000}": ("999.000000", False),
        f"c2:plan_tier:{BASE}": ("3.000000", True), f"c2:plan_tier:{BASE + 30_000}": ("8.000000", False),
    }
    assert [r.metric for r in select_windows(store.windows(), customer_id="c2").collect()] == ["plan_tier"] * 2
    assert corrections_of(store.corrections(), f"c1:api_calls:{BASE}").count() == 2
    assert store.log().where(F.get_json_object("payload", "$.n") == "0").count() >= 1


def test_a_batch_of_a_source_is_skipped_only_if_that_source_has_committed_it(spark, tmp_path):
    write_lines(tmp_path / "in1", "1.json", BATCH_1)
    write_lines(tmp_path / "in2", "2.json", BATCH_2)
    one, two = (read_json(spark, str(tmp_path / f"in{k}")) for k in (1, 2))
    s = MeteringStore(spark, str(tmp_path / "tables"), S)
    assert s.ingest(one, NOW, source="a", source_batch=0) == 0
    assert s.ingest(one, NOW, source="a", source_batch=0) == 0
    assert s.ingest(two, NOW, source="b", source_batch=0) == 1
    assert s.ingest(two, NOW, source="a", source_batch=1) == 2
    assert s.ingest(two, NOW) == 3
    assert {r.disposition: r.deliveries for r in s.counts(2).collect()} == {"deduped": 3}
    # A copy of the store still knows what its sources have delivered.
    copy = s.rewrite(str(tmp_path / "copy"))
    assert copy.ingest(two, NOW, source="a", source_batch=1) == 0 and copy.log().count() == s.log().count()


@pytest.mark.parametrize("crashed,next_call", [("ingest", "seal"), ("ingest", "ingest"), ("seal", "ingest"), ("seal", "seal")])
def test_what_a_crashed_call_leaves_is_never_published(spark, tmp_path, monkeypatch, crashed, next_call):
    write_lines(tmp_path / "in1", "1.json", BATCH_1)
    write_lines(tmp_path / "in2", "2.json", BATCH_2)
    s = MeteringStore(spark, str(tmp_path / "tables"), S)
    s.ingest(read_json(spark, str(tmp_path / "in1")), NOW)
    calls = {"ingest": lambda: s.ingest(read_json(spark, str(tmp_path / "in2")), NOW), "seal": lambda: s.seal(NOW)}
    with monkeypatch.context() as m:
        m.setattr(MeteringStore, "_commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            calls[crashed]()
    assert (s.last_batch(), s.log().count(), s.receipts().count()) == (0, 5, 0)
    calls[next_call]()
    sealed = next_call == "seal"
    assert s.receipts().count() == s.windows().where(F.col("state") == "sealed").count() == (2 if sealed else 0)
    assert s.log().count() == (5 if sealed else 7)
    assert {r.window_key for r in s.totals().collect()} == {r.window_key for r in s.windows().collect()}


def test_equal_lines_are_one_event_and_line_order_decides(spark, tmp_path):
    write_lines(tmp_path / "in", "1.json", [("e", "c", "api_calls", "9", BASE)] * 2)
    text = (tmp_path / "in" / "1.json").read_text().replace('"n": 1', '"n": 0')
    (tmp_path / "in" / "1.json").write_text(text + text.split("\n")[0].replace('"9"', '"10"') + "\nno json\n")
    s = MeteringStore(spark, str(tmp_path / "tables"), S)
    s.ingest(read_json(spark, str(tmp_path / "in")), NOW)
    assert {r.disposition: r.deliveries for r in s.counts(0).collect()} == {"accepted": 1, "deduped": 2}
    assert [r.quantity_micros for r in s.log().collect()] == [9_000_000]
    assert [(r.payload, r.reject_reason) for r in s.table("rejects").collect()] == [("no json", "no_event_id")]


def test_ids_are_compared_as_given(spark, tmp_path):
    write_lines(tmp_path / "in", "1.json", [("EV1", "Acme", "api_calls", 1, BASE), ("ev1", "acme", "api_calls", 2, BASE)])
    s = MeteringStore(spark, str(tmp_path / "tables"), S)
    s.ingest(read_json(spark, str(tmp_path / "in")), NOW)
    assert {r.customer_id for r in s.windows().collect()} == {"Acme", "acme"}
    left = s.rewrite(str(tmp_path / "left"), spark.createDataFrame([("Acme",)], "customer_id string"))
    assert [r.customer_id for r in left.log().collect()] == ["acme"]


def test_a_stream_goes_on_after_other_calls(spark, tmp_path):
    s = MeteringStore(spark, str(tmp_path / "tables"), S)
    write_lines(tmp_path / "batch", "0.json", [("z1", "c9", "api_calls", 4, BASE)])
    s.ingest(read_json(spark, str(tmp_path / "batch")), NOW)
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    for k, rows in enumerate((BATCH_1, BATCH_2)):
        write_lines(source, f"{k}.json", rows)
        start_metering(stream_json(spark, str(source)), s, checkpoint, NOW, auto_seal=False).awaitTermination()
        s.seal(NOW)
    assert s.last_batch() == 4
    assert {r.event_id for r in s.log().collect()} == {"z1", "a1", "a2", "a3", "b1", "b3", "b4"}
    assert {r.reason for r in s.corrections().collect()} == {"payload_conflict", "late_after_seal"}


def test_bundles_verify_from_files_in_all_shapes(spark, store, tmp_path):
    write_bundles(store.bundles(), str(tmp_path / "b"))
    b = read_bundles(spark, str(tmp_path / "b"))
    assert verify_bundles(b, S.domain, S.receipt_key).where("ok").count() == 2
    docs = [json.loads(line) for line in b.toJSON().collect()]
    for name, doc in {"one": docs[0], "list": docs, "invoice": {"seed": 1, "windows": docs}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
        got = import_bundles(spark, str(tmp_path / f"{name}.json"))
        assert verify_bundles(got, S.domain, S.receipt_key).where("ok").count() == (1 if name == "one" else 2)


def test_state_is_rebuilt_from_the_tagged_log(spark, store, tmp_path):
    state = store.state()
    write_tagged_log(state, str(tmp_path / "log"))
    lines = read_tagged_log(spark, str(tmp_path / "log"))
    assert {r.t for r in lines.select("t").distinct().collect()} == {"event", "seal", "correction", "receipt"}
    rebuilt = replay_state(lines, S)
    for name in ("log", "windows", "watermarks", "corrections", "receipts"):
        a, b = getattr(state, name), getattr(rebuilt, name)
        columns = sorted(a.columns)
        rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
        assert rows(a) == rows(b), name


def test_purge_and_merge(spark, store, tmp_path):
    gone = spark.createDataFrame([("c1",)], "customer_id string")
    left = store.rewrite(str(tmp_path / "left"), gone)
    for rows in (left.log(), left.windows(), left.watermarks(), left.receipts()):
        assert {r.customer_id for r in rows.select("customer_id").collect()} == {"c2"}
    assert left.corrections().count() == 0
    merged = store.rewrite(str(tmp_path / "merged"))
    assert sorted(map(tuple, merged.totals().collect())) == sorted(map(tuple, store.totals().collect()))
    assert merged.reset().log().count() == 0


def test_stream_gives_the_same_tables_and_goes_on_after_a_stop(spark, store, tmp_path):
    stream = MeteringStore(spark, str(tmp_path / "tables"), S)
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    write_lines(source, "1.json", BATCH_1)
    start_metering(stream_json(spark, str(source)), stream, checkpoint, NOW).awaitTermination()
    assert stream.last_batch() == 0
    write_lines(source, "2.json", BATCH_2)
    start_metering(stream_json(spark, str(source)), stream, checkpoint, NOW).awaitTermination()
    assert stream.last_batch() == 1
    assert sorted(map(tuple, stream.totals().collect())) == sorted(map(tuple, store.totals().collect()))
    same = ["event_id", "window_key", "quantity_micros", "reason"]
    assert sorted(map(tuple, stream.corrections().select(same).collect())) == sorted(
        map(tuple, store.corrections().select(same).collect())
    )


def test_strict_ingest_is_all_or_nothing(spark, tmp_path):
    write_lines(tmp_path / "in", "1.json", BATCH_1)
    s = MeteringStore(spark, str(tmp_path / "tables"), S)
    with pytest.raises(Exception, match="not_a_quantity"):
        s.ingest(read_json(spark, str(tmp_path / "in")), NOW, strict=True)
    assert s.last_batch() == -1
    assert s.state().log is None


def test_sealing_apart_from_ingest(spark, tmp_path):
    write_lines(tmp_path / "in", "1.json", BATCH_1)
    s = MeteringStore(spark, str(tmp_path / "tables"), S)
    s.ingest(read_json(spark, str(tmp_path / "in")), NOW)
    assert s.windows().where(F.col("state") == "sealed").count() == 0
    assert s.seal(NOW).count() == 2
    assert s.seal(NOW).count() == 0
    assert s.receipts().count() == 2


def test_reads_by_key_push_their_conditions_down(store, capsys):
    key = f"c1:api_calls:{BASE}"
    assert [(r.billed_total, r.event_count, r.sealed) for r in store.total(key).collect()] == [("150.500000", 2, True)]
    assert [(r.billed_total, r.sealed) for r in store.total("nobody:tokens:0").collect()] == [("0.000000", False)]
    assert [r.receipt.windowKey for r in store.bundle(key).collect()] == [key]
    assert store.bundle(f"c2:plan_tier:{BASE + 30_000}").count() == 0
    assert [r.event_id for r in store.corrections_of(key).collect()] == ["a2", "a9"]
    assert [r.watermark_ms for r in store.watermark("c1", "api_calls").collect()] == [BASE + 10_001]
    assert [r.metric for r in store.select_windows(metric="plan_tier").collect()] == ["plan_tier"] * 2
    store._window(key, store.last_batch())[1].explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(customer_id,c1)" in plan and "GreaterThanOrEqual(event_time_ms" in plan
