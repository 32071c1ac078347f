"""The billing contract on small hand-made batches."""

from dataclasses import fields
from itertools import permutations

from pyspark.sql import functions as F

from sealbook.operators.durable import durable
from sealbook.operators.ingest import State, applied, ingest, ingest_counts
from sealbook.operators.sealing import seal_due_windows
from sealbook.operators.totals import gauge_totals, gauge_totals_by_arrival, window_totals
from sealbook.operators.validate import check_deliveries, rejected_deliveries, valid_deliveries
from sealbook.settings import Settings
from tests.conftest import BASE, NOW

S = Settings()
W0 = f"c1:api_calls:{BASE}"


def counts(admission):
    return {r.disposition: r.deliveries for r in ingest_counts(admission.dispositions).collect()}


def step(state, deliveries, seal=True):
    admission = ingest(deliveries, state, S)
    after = applied(state, admission)
    if seal:
        windows = seal_due_windows(after.windows, after.watermarks, NOW).drop("newly_sealed")
        after = State(after.log, windows, after.watermarks, after.corrections)
    # Written down between calls, as a store does, so that plans do not grow with the history.
    tables = {f.name: getattr(after, f.name) for f in fields(State)}
    return admission, State(**{name: table and durable(table) for name, table in tables.items()})


def total(state, key=W0):
    row = window_totals(state.log, state.windows, S).where(F.col("window_key") == key).first()
    return row.billed_total, row.sealed


def test_a_late_event_is_filed_and_the_sealed_total_stays(deliver):
    first, state = step(State(), deliver([("k1", 61, BASE + 300), ("k2", "13.25", BASE + 9_999), ("k3", 8, BASE + 12_500)]))
    assert counts(first) == {"accepted": 3}
    assert total(state) == ("74.250000", True)
    late, state = step(state, deliver([("m4", 410, BASE + 4_400)]))
    assert counts(late) == {"quarantined": 1}
    assert [(c.event_id, c.reason, c.window_key) for c in late.corrections.collect()] == [("m4", "late_after_seal", W0)]
    assert total(state) == ("74.250000", True)
    # The same late event again: counted again, filed once.
    again, state = step(state, deliver([("m4", 410, BASE + 4_400)]))
    assert counts(again) == {"quarantined": 1}
    assert again.corrections.count() == 0
    assert state.corrections.count() == 1


def test_an_admitted_event_sent_again_after_the_seal_is_a_duplicate(deliver):
    rows = [("k1", 36, BASE + 700), ("k3", 2, BASE + 12_900)]
    _, state = step(State(), deliver(rows))
    again, state = step(state, deliver([rows[0]]))
    assert counts(again) == {"deduped": 1}
    assert again.corrections.count() == 0
    assert total(state) == ("36.000000", True)


def test_a_conflicting_delivery_is_audited_under_the_original(deliver):
    _, state = step(State(), deliver([("e1", "7.5", BASE + 1)]))
    other, after = step(state, deliver([("e1", 6, BASE + 41_000)], customer="c2"))
    assert counts(other) == {"deduped": 1}
    c = other.corrections.first()
    assert (c.customer_id, c.window_key, c.event_time_ms, c.quantity_micros) == ("c1", W0, BASE + 1, 6_000_000)
    assert c.reason == "payload_conflict"
    assert total(after)[0] == "7.500000"


def test_first_arrival_wins_and_the_first_conflict_is_filed(deliver):
    batch = deliver([("e1", 5, BASE), ("e1", 5, BASE), ("e1", 7, BASE), ("e1", 9, BASE), ("E1", 5, BASE)])
    admission, state = step(State(), batch)
    assert counts(admission) == {"accepted": 2, "deduped": 3}
    assert [c.quantity_micros for c in admission.corrections.collect()] == [7_000_000]
    assert total(state)[0] == "10.000000"


def test_an_id_that_was_quarantined_can_still_be_admitted_elsewhere(deliver):
    _, state = step(State(), deliver([("a1", 1, BASE), ("a2", 1, BASE + 12_001)]))
    mixed, state = step(state, deliver([("x", 3, BASE + 5), ("x", 4, BASE + 13_000), ("x", 3, BASE + 6)]))
    got = sorted((d.arrival, d.disposition, d.conflict) for d in mixed.dispositions.collect())
    assert got == [(0, "quarantined", False), (1, "accepted", False), (2, "deduped", True)]
    assert [c.reason for c in mixed.corrections.collect()] == ["late_after_seal"]


def test_only_admitted_events_move_the_watermark_and_it_never_goes_back(deliver, as_map):
    _, state = step(State(), deliver([("a1", 1, BASE + 30_000)]))
    _, state = step(state, deliver([("a1", 1, BASE + 90_000), ("a2", 1, BASE + 20_000)]))
    assert as_map(state.watermarks, "customer_id", "watermark_ms") == {"c1": BASE + 28_000}


def test_gauge_ties_go_to_the_greater_id_in_every_order(deliver):
    rows = [("p9", 40, BASE + 250), ("p3", 6, BASE + 7_100), ("p5", 5, BASE + 7_100)]
    fixed, loose = set(), set()
    for order in permutations(rows):
        batch = deliver(order, metric="active_seats")
        fixed.add(int(gauge_totals(batch, S).first().total_micros))
        loose.add(int(gauge_totals_by_arrival(batch, S).first().total_micros))
    assert fixed == {5_000_000}
    assert loose == {6_000_000, 5_000_000}


def test_sealing_twice_changes_nothing(deliver):
    _, state = step(State(), deliver([("a1", 1, BASE), ("a2", 1, BASE + 12_001)]))
    again = seal_due_windows(state.windows, state.watermarks, NOW + 1)
    assert again.where("newly_sealed").count() == 0
    assert sorted(map(tuple, again.drop("newly_sealed").collect())) == sorted(map(tuple, state.windows.collect()))


def test_windows_floor_below_the_epoch(deliver):
    admission, _ = step(State(), deliver([("a1", 1, -1)]))
    assert admission.windows.first().window_key == "c1:api_calls:-10000"


def test_rejects_name_the_first_problem(spark):
    schema = "event_id string, customer_id string, metric string, quantity string, event_time_ms long, ingest_time_ms long, payload string"
    rows = [
        ("A", "c", "m", "1", 5, None, None), (None, "c", "m", "1", 5, 1, "{}"), ("b", "", "m", "1", 5, 1, "{}"),
        ("b", "c", "", "1", 5, 1, "{}"), ("b", "c", "m", "1", None, 1, "{}"), ("b", "c", "m", "1e2", 5, 1, "{}"), ("b", "c", "m", "9" * 14, 5, 1, "{}"),
    ]
    df = spark.createDataFrame(rows, schema)
    assert rejected_deliveries(df, NOW).count() == 6
    kept = valid_deliveries(df, NOW).first()
    assert (kept.event_id, kept.ingest_time_ms, kept.payload) == ("A", NOW, "{}")
    reasons = [r.reject_reason for r in check_deliveries(df, NOW).where("reject_reason is not null").collect()]
    assert reasons == ["no_event_id", "no_customer_id", "no_metric", "no_event_time", "not_a_quantity", "quantity_too_large"]
    try:
        valid_deliveries(df, NOW, strict=True).collect()
    except Exception as problem:
        assert any(reason in str(problem) for reason in reasons)
    else:
        raise AssertionError("strict mode let an invalid delivery pass")


def test_hand_made_window_with_an_early_watermark(spark, deliver):
    log = deliver([("a1", 1, BASE), ("a2", 2, BASE + 4000), ("a3", 4, BASE + 6000)])
    made = spark.createDataFrame(
        [("w", "c1", "api_calls", BASE, BASE + 10_000, "sealed", 1, BASE + 5000)],
        "window_key string, customer_id string, metric string, window_open_ms long, window_close_ms long, "
        "state string, sealed_at_ms long, sealed_watermark_ms long",
    )
    row = window_totals(log, made, S, hand_made_windows=True).first()
    assert (row.billed_total, row.event_count) == ("3.000000", 2)


def test_only_tied_events_are_hashed_for_tie_sensitivity(deliver):
    """Two of three windows end in a tie; what does not share the last time of its window meets no arrival order."""
    from sealbook.plans.proofs import tie_sensitivity

    rows = [("a1", 1, BASE), ("a2", 2, BASE + 5), ("a3", 3, BASE + 5), ("b1", 4, BASE + 10_000), ("b2", 5, BASE + 10_001), ("c1", 7, BASE + 20_000), ("c2", 7, BASE + 20_000)]
    found = tie_sensitivity(deliver(rows), ["one", "two", "three", "four", "five"], S)
    assert sorted((r.window_key, r.tied, r.billed_total, r.stable) for r in found.collect() if r.billed_total != "3.000000") == [
        (f"c1:api_calls:{BASE + 20_000}", 2, "7.000000", True)
    ]
    assert [(r.tied, r.distinct_values in (1, 2)) for r in found.collect() if r.window_key == W0] == [(2, True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5") < plan.index("Join") and "md5" not in plan[plan.index("Join"):]
