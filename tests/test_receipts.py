"""Roots, signatures and totals against a few lines of plain Python."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from sealbook.functions.hashing import empty_root, hmac_sha256
from sealbook.operators import receipts as receipts_module
from sealbook.operators.merkle import merkle_roots
from sealbook.operators.ordering import in_order
from sealbook.operators.receipts import build_receipts, bundles, sealed_leaves
from sealbook.operators.verify import bundle_leaves, invoice_roots, tamper_first_leaf, verify_bundles, verify_invoices
from sealbook.plans.invoices import customer_invoices
from sealbook.plans.scenarios import sealed_log
from sealbook.settings import Settings
from tests.conftest import BASE, NOW

S = Settings()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(level, domain=S.domain):
    while len(level) > 1:
        level = [
            sha(f"{domain}.node.v1\n{level[i]}{level[i + 1]}") if i + 1 < len(level) else level[i]
            for i in range(0, len(level), 2)
        ]
    return level[0]


@pytest.mark.parametrize("rows_per_task", [None, 100])
def test_roots_of_all_lengths(spark, rows_per_task):
    """Every length near a power of two or a block, also with groups that are cut into ranges."""
    sizes = [*range(1, 20), 63, 64, 65, 255, 256, 257, 1023, 1024, 1025, 2500]
    rows = [(f"k{n}", i, sha(f"{n}/{i}")) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at long, hash string")
    ordered = in_order(df, ["k"], ["at"], rows_per_task=rows_per_task)
    assert ordered.largest == 2500
    expected = {f"k{n}": root([sha(f"{n}/{i}") for i in range(n)]) for n in sizes}
    got = {r.k: r.merkle_root for r in merkle_roots(ordered.rows, ["k"], ordered.largest, S.domain).collect()}
    assert got == expected


def test_ordering_in_ranges_equals_one_window(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(40)).alias("t"),
        F.sha2(F.col("id").cast("string"), 256).alias("id"),
        F.col("id").alias("q"),
    )
    running = {"total": F.col("q").cast("decimal(28,0)")}
    plain = in_order(df, ["k"], ["t", "id"], running)
    cut = in_order(df, ["k"], ["t", "id"], running, rows_per_task=50)
    pick = ["k", "id", "position", "total"]
    assert sorted(map(tuple, plain.rows.select(pick).collect())) == sorted(map(tuple, cut.rows.select(pick).collect()))


@pytest.mark.parametrize("key", ["k", "key" * 40])
def test_hmac(spark, key):
    got = spark.range(1).select(hmac_sha256(F.lit("root"), key).alias("h")).first().h
    assert got == hmac.new(key.encode(), b"root", hashlib.sha256).hexdigest()


@pytest.fixture(scope="module")
def books(spark):
    """Two streams; one window of each is sealed, the gauge has ties."""
    rows = spark.range(300).select(
        F.lpad(F.hex(F.pmod(F.xxhash64("id"), F.lit(2**40))), 12, "0").alias("event_id"),
        F.concat(F.lit("c"), F.col("id") % 2).alias("customer_id"),
        F.when(F.col("id") % 2 == 0, "api_calls").otherwise("plan_tier").alias("metric"),
        (F.lit(BASE) + (F.col("id") % 7) * 1000 + F.when(F.col("id") > 290, 20_000).otherwise(0)).alias("event_time_ms"),
        ((F.col("id") + 1) * 1_000_000).cast("bigint").alias("quantity_micros"),
        F.lit(NOW).cast("bigint").alias("ingest_time_ms"),
        F.lit("{}").alias("payload"),
    )
    return sealed_log(rows.cache(), S)


@pytest.mark.parametrize("rows_per_task", [None, 20])
def test_receipts_and_bundles_by_hand(books, rows_per_task):
    leaves = sealed_leaves(books.log, books.windows, S, rows_per_task)
    made = build_receipts(leaves, S, NOW)
    by_window = {}
    for e in books.log.collect():
        by_window.setdefault(e.customer_id, []).append(e)
    for r in made.collect():
        events = sorted((e for e in by_window[r.customer_id] if e.event_time_ms < BASE + 10_000),
                        key=lambda e: (e.event_time_ms, e.event_id))
        level = [sha(f"{S.domain}.leaf.v1\n{e.event_id}|{e.event_time_ms}|{e.quantity_micros}") for e in events]
        assert r.merkle_root == root(level)
        assert r.signature == hmac.new(S.receipt_key.encode(), r.merkle_root.encode(), hashlib.sha256).hexdigest()
        expected = events[-1].quantity_micros if r.mode == "gauge" else sum(e.quantity_micros for e in events)
        assert (int(r.billed_total_micros), r.event_count) == (expected, len(events))
    assert made.count() == 2
    # A window that goes out in several rows verifies like one that goes out whole.
    for size in (receipts_module.BUNDLE_LEAVES, 32):
        b = bundles(made, leaves.rows, size)
        assert b.count() == (2 if size > 32 else 10)
        v = verify_bundles(b, S.domain, S.receipt_key)
        assert v.where("ok and metadata_ok").count() == 2
        bad = verify_bundles(tamper_first_leaf(b, "1"), S.domain, S.receipt_key)
        assert bad.where("root_ok or signature_ok or ok").count() == 0


def test_order_of_leaves_is_part_of_the_claim(books):
    leaves = sealed_leaves(books.log, books.windows, S)
    b = bundles(build_receipts(leaves, S, NOW), leaves.rows)
    turned = b.withColumn("leaves", F.reverse("leaves"))
    v = verify_bundles(turned, S.domain, S.receipt_key)
    assert v.where("total_ok and not root_ok and not ok").count() == 2
    assert bundle_leaves(b).count() == leaves.rows.count()


def test_wrong_key_and_foreign_stream_are_seen(books):
    leaves = sealed_leaves(books.log, books.windows, S)
    b = bundles(build_receipts(leaves, S, NOW), leaves.rows)
    assert verify_bundles(b, S.domain, "other").where("signature_ok").count() == 0
    swapped = b.withColumn("receipt", F.col("receipt").withField("customerId", F.lit("someone")))
    assert verify_bundles(swapped, S.domain, S.receipt_key).where("ok and not metadata_ok").count() == 2


def test_invoice_roots_sort_the_window_roots(spark, books):
    leaves = sealed_leaves(books.log, books.windows, S)
    made = build_receipts(leaves, S, NOW)
    v = verify_bundles(bundles(made, leaves.rows), S.domain, S.receipt_key)
    roots = sorted(r.recomputed_root for r in v.collect())
    assert verify_invoices(v, [], S.domain).first().invoice_root == root(roots)
    assert invoice_roots(v, [], S.domain, rows_per_task=1).first().invoice_root == root(roots)
    per = {r.customer_id: r.invoice_root for r in customer_invoices(made, S).collect()}
    assert set(per.values()) == set(roots)
    nothing = verify_invoices(v.where("false"), [], S.domain).first()
    assert (nothing.ok, nothing.windows, nothing.invoice_root) == (False, 0, empty_root(S.domain))
