"""Checking receipts from bundles alone.

Nothing here is shared with the code that builds receipts: leaf text, hashes, tree, totals and
signature are written a second time, so that each side checks the other.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealbook.operators.ordering import in_order

LEVEL_STEP = 8  # tree levels folded between two shuffles


def bundle_id() -> Column:
    """Rows with one receipt are parts of one bundle, whatever window it names."""
    return F.sha2(F.to_json("receipt"), 256)


def bundle_leaves(bundles: DataFrame) -> DataFrame:
    """One row per leaf, at the position the bundle gives it; order is part of the claim."""
    rows = bundles.select(
        bundle_id().alias("bundle_id"),
        F.col("receipt.windowKey").alias("window_key"),
        F.coalesce("firstLeaf", F.lit(0)).alias("base"),
        F.posexplode("leaves").alias("at", "leaf"),
    )
    return rows.select("bundle_id", "window_key", (F.col("base") + F.col("at")).alias("position"), "leaf.*")


def bundle_claims(bundles: DataFrame) -> DataFrame:
    """One row per bundle: its receipt, and whether its parts are the whole of it, each once.

    A bundle of which only a later part is there, a part that is missing or comes twice, and a second
    bundle for the same window all stay rows, marked in ``parts_ok`` and ``window_once``.
    """
    part = F.struct(F.coalesce("firstLeaf", F.lit(0)).cast("bigint").alias("first"), F.size("leaves").cast("bigint").alias("n"))
    rows = bundles.select(bundle_id().alias("bundle_id"), "receipt", part.alias("part"))
    whole = rows.groupBy("bundle_id").agg(F.any_value("receipt").alias("receipt"), F.sort_array(F.collect_list("part")).alias("parts"))
    # Where each part must begin for the ones before it to reach it; -1 once one does not.
    reached = F.aggregate("parts", F.lit(0).cast("bigint"), lambda end, p: F.when(p["first"] == end, end + p["n"]).otherwise(-1))
    once = Window.partitionBy("receipt.windowKey")
    return whole.select(
        "bundle_id",
        "receipt",
        reached.eqNullSafe(F.col("receipt.eventCount")).alias("parts_ok"),
        (F.count(F.lit(1)).over(once) == 1).alias("window_once"),
    )


def verify_bundles(bundles: DataFrame, domain: str, key: str) -> DataFrame:
    """Per bundle: is it whole, and are root, total and signature what the leaves say?"""
    leaves = bundle_leaves(bundles)
    hashed = leaves.select(
        "bundle_id",
        "position",
        F.sha2(
            F.format_string(f"{domain}.leaf.v1\n%s|%s|%s", "eventId", "eventTimeMs", "quantityMicros"), 256
        ).alias("node"),
    )
    ends = F.coalesce("firstLeaf", F.lit(0)) + F.size("leaves")
    roots = _roots(hashed, ["bundle_id"], domain, bundles.agg(F.max(ends)).first()[0] or 0)
    micros = F.col("quantityMicros").cast("decimal(28,0)")
    totals = leaves.groupBy("bundle_id").agg(
        F.sum(micros).cast("string").alias("as_counter"),
        F.max(F.struct("eventTimeMs", "eventId", micros.alias("micros")))["micros"].cast("string").alias("as_gauge"),
        F.count(F.lit(1)).alias("leaf_count"),
    )
    claims = bundle_claims(bundles).select("bundle_id", "receipt.*", "parts_ok", "window_once")
    nothing = hashlib.sha256(f"{domain}.empty.v1".encode()).hexdigest()
    checked = (
        claims.join(roots, "bundle_id", "left").join(totals, "bundle_id", "left")
        .withColumn("recomputed_root", F.coalesce("node", F.lit(nothing)))
        .withColumn("leaf_count", F.coalesce("leaf_count", F.lit(0)))
        .withColumn(
            "recomputed_total_micros",
            F.coalesce(F.when(F.col("mode") == "gauge", F.col("as_gauge")).otherwise(F.col("as_counter")), F.lit("0")),
        )
    )
    root_ok = F.col("recomputed_root").eqNullSafe(F.col("merkleRoot")) & F.col("leaf_count").eqNullSafe(
        F.col("eventCount")
    )
    return checked.select(
        F.col("windowKey").alias("window_key"),
        F.col("customerId").alias("customer_id"),
        "metric",
        "parts_ok",
        "window_once",
        root_ok.alias("root_ok"),
        F.col("recomputed_total_micros").eqNullSafe(F.col("billedTotalMicros")).alias("total_ok"),
        _signed(F.col("recomputed_root"), key).eqNullSafe(F.col("signature")).alias("signature_ok"),
        _bound(key).alias("metadata_ok"),
        F.col("leaf_count").alias("event_count"),
        "recomputed_root",
        F.col("merkleRoot").alias("claimed_root"),
        "recomputed_total_micros",
        F.col("billedTotalMicros").alias("claimed_total_micros"),
    ).withColumn("ok", F.col("parts_ok") & F.col("window_once") & F.col("root_ok") & F.col("total_ok") & F.col("signature_ok"))


def tampered(verified: DataFrame) -> DataFrame:
    return verified.where(~F.col("ok"))


def _bound(key: str) -> Column:
    """Our own extra: the window key names the stream of the receipt. ``ok`` does not depend on it."""
    prefix = F.concat_ws(":", "customerId", "metric")
    return F.startswith(F.col("windowKey"), F.concat(prefix, F.lit(":")))


def _signed(root: Column, key: str) -> Column:
    secret = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    pads = [F.unhex(F.lit(bytes(mask ^ b for b in secret.ljust(64, b"\x00")).hex())) for mask in (0x36, 0x5C)]
    digest = F.unhex(F.sha2(F.concat(pads[0], root.cast("binary")), 256))
    return F.sha2(F.concat(pads[1], digest), 256)


def _roots(nodes: DataFrame, keys: list[str], domain: str, longest: int) -> DataFrame:
    """Pairs of neighbours are hashed level by level, a few levels in each shuffle."""
    top = max(longest - 1, 0)
    while True:
        width = 1 << LEVEL_STEP
        group = F.floor(F.col("position") / width)
        nodes = (
            nodes.groupBy(*keys, group.alias("position"))
            .agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("row"))
            .withColumn("level", F.transform("row", lambda m: m["node"]))
        )
        for _ in range(min(LEVEL_STEP, top.bit_length())):
            nodes = nodes.withColumn("level", _pair_up(F.col("level"), domain))
        nodes = nodes.select(*keys, "position", F.get("level", F.lit(0)).alias("node"))
        top //= width
        if top == 0:
            return nodes.select(*keys, "node")


def _pair_up(level: Column, domain: str) -> Column:
    lefts = F.filter(level, lambda _, i: i % 2 == 0)
    rights = F.filter(level, lambda _, i: i % 2 == 1)
    return F.zip_with(
        lefts,
        rights,
        lambda a, b: F.when(b.isNull(), a).otherwise(F.sha2(F.concat(F.lit(f"{domain}.node.v1\n"), a, b), 256)),
    )


def invoice_roots(verified: DataFrame, by: list[str], domain: str, rows_per_task: int | None = None) -> DataFrame:
    """Root over the sorted window roots, per ``by`` or over everything when it is empty."""
    ordered = in_order(verified.select(*by, F.col("recomputed_root").alias("node")), by, ["node"],
                       rows_per_task=rows_per_task)
    return _roots(ordered.rows, by, domain, ordered.largest).withColumnRenamed("node", "invoice_root")


def verify_invoices(verified: DataFrame, by: list[str], domain: str) -> DataFrame:
    """Grand total of the recomputed totals, invoice root, and whether there are windows and every one holds."""
    micros = F.col("recomputed_total_micros").cast("decimal(38,0)")
    sums = verified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(~F.col("ok")).alias("rejected"),
        F.coalesce(F.sum(micros), F.lit(0)).cast("string").alias("grand_total_micros"),
        F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"),
    )
    roots = invoice_roots(verified, by, domain)
    if by:
        return sums.join(roots, by)
    nothing = hashlib.sha256(f"{domain}.empty.v1".encode()).hexdigest()
    both = sums.unionByName(roots, allowMissingColumns=True)
    return both.agg(
        *[F.max(c).alias(c) for c in sums.columns],
        F.coalesce(F.max("invoice_root"), F.lit(nothing)).alias("invoice_root"),
    )


def tamper_first_leaf(bundles: DataFrame, quantity_micros: str) -> DataFrame:
    """The challenge: change the quantity of each window's first leaf and keep the receipt."""
    first = F.coalesce("firstLeaf", F.lit(0)) == 0
    changed = F.transform(
        "leaves",
        lambda leaf, i: F.when(
            (i == 0) & first, leaf.withField("quantityMicros", F.lit(quantity_micros))
        ).otherwise(leaf),
    )
    return bundles.withColumn("leaves", changed)
