"""Leaf, node and signature hashes as nested ``sha2`` calls; no Python per row."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf_text(event_id: Column, event_time_ms: Column, quantity_micros: Column) -> Column:
    return F.concat_ws("|", event_id, event_time_ms.cast("string"), quantity_micros.cast("string"))


def leaf_hash(text: Column, domain: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{domain}.leaf.v1\n"), text), 256)


def node_hash(left: Column, right: Column, domain: str) -> Column:
    """Hash of two child hashes, taken over their hex text."""
    return F.sha2(F.concat(F.lit(f"{domain}.node.v1\n"), left, right), 256)


def empty_root(domain: str) -> str:
    return sha256(f"{domain}.empty.v1".encode()).hexdigest()


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 (RFC 2104) of a text column.

    The two key pads become literals of the plan; set ``spark.sql.redaction.string.regex``
    where plans are logged.
    """
    raw = key.encode()
    raw = (sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in raw))
    outer = F.lit(bytes(b ^ 0x5C for b in raw))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)
