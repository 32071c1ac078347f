"""Billing settings, passed explicitly to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass, field

# Metrics billed as their latest value, and the suffix that marks more of them.
GAUGE_METRICS = ("active_seats", "plan_tier", "concurrent_connections")
GAUGE_SUFFIX = "_gauge"

# Texts stored on every receipt.
RECEIPT_ALGO = "sha256"
LEAF_ORDER_RULE = "event_time_ms,event_id ASC"

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Settings:
    """What turns usage events into bills.

    ``window_ms`` is a length in milliseconds, or ``"month"`` for calendar months in UTC.
    ``domain`` separates our hashes from hashes made for other purposes.
    """

    window_ms: int | str = 10_000
    grace_ms: int = 2_000
    gauge_metrics: tuple[str, ...] = GAUGE_METRICS
    gauge_suffix: str = GAUGE_SUFFIX
    domain: str = "sealbook"
    receipt_key: str = field(default="sealbook-demo-key", repr=False)
