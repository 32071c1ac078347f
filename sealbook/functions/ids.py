"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_ordered_id(ms: Column, *seed: Column) -> Column:
    """A version 7 UUID whose random part is a hash of ``seed``, so replays give the same id."""
    when = F.lpad(F.lower(F.hex(ms)), 12, "0")
    tail = F.sha2(F.concat_ws("|", *seed), 256)
    variant = F.translate(F.substring(tail, 4, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.left(when, F.lit(8)),
        F.right(when, F.lit(4)),
        F.concat(F.lit("7"), F.substring(tail, 1, 3)),
        F.concat(variant, F.substring(tail, 5, 3)),
        F.substring(tail, 8, 12),
    )


def short_id(text: Column, head: int = 0, tail: int = 0) -> Column:
    """The first ``head`` or the last ``tail`` characters, for reports."""
    return F.left(text, F.lit(head)) if head else F.right(text, F.lit(tail))


def hash_order(seed: str | Column, *parts: Column) -> Column:
    """A reproducible shuffle key: sort by it to get the arrival order of this seed."""
    return F.md5(F.concat_ws("|", seed if isinstance(seed, Column) else F.lit(seed), *parts))
