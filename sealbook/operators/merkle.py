"""Merkle roots of many ordered lists at once.

An odd node at the end of a level moves up unchanged, so after k levels every aligned block of
2^k hashes, also a short last one, is exactly one node. The tree is folded block by block: no
task ever holds more than one block of one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealbook.functions.hashing import node_hash

LEVELS = 10
BLOCK = 2**LEVELS


def merkle_roots(
    hashes: DataFrame,
    keys: list[str],
    largest: int,
    domain: str,
    sums: tuple[str, ...] = (),
    lasts: tuple[str, ...] = (),
) -> DataFrame:
    """Root per ``keys`` over rows of ``position`` (0, 1, ...) and ``hash``.

    ``largest`` is the length of the longest list and sets the number of rounds. The columns in
    ``sums`` are added up on the way, those in ``lasts`` keep the value of the last position.
    """
    nodes = hashes.select(*keys, "position", "hash", *sums, *lasts)
    while True:
        levels = min(LEVELS, max(largest - 1, 0).bit_length())
        block = ((F.col("position") - F.pmod("position", F.lit(BLOCK))) / BLOCK).cast("bigint")
        nodes = (
            nodes.withColumn("_block", block)
            .groupBy(*keys, "_block")
            .agg(
                F.sort_array(F.collect_list(F.struct("position", "hash"))).alias("members"),
                *[F.sum(c).alias(c) for c in sums],
                *[F.max_by(c, "position").alias(c) for c in lasts],
            )
            .select(
                *keys,
                F.col("_block").alias("position"),
                _fold(F.col("members.hash"), levels, domain).alias("hash"),
                *sums,
                *lasts,
            )
        )
        largest = -(-largest // BLOCK)
        if largest <= 1:
            return nodes.select(*keys, F.col("hash").alias("merkle_root"), *sums, *lasts)


def _fold(hashes: Column, levels: int, domain: str) -> Column:
    def halve(level: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(1), F.size(level), F.lit(2))
        return F.transform(
            pairs,
            lambda i: F.when(
                i < F.size(level), node_hash(F.element_at(level, i), F.element_at(level, i + 1), domain)
            ).otherwise(F.element_at(level, i)),
        )

    return F.reduce(F.sequence(F.lit(0), F.lit(levels - 1)), hashes, halve, lambda x: x[0]) if levels else hashes[0]
