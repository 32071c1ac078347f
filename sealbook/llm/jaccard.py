"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Two sets of sizes a <= b with a similarity of at least t
differ in at most ``d = (1 - t) / t * a`` shingles. Shingles are dealt by hash to ``1.5 (d + 1)`` parts;
each part is a sketch, the XOR of its shingles' hashes. Of any ``d + 1`` parts at least one is the same
in both sets, so similar sets meet in a join on (size band, part, sketch). A set sends only its fullest
parts: all that hold at least q shingles, where q is the largest number that leaves ``d + 1`` parts. Of
two sets the one with the larger q has ``d + 1`` such parts, one of which agrees, and the other sends it.

What meets is compared by a second, folded bit sketch, whose Hamming distance never exceeds the number
of differing shingles, and then by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealbook.llm.common import documents, mixed, outer_id, shingle_sets, slices
from sealbook.llm.components import components
from sealbook.operators.durable import Scratch, durable, release_shuffles

#: 64-bit words of the bit sketch that filters candidate pairs.
SKETCH_WORDS = 64
#: Join keys are dealt to so many columns, which are shuffled one after the other, so that one share at a time is on disk.
KEY_SHARES = 3


def bands(least: Fraction, most: int = 1 << 31) -> np.ndarray:
    """The first size of each band; a similar set is in the same band or the next."""
    starts = [1]
    while starts[-1] < most:
        starts.append(max(starts[-1] + 1, floor(starts[-1] / least) + 1))
    return np.array(starts)


def budget(first_of_next: int, least: Fraction) -> int:
    """Most differing shingles of a similar pair whose smaller set lies below that size."""
    return floor((first_of_next - 1) * (1 - least) / least)


def part_keys(shingles: np.ndarray, scheme: int, d: int) -> np.ndarray:
    """The join keys of one set under one band's scheme."""
    parts = max(2, (3 * (d + 1) + 1) // 2)
    order = np.argsort(part := (mixed(shingles ^ np.uint64(scheme)) >> np.uint64(16)) % np.uint64(parts), kind="stable")
    part, values = part[order].astype(np.int64), mixed(shingles[order])
    sizes = np.bincount(part, minlength=parts)
    sent = np.sort(sizes)[::-1]
    q = int(sent[d])  # d + 1 parts hold at least q
    xor = np.zeros(parts, np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        xor[full] = np.bitwise_xor.reduceat(values, np.concatenate([[0], np.cumsum(sizes)])[full])
    chosen = np.flatnonzero(sizes >= q)
    return mixed(xor[chosen] + mixed(chosen.astype(np.uint64) + np.uint64(scheme << 32))).view(np.int64)


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """Each shingle flips one bit."""
    bit = (mixed(shingles ^ np.uint64(0x5A5A)) >> np.uint64(20)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.flatnonzero(np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1)
    out = np.zeros(SKETCH_WORDS, np.uint64)
    np.bitwise_xor.at(out, odd // 64, np.uint64(1) << (odd % 64).astype(np.uint64))
    return out.view(np.int64)


_SHARES = [f"keys_{k}" for k in range(KEY_SHARES)]


def _sketched(words: int, least: Fraction):
    starts = bands(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("id").to_pylist()
            rows = []
            for id_, s in zip(ids, shingle_sets(batch.column("text"), words)):
                n, keys, sketch, mark = len(s), np.empty(0, np.int64), None, None
                parts = []
                if n:
                    with np.errstate(over="ignore"):
                        mark = np.array([mixed(s).sum(), mixed(s ^ np.uint64(0xABCD)).sum()], np.uint64).tobytes()
                    band = int(np.searchsorted(starts, n, side="right")) - 1
                    for scheme in (band, band - 1):
                        if scheme >= 0 and (d := budget(int(starts[scheme + 1]), least)):
                            parts.append(part_keys(s, scheme, d))
                    keys = np.concatenate([keys, *parts])
                    sketch = bit_sketch(s) if len(keys) else None
                share = keys.view(np.uint64) % np.uint64(KEY_SHARES)
                rows.append((id_, n, mark, sketch, *[keys[share == k] for k in range(KEY_SHARES)]))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()),
                 *[pa.array(c, pa.list_(pa.int64())) for c in columns[3:]]],
                ["id", "n", "mark", "sketch", *_SHARES],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"]
            )

    return run


def _linked(least: Fraction):
    """Pairs whose sets are similar enough, by the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("left"), batch.column("right")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(shared > 0 and shared * least.denominator >= (len(a) + len(b) - shared) * least.numerator)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _hamming(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _close(left: str, right: str, least: Fraction):
    """Sizes and bit sketches allow the similarity: ``d <= (a + b) (1 - t) / (1 + t)``, by whole numbers."""
    p, q = least.numerator, least.denominator
    sizes = F.col(f"{left}.n") + F.col(f"{right}.n")
    return (
        (F.least(f"{left}.n", f"{right}.n") * q >= F.greatest(f"{left}.n", f"{right}.n") * p)
        & (_hamming(f"{left}.sketch", f"{right}.sketch") * (q + p) <= sizes * (q - p))
    )


def near_duplicates(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row of ``docs``.

    Two documents are linked when ``den`` * shared shingles >= ``num`` * all shingles of both; the
    component id is the smallest doc_id that links reach. All links between different sets count, yet
    not every pair is looked at: equal sets are one node, a group that meets on a key is first compared
    with its smallest node alone, and only nodes that are still in different components are then
    compared with each other, sketch against sketch inside the join.

    Null or empty texts have no shingles and no links. A null doc_id counts as the smallest id and is
    given back as null. Rows with one doc_id are one node: with different texts it has the links of all
    of them. An empty table gives no rows; other columns are not looked at.
    """
    with Scratch(docs.sparkSession) as scratch:
        return durable(_near_duplicates(documents(docs), words, Fraction(num, den), scratch))


def _near_duplicates(base: DataFrame, words: int, least: Fraction, scratch: Scratch) -> DataFrame:
    """What `near_duplicates` gives, of ``id`` and ``text``; tables that it reads lie in ``scratch``."""
    kind = "id long, n long, mark binary, sketch array<long>, " + ", ".join(f"{c} array<long>" for c in _SHARES)
    sketched = scratch.keep(base.mapInArrow(_sketched(words, least), kind))

    full = sketched.filter("n > 0")
    equal = full.groupBy("mark").agg(F.min("id").alias("rep"))
    copies = scratch.keep(full.select("id", "mark").join(equal, "mark").select("id", "rep").distinct())
    texts = copies.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low != high")
    several = copies.join(texts.select("id", "low"), "id").select(F.col("rep").alias("u"), F.col("low").alias("v"))
    nodes = full.join(equal.select("mark", F.col("rep").alias("id")), ["mark", "id"], "left_semi").filter("sketch is not null")

    order = Window.partitionBy("key").orderBy("id")
    shares = []
    for share in _SHARES:
        met = nodes.select("id", F.explode(share).alias("key"))
        shares.append(scratch.keep(
            met.withColumn("hub", F.first("id").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("next", F.lead("id").over(order))
            .filter("hub != id or next is not null")
            .select("key", "id", "hub")
        ))
        release_shuffles(base.sparkSession)
    groups = reduce(DataFrame.unionByName, shares)
    sizes = nodes.select("id", "n", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        with Scratch(base.sparkSession) as own:
            pairs = own.keep(pairs)
            wanted = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
            sets = own.keep(base.join(wanted, "id", "left_semi").mapInArrow(_sets(words), "id long, shingles binary").distinct())
            release_shuffles(base.sparkSession)
            both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("left")), "u").join(
                sets.select(F.col("id").alias("v"), F.col("shingles").alias("right")), "v"
            )
            found = scratch.keep(both.select("u", "v", "left", "right").mapInArrow(_linked(least), "u long, v long").distinct())
        release_shuffles(base.sparkSession)
        return found

    hubs = groups.filter("hub != id").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    pairs = hubs.join(sizes.alias("a"), F.col("u") == F.col("a.id")).join(sizes.alias("b"), F.col("v") == F.col("b.id"))
    links = verified(pairs.filter(_close("a", "b", least)).select("u", "v"))

    labels = components(links)
    open_ = groups.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("label")
    )
    split = open_.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
    left = scratch.keep(
        open_.join(split.filter("low != high and size > 2").select("key"), "key", "left_semi").join(sizes, "id")
    )
    a, b = left.alias("a"), left.alias("b")
    cross = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") < F.col("b.label")) & _close("a", "b", least))
    more = verified(cross.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct())

    found = components(links.unionByName(more).unionByName(several))
    member = copies.join(found.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(
        F.min(F.coalesce("component", "rep")).alias("component")
    )
    return sketched.select("id", "n").join(member, "id", "left").select(
        outer_id(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        outer_id(F.coalesce("component", "id")).alias("component_id"),
    )
