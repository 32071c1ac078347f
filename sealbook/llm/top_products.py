"""Exact top-k search by inner product: vectors in order of length, pruned by length or by coordinate.

The vectors are written once in order of length, so that vectors of like length lie together. A batch of them is
a bucket. For a query whose k-th score so far is T, a vector of a bucket with greatest length L has to point the
query's way by a cosine of at least T / (|q| L). Where that is over one the bucket is left out, and with it all that
follow (length). Where it leaves only a narrow range of the query's largest coordinate, only vectors in that range are
looked at (coordinate). What remains is multiplied out as whole numbers.

Queries are handled in blocks of bounded bytes; each block passes once over the vectors that can still matter. A hashed
share of all vectors is searched first, only to have thresholds from the start; the pass itself covers every vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealbook.llm.common import LOWEST, outer_id
from sealbook.operators.durable import Scratch, durable

#: Bytes of the queries that one pass holds in each worker, as 64-bit numbers.
BLOCK_BYTES = 32_000_000
#: Vectors and queries that are multiplied at once.
BUCKET_ROWS, TILE_QUERIES = 2048, 1024
#: One vector of so many is searched first, for the thresholds.
SEED_SHARE = 64
#: A pair found by coordinate costs about as much as so many pairs of a matrix product.
COORDINATE_COST = 12
#: Squared lengths from here on have products beyond 64 bits.
TOO_LONG = 9.2e18

_FOUND = "block long, q long, query_id long, self long, score long, id long"


def whole_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``id``, ``parts`` (components as whole numbers, rounded down) and ``square`` (squared length) of usable vectors."""
    x = vectors["embedding"]
    usable = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    parts = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    rows = vectors.where(usable).select(F.coalesce(vectors["vec_id"].cast("long"), F.lit(LOWEST)).alias("id"), parts.alias("parts"))
    square = F.aggregate("parts", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    return rows.withColumn("square", square).where(F.col("square") < TOO_LONG)


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each query row the ``k`` greatest inner products with the other rows: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on the column ``id``, the vec_id as a long.
    Components become floor(scale * x). Ties go to the smaller vec_id; a null vec_id comes first, and is null in the
    result. Only the query's own row is left out: other rows with its id are candidates. A row that is there twice
    is two candidates and, where it is a query, two queries. Vectors that are null or hold a null or non-finite component
    take no part, nor do those whose squared whole length is 9.2e18 or more, as their scores are no longs. A shorter
    vector counts as filled up with zeros. Without queries or candidates there are no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        rows = whole_vectors(vectors, scale)
        # Equal vectors lie together with rising ids. The hash of the id deals out lengths that many vectors share.
        order = [F.desc("square"), F.xxhash64("id")]
        table = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(F.desc("square"), F.xxhash64("parts"), "id"))
        asked = table.where(is_query)
        n, width, longest = asked.agg(F.count(F.lit(1)), F.max(F.size("parts")), F.max("square")).first()
        if not n:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        blocks = -(-n * max(1, width) * 8 // block_bytes)
        held = scratch.keep(asked.repartition(blocks).withColumn("block", F.spark_partition_id()))
        found = []
        for block in range(blocks):
            mine = held.where(F.col("block") == block).select("id", "parts").toArrow()
            queries = _Queries(block, mine.column("id").to_numpy(), _matrix(mine.column("parts").combine_chunks()), k + 1)
            seeds = table.where(F.pmod(F.xxhash64("id", "parts"), F.lit(SEED_SHARE)) == 0)
            best = _ranked(seeds.mapInArrow(queries.search, _FOUND)).where(F.col("place") == k + 1).select("q", "score").toArrow()
            queries.least[best.column("q").to_numpy()] = best.column("score").to_numpy()
            # Vectors too short for every query of the block are not even read.
            reach = queries.shortest()
            found.append(scratch.keep(table.where(F.col("square") >= reach).mapInArrow(queries.search, _FOUND)))
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        own = (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("self"))
        before = Window.partitionBy("block", "q").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
        met = _ranked(every).where(F.col("place") <= k + 1).withColumn("own", own).withColumn("met", F.count_if("own").over(before))
        rank = F.col("place") - F.when(F.col("met") > 0, 1).otherwise(0)
        others = met.where(~(F.col("own") & (F.col("met") == 1))).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
        return durable(others.select("query_id", "rank", outer_id(F.col("id")).alias("vec_id"), "score"))


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order))


def _matrix(parts: pa.ListArray, width: int = 0) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    starts = parts.offsets.to_numpy()
    lengths = np.diff(starts)
    values = parts.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].astype(np.int64, copy=False)
    width = max(width, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(starts[:-1] - starts[0], lengths)] = values
    return out


class _Queries:
    """A block of queries, and the search of vectors in order of length for the ``k`` best of each."""

    def __init__(self, block: int, ids: np.ndarray, parts: np.ndarray, k: int):
        self.block, self.ids, self.parts, self.k = block, ids, parts, k
        self.self_ = (parts * parts).sum(axis=1)
        self.length = np.sqrt((parts.astype(float) ** 2).sum(axis=1))
        self.least = np.full(len(ids), np.iinfo(np.int64).min)  # a score that k rows are known to reach

    def shortest(self) -> float:
        """The least squared length that can matter, with room for rounding."""
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((self.least > 0) & (self.length > 0), self.least / self.length, 0.0)
        return float(need.min(initial=np.inf)) ** 2 * (1 - 1e-9) if len(need) else 0.0

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(self.ids), self.k, self.least)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET_ROWS):
                part = batch.slice(at, BUCKET_ROWS)
                lists = part.column("parts")
                bucket = _matrix(lists, self.parts.shape[1])
                ids = part.column("id").to_numpy()
                if len(ids) > self.k:  # of equal vectors only those of the k smallest ids can count
                    same = np.concatenate([[False], (bucket[1:] == bucket[:-1]).all(axis=1) & (np.diff(ids) >= 0)])
                    run = np.arange(len(ids)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
                    bucket, ids = bucket[run < self.k], ids[run < self.k]
                self._bucket(bucket, ids, best)
        q, score, id_ = best.rows()
        for at in range(0, len(q), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q[s]), self.block)), pa.array(q[s]), pa.array(self.ids[q[s]]), pa.array(self.self_[q[s]]), pa.array(score[s]), pa.array(id_[s])],
                names=["block", "q", "query_id", "self", "score", "id"],
            )

    def _bucket(self, bucket: np.ndarray, ids: np.ndarray, best: _Best) -> None:
        queries = self.parts
        if bucket.shape[1] > queries.shape[1]:
            bucket = bucket[:, : queries.shape[1]]  # the queries have only zeros there
        real = bucket.astype(float)
        lengths = np.sqrt((real * real).sum(axis=1))
        longest = lengths.max(initial=0.0)
        exact = longest * self.length.max(initial=0.0) < 2**52  # sums of products in doubles are whole
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(best.least > 0, best.least / (self.length * longest), -1.0)  # local thresholds
        active = np.flatnonzero(~(cosine > 1 + 1e-9))
        narrow = self._by_coordinate(active[cosine[active] > 0], cosine, real, lengths, bucket, ids, best)
        for at in range(0, len(rest := active[~np.isin(active, narrow)]), TILE_QUERIES):
            some = rest[at : at + TILE_QUERIES]
            scores = (queries[some].astype(float) @ real.T).astype(np.int64) if exact else queries[some] @ bucket.T
            floor = best.least[some]
            hit = scores >= floor[:, None]
            if hit.sum() > 2 * self.k * len(some) and len(ids) > self.k:
                kth = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                hit = scores >= np.maximum(floor, kth)[:, None]
            row, col = np.nonzero(hit)
            best.add(some[row], scores[row, col], ids[col])

    def _by_coordinate(self, asked, cosine, real, lengths, bucket, ids, best) -> np.ndarray:
        """Queries whose two largest coordinates leave few vectors of the bucket; those are verified here."""
        if not len(asked) or not len(ids):
            return asked[:0]
        unit = self.parts[asked] / self.length[asked, None]
        focus = np.argsort(-np.abs(unit), axis=1)[:, :2]
        spread = np.arccos(np.clip(cosine[asked], -1, 1))
        ways = real / np.where(lengths > 0, lengths, 1)[:, None]

        def feasible(column):
            angle = np.arccos(np.clip(unit[np.arange(len(asked)), column], -1, 1))
            return np.cos(np.minimum(np.pi, angle + spread)) - 1e-9, np.cos(np.maximum(0, angle - spread)) + 1e-9

        low, high = feasible(focus[:, 0])
        first, last = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        orders = {}
        for f in np.unique(focus[:, 0]):
            orders[f] = np.argsort(ways[:, f], kind="stable")
            along, of = ways[orders[f], f], focus[:, 0] == f
            first[of] = np.searchsorted(along, low[of], side="left")
            last[of] = np.searchsorted(along, high[of], side="right")
        few = np.flatnonzero((last - first) * COORDINATE_COST < len(ids))
        if not len(few):
            return asked[:0]
        low, high = feasible(focus[:, -1])
        for i in few:
            here = orders[focus[i, 0]][first[i] : last[i]]
            side = ways[here, focus[i, -1]]
            here = here[(side >= low[i]) & (side <= high[i])]
            score = bucket[here] @ self.parts[asked[i]]
            keep = score >= best.least[asked[i]]
            best.add(np.full(keep.sum(), asked[i]), score[keep], ids[here[keep]])
        return asked[few]


class _Best:
    """The k greatest scores of each query so far, ties by id; ``least`` is what a new one has to reach."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.q, self.score, self.id_ = (np.empty(0, np.int64) for _ in range(3))

    def add(self, q, score, id_) -> None:
        self.q, self.score, self.id_ = (np.concatenate(p) for p in ((self.q, q), (self.score, score), (self.id_, id_)))
        if len(self.q) > 4 * self.k * max(1, len(self.least)) or len(q) > 1000:
            self._cut()

    def _cut(self) -> None:
        order = np.lexsort((self.id_, -self.score, self.q))
        q = self.q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        order = order[place < self.k]
        kth = self.q[order[place[place < self.k] == self.k - 1]]
        at = order[place[place < self.k] == self.k - 1]
        self.least[kth] = np.maximum(self.least[kth], self.score[at])
        self.q, self.score, self.id_ = self.q[order], self.score[order], self.id_[order]

    def rows(self):
        self._cut()
        return self.q, self.score, self.id_
