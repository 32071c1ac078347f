"""Exact top-k search against all products, on vectors of many lengths, with ties, repeats and unusable rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

KIND = "vec_id long, embedding array<float>, id string, square string, score string, `odd name. here` string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], KIND)


def plain(rows, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * float(np.float32(x))) for x in v]

    usable = [(i, w) for i, v in rows if (w := whole(v)) is not None and sum(x * x for x in w) < 9.2e18]
    out = Counter()
    for n, (i, q) in enumerate(usable):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, w)), -(2**63) if j is None else j) for m, (j, w) in enumerate(usable) if m != n)
        out.update((i, rank, None if j == -(2**63) else j, -s) for rank, (s, j) in enumerate(scored[:k], 1))
    return out


def found(df):
    return Counter(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def made_up(seed, n=900, d=6):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) * 10 ** r.uniform(-2, 1) * (4 if k == i % 3 else 1) for k in range(d)]) for i in range(-100, n)]
    same = [r.gauss(0, 1) for _ in range(d)]
    rows += [(2000 + i, same) for i in range(400)]  # many equal vectors, some of them queries
    rows += [(2000, same), (100, rows[3][1]), (100, rows[3][1]), rows[50], rows[100]]
    rows += [(3000, None), (3100, [1.0, None]), (3200, [float("nan")] * d), (3300, [float("inf")] + [0.0] * (d - 1)), (3400, [1e30] * d)]
    rows += [(3500, []), (3600, [0.5]), (3700, [0.25] * (d + 2)), (None, same), (None, [3.0] * d)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,block", [(1, 10, 32_000_000), (2, 3, 400), (3, 1, 32_000_000)])
def test_all_products(spark, seed, k, block):
    from sealbook.llm.top_products import top_products

    rows = made_up(seed)
    assert found(top_products(table(spark, rows), F.col("id") % 100 == 0, k, block_bytes=block)) == plain(rows, k)


def test_few_rows(spark):
    from sealbook.llm.top_products import top_products

    for rows in ([], [(1, [1.0])], [(0, [1.0])], [(0, None)], [(0, [1.0]), (0, [1.0])], [(None, None)], [(0, [-1.0]), (7, [2.0, 5.0])]):
        assert found(top_products(table(spark, rows), F.col("id") % 100 == 0)) == plain(rows, 10)


def test_large_components_are_exact(spark):
    """Products beyond 2**53 are computed as whole numbers."""
    from sealbook.llm.top_products import top_products

    r = random.Random(5)
    rows = [(i * 50, [float(np.float32(r.uniform(-1e6, 1e6))) for _ in range(3)]) for i in range(40)]
    assert found(top_products(table(spark, rows), F.col("id") % 100 == 0)) == plain(rows, 10)


def test_both_ways_of_pruning():
    """With thresholds near the greatest product, buckets are left out by length and rows by coordinate; nothing is lost."""
    from sealbook.llm import top_products as t

    r = np.random.default_rng(6)
    parts = r.normal(size=(6000, 3))
    parts = np.rint(parts / np.sqrt((parts**2).sum(axis=1, keepdims=True)) * r.choice([1000, 50], (6000, 1)) * r.uniform(1, 1.05, (6000, 1))).astype(np.int64)
    parts = parts[np.argsort(-(parts**2).sum(axis=1), kind="stable")]
    ids = np.arange(6000)
    queries = t._Queries(0, ids[:50], parts[r.integers(0, 2500, 50)], 11)
    truth = queries.parts @ parts.T
    order = np.lexsort((np.broadcast_to(ids, truth.shape), -truth), axis=1)[:, :11]
    queries.least[:] = np.take_along_axis(truth, order[:, -1:], axis=1)[:, 0]
    best = t._Best(50, 11, queries.least)
    looked, coordinate = [0, 0], queries._by_coordinate

    def counted(asked, *rest):
        out = coordinate(asked, *rest)
        looked[0] += len(asked)
        looked[1] += len(out)
        return out

    queries._by_coordinate = counted
    for at in range(0, 6000, 500):
        queries._bucket(parts[at : at + 500], ids[at : at + 500], best)
    assert looked[0] < 12 * 50 and looked[1] > 0
    q, score, id_ = best.rows()
    assert (id_.reshape(50, 11) == order).all() and (score.reshape(50, 11) == np.take_along_axis(truth, order, axis=1)).all()
