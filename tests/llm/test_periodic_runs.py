"""Runs against all periods tried word by word, and the digests against their definition."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, runs string, id string, n_words string, `odd name. here` string"


def plain_runs(w):
    out = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def plain(id_, text, planted):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(id_).encode())
    if planted and n and h % 10 == 0 and id_ is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (id_, len(runs), *top, sha(lines), sha(kept))


def made_up(seed, n=150):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        few = [f"w{k}" for k in range(r.choice([1, 2, 3, 30]))]
        parts = []
        for _ in range(r.randint(0, 5)):
            unit = [r.choice(few) for _ in range(r.randint(1, 9))]
            if r.random() < 0.3:  # runs inside the unit of a longer run
                unit = unit * 12 + [r.choice(few)]
            parts += unit * r.choice([1, 1, 2, 3, 4, 9]) + unit[: r.randint(0, len(unit))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    fib = ["a", "b"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    thue = "".join(str(bin(i).count("1") % 2) for i in range(512))
    rows += [(1000, " ".join(fib[-1])), (1001, " ".join(thue)), (1002, "x " * 5000), (1003, None), (1004, ""), (1005, " \n\t "), (None, "y " * 30)]
    rows += [(1006, "ÀÉ ß " * 20), (1007, "one"), rows[5], rows[5], (None, None), (-7, "z q " * 40), (1008, " ".join(f"u{i % 997}" for i in range(6000)))]
    return rows


@pytest.mark.parametrize("seed,planted", [(1, False), (2, True)])
def test_runs(spark, seed, planted):
    from sealbook.llm.periodic_runs import digests, periodic_runs

    rows = made_up(seed)
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], KIND)
    out = digests(periodic_runs(docs, planted=planted))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, out.collect())) == Counter(plain(i, t, planted) for i, t in rows)


def test_no_rows(spark):
    from sealbook.llm.periodic_runs import digests, periodic_runs

    assert digests(periodic_runs(spark.createDataFrame([], KIND))).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_words(seed):
    """Binary texts with many runs in one slice, and rounds of pairing left out or not."""
    from sealbook.llm import periodic_runs as m

    r = random.Random(seed)
    texts = [[r.choice("ab") for _ in range(r.randint(0, 4))] * r.randint(1, 30) + [r.choice("ab")] * r.randint(0, 40) for _ in range(12)]
    texts += [t + u for t in texts[:3] for u in texts[3:6]]
    codes = np.array([ord(c) for t in texts for c in t], np.int64)
    starts = np.cumsum([0] + [len(t) for t in texts])
    expected = sorted((int(a) + s, int(a) + s + n, p) for a, t in zip(starts, texts) for s, n, p in plain_runs(t))
    for rounds in (0, 2, 48):
        m.ROUNDS, before = rounds, m.ROUNDS
        try:
            assert sorted(zip(*(x.tolist() for x in m.runs_of(codes, starts)))) == expected
        finally:
            m.ROUNDS = before


def test_repeated_words_become_few_symbols():
    """A run of 2**14 words takes about as many rounds as it has doublings, and few symbols are looked at."""
    from sealbook.llm import periodic_runs as m

    looked, crossing = [], m._crossing
    m._crossing = lambda four, lo, border, hi: looked.append(len(lo)) or crossing(four, lo, border, hi)
    try:
        codes = np.tile(np.arange(3), 2**14 // 3)
        assert [x.tolist() for x in m.runs_of(codes, np.array([0, len(codes)]))] == [[0], [len(codes)], [3]]
    finally:
        m._crossing = crossing
    assert sum(looked) < 60
