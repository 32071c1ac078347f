"""Collocations against a plain count of every phrase, also where most fingerprints collide."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, lang string, text string, phrase string, a string, chunk string, `odd name. here` string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, low=2, high=3, least=10, nested=50, top=2000):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, high + 1):
                count[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = Counter()
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if low <= len(p) and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= nested * a for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out[lang, rank, p.decode(), -a, left, right, n[lang], -s] += 1
    return out


def made_up(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "ÀB", "w\x0bx", "日本"]
    fixed = ["new york city", "New York", "of the", "a a a a"]
    rows = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        glue = [r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r"]) for _ in parts]
        rows.append((r.choice(["en", "en", "de", None, "und"]), "".join(a + b for a, b in zip(parts, glue))))
    return rows + [("en", None), ("fr", ""), ("fr", " ,. \n"), (None, None), ("en", "x y " * 3000), rows[3], rows[3], ("nl", "een twee " * 10)]


def table(spark, rows):
    return spark.createDataFrame([(k % 7, i, t, "x", "y", "z", "w") for k, (i, t) in enumerate(rows)], KIND)


def found(df):
    assert df.columns == COLUMNS
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("seed,chunk,spare,ranges", [(1, 8_000_000, 16, 6_000_000), (2, 3000, 16, 5000), (3, 3000, -9, 5000)])
def test_all_phrases(spark, monkeypatch, seed, chunk, spare, ranges):
    from sealbook.llm import collocations as m

    monkeypatch.setattr(m, "RANGE_BYTES", ranges)
    rows = made_up(seed)
    assert found(m.collocations(table(spark, rows), chunk_bytes=chunk, spare_bits=spare)) == plain(rows)


def test_other_limits(spark):
    from sealbook.llm.collocations import collocations

    rows = made_up(4)
    asked = dict(min_words=3, max_words=5, least=4, nested_percent=80, top=15)
    assert found(collocations(table(spark, rows), **asked)) == plain(rows, 3, 5, 4, 80, 15)


def test_few_rows(spark):
    from sealbook.llm.collocations import collocations

    for rows in ([], [(None, None)], [("en", "a b")], [("en", "a b. " * 9)], [("en", "a b. " * 10)]):
        assert found(collocations(table(spark, rows))) == plain(rows)


def test_packing():
    from sealbook.llm import collocations as m

    r = np.random.default_rng(1)
    values = np.unique(r.integers(0, 2**63, 50_000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert (m._unpack_rising(m._pack_rising(values), len(values)) == values).all()
    short = np.unique(values >> np.uint64(24))
    assert (m._unpack_rising(packed := m._pack_rising(short), len(short)) == short).all() and len(packed) < 3.6 * len(short)
