"""Runs of repeated words, found in a grammar of the text.

The word ids of a slice of documents are compressed by Re-Pair: frequent pairs of neighbours become symbols of their
own, round by round, until none repeats; what is left of a document is joined in a balanced tree. Each symbol made of
more than ``LEAST`` words is looked at once: a run that lies across the border of its two halves shows itself by equal words one
period apart on one side of the border. The longest such stretch inside the symbol follows from names of blocks of
1, 2, 4, ... words. Runs are then moved to all places where the symbol stands, and of stretches of one period that
overlap only the longest stays. The lowest symbol that holds a run wholly has it across its border, so none is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealbook.llm.common import LOWEST, documents, mixed, outer_id, slices

#: Words that a run has at least, and repeats of its period.
LEAST, TIMES = 24, 3
#: Rounds of pairing by frequency; what repeats after that is found all the same, only more than once.
ROUNDS = 48

_KIND = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are what lies between spaces and the controls tab to carriage return. A run is a stretch of ``LEAST`` or more
    words that repeats with its smallest period at least ``TIMES`` times and that no neighbour extends.
    ``collapsed`` has the words joined by a space, without those that some run holds after its first period.
    With ``planted`` some documents are first made periodic by the crc32 of their doc_id (see `planted_words`), which
    gives tables without repeats something to find.

    A null or empty text has no words, no runs and an empty ``collapsed``. Rows of one doc_id are handled each by
    itself; where the doc_id is null nothing is planted. Other columns are not read. A document is handled by one
    task, so it has to fit a worker: about 250 bytes a word.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield _found(part, planted)

    return documents(docs).mapInArrow(found, _KIND).select(outer_id(F.col("id")).alias("doc_id"), "n_words", "runs", "collapsed")


def digests(found: DataFrame) -> DataFrame:
    """``doc_id``, ``n_runs``, the run of greatest length by period (ties: smallest start, then period), and hashes of runs and ``collapsed``.

    Exponents are compared exactly, as products of whole numbers.
    """
    better = lambda a, b: F.when(
        a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b
    ).otherwise(a)
    # Runs are in order of start and period, so the first of equal ones stays.
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    rows = found.withColumn("best", F.aggregate("runs", none, better))
    lines = F.transform("runs", lambda r: F.concat(*[x for c in ("start", "length", "period") for x in (F.lit(","), r[c].cast("string"))][1:], F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _found(batch: pa.RecordBatch, planted: bool) -> pa.RecordBatch:
    ids = batch.column("id").to_numpy()
    data, first, last, starts = split_words(batch.column("text"))
    codes = _codes(data, first, last)
    if planted and len(codes):
        source = planted_words(ids, starts)
        codes, first, last = codes[source], first[source], last[source]
    lo, hi, period = runs_of(codes, starts)

    # Every word but a run's first period is dropped.
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, lo + period, 1)
    np.add.at(cover, hi, -1)
    keep = np.cumsum(cover[:-1]) == 0
    owner = np.searchsorted(starts, lo, side="right") - 1
    order = np.lexsort((period, lo, owner))
    owner, lo, hi, period = owner[order], lo[order], hi[order], period[order]
    kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    parts = [pa.array(x) for x in (lo - starts[owner], hi - lo, period)]
    offsets = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(kinds)))
    kept = np.concatenate([[0], np.cumsum(keep)])[starts]
    collapsed = _joined(data, first[keep], last[keep], kept)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(starts)), runs, collapsed], names=["id", "n_words", "runs", "collapsed"])


def split_words(texts: pa.Array):
    """The bytes of all texts, where words begin and end in them, and the number of each text's first word (one more at the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    # A word begins after a separator or at the start of its text.
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return raw, first, last, np.searchsorted(first, at)


def _joined(data: np.ndarray, first: np.ndarray, last: np.ndarray, starts: np.ndarray) -> pa.Array:
    """For each text its words joined by one space."""
    sizes = last - first + 1
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(first - (ends - sizes), sizes) + np.arange(total)
    space = ends - 1
    at[space] = 0
    out = data[at] if len(data) else np.empty(0, np.uint8)
    out[space] = 32
    # The space after a text's last word is left out.
    bounds = np.concatenate([[0], ends])[starts]
    full = starts[1:] > starts[:-1]
    out = np.delete(out, bounds[1:][full] - 1)
    offsets = bounds - np.concatenate([[0], np.cumsum(full)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.large_string()).cast(pa.string())


def _codes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A number per word, the same for the same bytes."""
    if not len(first):
        return np.empty(0, np.int64)
    sizes = last - first
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def planted_words(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which word stands at each place once a tenth of the documents has been made periodic.

    With h the crc32 of the decimal doc_id and g = h // 10, a document of n words with h % 10 == 0 gets, from word
    a = g % n on, the words a to a + p - 1 over and over, p = 1 + (n - a) // (3 + g % 8).
    """
    source = np.arange(starts[-1])
    for k, id_ in enumerate(ids.tolist()):
        n = int(starts[k + 1] - starts[k])
        h = zlib.crc32(b"%d" % id_)
        if n and h % 10 == 0 and id_ != LOWEST:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            place = np.arange(n - a)
            source[starts[k] + a : starts[k + 1]] = starts[k] + a + place % p
    return source


def runs_of(codes: np.ndarray, starts: np.ndarray):
    """Start, end and smallest period of all runs; texts begin at ``starts``."""
    n = len(codes)
    nothing = (np.empty(0, np.int64),) * 3
    if n < LEAST:
        return nothing
    four = _names(_names(codes, 1), 2)  # equal where four words are equal
    # Symbols in text order: their number, first word and text.
    symbol, at = codes.copy(), np.arange(n)
    text = np.searchsorted(starts, at, side="right") - 1
    fresh = int(codes.max()) + 1
    checks, places = [], []
    for round_ in range(10_000):
        joins = text[:-1] == text[1:]
        if not joins.any():
            break
        if round_ < ROUNDS:
            chosen, rules = _frequent(symbol, joins, fresh)
        if round_ >= ROUNDS or chosen is None:
            # Neighbours in a balanced tree: every second border of each text.
            place = np.arange(len(symbol)) - np.searchsorted(text, text, side="left")
            chosen = np.flatnonzero(joins & (place[:-1] % 2 == 0))
            rules = np.arange(len(chosen))
            round_ = ROUNDS
        end = np.append(at[1:], n)
        lo, border, hi = at[chosen], at[chosen + 1], end[chosen + 1]
        _, example = np.unique(rules, return_index=True)
        long_ = example[hi[example] - lo[example] >= LEAST]
        seen = _crossing(four, lo[long_], border[long_], hi[long_])
        if len(seen[0]):
            of = np.full(len(example), -1)
            of[rules[long_]] = np.arange(len(long_))
            kind = of[rules]
            base = sum(map(len, places))
            shown = np.unique(seen[0])
            rank = np.full(len(long_), -1)
            rank[shown] = np.arange(len(shown))
            checks.append((rank[seen[0]] + base, lo[long_][seen[0]], hi[long_][seen[0]], seen[1], seen[2]))
            here = np.flatnonzero(kind >= 0)
            here = here[rank[kind[here]] >= 0]
            here = here[np.argsort(rank[kind[here]], kind="stable")]
            groups = np.split(lo[here], np.flatnonzero(np.diff(rank[kind[here]])) + 1)
            places.append(groups)
        symbol[chosen] = fresh + rules
        fresh += len(example)
        stay = np.ones(len(symbol), bool)
        stay[chosen + 1] = False
        symbol, at, text = symbol[stay], at[stay], text[stay]
    if not checks:
        return nothing
    node, lo, hi, left, right = (np.concatenate(x) for x in zip(*checks))
    start, end = _extended(codes, starts, left, right, lo, hi)
    period = right - left
    full = end - start >= np.maximum(LEAST, TIMES * period)
    node, lo, start, end, period = (x[full] for x in (node, lo, start, end, period))
    places = [p for groups in places for p in groups]
    found = np.unique(np.stack([node, start - lo, end - start, period], axis=1), axis=0)
    # To every place of the symbol.
    times = np.array([len(places[k]) for k in found[:, 0]], np.int64)
    if not len(times):
        return nothing
    moved = np.concatenate([places[k] for k in found[:, 0]])
    shift, length, period = (np.repeat(found[:, c], times) for c in (1, 2, 3))
    return _maximal(moved + shift, moved + shift + length, period)


def _frequent(symbol: np.ndarray, joins: np.ndarray, fresh: int):
    """Places of pairs that repeat and are more frequent than the pairs they overlap, and the rule of each.

    Replacing the most frequent pair first comes to the same wherever pairs do not overlap, so all such
    pairs of a round go at once.
    """
    key = np.where(joins, symbol[:-1] * fresh + symbol[1:], -1 - np.arange(len(joins)))
    _, same, times = np.unique(key, return_inverse=True, return_counts=True)
    times = times[same]
    if times.max(initial=0) < 2:
        return None, None
    # Ties by hash: a chain of pairs of one frequency must not go one pair a round.
    priority = (times.astype(np.uint64) << np.uint64(32)) | (mixed(same.astype(np.uint64)) >> np.uint64(32))
    up = np.concatenate([[True], (priority[1:] > priority[:-1]) | (key[1:] == key[:-1])])
    down = np.concatenate([(priority[:-1] > priority[1:]) | (key[1:] == key[:-1]), [True]])
    chosen = np.flatnonzero(up & down & (times > 1))
    # Neighbouring places are those of one pair in a row (a, a, a): every second one.
    begins = np.concatenate([[True], np.diff(chosen) > 1])
    run = np.arange(len(chosen)) - np.maximum.accumulate(np.where(begins, np.arange(len(chosen)), 0))
    chosen = chosen[run % 2 == 0]
    if not len(chosen):
        return None, None
    return chosen, np.unique(same[chosen], return_inverse=True)[1]


def _names(names: np.ndarray, step: int) -> np.ndarray:
    """Numbers for blocks of twice the length: equal where both halves are."""
    key = names[:-step] * (int(names.max(initial=0)) + 1) + names[step:]
    return np.unique(key, return_inverse=True)[1] if len(key) else key


def _crossing(four: np.ndarray, lo: np.ndarray, border: np.ndarray, hi: np.ndarray):
    """Which symbols may have a run across their border, and two places one period apart in it.

    A run has half its length on one side of the border, that is 12 words and 1.5 periods or more. So on that
    side at least four words next to the border equal those one period further.
    """
    most = (hi - lo) // TIMES
    node = np.repeat(np.arange(len(lo)), most)
    period = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
    b = border[node]
    right = np.flatnonzero(b + period + 4 <= hi[node])
    right = right[four[b[right]] == four[b[right] + period[right]]]
    left = np.flatnonzero(b - period - 4 >= lo[node])
    left = left[four[b[left] - 4] == four[b[left] - 4 - period[left]]]
    return (
        np.concatenate([node[right], node[left]]),
        np.concatenate([b[right], b[left] - period[left]]),
        np.concatenate([b[right] + period[right], b[left]]),
    )


def _extended(codes, starts, left, right, lo, hi):
    """The longest stretch inside lo to hi around ``left`` that equals itself moved to ``right``."""
    # Only texts with something to extend get names of long blocks.
    text = np.searchsorted(starts, lo, side="right") - 1
    used = np.unique(text)
    sizes = starts[used + 1] - starts[used]
    moved = np.cumsum(sizes) - sizes
    shift = moved[np.searchsorted(used, text)] - starts[text]
    pick = np.repeat(starts[used] - moved, sizes) + np.arange(sizes.sum())
    names, longest = [codes[pick]], int((hi - lo).max(initial=0))
    while 2 ** len(names) <= min(longest, len(pick)):
        names.append(_names(names[-1], 2 ** (len(names) - 1)))
    ahead, behind = right + shift, left + shift  # ahead runs up to hi, behind down to lo
    top, bottom = hi + shift, lo + shift
    forward, back = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for k in range(len(names) - 1, -1, -1):
        size, name = 2**k, names[k]
        i = np.flatnonzero(ahead + forward + size <= top)
        forward[i[name[ahead[i] + forward[i]] == name[behind[i] + forward[i]]]] += size
        i = np.flatnonzero(behind - back - size >= bottom)
        back[i[name[ahead[i] - back[i] - size] == name[behind[i] - back[i] - size]]] += size
    return left - back, right + forward


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """Of stretches of one period the longest; of one stretch the smallest period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    # Within a period the ends so far; periods are kept apart by a step larger than any end.
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + period * step)
    stays = np.concatenate([[True], (end + period * step)[1:] > reach[:-1]])
    start, end, period = start[stays], end[stays], period[stays]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)])
    return start[new], end[new], period[new]
