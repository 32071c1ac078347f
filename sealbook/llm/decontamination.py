"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased and cut to words joined by single spaces. An item of n
characters may differ from a passage by ``k = 0.08 n`` edits. Such a passage still shares at least
``n + 1 - q - k q`` character q-grams with the item, all on diagonals at most k apart, so they lie in one of the
overlapping bands of ``2 (k + 1)`` diagonals. Bands with enough shared q-grams are retained and verified
by an alignment confined to the band's surroundings.

Shared q-grams are counted per band without a list of all pairs of equal ones, so repetitive texts and items
take no more memory than others.

The benchmark is a query set: it is taken in blocks of bounded size, and every block meets every document
where that lies, so no document is shuffled. Over a benchmark of several blocks there is one pass per block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealbook.llm.common import ids, outer_id, rows_with_text, slices, texts_of
from sealbook.operators.durable import durable

Q = 10
EDIT_RATE = 0.08
#: Items with fewer characters after normalising must occur word for word, and say too little to be looked for
#: if they have fewer than LEAST_WORDS words as well.
LEAST_CHARS, LEAST_WORDS = 20, 3
#: Characters of benchmark text that one pass over the documents looks for.
BLOCK_CHARS = 2_000_000
#: Meetings of text positions and items that are held at once, and bytes of passages whose alignment is remembered.
MEETINGS, ALIGNED_BYTES = 1 << 17, 8_000_000

_WORDS = re.compile(r"\w+")
_TOP = np.uint64(44)  # leaves 20 bits for the first look-up


def normal(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def sought(item: str) -> bool:
    """Whether a normalised item is looked for at all."""
    return len(item) >= LEAST_CHARS or item.count(" ") + 1 >= LEAST_WORDS


def edits(n: int) -> int:
    """The edit budget of an item of n characters; leaves at least one shared q-gram."""
    return max(0, min(int(EDIT_RATE * n), (n - Q) // Q))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray) -> np.ndarray:
    n = max(0, len(codes) - Q + 1)
    out = np.zeros(n, np.uint64)
    for k in range(Q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[k : k + n]
    return out


class Index:
    """The q-grams of a block of items, and what each item asks for."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids, self.words, self.texts = [i for i, _ in items], [t for _, t in items], [_codes(t) for _, t in items]
        self.n = np.array([len(t) for t in self.texts], np.int64)
        self.k = np.array([edits(n) for n in self.n.tolist()], np.int64)
        self.least = self.n + 1 - Q - self.k * Q
        grams = [_grams(t) for t in self.texts]
        flat = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        flat, item = flat[order], np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)])[order].astype(np.int64)
        # Places of a q-gram in an item that are at most a band's step apart are one interval: together they
        # meet a text position on every band between the first and the last of them.
        opens = np.ones(len(flat), bool)
        opens[1:] = (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > self.k[item[1:]] + 1)
        at = np.flatnonzero(opens)
        self.item, self.low, self.high = item[at], place[at], place[np.append(at, len(flat))[1:] - 1]
        self.grams, self.first = np.unique(flat[at], return_index=True)
        self.count = np.diff(np.append(self.first, len(at)))
        #: Items without a q-gram, by their words.
        self.short: dict[str, list[int]] = {}
        for i, (_, t) in enumerate(items):
            if len(t) < Q:
                self.short.setdefault(t, []).append(i)
        self.short_sizes = sorted({t.count(" ") + 1 for t in self.short})
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.grams >> _TOP).astype(np.int64)] = True


def distance(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> int:
    """Fewest edits between the item and a passage of the text that begins at ``low`` to ``high``; k + 1 if over k.

    Row by row over the item, on the diagonals ``low - k`` to ``high + k`` only.
    """
    first, width = low - k, high - low + 2 * k + 1
    far = k + 1
    starts = np.arange(first, first + width)
    row = np.where((starts >= 0) & (starts <= len(text)), 0, far)
    slope = np.arange(width)
    for i, c in enumerate(item.tolist()):
        at = starts + i  # the text character that a diagonal pairs with this one
        inside = (at >= 0) & (at < len(text))
        differs = np.ones(width, np.int64)
        differs[inside] = text[at[inside]] != c
        best = np.where(inside, row + differs, far)
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)  # the item's character is missing in the text
        best[(at + 1 < 0) | (at + 1 > len(text))] = far
        row = np.minimum(np.minimum.accumulate(best - slope) + slope, far)  # extra characters in the text
        row[(at + 1 < 0) | (at + 1 > len(text))] = far
        if row.min() > k:
            return far
    return int(row.min())


def _meetings(codes: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Text positions and the intervals of items with the same q-gram, by position and at most MEETINGS at a time
    (more only if one position alone has more), each time with the position that the next begins at."""
    grams = _grams(codes)
    maybe = np.flatnonzero(index.known[(grams >> _TOP).astype(np.int64)]) if len(index.grams) else np.empty(0, np.int64)
    slot = np.minimum(np.searchsorted(index.grams, grams[maybe]), max(0, len(index.grams) - 1))
    same = index.grams[slot] == grams[maybe] if len(maybe) else np.zeros(0, bool)
    del grams
    maybe, slot = maybe[same], slot[same]
    ends = np.cumsum(index.count[slot])
    start = 0
    while start < len(maybe):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MEETINGS, side="right")))
        first, reps = index.first[slot[start:stop]], index.count[slot[start:stop]]
        entry = np.repeat(first - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        yield np.repeat(maybe[start:stop], reps), entry, int(maybe[stop]) if stop < len(maybe) else len(codes)
        start = stop


def _summed(*columns: np.ndarray) -> list[np.ndarray]:
    """The last column summed per distinct value of the others, in their order."""
    *keys, n = columns
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    new = np.ones(len(n), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [*(k[at] for k in keys), np.add.reduceat(n, at) if len(at) else n]


def _retained(codes: np.ndarray, begins: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """Text, item and lowest diagonal (in the text) of the bands with as many shared q-grams as the lemma asks for.

    A band's q-grams are counted by text position. Positions come in order, so counts of a band are final once
    its last position has passed; only the counts of open bands are held.
    """
    shift = int(index.n.max(initial=0)) + 1  # keeps diagonals positive
    held = [np.empty(0, np.int64)] * 4
    for position, entry, following in _meetings(codes, index):
        item = index.item[entry]
        step = index.k[item] + 1
        # Each diagonal lies in its own band and in the one before, which overlap.
        top = (position - index.low[entry] + shift) // step
        reps = top - (position - index.high[entry] + shift) // step + 2
        for a, b in _bounded(reps, MEETINGS):
            r = reps[a:b]
            back = np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
            band, where, which = np.repeat(top[a:b], r) - back, np.repeat(position[a:b], r), np.repeat(item[a:b], r)
            row = np.searchsorted(begins, where, side="right") - 1
            # Intervals of one q-gram in one item may share a band: the position counts once.
            row, which, band, _, n = _summed(row, which, band, where, np.ones(len(band), np.int64))
            held = _summed(*(np.concatenate([x, y]) for x, y in zip(held, (row, which, band, np.minimum(n, 1)))))
        row, item, band, n = held
        step = index.k[item] + 1
        low = band * step - shift
        final = (low + 2 * step + index.n[item] < following) | (begins[row + 1] <= following)
        enough = final & (n >= index.least[item])
        yield from zip(row[enough].tolist(), item[enough].tolist(), (low - begins[row])[enough].tolist())
        held = [x[~final] for x in held]


def _bounded(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes add up to about ``most``, cut anywhere: counts are added up later."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, stop
        start = stop


def find(texts: list[str], index: Index) -> list[list[tuple[int | None, int]]]:
    """For each normalised text the items it holds, with their fewest edits."""
    out: list[dict[int, int]] = [{} for _ in texts]
    codes = _codes("\n".join(texts))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    aligned: dict[tuple[int, int, bytes], int] = {}  # passages of repetitive texts are aligned once
    for r, i, low in _retained(codes, begins, index):
        k = int(index.k[i])
        if out[r].get(i, k + 1) == 0:
            continue
        if index.n[i] < LEAST_CHARS:
            if f" {index.words[i]} " in f" {texts[r]} ":
                out[r][i] = 0
            continue
        text = codes[begins[r] : begins[r + 1] - 1]
        cut = max(0, low - 2 * k)
        near = text[cut : low + 2 * (k + 1) + int(index.n[i]) + 2 * k]
        key = (i, low - cut, near.tobytes())
        if key not in aligned:
            if len(aligned) * len(key[2]) > ALIGNED_BYTES:
                aligned.clear()
            aligned[key] = distance(index.texts[i], near, low - cut, low - cut + 2 * k + 1, k)
        d = aligned[key]
        if d <= k:
            out[r][i] = min(d, out[r].get(i, d))
    for r, words in enumerate(t.split(" ") for t in (texts if index.short else ())):
        for size in index.short_sizes:
            for at in range(len(words) - size + 1):
                for i in index.short.get(" ".join(words[at : at + size]), ()):
                    out[r][i] = 0
    return [[(index.ids[i], d) for i, d in sorted(found.items())] for found in out]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[Index]:
    """Indexes over blocks of the items, of about that many characters; at most one is on the driver."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).filter("length(text) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct().collect()
        kept = [(r.item_id, t) for r in rows if sought(t := normal(r.text))]
        if kept:
            yield Index(sorted(kept, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))


_MATCHES = "array<struct<item_id: bigint, edits: bigint>>"


def _looked_up(base: DataFrame, index: Index) -> DataFrame:
    """``matches`` of the rows filled with the items of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = find([normal(t) for t in texts_of(batch).to_pylist()], index)
            column = batch.schema.get_field_index("matches")
            rows = [[{"item_id": i, "edits": d} for i, d in f] for f in found]
            yield batch.set_column(column, "matches", pa.array(rows, batch.schema.field(column).type))

    return base.mapInArrow(run, base.schema)


def _matched(docs: DataFrame, benchmark: DataFrame, block_chars: int) -> DataFrame:
    """``row``, ``id`` and ``matches`` of every row of ``docs``.

    A benchmark of one block goes over the documents where they lie. A larger one is a pass per block, each a job of
    its own, so that one block at a time is in a plan and on the executors. A pass keeps the key and matches of the
    documents that have some; those are put together and joined back. Rows of equal id and text have equal matches,
    so both, hashed, are the key.
    """
    base = docs.select(F.struct("*").alias("row"), *ids(docs)).withColumn("matches", F.array().cast(_MATCHES))
    blocks = _blocks(benchmark, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return base
    if second is None:
        return _looked_up(docs.select(*rows_with_text(docs), ids(docs)[0], F.array().cast(_MATCHES).alias("matches")), first)
    key = [F.col("id").alias("key_id"), F.sha2("text", 256).alias("key_text")]
    found = None
    for index in chain((first, second), blocks):
        bare = _looked_up(base.select("id", "text", "matches"), index).filter("size(matches) > 0")
        part = durable(bare.select(*key, F.explode("matches").alias("match")).distinct())
        found = part if found is None else found.unionByName(part)
    found = durable(found.groupBy("key_id", "key_text").agg(F.array_sort(F.collect_list("match")).alias("found")))
    return base.select("row", "id", "text", *key).join(found, ["key_id", "key_text"], "left").select(
        "row", "id", F.coalesce("found", F.array().cast(_MATCHES)).alias("matches")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``contaminated``, ``n_items``, ``item_ids``, ``fewest_edits``, ``kept`` of every row of ``docs``.

    A document is contaminated if it holds a passage within the edit budget of a benchmark item. Null and
    empty texts hold none. Items under ``LEAST_CHARS`` characters have no edit budget and must occur as whole words;
    of those, items of under ``LEAST_WORDS`` words, and items without text, are not looked for.
    Null doc_ids are judged like others, and identical rows get identical results. An empty benchmark
    contaminates nothing and empty documents give no rows; other columns are not looked at.
    """
    found = _matched(docs, benchmark, block_chars)
    return found.select(
        outer_id(F.col("id")).alias("doc_id"), (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"),
        F.array_sort("matches.item_id").alias("item_ids"), F.array_min("matches.edits").alias("fewest_edits"), (F.size("matches") == 0).alias("kept"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    return _matched(docs, benchmark, BLOCK_CHARS).filter(F.size("matches") == 0).select("row.*")
