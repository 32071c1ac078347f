"""What several operators share: document ids, words, set hashes, tables kept for a later step."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stands for a null doc_id inside the operators, so that it sorts first and joins with itself.
LOWEST = -(2**63)
#: Words are what lies between these separators: space, and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handled in slices of about this many bytes, so that memory does not follow the batch size.
SLICE_BYTES = 2_000_000


def ids(docs: DataFrame) -> list[Column]:
    """``id`` and ``text`` of documents: null ids become LOWEST, null texts stay."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)).alias("id"), docs["text"].cast("string").alias("text")]


def documents(docs: DataFrame) -> DataFrame:
    """``id``, ``text`` of documents, whatever else the table has."""
    return docs.select(*ids(docs))


def rows_with_text(docs: DataFrame) -> list[Column]:
    """``row`` with all columns; ``text`` beside it only if `texts_of` does not find a string in the row, so that workers get it once."""
    found = [f.dataType for f in docs.schema if f.name == "text"]
    return [F.struct("*").alias("row"), *(ids(docs)[1:] if found != [StringType()] else ())]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch of `documents` or `rows_with_text`."""
    return batch.column(column) if column in batch.schema.names else pc.struct_field(batch.column("row"), column)


def outer_id(id_: Column) -> Column:
    """The doc_id to give back for an inner id."""
    return F.when(id_ != LOWEST, id_)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded bytes; one very long text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts_of(batch, column)), 0).to_numpy(zero_copy_only=False))
        start, n = 0, batch.num_rows
        while start < n:
            end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, side="right"))
            end = max(end, start + 1)
            yield batch.slice(start, end - start)
            start = end


class Words:
    """The words of some texts as arrays: no Python object per word.

    ``starts`` has where each text's words begin (one more at the end), ``hashes`` a 64-bit hash per word.
    ``joined`` is all words, each followed by one space, and ``offsets`` where each begins in it.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        data = np.insert(raw, ends[1:] - ends[0], 32)
        ends = ends[1:] - ends[0] + np.arange(1, len(texts) + 1)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)
        inside = (data != 32) & ((data < 9) | (data > 13))
        change = np.flatnonzero(np.diff(inside, prepend=False))
        first, last = change[::2], change[1::2]  # every text ends in a separator
        lengths = last - first
        self.starts = np.searchsorted(first, np.concatenate([[0], ends]))
        keep = inside.copy()
        keep[last] = True
        self.joined = data[keep]
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.joined[self.offsets[1:] - 1] = 32
        self.hashes = _hashes_in_parts(self.joined, self.offsets[:-1], self.offsets[1:] - 1)

    def __len__(self) -> int:
        return len(self.hashes)


def _parts(starts: np.ndarray, ends: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of runs of about so many bytes, so that what is computed per byte takes little memory."""
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + most, side="right")))
        yield first, last
        first = last


def _hashes_in_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    hashes = [np.empty(0, np.uint64)]
    for a, b in _parts(starts, ends):
        low, high = starts[a], ends[b - 1]
        hashes.append(_run_hashes(data[low:high], starts[a:b] - low, ends[a:b] - low))
    return np.concatenate(hashes)


def _run_hashes(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: a polynomial from running sums, with powers of an odd base and of its inverse."""
    n = len(data)
    powers, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    terms = data + np.uint64(1)
    terms *= powers[:n]
    np.cumsum(terms, out=sums[1:])
    del terms
    return mixed((sums[to] - sums[at]) * inverse[at] + mixed((to - at).astype(np.uint64)))


_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of the base and of its inverse, modulo 2**64."""
    store = kept_in_worker("powers", dict)
    if len(store.get("up", ())) < n:
        n += n // 4
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            column = np.full(n, base, np.uint64)
            column[0] = 1
            store[name] = np.cumprod(column, dtype=np.uint64)
    return store["up"], store["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of each 64-bit value depends on every bit that came in."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` hashes, in order; runs may cross documents, callers leave those out."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words (A-Z lowered).

    A text with fewer words has its whole sequence as one run, a text without words an empty set.
    """
    words = Words(texts, lower=True)
    hashes, starts = words.hashes, words.starts
    grams = gram_hashes(hashes, size)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(gram_hashes(hashes[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Segments:
    """Texts cut between every two bytes x, y with ``cut[x, y]``; no Python object per segment.

    Texts marked in ``whole`` are one segment each. ``data`` is the bytes of all texts, ``starts`` and ``ends`` where
    the segments lie in it, and ``firsts`` the number of segments before each text (one more at the end). Segment i is
    the same bytes as the one numbered ``sample[kind[i]]``: kinds are found by hash and compared byte for byte.
    """

    def __init__(self, texts: pa.Array, cut: np.ndarray, whole: np.ndarray | None = None):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        n = len(self.data)
        begins = np.zeros(n, bool)
        begins[1:] = cut.ravel()[(self.data[:-1].astype(np.uint16) << np.uint16(8)) | self.data[1:]]
        for t in np.flatnonzero(whole).tolist() if whole is not None else ():
            begins[bounds[t] : bounds[t + 1]] = False
        begins[bounds[:-1][bounds[:-1] < n]] = True
        self.starts = np.flatnonzero(begins)
        self.ends = np.append(self.starts, n)[1:]
        self.firsts = np.searchsorted(self.starts, bounds)
        hashes = _hashes_in_parts(self.data, self.starts, self.ends)
        _, self.sample, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        lengths, like = self.ends - self.starts, self.sample[self.kind]
        differs = [np.empty(0, np.int64)]
        for p in (slice(a, b) for a, b in _parts(self.starts, self.ends)):
            low, high = self.starts[p][0], self.ends[p][-1]
            twin = np.repeat(self.starts[like[p]] - self.starts[p], lengths[p])
            twin += np.arange(low, high)
            np.minimum(twin, n - 1, out=twin)
            differs.append(low + np.flatnonzero(self.data[low:high] != self.data[twin]))
        differs = np.concatenate(differs)
        odd = np.union1d(np.flatnonzero(lengths != lengths[like]), np.searchsorted(self.starts, differs, side="right") - 1)
        self.kind[odd] = len(self.sample) + np.arange(len(odd))
        self.sample = np.append(self.sample, odd)
        self.hashes = hashes[self.sample]

    def coded(self, known: Known, encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments, one after the other, and the number of ids before each text (one more at the end).

        ``encode`` takes segments that are not known yet, as bytes, and gives the ids of each as bytes of 32-bit integers.
        """
        flat, places, sizes = known.coded(self.data, self.starts[self.sample], self.ends[self.sample], self.hashes, encode)
        counts = sizes[self.kind]
        before = np.concatenate([[0], np.cumsum(counts)])
        out = flat[np.repeat(places[self.kind] - before[:-1], counts) + np.arange(before[-1])]
        return out, before[self.firsts]


def _spans(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of ``source``, one after the other."""
    before = np.cumsum(sizes) - sizes
    return source[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


class _Pairs:
    """Segments and their ids as arrays in the order they came, and their hashes sorted; no two have the same hash."""

    def __init__(self):
        self.hashes, self.rows = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.data, self.ids = np.empty(0, np.uint8), np.empty(0, np.uint32)
        self.data_ends, self.ids_ends = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.rows)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        out = at < len(self)
        out[out] = self.hashes[at[out]] == hashes[out]
        return out

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The row of each segment, -1 for those that are not here; compared byte for byte."""
        rows = np.full(len(hashes), -1, np.int64)
        if not len(self):
            return rows
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        row = self.rows[at[hit]].astype(np.int64)
        same = lengths[hit] == self.data_ends[row + 1] - self.data_ends[row]
        hit, row = hit[same], row[same]
        rows[hit] = row
        n = lengths[hit]
        differs = np.flatnonzero(_spans(data, starts[hit], n) != _spans(self.data, self.data_ends[row], n))
        rows[hit[np.searchsorted(np.cumsum(n), differs, side="right")]] = -1
        return rows

    def add(self, data: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Takes up segments, given one after the other, whose hashes are all new and different."""
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.rows = np.insert(self.rows, at, len(self) + order)
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.data, self.ids = np.concatenate([self.data, data]), np.concatenate([self.ids, ids])
        self.data_ends = np.concatenate([self.data_ends, self.data_ends[-1] + np.cumsum(lengths)])
        self.ids_ends = np.concatenate([self.ids_ends, self.ids_ends[-1] + np.cumsum(sizes)])


class Known:
    """Encoded segments that a worker keeps: those in use and those of the round before, of bounded bytes.

    A round ends when it holds ``most`` bytes of segments and ids, each pair counted with 200 more (the arrays take a
    fifth of that); segments over ``longest`` bytes are never kept.
    """

    def __init__(self, most: int = 96_000_000, longest: int = 200):
        self.most, self.longest = most, longest
        self.now, self.before = _Pairs(), _Pairs()
        self.held = 0

    def coded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct segments of ``data``: all of them, where those of each segment begin, and how many they are.

        ``encode`` takes segments that are not known yet, as bytes, and gives the ids of each as bytes of 32-bit integers.
        """
        lengths, order, found, counts = ends - starts, [], [], []

        def take(which: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
            order.append(which)
            found.append(ids)
            counts.append(sizes)

        missing = np.arange(len(hashes))
        for pairs in (self.now, self.before):
            rows = pairs.find(data, starts[missing], lengths[missing], hashes[missing])
            hit = rows >= 0
            rows = rows[hit]
            sizes = pairs.ids_ends[rows + 1] - pairs.ids_ends[rows]
            take(missing[hit], _spans(pairs.ids, pairs.ids_ends[rows], sizes), sizes)
            missing = missing[~hit]
        if len(missing):
            raw = data.tobytes()
            new = encode([raw[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist())])
            take(missing, np.frombuffer(b"".join(new), np.uint32), np.fromiter(map(len, new), np.int64, len(new)) // 4)
        places, sizes = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        sizes[np.concatenate(order)] = np.concatenate(counts)
        places[np.concatenate(order)] = np.cumsum(np.concatenate(counts)) - np.concatenate(counts)
        flat = np.concatenate(found)
        late = np.concatenate(order[1:])
        late = late[lengths[late] <= self.longest]
        self.held += int(lengths[late].sum() + 4 * sizes[late].sum()) + 200 * len(late)
        late = late[np.unique(hashes[late], return_index=True)[1]]
        late = late[~self.now.holds(hashes[late])]
        self.now.add(_spans(data, starts[late], lengths[late]), lengths[late], hashes[late], _spans(flat, places[late], sizes[late]), sizes[late])
        if self.held > self.most:
            self.now, self.before, self.held = _Pairs(), self.now, 0
        return flat, places, sizes

    def look_up(self, keys: list[bytes], encode) -> list[bytes]:
        """What each of the distinct ``keys`` is encoded as."""
        ends = np.cumsum([0, *map(len, keys)])
        data = np.frombuffer(b"".join(keys), np.uint8)
        flat, places, sizes = self.coded(data, ends[:-1], ends[1:], _hashes_in_parts(data, ends[:-1], ends[1:]), encode)
        return [flat[a : a + n].tobytes() for a, n in zip(places.tolist(), sizes.tolist())]


def kept_in_worker(name: str, make):
    """One object per Python worker process, made when first asked for."""
    home = sys.modules.setdefault("sealbook_worker", ModuleType("sealbook_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
