"""Frequent phrases and how strongly their words belong together, counted by fingerprints.

A pass over chunks of documents hashes every phrase of up to the most words by prefix polynomials (Rabin and Karp) and
sends sorted fingerprints, with the chunk as their place, to the task of their range. Only fingerprints that are
frequent over all chunks go back, to the chunks that hold them. There the phrases behind them are read from the text,
told apart word by word and counted again, so a collision costs a look but never a count. Text is made for frequent phrases only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealbook.llm.common import kept_in_worker, mixed, slices
from sealbook.operators.durable import Scratch, durable
from sealbook.operators.skew import join_hot

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8_000_000
#: Bytes of text whose phrases share a range of fingerprints.
RANGE_BYTES = 6_000_000
#: Bits of a fingerprint beyond those that number all phrases: about one phrase in 2**16 collides.
SPARE_BITS = 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 32]] = True
_BORDER = np.zeros(256, bool)
_BORDER[[*b".,;:!?", *range(10, 14)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32

_BASE = 0x9E3779B97F4A7C15


def collocations(docs: DataFrame, min_words: int = 2, max_words: int = 3, least: int = 10, nested_percent: int = 50, top: int = 2000,
                 chunk_bytes: int = CHUNK_BYTES, spare_bits: int = SPARE_BITS) -> DataFrame:
    """The ``top`` phrases of each ``lang``: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A-Z is lowered and texts are cut at ``.,;:!?`` and line breaks into pieces, those at spaces and tabs into words. ``a`` counts
    all places of a phrase within pieces, overlapping ones too; ``n`` all words of the language. Candidates have
    ``min_words`` to ``max_words`` words and an ``a`` of ``least`` or more. Cut in two after some word, the parts
    are found ``l`` and ``r`` times, and the score is floor(1000000 * a * a / (l * r)), in decimals, exact for counts below 10**16; the
    cut of the lowest score counts, of equal ones the first. A candidate inside a longer one that is at least ``nested_percent`` percent
    as frequent goes. Ranks are by score, a (both falling) and phrase in byte order.

    Null texts are empty, a null lang is ``und``; doc_id plays no part, so rows that are there twice count twice. Languages
    without candidates, and empty tables, give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held = TaskContext.get().partitionId() << 32, 0
            for part in slices(batches, most=chunk_bytes // 4):
                size = pc.sum(pc.binary_length(part.column("text"))).as_py()
                if held and held + size > chunk_bytes:
                    number, held = number + 1, 0
                held += size
                yield part.append_column("chunk", pa.array(np.full(part.num_rows, number)))

        # Written down, so that a chunk is the same documents in both passes.
        chunks = scratch.keep(texts.mapInArrow(dealt, "lang string, text string, chunk long"))
        total = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        split = max(0, math.ceil(math.log2(max(1, total / RANGE_BYTES))))
        bits = min(64, max(split, math.ceil(math.log2(total * max_words + 2)) + spare_bits))

        def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, rows in _by_chunk(batches):
                phrases = _Phrases(rows, max_words)
                for size in range(1, max_words + 1):
                    yield from phrases.packed(size, bits, split, chunk)

        sent = chunks.mapInArrow(prints, _PACKED).groupBy("part").applyInArrow(lambda rows: _frequent(rows, least), _BACK)

        def texts_of(mine: pa.Table, back: pa.Table) -> pa.Table:
            return _Phrases(mine.to_batches(), max_words).counted(back, bits)

        counts = chunks.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(texts_of, "lang string, size int, phrase string, a long")
        counts = counts.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("size") == 0))
        return durable(_scored(scratch.keep(counts), min_words, nested_percent, top))


def _scored(counts: DataFrame, min_words: int, nested_percent: int, top: int) -> DataFrame:
    phrases = counts.where("size > 0").select("lang", "phrase", "size", "a", F.split("phrase", " ").alias("words"))
    candidates = phrases.where(F.col("size") >= min_words)
    # Each cut of a candidate asks for the counts of both parts.
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    side = F.explode(F.array(F.struct(F.lit(True).alias("head"), F.slice("words", 1, F.col("k")).alias("part")),
                             F.struct(F.lit(False).alias("head"), F.slice("words", F.col("k") + 1, F.col("size")).alias("part"))))
    asked = cut.select("lang", "phrase", "a", "k", side.alias("s")).select("lang", "phrase", "a", "k", "s.head", F.struct("lang", F.array_join("s.part", " ").alias("phrase")).alias("key"))
    # A common word is part of many phrases; how many is counted, and hot ones are spread.
    asks = asked.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    parts = phrases.select(F.struct("lang", "phrase").alias("key"), F.col("a").alias("times")).join(asks, "key")
    told = join_hot(asked, parts, "key", F.struct("phrase", "k"), "copies").groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("head"), F.col("times"))).alias("l"), F.max(F.when(~F.col("head"), F.col("times"))).alias("r")
    )
    wide = "cast({0} as decimal(16,0))"
    score = F.expr(f"cast(1000000 as decimal(7,0)) * ({wide.format('a')} * {wide.format('a')}) div ({wide.format('l')} * {wide.format('r')})")
    cuts = told.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"), F.lit(None).cast("long").alias("longer"))
    # What lies inside a candidate learns how frequent the candidate is.
    inner = candidates.where(F.col("size") > min_words).withColumn("m", F.explode(F.sequence(F.lit(min_words), F.col("size") - 1)))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("words", F.col("from"), F.col("m")), " ").alias("phrase"), F.lit(None).cast("long").alias("a"),
                         F.lit(None).cast(cuts.schema["cut"].dataType).alias("cut"), F.col("a").alias("longer"))
    best = cuts.unionByName(inner).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    kept = best.where(F.coalesce(100 * F.col("longer") < nested_percent * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = counts.where("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


_PACKED = "part long, chunk long, size int, n int, prints binary, counts binary"
_BACK = "chunk long, size int, n int, prints binary"


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes of one weight after those of another; those that are all zero nearly vanish."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def _pack_rising(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_rising(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(packed, n, np.uint64), dtype=np.uint64)


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of one chunk that follow each other. A file may be read in parts, then a chunk comes in as many."""
    held, number = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column("chunk").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(edges, edges[1:]):
            if number is not None and chunk[a] != number:
                yield number, held
                held = []
            number = int(chunk[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield number, held


def _frequent(rows: pa.Table, least: int) -> pa.Table:
    """The fingerprints of a range that are frequent over all chunks, for each chunk those it holds."""
    out = {"chunk": [], "size": [], "n": [], "prints": []}
    sizes, chunks, ns = (rows.column(c).to_pylist() for c in ("size", "chunk", "n"))
    for size in sorted(set(sizes)):
        at = [k for k, s in enumerate(sizes) if s == size]
        prints = [_unpack_rising(rows.column("prints")[k].as_py(), ns[k]) for k in at]
        counts = np.concatenate([_unpack(rows.column("counts")[k].as_py(), ns[k], np.uint32) for k in at])
        every = np.concatenate(prints)
        order = np.argsort(every)
        begins = np.flatnonzero(np.diff(every[order], prepend=~every[order[:1]]) != 0)
        enough = np.add.reduceat(counts[order].astype(np.int64), begins) >= least
        often = every[order][begins[enough]]
        for k, mine in zip(at, prints):
            mine = mine[_held(mine, often)]
            if len(mine):
                for c, v in zip(out, (chunks[k], size, len(mine), _pack_rising(mine))):
                    out[c].append(v)
    return pa.table([pa.array(out["chunk"], pa.int64()), pa.array(out["size"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["prints"], pa.binary())], names=list(out))


def _held(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among the sorted others."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class _Phrases:
    """The words of a chunk as numbers, and hashes of every phrase from running sums."""

    def __init__(self, rows: list[pa.RecordBatch], max_words: int):
        words, langs, borders, last_lang = [], [], [], []
        kinds: dict[str, int] = {}
        for part in slices(iter(rows)):
            found, text, border = _words(part.column("text"))
            words.append(found)
            of = np.array([kinds.setdefault(x, len(kinds)) for x in part.column("lang").to_pylist()], np.int64)
            langs.append(of[text])
            borders.append(border)
        coded = pa.chunked_array(words or [pa.array([], pa.large_binary())]).combine_chunks().dictionary_encode()
        self.words, self.langs = coded.dictionary, list(kinds)
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.lang = np.concatenate(langs) if langs else np.empty(0, np.int64)
        border = np.concatenate(borders) if borders else np.empty(0, bool)
        # How many words there are from each word to the end of its piece.
        ends = np.append(np.flatnonzero(border)[1:], len(border)) if len(border) else np.empty(0, np.int64)
        self.left = ends[np.cumsum(border) - 1] - np.arange(len(border)) if len(border) else ends
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), 7) for x in self.langs], np.uint64)
        hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in self.words.to_pylist()], np.uint64)
        up, self.down = _powers(len(self.code) + 1)
        self.sums = np.zeros(len(self.code) + 1, np.uint64)
        if len(self.code):
            np.cumsum(hashes[self.code] * up[: len(self.code)], out=self.sums[1:])
            self.seed = seeds[self.lang]

    def at(self, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases of this many words begin, and their fingerprints."""
        start = np.flatnonzero(self.left >= size)
        if not len(start):
            return start, np.empty(0, np.uint64)
        value = (self.sums[start + size] - self.sums[start]) * self.down[start]
        return start, mixed(value + self.seed[start] + np.uint64(size)) >> np.uint64(64 - bits)

    def names(self, start: np.ndarray, size: int) -> np.ndarray:
        """A number per phrase: equal for equal words of one language, and for nothing else."""
        name = self.lang[start]
        for k in range(size):
            name = np.unique(name * (len(self.words) + 1) + self.code[start + k], return_inverse=True)[1]
        return name

    def packed(self, size: int, bits: int, split: int, chunk: int) -> Iterator[pa.RecordBatch]:
        """The chunk's distinct fingerprints with their counts, by range."""
        _, prints = self.at(size, bits)
        if not len(prints):
            return
        prints, counts = np.unique(prints, return_counts=True)
        part = (prints >> np.uint64(bits - split)).astype(np.int64) if split else np.zeros(len(prints), np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        rows = [(int(part[a]), chunk, size, int(b - a), _pack_rising(prints[a:b]), _pack(counts[a:b].astype(np.uint32))) for a, b in zip(edges[:-1], edges[1:])]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "chunk", "size", "n", "prints", "counts"])

    def counted(self, back: pa.Table, bits: int) -> pa.Table:
        """The phrases behind the given fingerprints with their counts, and as size 0 the words of each language."""
        langs, sizes, texts, counts = [], [], [], []
        asked: dict[int, list[np.ndarray]] = {}
        for size, n, prints in zip(*(back.column(c).to_pylist() for c in ("size", "n", "prints"))):
            asked.setdefault(size, []).append(_unpack_rising(prints, n))
        for size, often in asked.items():
            start, prints = self.at(size, bits)
            start = start[_held(prints, np.unique(np.concatenate(often)))]
            _, first, times = np.unique(self.names(start, size), return_index=True, return_counts=True)
            begin = start[first]
            parts = [self.words.take(pa.array(self.code[begin + k])) for k in range(size)]
            joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if size > 1 else parts[0]
            texts.append(joined.cast(pa.large_string()).cast(pa.string()))
            langs.append(pa.array(self.langs, pa.string()).take(pa.array(self.lang[begin])))
            sizes.append(np.full(len(begin), size, np.int32))
            counts.append(times)
        words = np.bincount(self.lang, minlength=len(self.langs))
        langs.append(pa.array(self.langs, pa.string()))
        texts.append(pa.array([""] * len(words), pa.string()))
        sizes.append(np.zeros(len(words), np.int32))
        counts.append(words)
        columns = [pa.concat_arrays(langs), pa.array(np.concatenate(sizes)), pa.concat_arrays(texts), pa.array(np.concatenate(counts).astype(np.int64))]
        return pa.table(columns, names=["lang", "size", "phrase", "a"])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words in order, the text of each, and whether it begins a piece."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    border = _BORDER[raw]
    inside = ~(border | _SPACE[raw])
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    last = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    sizes = last - first
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = _LOW[raw[inside]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    text = np.searchsorted(at, first, side="right") - 1
    piece = np.cumsum(border)[first] + text if len(raw) else first
    # Neither number ever falls, so their sum stays only where both do.
    return words, text, np.diff(piece, prepend=-1) != 0


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of the base and of its inverse, modulo 2**64."""
    store = kept_in_worker("phrase_powers", dict)
    if len(store.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            column = np.full(n + n // 4 + 1000, base, np.uint64)
            column[0] = 1
            store[name] = np.cumprod(column, dtype=np.uint64)
    return store["up"], store["down"]
