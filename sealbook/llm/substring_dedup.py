"""Substring dedup by super-k-mer partitioning.

A window is ``size`` consecutive words of one document. Its minimiser is the smallest hash of the runs of
``MINIMISER_SHARE`` of its words (the first of equals), so equal windows have equal minimisers at equal places.
Consecutive windows that share a minimiser are a super-k-mer: they travel together as one packed string
to the minimiser's bucket, where their windows are sorted by content and place, which shows exactly which
windows also start earlier. Those go back to their documents as ranges, and covered words are removed.

Three things keep traffic and buckets small. Minimisers are counted first, by number alone, and a
super-k-mer whose minimiser occurs nowhere else stays at home: none of its windows can be repeated. Within
a slice of the input equal packed strings are one row, since all but the earliest are known to be repeats.
And minimisers of very many super-k-mers send their windows one by one, dealt by the windows' own hash, so
that only equal windows meet, at most one from each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealbook.llm.common import Words, documents, gram_hashes, mixed, outer_id, slices
from sealbook.operators.durable import durable

#: Words of a minimiser as a share of a window's.
MINIMISER_SHARE = 0.3
#: A minimiser with more super-k-mers than this sends single windows. Results do not depend on it.
HOT_ROWS = 20_000
#: Bytes of text within which equal super-k-mers are combined before they travel.
COMBINED_BYTES = 4_000_000
#: Whole buckets are handled together up to about so many rows.
BUCKET_ROWS = 20_000
_POSITION = np.uint64((1 << 28) - 1)


def _runs(words: Words, size: int):
    """Super-k-mers of a slice: document row, first window, number of windows, minimiser."""
    if len(words) < size:
        return None
    length = max(1, int(size * MINIMISER_SHARE))
    grams = gram_hashes(words.hashes, length)
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    span, width = size - length + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & _POSITION).astype(np.int64)  # one entry per window of the slice
    starts = words.starts
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(place)]
    windows = np.flatnonzero(np.arange(len(place)) + size <= starts[1:][rows])
    if not len(windows):
        return None
    new = np.ones(len(windows), bool)
    new[1:] = (place[windows][1:] != place[windows][:-1]) | (rows[windows][1:] != rows[windows][:-1])
    first = windows[new]
    count = np.diff(np.append(np.flatnonzero(new), len(windows)))
    return rows[first], first, count, grams[place[first]].view(np.int64)


def _minimisers(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if found := _runs(Words(batch.column("text")), size):
                rows, _, _, bucket = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), batch.column("id").take(pa.array(rows)), batch.column("h").take(pa.array(rows))], ["bucket", "id", "h"]
                )

    return run


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=COMBINED_BYTES):
            words = Words(batch.column("text"))
            if not (found := _runs(words, size)):
                continue
            rows, first, count, bucket = found
            # Each document's shared minimisers, hot ones marked.
            lists = batch.column("shared")
            owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            shared, hot = flat.field("bucket").to_numpy(), flat.field("hot").to_numpy(zero_copy_only=False)
            tag = mixed(shared.view(np.uint64)) + mixed(owner.astype(np.uint64))
            order = np.argsort(tag)
            own = mixed(bucket.view(np.uint64)) + mixed(rows.astype(np.uint64))
            at = np.minimum(np.searchsorted(tag[order], own), max(len(tag) - 1, 0))
            goes = tag[order][at] == own if len(tag) else np.zeros(len(own), bool)
            single = hot[order][at][goes] if len(tag) else np.zeros(0, bool)
            rows, first, count, bucket = rows[goes], first[goes], count[goes], bucket[goes]
            if single.any():
                reps = np.where(single, count, 1)
                step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                rows, bucket = np.repeat(rows, reps), np.repeat(bucket, reps)
                first, count = np.repeat(first, reps) + step, np.where(np.repeat(single, reps), 1, np.repeat(count, reps))
                single = np.repeat(single, reps)
            ids, texts = batch.column("id").to_numpy(), batch.column("h").to_numpy()
            # Earliest first, so that the first of equal strings is the one that travels; of identical rows one counts.
            start = first - words.starts[rows]
            order = np.lexsort((start, texts[rows], ids[rows]))
            rows, first, count, bucket, single, start = (x[order] for x in (rows, first, count, bucket, single, start))
            once = np.ones(len(rows), bool)
            once[1:] = (ids[rows][1:] != ids[rows][:-1]) | (texts[rows][1:] != texts[rows][:-1]) | (start[1:] != start[:-1])
            rows, first, count, bucket, single, start = (x[once] for x in (rows, first, count, bucket, single, start))
            joined = words.joined.tobytes()
            begin, end = words.offsets[first].tolist(), (words.offsets[first + count + size - 1] - 1).tolist()
            strings = [joined[a:b] for a, b in zip(begin, end)]
            seen: set[bytes] = set()
            travels = np.fromiter((not (s in seen or seen.add(s)) for s in strings), bool, len(strings))
            for k in np.flatnonzero(single & travels):
                bucket[k] = np.uint64(xxhash.xxh3_64_intdigest(strings[k])).view(np.int64)
            anywhere = mixed((ids[rows] * 31 + first).view(np.uint64)).view(np.int64)
            packed = pa.array([s if t else None for s, t in zip(strings, travels.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(travels, bucket, anywhere)), pa.array(ids[rows]), pa.array(texts[rows]),
                 pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), packed],
                ["bucket", "id", "h", "start", "n", "packed"],
            )

    return run


def _repeats(size: int):
    """In whole buckets: ranges of windows that also start earlier."""

    def decide(table: pa.Table) -> pa.RecordBatch:
        known = pc.is_null(table.column("packed"))
        done, open_ = table.filter(known), table.filter(pc.invert(known))
        buckets = open_.column("bucket").to_numpy()
        out = [done.select(["id", "h", "start", "n"])]
        if len(buckets):
            _, group, sizes = np.unique(buckets, return_inverse=True, return_counts=True)
            open_ = open_.filter(pa.array(sizes[group] > 1))
        if open_.num_rows:
            ids, texts, begin = (open_.column(c).to_pylist() for c in ("id", "h", "start"))
            windows = []
            for i, (packed, n) in enumerate(zip(open_.column("packed").to_pylist(), open_.column("n").to_pylist())):
                words = packed.split(b" ")
                at = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
                windows += [(packed[at[k] : at[k + size] - 1], ids[i], texts[i], begin[i] + k) for k in range(n)]
            windows.sort()
            again, text, place = [], None, None
            for window in windows:
                if window[0] != text:
                    text, place = window[0], window[1:]
                elif window[1:] != place:
                    again.append(window[1:])
            if again:
                a, b, c = zip(*again)
                out.append(pa.table({"id": pa.array(a, pa.int64()), "h": pa.array(b, pa.int64()), "start": pa.array(c, pa.int32()), "n": pa.array([1] * len(a), pa.int32())}))
        return pa.concat_tables(out).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= BUCKET_ROWS:
                table = pa.Table.from_batches(held)
                buckets = table.column("bucket").to_numpy()
                whole = int(np.searchsorted(buckets, buckets[-1]))  # the last bucket may go on
                if whole:
                    yield from decide(table.slice(0, whole)).to_batches()
                held, rows = table.slice(whole).to_batches(), table.num_rows - whole
        if held:
            yield from decide(pa.Table.from_batches(held)).to_batches()

    return run


def _removed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            change = np.zeros(len(words) + 1, np.int64)
            ranges = batch.column("ranges")
            if ranges.null_count < len(ranges):
                rows = np.repeat(np.arange(len(ranges)), pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False))
                flat = ranges.flatten()
                first = words.starts[rows] + flat.field("start").to_numpy()
                np.add.at(change, first, 1)
                np.add.at(change, first + flat.field("n").to_numpy() + size - 1, -1)
            stay = np.cumsum(change[:-1]) == 0
            lengths = np.diff(words.offsets)
            text = words.joined[np.repeat(stay, lengths)].tobytes()
            ends = np.concatenate([[0], np.cumsum(lengths * stay)])[words.starts].tolist()
            kept = [text[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]
            left = np.concatenate([[0], np.cumsum(stay)])[words.starts]
            n = np.diff(words.starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n.astype(np.int64)), pa.array((n - np.diff(left)).astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept_text"],
            )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("h", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, size: int = 20) -> DataFrame:
    """``id``, ``h``, ``start``, ``n``: ranges of windows of each text that also start earlier."""
    base = _texts(docs)
    found = base.mapInArrow(_minimisers(size), "bucket long, id long, h long")
    # Written down so that both sides of the join are plain shuffles, of which large partitions can be split.
    counts = durable(found.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = (
        found.join(counts, "bucket").select("id", "h", F.struct("bucket", (F.col("n") > HOT_ROWS).alias("hot")).alias("s"))
        .groupBy("id", "h").agg(F.collect_list("s").alias("shared"))
    )
    kind = "bucket long, id long, h long, start int, n int, packed binary"
    dealt = base.join(shared, ["id", "h"]).mapInArrow(_packed(size), kind).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_repeats(size), "id long, h long, start int, n int")


def substring_dedup(docs: DataFrame, size: int = 20) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` of every row of ``docs``.

    A word is removed if a window of ``size`` words around it also starts earlier: in a document of
    smaller doc_id, or earlier in the same one. Windows are judged on the input, not on what is left.
    ``kept_text`` is the other words joined by one space.

    Null and empty texts have no words and give an empty text; texts shorter than a window lose nothing.
    A null doc_id comes before all others and is given back as null. Identical rows are one place and lose
    the same words; rows with one doc_id and different texts are ordered by a hash of the text. An empty
    table gives no rows; other columns are not looked at.
    """
    ranges = repeated_windows(docs, size).groupBy("id", "h").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    base = _texts(docs)
    kind = "id long, n_words long, n_removed long, kept_text string"
    joined = base.join(ranges, ["id", "h"], "left").select("id", "text", "ranges")
    return joined.mapInArrow(_removed(size), kind).select(outer_id(F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_text")
