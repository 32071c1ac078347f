"""Token ids as binary files: Simple-8b words with escapes and per-block offsets.

A block holds the ids of consecutive documents. Each 64-bit word has a selector in its top 4 bits and, for
selectors 0 to 12, a fixed count of ids of a fixed width below: the count times the width is at most 60.
Selector 15 is the escape: one id of up to 60 bits, for ids wider than 30 bits and for a last id that has
no neighbours to share a word with. Beside the words a block carries for each document
the number of ids, and for every ``STRIDE`` words the number of ids before them, so that a reader can
start anywhere and decode all words of one selector with one vector operation.

The file is a Parquet table of blocks, so it can be written, listed and read on any store that Spark knows,
and survives lost executors through Spark's commit protocol.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealbook.llm.common import Known, Segments, documents, kept_in_worker, outer_id, slices

# Fixed values of the file format: ids per word and their width in bits, by selector. 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30])
ESCAPE = 15
STRIDE = 512
#: Ids of a block, about; a document is never split over blocks.
BLOCK_IDS = 1 << 18
#: Bytes of text that are cut and encoded at a time.
SLICE = 1_000_000
# Characters that are more than a byte, or seldom used, and that some count as white space.
_OTHER_SPACES = "[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: ASCII characters that are no white space.
_SOLID = frozenset(i for i in range(128) if not chr(i).isspace())
#: The first selector wide enough for each of the small ids.
_NEEDS = np.searchsorted(1 << WIDTHS, np.arange(1 << 16), side="right").astype(np.uint8)


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of the ids (below 2**60)."""
    ids = ids.astype(np.uint64)
    n, rungs = len(ids), len(COUNTS)
    if not n:
        return np.empty(0, np.uint64)
    # For each id the first selector wide enough; for each place and selector the largest of these in reach.
    needs = _NEEDS[ids] if ids.max() < len(_NEEDS) else np.searchsorted(np.uint64(1) << WIDTHS.astype(np.uint64), ids, side="right").astype(np.uint8)
    spans = [needs]
    while 2 ** len(spans) <= COUNTS[0]:
        last, step = spans[-1], 2 ** (len(spans) - 1)
        spans.append(np.maximum(last, np.append(last[step:], np.full(min(step, n), rungs, np.uint8))[:n]))
    selector = np.full(n, ESCAPE, np.uint8)
    for s in range(rungs - 1, -1, -1):  # the densest that fits wins
        count = int(COUNTS[s])
        if count <= n:
            power = count.bit_length() - 1
            most = np.maximum(spans[power][: n - count + 1], spans[power][count - 2**power : n - 2**power + 1])
            selector[: n - count + 1][most <= s] = s
    steps = np.append(COUNTS, np.ones(ESCAPE + 1 - rungs, np.int64)).astype(np.uint8)[selector].tobytes()
    firsts, i = [], 0
    while i < n:
        firsts.append(i)
        i += steps[i]
    firsts = np.array(firsts)
    chosen = selector[firsts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        at = np.flatnonzero(chosen == s)
        count, w = (1, 60) if s == ESCAPE else (int(COUNTS[s]), int(WIDTHS[s]))
        packed = words[at]
        for k in range(count):
            packed |= ids[firsts[at] + k] << np.uint64(w * k)
        words[at] = packed
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids that `pack` was given."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.where(selector == ESCAPE, 1, COUNTS[np.minimum(selector, 12)])
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        at = np.flatnonzero(selector == s)
        count, w = (1, 60) if s == ESCAPE else (int(COUNTS[s]), int(WIDTHS[s]))
        first, mask = ends[at] - count, np.uint64((1 << w) - 1)
        for k in range(count):
            out[first + k] = (words[at] >> np.uint64(w * k)) & mask
    return out


def unpack_range(words: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a block, touching only the words around them."""
    first = int(np.searchsorted(offsets, begin, side="right")) - 1
    last = int(np.searchsorted(offsets, end, side="left"))
    return unpack(words[first * STRIDE : last * STRIDE])[begin - offsets[first] : end - offsets[first]]


def _cuts() -> np.ndarray:
    """Pairs of bytes that a byte-level pre-tokenizer always parts, whatever stands around them.

    It takes nothing together with white space behind it, and an ASCII letter or digit only with the same sort behind it.
    """
    byte = np.arange(256)
    space, digit = (byte == 32) | ((byte >= 9) & (byte <= 13)), (byte >= 48) & (byte <= 57)
    letter = ((byte | 32) >= 97) & ((byte | 32) <= 122) & (byte < 128)
    ascii_ = (byte < 128) & ~space
    return np.outer(~space, space) | np.outer(letter, ascii_ & ~letter) | np.outer(digit, ascii_ & ~digit)


def kept_whole(tokenizer: str) -> str | None:
    """Texts that match this pattern are encoded as they are; None stands for all texts.

    Other texts can be parted where a byte-level pre-tokenizer always does, and the parts encoded once each. That holds
    if nothing is normalised, prefixed, padded or cut, and no added token occurs.
    """
    spec = json.loads(tokenizer)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    if not plain or any(spec.get(part) for part in ("normalizer", "truncation", "padding")) or (spec.get("model") or {}).get("dropout"):
        return None
    return "|".join([_OTHER_SPACES, *(re.escape(t["content"]) for t in spec.get("added_tokens") or () if t["content"])])


def _widths(coder) -> np.ndarray:
    """The bytes that each id of a byte-level tokenizer stands for; its pieces have one character a byte."""
    vocabulary = coder.get_vocab(with_added_tokens=True)
    widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    widths[list(vocabulary.values())] = [len(piece) for piece in vocabulary]
    return widths


def _side_by_side(segments: list[bytes], coder, widths: np.ndarray) -> list[bytes | None]:
    """The ids of segments that begin with white space and do not end so, as bytes; None for the others.

    Such segments can stand behind each other in one text, which is encoded faster than many. The widths of the ids tell
    where each segment ends; where that comes out wrong, all segments of the text are left to be encoded one by one.
    """
    out: list[bytes | None] = [None] * len(segments)
    fit = [i for i, s in enumerate(segments) if s[0] in b" \t\n\v\f\r" and len(s) <= 200 and (s[-1] in _SOLID or (s[-1] > 127 and not s.decode()[-1].isspace()))]
    groups = [fit[k : k + 256] for k in range(0, len(fit), 256)]
    for first in range(0, len(groups), 16):
        some = groups[first : first + 16]
        for group, e in zip(some, coder.encode_batch_fast([b"".join([segments[i] for i in g]).decode() for g in some], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            reach, ends = np.cumsum(widths[ids]), np.cumsum([len(segments[i]) for i in group])
            at = np.searchsorted(reach, ends)
            if at[-1] != len(ids) - 1 or (reach[at] != ends).any():
                continue
            raw, at = ids.tobytes(), ((at + 1) * 4).tolist()
            for i, a, b in zip(group, [0, *at], at):
                out[i] = raw[a:b]
    return out


def _blocks(tokenizer: str, end_id: int):
    """Tokenizes documents in the order given and packs them into blocks."""
    pattern, cut = kept_whole(tokenizer), _cuts()

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        key = str(zlib.crc32(tokenizer.encode()))
        coder = kept_in_worker("coder_" + key, lambda: Tokenizer.from_str(tokenizer))
        widths = kept_in_worker("widths_" + key, lambda: _widths(coder))
        known = kept_in_worker("pieces_" + key, Known)

        def fresh(segments: list[bytes]) -> list[bytes | None]:
            out = _side_by_side(segments, coder, widths) if pattern is not None else [None] * len(segments)
            left = [i for i, ids in enumerate(out) if ids is None]
            for k in range(0, len(left), 1024):
                part = left[k : k + 1024]
                for i, e in zip(part, coder.encode_batch_fast([segments[i].decode() for i in part], add_special_tokens=False)):
                    out[i] = array("I", e.ids).tobytes()
            return out

        texts = pc.fill_null(texts, "")
        if pattern is None:
            whole = np.ones(len(texts), bool)
        else:
            whole = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        return Segments(texts, cut, whole).coded(known, fresh)

    def block(docs: list) -> dict:
        ids = np.concatenate([d[2] for d in docs])
        words = pack(ids)
        counts = np.where(sel == ESCAPE, 1, COUNTS[np.minimum(sel, 12)]) if len(sel := (words >> np.uint64(60)).astype(np.int64)) else sel
        before = np.concatenate([[0], np.cumsum(counts)])[:-1][::STRIDE]
        return {"doc_ids": [d[0] for d in docs], "n_ids": [len(d[2]) for d in docs], "words": words.tobytes(), "offsets": before.tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, total, held = TaskContext.get().partitionId(), 0, 0, []
        kind = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_total", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int64())), ("words", pa.binary()), ("offsets", pa.list_(pa.int64()))])

        def out():
            return pa.RecordBatch.from_pylist([block(held) | {"shard": shard, "block": number, "n_total": total}], kind)

        for batch in slices(batches, most=SLICE):
            flat, bounds = encode(batch.column("text"))
            flat = np.insert(flat, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            for id_, a, b in zip(batch.column("id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = flat[a:b]
                held.append((id_, None, ids))
                total += len(ids)
                if total >= BLOCK_IDS:
                    yield out()
                    number, total, held = number + 1, 0, []
        if held:
            yield out()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # One block at a time, however many come together.
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            ids = unpack(np.frombuffer(r["words"], np.uint64)).astype("<u4")
            ends = np.cumsum(r["n_ids"])
            starts = ends - r["n_ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["before"]), pa.array(r["n_ids"], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(ids.view(np.int32)))],
                ["id", "start", "n_tokens", "ids"],
            )


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encodes every whole text and writes the ids, each document closed by ``end_id``, as blocks under ``path``.

    ``tokenizer`` is the text of a tokenizers JSON file. Documents are in ascending doc_id order over
    shards, blocks and places in a block; null ids come first, rows with one id are ordered by a hash of the text. Null and
    empty texts give the end id alone. An empty table gives a table without blocks.
    """
    base = documents(docs).withColumn("h", F.xxhash64("text"))
    ordered = base.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    kind = "shard int, block int, n_total long, doc_ids array<long>, n_ids array<long>, words binary, offsets array<long>"
    ordered.mapInArrow(_blocks(tokenizer, end_id), kind).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids`` from the files alone."""
    kind = "shard int, block int, n_total long, doc_ids array<long>, n_ids array<long>, words binary, offsets array<long>"
    blocks = spark.read.schema(kind).parquet(path)
    # Shards first: one row per shard is summed in order; then the blocks within each shard.
    shards = blocks.groupBy("shard").agg(F.sum("n_total").alias("n_shard"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n_shard").over(order), F.lit(0)).alias("shard_before"))
    order = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = blocks.select("shard", "block", F.coalesce(F.sum("n_total").over(order), F.lit(0)).alias("block_before"))
    # A few numbers per block of BLOCK_IDS ids, so these are broadcast; shuffling the blocks would sort all ids in memory.
    placed = blocks.join(F.broadcast(within), ["shard", "block"]).join(F.broadcast(shards), "shard").select(
        "doc_ids", "n_ids", "words", (F.col("block_before") + F.col("shard_before")).alias("before")
    )
    return placed.mapInArrow(_read, "id long, start long, n_tokens long, ids array<int>").select(
        outer_id(F.col("id")).alias("doc_id"), "start", "n_tokens", "ids"
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, offsets = np.asarray(lists.values).astype("<i4"), np.asarray(lists.offsets).tolist()
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
        yield batch.drop_columns(["ids"]).append_column("ids_crc32", pa.array(sums, pa.int64()))


def with_checksums(tokens: DataFrame) -> DataFrame:
    """The columns with ``ids`` replaced by the unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    rest = [f for f in tokens.schema if f.name != "ids"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", ids_crc32 long"
    return tokens.select(*[f.name for f in rest], "ids").mapInArrow(_checksums, kind)
