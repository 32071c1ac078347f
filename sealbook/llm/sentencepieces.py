"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut wherever two bytes meet that stand side by side in no piece, so no merge reaches over a cut. The distinct
segments of a batch are concatenated and indexed by a suffix array, in which every piece of the vocabulary
is searched for its range of occurrences. Each occurrence is an edge from where it begins to where it ends;
sorted by position they are relaxed from left to right.

The vocabulary is one of byte-pair merges, where the best path is the one that merging would have
built. An edge extends the path at its beginning if merging leaves the border between the two pieces alone,
which is looked up per pair of pieces. For each position exactly one edge does, so relaxing needs no scores.
Characters outside the vocabulary become their UTF-8 bytes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sealbook.llm.common import Known, Segments, documents, kept_in_worker, outer_id, slices

SPACE = "\u2581"
#: Pairs of pieces with judged borders that a worker keeps.
PAIRS = 250_000
#: Bytes of text that are indexed together, and edges relaxed as one list: these bound a worker's memory.
INDEX_BYTES = 2_000_000
EDGES = 200_000

_UNKNOWN = -1


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in order of id; ``bytes_from`` is the id of the piece for byte 0, the 256 are consecutive."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    bytes_from: int

    @property
    def key(self) -> str:
        return str(zlib.crc32("\n".join(self.pieces).encode()))


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a byte-fallback model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = tuple(not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n))
    return Vocabulary(tuple(map(model.id_to_piece, range(n))), tuple(map(model.get_score, range(n))), plain, model.piece_to_id("<0x00>"))


class Merger:
    """Merging of short strings, and the borders it leaves alone.

    Merging takes the pair of best rank, the leftmost of equals. Before a border is crossed, each side merges
    as it would alone. So of each piece the symbols at its ends are noted with the rank of the merge that
    made them and of the one that used them up: the border between two pieces is crossed if two end symbols
    live at one time and their union is a piece that comes before either is used up. This needs ranks that
    only grow within a piece; for other pieces the union is merged to see.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.ids = {p: i for i, (p, ok) in enumerate(zip(vocabulary.pieces, vocabulary.plain)) if ok}
        self.ranks, self.pieces = [-s for s in vocabulary.scores], vocabulary.pieces
        self.borders: dict[int, bool] = {}
        self.ends: dict[int, tuple[list, list]] = {}
        found = []
        for p, i in self.ids.items():
            steps: list[tuple[float, int, int]] = []
            if self.merge(p, steps) == [p]:  # else merging never builds it
                found.append((p, i))
                if all(r <= s for (r, _, _), (s, _, _) in zip(steps, steps[1:])):
                    self.ends[i] = self._lives(p, steps)
        self.found = np.array([i for _, i in found], np.int64)
        self.lengths = np.array([len(p) for p, _ in found], np.int64)
        self.table = np.zeros((len(found), int(self.lengths.max(initial=1))), np.uint32)
        for row, (p, _) in zip(self.table, found):
            row[: len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)

    def merge(self, text: str, steps: list | None = None) -> list[str]:
        """What merging makes of a text; notes rank, place and number of symbols of each step."""
        parts = list(text)
        while len(parts) > 1:
            best, at = np.inf, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and self.ranks[j] < best:
                    best, at = self.ranks[j], i
            if at < 0:
                break
            if steps is not None:
                steps.append((best, at, len(parts)))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @staticmethod
    def _lives(piece: str, steps: list[tuple[float, int, int]]) -> tuple[list, list]:
        """First and last symbols over time: text, rank that made it, rank that used it up."""
        parts, sides = list(piece), ([], [])
        born = [-np.inf, -np.inf]
        for rank, at, n in steps:
            if at == 0:
                sides[0].append((parts[0], born[0], rank))
                born[0] = rank
            if at == n - 2:
                sides[1].append((parts[-1], born[1], rank))
                born[1] = rank
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        sides[0].append((piece, born[0], np.inf))
        sides[1].append((piece, born[1], np.inf))
        return sides

    def border(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.borders.get(key)
        if ok is None:
            if len(self.borders) > PAIRS:
                self.borders.clear()
            ok = self.borders[key] = self._holds(a, b)
        return ok

    def _holds(self, a: int, b: int) -> bool:
        if a not in self.ends or b not in self.ends:
            left, right = self.pieces[a], self.pieces[b]
            return self.merge(left + right) == [left, right]
        ids, ranks = self.ids, self.ranks
        for x, made_x, used_x in self.ends[a][1]:
            for y, made_y, used_y in self.ends[b][0]:
                j = ids.get(x + y)
                # Of equal ranks the left merge comes first.
                if j is not None and ranks[j] < used_x and ranks[j] <= used_y and made_x <= used_y and made_y < used_x:
                    return False
        return True


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of what follows them, by the first ``depth`` or more codes."""
    # Three codes of 21 bits make the first key; each round doubles how far a rank looks.
    ahead = np.append(codes, np.zeros(2, codes.dtype)).astype(np.int64)
    pair, span = ahead[:-2] << 42 | ahead[1:-1] << 21 | ahead[2:], 3
    order = np.argsort(pair, kind="stable")
    while span < depth:
        rank = np.zeros(len(pair), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        second = np.zeros(len(rank), np.int64)
        second[: max(0, len(rank) - span)] = rank[span:] + 1
        pair = rank * (len(rank) + 1) + second
        order = np.argsort(pair, kind="stable")
        span *= 2
    return order


def ranges(codes: np.ndarray, order: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``table`` the part of the suffix array that begins with it, by binary search."""
    low, high = np.zeros(len(table), np.int64), np.full(len(table), len(order), np.int64)
    padded = np.append(codes, np.zeros(table.shape[1] + 1, codes.dtype))
    for j in range(table.shape[1]):
        live = np.flatnonzero((lengths > j) & (low < high))
        want = table[live, j]
        bounds = []
        for after in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                have = padded[order[np.minimum(mid, len(order) - 1)] + j]
                right = open_ & ((have <= want) if after else (have < want))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            bounds.append(a)
        low[live], high[live] = bounds
    return low, high


def encode_segments(segments: list[str], merger: Merger, bytes_from: int) -> list[list[int]]:
    """The ids of each segment."""
    text = "\0".join(segments) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    order = suffix_array(codes, merger.table.shape[1])
    low, high = ranges(codes, order, merger.table, merger.lengths)
    n = high - low
    total = int(n.sum())
    begin = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)].astype(np.int32)
    length, piece = np.repeat(merger.lengths.astype(np.int8), n), np.repeat(merger.found.astype(np.int32), n)
    del order
    covered = np.zeros(len(codes), bool)
    covered[begin[length == 1]] = True
    alone = np.flatnonzero(~covered).astype(np.int32)
    begin = np.concatenate([begin, alone])
    length = np.concatenate([length, np.ones(len(alone), np.int8)])
    piece = np.concatenate([piece, np.full(len(alone), _UNKNOWN, np.int32)])
    by = np.argsort((begin.astype(np.int64) + length) * 64 - length).astype(np.int32)  # by end, longest first
    begin, length, piece = begin[by], length[by], piece[by]
    del by
    starts = np.cumsum([0] + [len(s) + 1 for s in segments])
    last: list[int | None] = [None] * (len(codes) + 1)
    for s in starts.tolist():
        last[s] = -2
    judged, border = merger.borders, merger.border
    for k in range(0, len(begin), EDGES):
        part = slice(k, k + EDGES)
        for b, e, p in zip(begin[part].tolist(), (begin[part] + length[part]).tolist(), piece[part].tolist()):
            if last[e] is not None:
                continue
            q = last[b]
            if q is None:
                continue
            if q < 0 or p < 0:
                last[e] = p
            else:
                ok = judged.get(q << 20 | p)
                if ok or (ok is None and border(q, p)):
                    last[e] = p
    sizes = {i: len(merger.pieces[i]) for i in np.unique(piece).tolist() if i >= 0}
    out = []
    for s, segment in zip(starts.tolist(), segments):
        at, ids = s + len(segment), []
        while at > s:
            p = last[at]
            if p == _UNKNOWN:
                at -= 1
                ids += [bytes_from + byte for byte in reversed(segment[at - s].encode("utf-8", "replace"))]
            else:
                ids.append(p)
                at -= sizes[p]
        out.append(ids[::-1])
    return out


def cuts(vocabulary: Vocabulary) -> np.ndarray:
    """The pairs of bytes that are side by side in no piece; characters stay whole, and spaces stand for their mark."""
    cut = np.ones((256, 256), bool)
    cut[:, 0x80:0xC0] = False
    for piece, ok in zip(vocabulary.pieces, vocabulary.plain):
        if ok:
            raw = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
            cut[raw[:-1], raw[1:]] = False
    return cut


def _encoder(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = kept_in_worker("merger_" + vocabulary.key, lambda: Merger(vocabulary))
        known = kept_in_worker("segments_" + vocabulary.key, Known)
        cut = kept_in_worker("cuts_" + vocabulary.key, lambda: cuts(vocabulary))

        def fresh(keys: list[bytes]) -> list[bytes]:
            segments = [k.decode().replace(" ", SPACE) for k in keys]
            plain = [s for s in segments if "\0" not in s]
            ids = iter(encode_segments(plain, merger, vocabulary.bytes_from) if plain else ())
            return [_with_nul(s, merger, vocabulary.bytes_from) if "\0" in s else array("i", next(ids)).tobytes() for s in segments]

        for batch in slices(batches, most=INDEX_BYTES):
            texts = pa.array([" " + t.replace(SPACE, " ") if t else "" for t in batch.column("text").to_pylist()], pa.string())
            flat, bounds = Segments(texts, cut).coded(known, fresh)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int32)))
            yield batch.drop_columns(["text"]).append_column("ids", lists)

    return run


def _with_nul(segment: str, merger: Merger, bytes_from: int) -> bytes:
    """NUL separates segments in the index, so a segment that holds one is cut there; NUL is no piece."""
    ids: list[int] = []
    for part in re.split("(\0)", segment):
        if part == "\0":
            ids.append(bytes_from)
        elif part:
            ids += encode_segments([part], merger, bytes_from)[0]
    return array("i", ids).tobytes()


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, ``ids`` of every row of ``docs``.

    Spaces are written as the vocabulary's space mark, and one is put before each text that is not empty.
    Null and empty texts have no ids. Null doc_ids come back as null, identical rows get identical ids, and
    an empty table gives no rows; other columns are not looked at.
    """
    return documents(docs).mapInArrow(_encoder(vocabulary), "id long, ids array<int>").select(outer_id(F.col("id")).alias("doc_id"), "ids")


def _decoder(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([p.encode() for p in vocabulary.pieces], object)
        for i, ok in enumerate(vocabulary.plain):
            if not ok:
                byte = i - vocabulary.bytes_from
                known[i] = bytes([byte]) if 0 <= byte < 256 else b""
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                lists, out = batch.column("ids"), []
                values, offsets = np.asarray(lists.values), np.asarray(lists.offsets).tolist()
                for a, b, ok in zip(offsets, offsets[1:], lists.is_valid().to_pylist()):
                    text = b"".join(known[values[a:b]].tolist()).decode("utf-8", "replace")
                    out.append(text.replace(SPACE, " ").removeprefix(" ") if ok else None)
                if "text" in batch.schema.names:
                    batch = batch.drop_columns(["text"])
                yield batch.append_column("text", pa.array(out, pa.string()))

    return run


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows of ``tokens`` with the ``text`` of their ``ids``; bytes that are no UTF-8 become replacement characters.

    Null ids give a null text, no ids an empty one, and ids outside the vocabulary are an error.
    """
    kind = StructType([f for f in tokens.schema if f.name != "text"]).add("text", "string")
    return tokens.mapInArrow(_decoder(vocabulary), kind)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id``, ``ids`` and the ``text`` decoded from them, of every row; encoding and decoding in one visit."""
    to, back = _encoder(vocabulary), _decoder(vocabulary)
    found = documents(docs).mapInArrow(lambda batches: back(to(batches)), "id long, ids array<int>, text string")
    return found.select(outer_id(F.col("id")).alias("doc_id"), "ids", "text")
