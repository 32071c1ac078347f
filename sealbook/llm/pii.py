"""Personal data by candidate gradient boosting.

Fixed patterns with checks give the base spans, which always stay. High-recall generators propose further,
overlapping spans: anything that looks like a key, a long number, an address of the network or of mail.
Boosted trees score each by its format and its context; a threshold calibrated on held-out candidates
selects those to redact, and where selected spans overlap the most likely stays.

There are no labelled spans, so the trees are fitted on what formats prove: candidates that overlap a checked base
span, or stand as a quoted or assigned secret beside a word that says so, are positive; the rest
is negative. Features leave out the checks themselves. The fit counts the candidates of all documents: equal ones are
counted together, and each level of the trees is one pass that adds up histograms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealbook.llm.common import documents, outer_id, slices
from sealbook.operators.durable import Scratch

#: Least share of positives among held-out candidates at or above the threshold.
PRECISION = 0.98
ROUNDS, RATE, DEPTH, BINS = 40, 0.3, 3, 24
#: Candidates fall into so many folds; a model for each is fitted without it.
FOLDS = 4
#: Steps of a probability by which the threshold is found.
STEPS = 10_000
#: Rows of the table that every pass reads, by task: passes are many and short, so tasks should not be.
ROWS_PER_TASK = 50_000
#: Histograms are added up as whole numbers of this fraction, so that no order of tasks changes a model.
UNIT = 2.0**24

# Fixed patterns of the base spans.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),  # the same matches, without retries inside a number
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = (*BASE, "secret", "number", "address")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: A base span needs one of these characters; texts without them are done.
_ANY = re.compile(r"[0-9@]")

GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])"),
    "number": re.compile(r"(?<![A-Za-z0-9])\(?[0-9][0-9 ().-]{5,24}[0-9](?![A-Za-z0-9])"),
    "address": re.compile(r"[^\s@|]{1,64}(?:@|\[at\]|\(at\))[^\s@|]{3,}|(?<![0-9.])[0-9]{1,3}(?:[.:-][0-9]{1,3}){3,5}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"),
}
CUES = re.compile(r"(?i)\b(?:token|key|secret|passw\w*|pwd|auth\w*|bearer|credential\w*|api|tel\w*|phone|mobile|fax|call|card|visa|account|iban|ssn|id|passport|mail|e-?mail|contact|ip|host)\b")
SECRET_CUES = re.compile(r"(?i)\b(?:token|key|secret|passw\w*|pwd|auth\w*|bearer|credential\w*|api)\b\W*$")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The mail pattern's matches, from each @ both ways, so that long words are not tried again and again."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the base spans, by start and then kind as listed."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in BASE["ip"].finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in BASE["card"].finditer(text):
            digits = "".join(_DIGIT.findall(m[0]))
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in BASE["phone"].finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]], s[1]))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that the generators propose; they may overlap each other and base spans."""
    if not _ANY.search(text):
        return []
    return [(*m.span(), kind) for kind, pattern in GENERATORS.items() for m in pattern.finditer(text)]


FEATURES = (
    "length", "digits", "share of digits", "share of upper", "share of lower", "share of punctuation", "entropy", "distinct", "groups", "longest digit run",
    "has @", "has dots", "hex only", "changes of kind", "cue before", "assigned", "quoted", "digit before", "digit after", "line share", "kind",
)


def features(text: str, start: int, end: int, kind: str) -> tuple[float, ...]:
    s = text[start:end]
    n = len(s)
    digits, upper, lower = sum(map(str.isdigit, s)), sum(map(str.isupper, s)), sum(map(str.islower, s))
    counts = Counter(s).values()
    runs = re.findall(r"[0-9]+", s)
    classes = ["d" if c.isdigit() else "a" if c.isalpha() else "p" for c in s]
    before, after = text[max(0, start - 24) : start], text[end : end + 8]
    return (
        n, digits, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, -sum(c / n * log2(c / n) for c in counts), len(counts), len(re.findall(r"[A-Za-z0-9]+", s)),
        max(map(len, runs), default=0), float("@" in s), s.count("."), float(re.fullmatch(r"[0-9a-fA-F]+", s) is not None), sum(a != b for a, b in zip(classes, classes[1:])) / n,
        float(CUES.search(before) is not None), float(re.search(r"[=:]\s*[\"']?$", before) is not None), float(before[-1:] in "\"'`" and after[:1] in "\"'`" and before != ""),
        float(re.search(r"[0-9]\W?$", before) is not None), float(re.match(r"\W?[0-9]", after) is not None), float(n > 40), float(list(GENERATORS).index(kind)),
    )


def proven(text: str, start: int, end: int, kind: str, base: list[tuple[int, int, str]]) -> bool:
    """Whether the formats prove a candidate."""
    if any(a < end and start < b for a, b, _ in base):
        return True
    return kind == "secret" and SECRET_CUES.search(text[max(0, start - 24) : start]) is not None


def rounded(x: np.ndarray) -> np.ndarray:
    """Features to three significant digits, so that a feature has a bounded number of values."""
    size = 10.0 ** (2 - np.floor(np.log10(np.maximum(np.abs(x), 1e-9))))
    return (np.rint(x * size) / size).astype(np.float32)


class Trees:
    """Gradient-boosted trees for the logistic loss, on binned features.

    A tree has its nodes at 0, then 1 and 2, then 3 to 6 and so on: a feature (-1 in leaves), a cut and a value for each.
    """

    def __init__(self, cuts: list[np.ndarray], start: float):
        self.cuts, self.start = cuts, start
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self) -> None:
        n = 2 ** (DEPTH + 1) - 1
        self.trees.append((np.full(n, -1), np.zeros(n, int), np.zeros(n)))

    @staticmethod
    def nodes(tree, b: np.ndarray) -> np.ndarray:
        """The node that each row has reached in a tree that may still grow."""
        at = np.zeros(len(b), int)
        for _ in range(DEPTH):
            f = tree[0][at]
            at = np.where(f < 0, at, 2 * at + 1 + (b[np.arange(len(b)), np.maximum(f, 0)] > tree[1][at]))
        return at

    def score(self, b: np.ndarray, most: int | None = None) -> np.ndarray:
        return self.start + RATE * sum((t[2][self.nodes(t, b)] for t in self.trees[:most]), np.zeros(len(b)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(binned(rounded(x), self.cuts))))

    def split(self, node: int, sums: np.ndarray) -> None:
        """Settle a node of the last tree by its histogram: by feature and bin the gradients, their slopes and rows."""
        g, h = sums[..., 0] / UNIT, sums[..., 1] / UNIT
        gs, hs = g[0].sum(), h[0].sum()
        feature, cut, value = self.trees[-1]
        if node == 0:
            value[node] = -gs / (hs + 1)
        if sums[0, :, 2].sum() < 20:
            return
        best = 1e-3
        for f, cuts in enumerate(self.cuts):
            gl, hl = g[f].cumsum()[: len(cuts)], h[f].cumsum()[: len(cuts)]
            if len(gl):
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], f, k
                    value[2 * node + 1 : 2 * node + 3] = -gl[k] / (hl[k] + 1), -(gs - gl[k]) / (hs - hl[k] + 1)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, col, side="right") for c, col in zip(cuts, x.T)], 1).astype(np.uint8)


def _rows(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, len(FEATURES))


def _added(table: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Whole numbers added up over all batches of a table, of one bounded array per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((sums(batch) for batch in batches if batch.num_rows), 0)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64).tobytes()])], ["sums"])

    return sum(np.frombuffer(r.sums, np.int64) for r in table.mapInArrow(run, "sums binary").toLocalIterator())


def _counted(docs: DataFrame) -> DataFrame:
    """The candidates of all documents: features, whether the formats prove them, and how many are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, labels = [], []
            for t in batch.column("text").to_pylist():
                found = candidates(t)
                base = base_spans(t) if found else []
                rows += [features(t, *c) for c in found]
                labels += [proven(t, *c, base) for c in found]
            x = rounded(np.array(rows, float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(labels, pa.bool_())], ["x", "y"])

    texts = documents(docs).filter(F.col("text").rlike("[0-9@]")).select("text")
    return texts.mapInArrow(run, "x binary, y boolean").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def _cuts(counted: DataFrame) -> list[np.ndarray]:
    """Per feature the values that part its candidates into bins of about equal size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _rows(batch, "x", np.float32), batch.column("n").to_numpy()
            for f in range(len(FEATURES) if batch.num_rows else 0):
                v, at = np.unique(x[:, f], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), f)), pa.array(v), pa.array(np.bincount(at, n).astype(np.int64))], ["f", "v", "n"])

    values = counted.mapInArrow(run, "f long, v float, n long").groupBy("f", "v").agg(F.sum("n").alias("n")).collect()
    cuts = []
    for f in range(len(FEATURES)):
        mine = sorted((r.v, r.n) for r in values if r.f == f)
        v, upto = np.array([a for a, _ in mine], np.float32), np.cumsum([n for _, n in mine])
        cuts.append(np.unique(v[np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS)]))
    return cuts


def train(docs: DataFrame):
    """Trees and threshold; None if the documents have no candidates of both kinds."""
    with Scratch(docs.sparkSession) as scratch:
        counted = scratch.keep(_counted(docs))
        if counted.select("y").distinct().count() < 2:
            return None
        cuts = _cuts(counted)

        def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = [r.tobytes() for r in binned(_rows(batch, "x", np.float32), cuts)]
                folds = pa.array([crc32(r) % FOLDS for r in b], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.binary()), folds, batch.column("y").cast(pa.int64()), batch.column("n")], ["b", "fold", "y", "n"])

        table = counted.mapInArrow(bins, "b binary, fold long, y long, n long").groupBy("b", "fold", "y").agg(F.sum("n").alias("n"))
        return _fitted(scratch.keep(table.coalesce(1 + counted.count() // ROWS_PER_TASK)), cuts)


def _fitted(table: DataFrame, cuts: list[np.ndarray]):
    """Trees for all candidates and a threshold from models that leave out the fold they are asked about."""
    kinds = np.zeros((FOLDS, 2), np.int64)
    for r in table.groupBy("fold", "y").agg(F.sum("n").alias("n")).collect():
        kinds[r.fold, r.y] = r.n
    # The last model leaves out no fold.
    models = []
    for m in range(FOLDS + 1):
        without, with_ = (kinds.sum(0) - (kinds[m] if m < FOLDS else 0)).tolist()
        share = with_ / max(1, without + with_)
        models.append(Trees(cuts, float(np.log((share + 1e-6) / (1 - share + 1e-6)))))
    shape = (len(FEATURES), BINS, 3)

    def columns(batch: pa.RecordBatch):
        return _rows(batch, "b", np.uint8), *(batch.column(c).to_numpy() for c in ("fold", "y", "n"))

    for _ in range(ROUNDS):
        for model in models:
            model.add()
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level

            def sums(batch: pa.RecordBatch) -> np.ndarray:
                b, fold, y, n = columns(batch)
                out = np.zeros((len(models), width, *shape), np.int64)
                for m, model in enumerate(models):
                    at = model.nodes(model.trees[-1], b)
                    mine = np.flatnonzero((at >= first) & (fold != m))
                    p = 1 / (1 + np.exp(-model.score(b[mine], -1)))
                    g, h = np.rint((p - y[mine]) * UNIT) * n[mine], np.rint(p * (1 - p) * UNIT) * n[mine]
                    for f in range(len(FEATURES)):
                        cell = (at[mine] - first) * BINS + b[mine, f]
                        for k, weight in enumerate((g, h, n[mine])):
                            out[m, :, f, :, k] = np.rint(np.bincount(cell, weight, width * BINS)).astype(np.int64).reshape(width, BINS)
                return out.ravel()

            found = _added(table, sums).reshape(len(models), width, *shape)
            grown = False
            for model, mine in zip(models, found):
                for k in range(width):
                    if mine[k, 0, :, 2].any():
                        model.split(first + k, mine[k])
                        grown |= bool(model.trees[-1][0][first + k] >= 0)
            if not grown:
                break

    def steps(batch: pa.RecordBatch) -> np.ndarray:
        b, fold, y, n = columns(batch)
        p = np.zeros(len(b))
        for m in range(FOLDS):
            p[fold == m] = 1 / (1 + np.exp(-models[m].score(b[fold == m])))
        return np.bincount((p * STEPS).astype(int) * 2 + y, n, 2 * (STEPS + 1)).astype(np.int64)

    # From the most likely down: the share of proven ones among all that are at least as likely.
    seen = _added(table, steps).reshape(-1, 2)[::-1].cumsum(0)
    good = np.flatnonzero((seen[:, 1] >= PRECISION * seen.sum(1)) & (seen[:, 1] > 0))
    threshold = max(0.5, (STEPS - int(good[-1])) / STEPS) if len(good) else 2.0
    return models[-1], threshold


def _spans(model):
    order = {k: i for i, k in enumerate(KINDS)}

    def spans(text: str) -> tuple[list, list]:
        base = base_spans(text)
        found = candidates(text) if model else []
        if not found:
            return base, base
        p = model[0].probability(np.array([features(text, *c) for c in found]))
        more: list[tuple[int, int, str]] = []
        for k in np.argsort(-p, kind="stable"):
            a, b, kind = found[k]
            if p[k] < model[1]:
                break
            if not any(s < b and a < e for s, e, _ in [*base, *more]):
                more.append((a, b, kind))
        return base, sorted([*base, *more], key=lambda s: (s[0], order[s[2]], s[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            both = [spans(t or "") for t in batch.column("text").to_pylist()]
            lists = [[[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in side] for side in zip(*both)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lists[0], kind), pa.array(lists[1], kind)], ["id", "base", "spans"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (all, base ones included) of every row: arrays of kind, start, end.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans. Null doc_ids come back as
    null, identical rows get identical spans, and an empty table gives no rows; other columns are not looked
    at. If the candidates cannot teach the trees anything, only base spans are found.
    """
    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return documents(docs).mapInArrow(_spans(train(docs)), f"id long, base {kind}, spans {kind}").select(outer_id(F.col("id")).alias("doc_id"), "base", "spans")
