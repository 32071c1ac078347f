"""Quality rules by line sequence labelling.

Each line of a document is content or boilerplate. A linear-chain conditional random field scores the
lines' features and the change from line to line; Viterbi decoding finds the best labels of the whole
sequence, and the share of words on content lines decides whether a document is kept.

The field is fitted on at most ``MOST_LABELLED`` labelled documents, those with the smallest hash of their
doc_id and at most ``MOST_LINES`` lines; every line takes its document's quality as its label. Decoding
looks at every line of every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealbook.llm.common import WORD, documents, outer_id, slices

MOST_LABELLED = 2_000
MOST_LINES = 50
#: Least share of words on content lines.
LEAST_CONTENT = 0.5
# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW = 50, 3

_WORDS = re.compile(WORD)
_SYMBOL = re.compile("[#*$%&|<>]")


def base_rules(text: str) -> tuple[int, int, int, int, int, bool]:
    """Words, their code points, symbols, repeated lines, words in repeated windows, and whether the rules fail."""
    words = _WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if _WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + WINDOW - max(i, until)
                until = i + WINDOW
    n = len(words)
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeated, n < LEAST_WORDS or 100 * repeated > 50 * n


FEATURES = (
    "constant", "1-2 words", "3-8 words", "9-30 words", "over 30 words", "few symbols", "many symbols", "bars", "capitals",
    "exclamations", "few distinct words", "hardly any distinct words", "ends a sentence", "digits", "long words", "seen before",
)


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 row of FEATURES and the number of words, for each line that has a word."""
    rows, sizes, seen = [], [], set()
    for line in lines:
        words = _WORDS.findall(line)
        if not words:
            continue
        n, chars = len(words), sum(map(len, words))
        symbols = len(_SYMBOL.findall(line)) / chars
        letters = sum(map(str.isalpha, line)) or 1
        distinct = len(set(words)) / n
        rows.append((
            1, n <= 2, 3 <= n <= 8, 9 <= n <= 30, n > 30, 0.005 < symbols <= 0.05, symbols > 0.05, line.count("|") > 0.1 * n,
            sum(map(str.isupper, line)) > 0.5 * letters, line.count("!") > 0.3 * n, n >= 8 and 0.25 < distinct <= 0.5, n >= 8 and distinct <= 0.25,
            line.rstrip()[-1:] in ".?!\"'", sum(map(str.isdigit, line)) > 0.2 * chars, chars > 10 * n, line in seen,
        ))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


def viterbi(emission: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The best sequence of labels (0 boilerplate, 1 content); equal scores prefer content."""
    n = len(emission)
    if not n:
        return np.empty(0, np.int64)
    (c00, c01), (c10, c11) = change.tolist()
    back, rows = [], emission.tolist()
    s0, s1 = rows[0]
    for e0, e1 in rows[1:]:
        from0, from1 = s1 + c10 >= s0 + c00, s1 + c11 >= s0 + c01
        s0, s1 = (s1 + c10 if from0 else s0 + c00) + e0, (s1 + c11 if from1 else s0 + c01) + e1
        back.append((from0, from1))
    label = int(s1 >= s0)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return np.array(out[::-1])


def fit_field(docs: list[tuple[np.ndarray, int]], penalty: float = 1.0, rounds: int = 100, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 2) and changes (2, 2) that make the labels likely, by Adam on the exact gradient."""
    longest = max(len(x) for x, _ in docs)
    x = np.zeros((len(docs), longest, len(FEATURES)))
    mask = np.zeros((len(docs), longest), bool)
    y = np.array([label for _, label in docs])
    for i, (rows, _) in enumerate(docs):
        x[i, : len(rows)], mask[i, : len(rows)] = rows, True
    last = mask.sum(1) - 1
    target = np.zeros((len(docs), longest, 2))
    target[np.arange(len(docs)), :, y] = mask
    steps = np.zeros((2, 2))
    np.add.at(steps, (y, y), last)
    flat = x[mask]
    theta = np.zeros(len(FEATURES) * 2 + 4)
    m = v = np.zeros_like(theta)

    for k in range(1, rounds + 1):
        w, c = theta[:-4].reshape(-1, 2), np.exp(theta[-4:].reshape(2, 2))
        e = x @ w
        e = np.where(mask[..., None], np.exp(e - e.max(2, keepdims=True)), 1.0)
        # Forward and backward values are scaled at each line; past a document's end they stand still.
        alpha, beta = e.copy(), np.ones_like(e)
        for t in range(1, longest):
            a = (alpha[:, t - 1] @ c) * e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b = (e[:, t + 1] * beta[:, t + 1]) @ c.T
            beta[:, t] = np.where(mask[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
        each = alpha * beta
        each *= mask[..., None] / each.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * c * (e * beta)[:, 1:, None, :]
        pair *= mask[:, 1:, None, None] / pair.sum((2, 3), keepdims=True)
        grad = np.concatenate([(flat.T @ (each - target)[mask]).ravel(), (pair.sum((0, 1)) - steps).ravel()]) + penalty * theta
        grad /= len(docs)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)


def content_share(text: str, field: tuple[np.ndarray, np.ndarray]) -> float:
    """The share of words on lines labelled content; 0 without words."""
    rows, sizes = line_features(text.split("\n"))
    return float(sizes @ viterbi(rows @ field[0], field[1]) / sizes.sum()) if len(sizes) else 0.0


def train(docs: DataFrame, labels: DataFrame):
    """The fitted field; None without labels of both kinds."""
    sample = (
        labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [line_features((t or "").split("\n"))[0] for t in batch.column("text").to_pylist()]
            few = [0 < len(r) <= MOST_LINES for r in rows]
            # Features as bits of one number per line.
            bits = [(r.astype(np.int64) << np.arange(r.shape[1])).sum(1).tolist() for r, f in zip(rows, few) if f]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).filter(pa.array(few)) for c in ("id", "quality")), pa.array(bits, pa.list_(pa.int64()))], ["id", "quality", "lines"]
            )

    rows = documents(docs).join(sample, "id").mapInArrow(run, "id long, quality int, lines array<long>").collect()
    rows.sort(key=lambda r: (r.id, r.lines))
    if len({r.quality for r in rows}) < 2:
        return None
    return fit_field([(((np.array(r.lines)[:, None] >> np.arange(len(FEATURES))) & 1).astype(float), int(r.quality > 0)) for r in rows])


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The base measures, ``content_share`` and ``kept`` of every row of ``docs``.

    A document fails the base rules with under 50 words or with over half of its words in repeated
    windows of three. Others are kept if at least half of their words are on content lines. Null and
    empty texts have no words and fail. Null doc_ids are judged like others; identical rows get identical
    results. Without labels of both kinds all lines are content. An empty table gives no rows; other columns are not
    looked at.
    """
    field = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = list(zip(*map(base_rules, texts)))
            share = np.array([content_share(t, field) if field is not None else float(n > 0) for t, n in zip(texts, base[0])])
            failed = np.array(base[5], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(b, pa.int64()) for b in base[:5]), pa.array(failed), pa.array(~failed & (share >= LEAST_CONTENT)), pa.array(share)],
                ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
            )

    kind = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    found = documents(docs).mapInArrow(run, kind)
    return found.select(outer_id(F.col("id")).alias("doc_id"), *(c for c in found.columns if c != "id"))
