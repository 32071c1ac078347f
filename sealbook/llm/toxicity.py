"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models; each later model also sees the earlier
categories' probabilities. In training those are out-of-fold predictions, so that a later model learns
from inputs like the ones it will get. Features are words and word beginnings, chosen by how much more often
they occur in toxic documents than in others.

Only the fit uses a sample: at most ``MOST_LABELLED`` labelled documents, those with the smallest hash of
their doc_id. Every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from sealbook.llm.common import Words, documents, outer_id, rows_with_text, slices, texts_of

MOST_LABELLED = 6_000
MOST_FEATURES = 400
#: A feature must be in so many sampled documents.
LEAST_DOCUMENTS = 4
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 5
#: A category's training label: the document is labelled toxic and has one of these words. The last category is the label.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "fool", "dumb"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "filth"),
    "toxic": (),
}


def _forms(word: str) -> list[int]:
    """Hashes of a word's features: the bare lower-case word and its beginnings."""
    bare = word.lower().strip("".join({c for c in word if not c.isalnum()}))
    if not bare:
        return []
    return [xxhash.xxh3_64_intdigest("=" + bare) >> 1] + [xxhash.xxh3_64_intdigest(f"{n}{bare[:n]}") >> 1 for n in BEGINNINGS if len(bare) > n]


def _features(chosen: dict[int, int] | None):
    """Distinct features of each text: hashes, or their numbers if ``chosen`` gives them."""

    def of(texts: pa.Array) -> list[np.ndarray]:
        words = Words(texts)
        starts, joined, offsets = words.starts, words.joined.tobytes(), words.offsets
        _, first, codes = np.unique(words.hashes, return_index=True, return_inverse=True)
        forms = [_forms(joined[offsets[i] : offsets[i + 1] - 1].decode(errors="replace")) for i in first.tolist()]
        if chosen is not None:
            forms = [[chosen[f] for f in fs if f in chosen] for fs in forms]
        sizes = np.array([len(f) for f in forms], np.int64)
        flat = np.array([f for fs in forms for f in fs], np.int64)
        first = np.cumsum(sizes) - sizes
        out = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            c = np.unique(codes[a:b])
            c = c[sizes[c] > 0]
            reps = sizes[c]
            at = np.repeat(first[c] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
            out.append(np.unique(flat[at]))
        return out

    return of


def _featured(chosen: dict[int, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _features(chosen)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array([f.tolist() for f in of(batch.column("text"))], pa.list_(pa.int64()))],
                [*(c for c in batch.schema.names if c != "text"), "features"],
            )

    return run


class _Rows:
    """A 0/1 matrix by its active columns, followed by a few dense columns and a constant."""

    def __init__(self, active: list[np.ndarray], width: int, dense: np.ndarray):
        self.flat = np.concatenate([*active, np.empty(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(active)), [len(a) for a in active])
        self.width, self.dense = width, np.hstack([dense, np.ones((len(active), 1))])
        self.norm = max(1.0, float((np.bincount(self.row, minlength=len(active)) + (self.dense**2).sum(1)).max()))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], len(self.dense)) + self.dense @ w[self.width :]

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.flat, r[self.row], self.width), r @ self.dense])


def _sigmoid(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _logistic(x: _Rows, y: np.ndarray, penalty: float = 0.5, rounds: int = 400) -> np.ndarray:
    """Weights, the last for the constant, by accelerated gradient descent on the mean loss."""
    w = v = np.zeros(x.width + x.dense.shape[1])
    shrink = np.append(np.full(len(w) - 1, penalty / len(y)), 0)
    for k in range(rounds):
        nxt = v - 4 / x.norm * (x.transposed_times(_sigmoid(x.times(v)) - y) / len(y) + shrink * v)
        v, w = nxt + (k / (k + 3)) * (nxt - w), nxt
    return w


def fit_chain(active: list[np.ndarray], width: int, labels: np.ndarray) -> tuple[list[np.ndarray], float]:
    """A model per column of ``labels``, and the threshold on the last that separates best out of fold."""
    fold = np.arange(len(active)) % FOLDS
    models, seen = [], np.zeros((len(active), 0))
    for k in range(labels.shape[1]):
        y, outside = labels[:, k].astype(float), np.zeros(len(active))
        for f in range(FOLDS):
            test, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(test) and len(rest):
                w = _logistic(_Rows([active[i] for i in rest], width, seen[rest]), y[rest])
                outside[test] = _sigmoid(_Rows([active[i] for i in test], width, seen[test]).times(w))
        models.append(_logistic(_Rows(active, width, seen), y))
        seen = np.hstack([seen, outside[:, None]])
    y, p = labels[:, -1] > 0, seen[:, -1]
    order = np.argsort(-p, kind="stable")
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    after = p[order[best + 1]] if best + 1 < len(y) else 0.0
    return models, float((p[order[best]] + after) / 2)


def train(docs: DataFrame, labels: DataFrame, categories: Mapping[str, tuple[str, ...]]):
    """Features with their numbers, the chain and the threshold; None without both kinds of label."""
    sample = (
        labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED)
    )
    sample = documents(docs).join(sample, "id").withColumn("toxic", F.col("toxic").cast("long"))
    every = sample.select("id", "toxic", "text").mapInArrow(_featured(None), "id long, toxic long, features array<long>")
    counts = every.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("n1"), F.count("*").alias("n"))
    n, n1 = every.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not n1 or n1 == n:
        return None
    rate = n1 / n
    z = (F.col("n1") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    top = counts.filter((F.col("n") >= LEAST_DOCUMENTS) & (F.col("n1") > F.col("n") * rate)).orderBy(z.desc(), "f").limit(MOST_FEATURES).collect()
    chosen = {r.f: i for i, r in enumerate(top)}
    wanted = {name: [h for w in words for h in _forms(w)[:1]] for name, words in categories.items()}
    held = {h for hs in wanted.values() for h in hs}
    for h in held:
        chosen.setdefault(h, len(chosen))
    rows = sample.select("id", "toxic", "text").mapInArrow(_featured(chosen), "id long, toxic long, features array<long>").collect()
    rows.sort(key=lambda r: xxhash.xxh3_64_intdigest(str(r.id)))
    y = np.zeros((len(rows), len(categories)))
    for i, r in enumerate(rows):
        has = set(r.features)
        for k, name in enumerate(categories):
            seeds = wanted[name]
            y[i, k] = r.toxic and (not seeds or any(chosen[h] in has for h in seeds))
    models, threshold = fit_chain([np.array(r.features, np.int64) for r in rows], len(chosen), y)
    return chosen, models, threshold


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, models, threshold = model
        of = _features(chosen)
        for batch in slices(batches):
            rows = of(texts_of(batch))
            p = np.zeros((len(rows), len(models)))
            for i, active in enumerate(rows):
                for k, w in enumerate(models):
                    score = w[active].sum() + w[-1] + p[i, :k] @ w[len(chosen) : len(chosen) + k]
                    p[i, k] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(p[:, -1] >= threshold)],
                [*(c for c in batch.schema.names if c != "text"), "p", "toxic"],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, categories: Mapping[str, tuple[str, ...]] = CATEGORIES) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` each, ``toxic`` and ``kept`` (its opposite) of every row.

    Null and empty texts have no features: they get the chain's answer to nothing, which is what clean
    text without known words gets. Null doc_ids are scored like others. Labels without id or value are left out; a doc_id
    labelled twice counts as toxic if one label says so. Without labels of both kinds nothing is toxic
    and probabilities are 0. An empty table gives no rows; other columns are not looked at.
    """
    names = list(categories)
    model = train(docs, labels, categories)
    base = documents(docs)
    if model is None:
        scored = base.select("id", F.array_repeat(F.lit(0.0), len(names)).alias("p"), F.lit(False).alias("toxic"))
    else:
        scored = base.mapInArrow(_scored(model), "id long, p array<double>, toxic boolean")
    return scored.select(
        outer_id(F.col("id")).alias("doc_id"), *(F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(names)), "toxic", (~F.col("toxic")).alias("kept")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with all their columns."""
    model = train(docs, labels, CATEGORIES)
    if model is None:
        return docs
    row = docs.select(*rows_with_text(docs))
    kind = StructType([row.schema["row"]]).add("p", ArrayType(DoubleType())).add("toxic", "boolean")
    scored = row.mapInArrow(_scored(model), kind)
    return scored.filter("not toxic").select("row.*")
