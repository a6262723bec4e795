"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word ends) and itself, hashed to rows of one embedding table,
so a misspelling never seen shares most of its vectors with the word it comes from. A window of words is the average
of its subwords' vectors, classified by a linear softmax; embeddings and softmax are trained together. A few toxic
words in a long text would drown in one average over it, so the text is scored window by window, whole, and its score
is that of its most toxic window; training picks that window likewise, since only texts have labels.

Averaging and the softmax are linear, so a trained model comes down to one number a subword: this vector (1 MB, fixed)
is all that is sent to the workers.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import by_size
from .common import cut, pieces, table

BUCKETS = 1 << 18
#: Words in a window, and from one window's start to the next.
WINDOW, STEP = 4, 2
MIN_TEXTS = 2
EDGES = ".,;:!?\"'()[]{}«»¿¡…"
REMEMBERED = 200_000


def subwords(token: str) -> list[int]:
    word = "<" + (token.strip(EDGES) or token) + ">"
    n = len(word)
    return sorted({crc32(word[i : i + k].encode()) % BUCKETS for k in (3, 4, 5) for i in range(n - k + 1)} | {crc32(word.encode()) % BUCKETS})


def windows(n: int) -> np.ndarray:
    """(start, stop) of the windows over n words: they cover all of them."""
    starts = np.arange(0, max(1, n - WINDOW + STEP), STEP)
    return np.stack([starts, np.minimum(starts + WINDOW, n)], 1)


@dataclass
class Model:
    """``weights``: each subword's contribution to the log odds. A text's score is the logistic of slope * (top window - threshold)."""

    weights: np.ndarray
    bias: float
    threshold: float
    slope: float

    def __post_init__(self):
        self.known: dict[str, complex] = {}

    def learn_words(self, tokens: set[str]) -> None:
        new = list(tokens.difference(self.known))
        if not new:
            return
        if len(self.known) > REMEMBERED:
            self.known.clear()
            new = list(tokens)
        ids = [subwords(t) for t in new]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        sums = np.add.reduceat(self.weights[flat].astype(float), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        self.known.update(zip(new, sums + 1j * sizes))

    def top(self, texts: list[str]) -> np.ndarray:
        """The largest window's log odds of each whole text; without words, none are lower."""
        tokens = [t.lower().split() for t in texts]
        self.learn_words(set().union(*tokens))
        out, known = np.full(len(texts), -np.inf), self.known
        for k, words in enumerate(tokens):
            if words:
                sums = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__getitem__, words), complex, len(words)))])
                at = windows(len(words))
                span = sums[at[:, 1]] - sums[at[:, 0]]
                out[k] = self.bias + (span.real / span.imag).max()
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.top(texts) - self.threshold), -40, 40)))


def fit(texts: list[str], toxic: np.ndarray, dim: int = 8, epochs: int = 16, batch: int = 96, rate: float = 0.5, seed: int = 7) -> Model:
    """Trains on labelled texts. With one class only, there is nothing to tell apart: every score is near 0."""
    rng = np.random.default_rng(seed)
    toxic = np.asarray(toxic, int)
    if len(texts) < 2 or toxic.min() == toxic.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 10.0, 1.0)
    vocabulary: dict[str, int] = {}
    docs = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t.lower().split()), np.int32) for t in texts]
    packed, sizes_of = array("i"), array("i")
    for w in vocabulary:
        bag = subwords(w)
        packed.extend(bag)
        sizes_of.append(len(bag))
    bag_size, flat = np.array(sizes_of, np.int64), np.frombuffer(packed, np.int32)
    bag_start = np.concatenate([[0], np.cumsum(bag_size)])
    # Subwords of fewer than MIN_TEXTS training texts have no weight: what is learnt of them does not carry over.
    texts_with = np.zeros(BUCKETS, np.int32)
    for d in docs:
        seen = np.unique(d)
        size = bag_size[seen]
        texts_with[np.unique(flat[np.repeat(bag_start[seen] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())])] += 1
    known = (texts_with >= MIN_TEXTS)[:, None]
    spans = [windows(len(d)) if len(d) else np.empty((0, 2), np.int64) for d in docs]
    owner = np.repeat(np.arange(len(docs)), [len(s) for s in spans])
    offset = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    span = np.concatenate(spans) + offset[owner][:, None]
    words = np.concatenate(docs)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    check = np.fromiter((crc32(t.encode()) % 5 == 0 for t in texts), bool, len(texts))  # sets the threshold, not the weights

    table_, out = rng.normal(0, 0.02, (BUCKETS, dim)), rng.normal(0, 0.3, (dim, 2))
    table_ *= known
    bias = np.zeros(2)
    squares = [np.full_like(table_, 1e-4), np.full_like(out, 1e-4), np.full_like(bias, 1e-4)]

    def collapsed() -> tuple[np.ndarray, float]:
        return (table_ @ (out[:, 1] - out[:, 0])), float(bias[1] - bias[0])

    def window_scores() -> np.ndarray:
        weight, shift = collapsed()
        sums = np.add.reduceat(weight.astype(np.float32)[flat], bag_start[:-1]).astype(float)
        total, count = (np.concatenate([[0.0], np.cumsum(x[words])]) for x in (sums, bag_size.astype(float)))
        return (total[span[:, 1]] - total[span[:, 0]]) / (count[span[:, 1]] - count[span[:, 0]]) + shift

    def step(chosen: np.ndarray) -> None:
        lengths = span[chosen, 1] - span[chosen, 0]
        token = words[np.repeat(span[chosen, 0] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())]
        size = bag_size[token]
        ids = flat[np.repeat(bag_start[token] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        row = np.repeat(np.repeat(np.arange(len(chosen)), lengths), size)
        n = np.bincount(row, minlength=len(chosen)).astype(float)
        hidden = np.stack([np.bincount(row, table_[ids, d], len(chosen)) for d in range(dim)], 1) / n[:, None]
        logits = hidden @ out + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(chosen)), toxic[owner[chosen]]] -= 1
        p /= len(chosen)
        back = (p @ out.T) / n[:, None]
        touched, where = np.unique(ids, return_inverse=True)
        grads = (np.stack([np.bincount(where, back[row, d], len(touched)) for d in range(dim)], 1), hidden.T @ p, p.sum(0))
        squares[0][touched] += grads[0] ** 2
        table_[touched] -= known[touched] * rate * grads[0] / np.sqrt(squares[0][touched])
        for value, g, s in ((out, grads[1], squares[1]), (bias, grads[2], squares[2])):
            s += g**2
            value -= 0.2 * rate * g / np.sqrt(s)

    has = np.zeros(len(docs), bool)
    has[owner] = True
    sizes = np.diff(np.r_[first, len(owner)])
    # Few texts take more rounds, for as many steps.
    epochs = min(120, max(epochs, 1200 * batch // (2 * len(docs))))
    for epoch in range(epochs):
        if epoch < epochs // 5:
            chosen = np.concatenate([first + rng.integers(0, sizes) for _ in range(3)])
        else:
            scores = window_scores()
            order = np.lexsort((-scores, owner))
            chosen = np.concatenate([order[first], first + rng.integers(0, sizes)])
            # A random window of a toxic text may well be clean: only texts without toxicity lend theirs.
            chosen = chosen[np.r_[np.ones(len(first), bool), toxic[owner[first]] == 0]]
        chosen = rng.permutation(chosen[~check[owner[chosen]]])
        for part in np.array_split(chosen, max(1, len(chosen) // batch)):
            if len(part):
                step(part)
    weight, shift = collapsed()
    top = np.full(len(docs), shift)
    top[owner[first]] = np.maximum.reduceat(window_scores(), first)
    threshold, slope = calibrate(top[check], toxic[check]) if check.any() and 0 < toxic[check].mean() < 1 else calibrate(top, toxic)
    return Model(weight.astype(np.float32), shift, threshold, slope)


def calibrate(top: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The threshold with the fewest errors, a clean text called toxic counting twice; between the classes where they part."""
    order = np.argsort(top)
    x, y = top[order], toxic[order]
    cost = np.concatenate([[2 * (y == 0).sum()], 2 * (y == 0).sum() + np.cumsum(np.where(y == 1, 1, -2))])
    best = np.flatnonzero(cost == cost.min())
    at = best[len(best) // 2]
    low, high = x[at - 1] if at else x[0] - 1, x[at] if at < len(x) else x[-1] + 1
    spread = max(1e-6, float(np.abs(x - (low + high) / 2).mean()))
    return float((low + high) / 2), 3.0 / spread


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """At most ``per_class`` texts of either label, of at most ``max_chars`` code points, in an order that a hash of the id gives.

    Only documents that qualify are drawn, so long texts leave no gaps. Of labels that contradict each other, toxic holds.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).select(F.col("doc_id").alias("__id"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    fits = known.join(short, F.col("__id") == F.col("doc_id"), "left_semi")
    picked = cut(fits.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(fits.where("toxic = 0").orderBy(*order).limit(per_class)))
    texts = docs.select(F.col("doc_id").alias("__id"), "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    joined = texts.join(F.broadcast(picked), F.col("__id") == F.col("doc_id"))  # at most 2 * per_class ids
    rows = joined.select("doc_id", "text", "toxic").orderBy(*order, "text").limit(2 * per_class).collect()
    return [r.text for r in rows], np.array([r.toxic for r in rows], int)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, max_chars: int = 8_000) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out."""
    return fit(*training_sample(docs, labels, per_class, max_chars))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, score_name: str = "score") -> DataFrame:
    """The columns ``keep`` (None: all) and the score of each row's whole text, of any length; a column of the score's name is replaced.

    A null text scores as an empty one. Every row gives one: repeated rows and rows without id score by their text, equal
    texts equally. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.threshold, model.slope))
    rest = [c for c in (docs.columns if keep is None else keep) if c != score_name]
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(rest)], F.col("text").alias("t"))
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)), "s double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in pieces(batches):
            scores = [own.score(texts) for texts in by_size(batch.column(len(rest)).to_pylist())]
            made = pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), made], names=[*(f"k{i}" for i in range(len(rest))), "s"])

    return chosen.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(rest)], F.col("s").alias(score_name))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores under ``limit``; repeated rows stay or go together. An empty table gives an empty table."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.threshold, model.slope))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in pieces(batches):
            scores = [own.score(texts) for texts in by_size(batch.column(at).to_pylist())]
            yield batch.filter(pa.array((np.concatenate(scores) if scores else np.empty(0)) < limit))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model that never saw the held-out documents' labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable] = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
