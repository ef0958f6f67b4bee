"""Quality classifier of supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word bigrams and character n-grams; a softmax layer
over the average gives the class. Both are trained together by minibatch stochastic gradient descent in numpy on a sample
of labelled documents of at most max_docs rows (the rows with the smallest hash of their id), which tasks turn into
bucket counts, so that no text reaches the driver. Because the layers are linear up to the softmax, a trained model
shrinks to one number per bucket; documents are scored in one pass without a shuffle.

Defined results: null and empty texts have no features and get the score of the output bias alone, the prior;
unlabelled, null-labelled and held-out rows don't train; no labelled rows at all give the score 0.5; repeated rows
are scored one by one, and repeated labels of a document each count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._grams import CACHE_WORDS, WordSums, counts_of, grams, minibatches
from ._shared import append, utf8

BUCKETS, DIM, LOW, HIGH = 1 << 14, 16, 3, 3
MAX_DOCS, EPOCHS, MIN_STEPS, BATCH, RATE = 6_000, 12, 1_000, 32, 60.0
CUT = 0.3
#: Words that are looked up at once.
STEP = 8192
U = np.uint64
#: The bucket of a word that repeats the one before.
AGAIN = 0
_FACTORS = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def bigrams(numbers: np.ndarray) -> np.ndarray:
    """Buckets of the word bigrams, from the words' hashes. All bigrams of a word with itself are one feature."""
    first, second = numbers[:-1], numbers[1:]
    mixed = first * _FACTORS[0] + second * _FACTORS[1]
    mixed = (mixed ^ mixed >> U(31)) * _FACTORS[0]
    return np.where(first == second, AGAIN, (mixed >> U(40)).astype(np.int64) % BUCKETS)


def word_number(word: bytes) -> int:
    return zlib.crc32(word, 2)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's features and how often each occurs."""
    words = utf8(text).split()
    total = np.bincount(bigrams(np.array([word_number(w) for w in words], U)), minlength=BUCKETS).astype(np.float64) if len(words) > 1 else np.zeros(BUCKETS)
    for word, n in Counter(words).items():
        np.add.at(total, grams(word, LOW, HIGH, BUCKETS, True), n)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.float32)


class Model:
    """z: what each bucket adds to the log-odds of class 1, averaged over a document's features; bias: the rest."""

    def __init__(self, z: np.ndarray, bias: float) -> None:
        self.z, self.bias = z, bias

    def scorer(self) -> Callable[[str | None], float]:
        z = self.z
        sums, numbers = np.zeros((CACHE_WORDS + 1, 2)), np.zeros(CACHE_WORDS + 1, U)

        def value(word: bytes) -> int:
            row, ids = len(cache), grams(word, LOW, HIGH, BUCKETS, True)
            sums[row], numbers[row] = (z[ids].sum(), len(ids)), word_number(word)
            return row

        cache = WordSums(value)

        def score(text: str | None) -> float:
            words = utf8(text).split()
            total, count, last = 0.0, 0, np.zeros(0, U)
            for at in range(0, len(words), STEP):
                part = words[at : at + STEP]
                rows = np.fromiter(map(cache.bounded(len(part)).__getitem__, part), np.int64, len(part))
                own = np.concatenate((last, numbers[rows]))
                pairs = bigrams(own)
                s, n = sums[rows].sum(axis=0)
                total, count, last = total + s + z[pairs].sum(), count + n + len(pairs), own[-1:]
            margin = self.bias + (total / count if count else 0.0)
            return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

        return score


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    if not len(rows):
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    prior = np.clip(labels.mean(), 0.01, 0.99)
    bias = np.array([np.log(1 - prior), np.log(prior)], np.float32)
    target = np.eye(2, dtype=np.float32)[labels]
    # Few rows are gone through more often.
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH // len(rows)))
    steps, done = epochs * -(-len(rows) // BATCH), 0
    for _ in range(epochs):
        for chosen, x in minibatches(rows, BUCKETS, BATCH, rng):
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = x @ vectors
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = (p - target[chosen]) / len(chosen)
            to_hidden = error @ out.T
            out -= 0.02 * rate * (hidden.T @ error)
            bias -= 0.002 * rate * error.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            vectors[used] -= rate * (x[:, used].T @ to_hidden)
    z = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64)
    return Model(z, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS) -> Model:
    """Trains on at most max_docs labelled rows for which allowed holds."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label_value")).where(allowed_on(allowed, id_col))
    # The ids are few and are chosen before any text is touched; labels that a document repeats each count.
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id", "label_value").limit(max_docs)
    # Rows that share an id are one row each for training: the one with the least text, so that the bound holds.
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("sample_text")).join(F.broadcast(chosen.select("label_id").distinct()), "label_id", "left_semi")
    once = texts.groupBy("label_id").agg(F.min("sample_text").alias("sample_text"))
    sample = once.join(F.broadcast(chosen), "label_id")

    def make():
        def fn(batch):
            made = [features(x) for x in batch.column(batch.schema.get_field_index("sample_text")).to_pylist()]
            return [a for a, _ in made], [b for _, b in made]

        return fn

    table = append(sample, "ids array<int>, counts array<float>", make, drop=("sample_text",)).toArrow()
    own = table["label_id"].to_pylist()
    y = table["label_value"].to_numpy()
    order = sorted(range(len(own)), key=lambda i: (own[i], y[i]))
    return train(counts_of(table, order), y[order])


def allowed_on(allowed: Column, id_col: str) -> Column:
    """Rows without an id never train."""
    return F.coalesce(allowed, F.lit(False))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True, cut: float = CUT) -> DataFrame:
    """docs with score and predicted."""

    def make():
        scorer = model.scorer()

        def fn(batch):
            values = [scorer(x) for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            return values, [int(v >= cut) for v in values]

        return fn

    return append(docs, "score double, predicted int", make, drop=() if keep_text else (text_col,))
