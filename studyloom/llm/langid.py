"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit of the code a binary logistic classifier over hashed n-grams predicts
the bit. Decoding adds up the logistic loss of every bit's margin against each codeword and takes the language of
the least loss; a document whose two best languages are close in loss is flagged as ambiguous. Up to seven
languages have the exhaustive code; more have a seeded random code of many bits with the largest least distance.

Training takes at most max_docs documents a language and max_total in all (those with the smallest hash of their id),
which tasks turn into bucket counts; every language takes part. Counts of the languages come first, so only rows whose
hash is below a language's threshold, about twice as many as are wanted, are ever ranked. Scoring is one pass without a shuffle; each word's contribution is summed once per task.

Defined results: null text or text without a letter is `und` with score 0; rows without lang don't train; with no
learned language every row is `und`; repeated rows are judged one by one.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._grams import CACHE_WORDS, WordSums, counted, counts_of, grams, minibatches
from ._shared import append, cut, small_side

BUCKETS, LOW, HIGH = 1 << 14, 2, 3
#: At most 1,000 documents a language, so that Spark limits each task before the shuffle.
MAX_DOCS, EPOCHS, BATCH = 1_000, 4, 32
#: Difference of losses, in parts of the number of bits, under which a document is ambiguous.
CLOSE = 0.1
#: Documents of all languages together: with many languages, each gives fewer.
MAX_TOTAL = 8_000
UNKNOWN = "und"
#: Words that are looked up at once.
STEP = 8192

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall((text or "").lower())]


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for word in _WORD.finditer(text or "") for c in word.group())


def code(languages: int, seed: int = 11) -> np.ndarray:
    """Codewords of +1 and -1, a row per language."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 7:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(columns, float).T
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(15 * np.log2(languages))), None
    for _ in range(200):
        words = rng.choice([-1.0, 1.0], (languages, bits))
        agree = words @ words.T
        np.fill_diagonal(agree, -bits)
        if best is None or agree.max() < best[0]:
            best = (agree.max(), words)
    return best[1]


class Model:
    def __init__(self, languages: list[str], words: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.languages, self.words, self.weights, self.bias = languages, words, weights, bias

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each document (row of margins) to each codeword."""
        return np.logaddexp(0, -margins[:, None, :] * self.words[None]).sum(axis=2)

    def predictor(self) -> Callable[[list], tuple[list, list, list]]:
        bits = self.words.shape[1]

        weights, table = self.weights, np.zeros((CACHE_WORDS + 1, bits + 1))

        def value(word: bytes) -> int:
            row, ids = len(rows), grams(word, LOW, HIGH, BUCKETS, False)
            table[row, :-1], table[row, -1] = weights[ids].sum(axis=0), len(ids)
            return row

        rows = WordSums(value)

        def predict(texts: list) -> tuple[list, list, list]:
            margins, known = np.zeros((len(texts), bits)), np.zeros(len(texts), bool)
            for i, text in enumerate(texts):
                if self.languages and (words := words_of(text)) and has_letter(text):
                    known[i] = True
                    sums = np.zeros(bits + 1)
                    for at in range(0, len(words), STEP):
                        part = words[at : at + STEP]
                        sums += table[np.fromiter(map(rows.bounded(len(part)).__getitem__, part), np.int64, len(part))].sum(axis=0)
                    margins[i] = self.bias + sums[:-1] / max(sums[-1], 1)
            if not self.languages:
                return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            loss = self.losses(margins)
            best = loss.argmin(axis=1)
            p = np.exp(loss.min(axis=1, keepdims=True) - loss)
            score = 1 / p.sum(axis=1)
            ordered = np.sort(loss, axis=1)
            close = ordered[:, 1] - ordered[:, 0] < CLOSE * bits if loss.shape[1] > 1 else np.zeros(len(texts), bool)
            langs = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            return langs, np.where(known, score, 0.0).tolist(), (close | ~known).tolist()

        return predict


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 5) -> Model:
    languages = sorted(set(langs))
    words = code(len(languages))
    bits = words.shape[1] if languages else 0
    weights, bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    if not languages:
        return Model([], np.zeros((0, 0)), weights, bias)
    target = words[np.searchsorted(languages, langs)].astype(np.float32)
    # Rare n-grams tell languages apart as well as common ones: each step is scaled by a bucket's own history.
    history = np.full((BUCKETS, 1), 1e-7, np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for chosen, x in minibatches(rows, BUCKETS, BATCH, rng):
            margins = x @ weights + bias
            error = -target[chosen] / (1 + np.exp(np.clip(margins * target[chosen], -30, 30))) / len(chosen)
            used = np.flatnonzero(x.any(axis=0))
            slope = x[:, used].T @ error
            history[used] += (slope**2).mean(axis=1, keepdims=True)
            weights[used] -= slope / np.sqrt(history[used]) * 1.0
            bias -= 0.05 * error.sum(axis=0)
    return Model(languages, words, weights.astype(np.float64), bias.astype(np.float64))


def sampled(docs: DataFrame, allowed: Column, id_col: str, lang_col: str, max_docs: int, max_total: int) -> DataFrame:
    """(sample_id, sample_lang) of the documents to train on."""
    ids = docs.where(F.coalesce(allowed, F.lit(False)) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("sample_id"), F.col(lang_col).alias("sample_lang"), F.xxhash64(F.col(id_col)).alias("hash"))
    sizes = cut(ids.groupBy("sample_lang").agg(F.count(F.lit(1)).alias("n")))
    wanted = F.least(F.lit(max_docs), F.greatest(F.lit(1), F.floor(F.lit(max_total) / F.lit(max(1, sizes.count())))))
    # In parts of 2^32: a language's rows below it are more than are wanted, but for a chance of nothing.
    limits = sizes.select(F.col("sample_lang").alias("of"), wanted.alias("wanted"), (F.lit(float(1 << 32)) * (2 * wanted + 100) / F.col("n")).alias("limit"))
    near = ids.join(small_side(limits, 10_000), F.col("sample_lang") == F.col("of")).where(F.pmod("hash", F.lit(1 << 32)) < F.col("limit"))
    order = Window.partitionBy("sample_lang").orderBy(F.pmod("hash", F.lit(1 << 32)), "hash", "sample_id")
    return cut(near.withColumn("rank", F.row_number().over(order)).where("rank <= wanted").select("sample_id", "sample_lang").distinct())


def fit(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_total: int = MAX_TOTAL) -> Model:
    """Trains on documents of every language for which allowed holds, at most max_docs of each and max_total in all."""
    chosen = sampled(docs, allowed, id_col, lang_col, max_docs, max_total)
    # The chosen are max_total rows at most (a row for each language, if there are more of these).
    sample = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("sample_text")).join(small_side(chosen, 2 * MAX_TOTAL), "sample_id")

    def make():
        def fn(batch):
            made = [counted(words_of(x), LOW, HIGH, BUCKETS, whole=False) for x in batch.column(batch.schema.get_field_index("sample_text")).to_pylist()]
            return [a for a, _ in made], [b for _, b in made]

        return fn

    table = append(sample, "ids array<int>, counts array<float>", make, drop=("sample_text",)).toArrow()
    order = np.argsort(table["sample_id"].to_numpy(), kind="stable")
    langs = table["sample_lang"].to_pylist()
    return train(counts_of(table, order), [langs[i] for i in order])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score and ambiguous."""

    def make():
        predict = model.predictor()

        def fn(batch):
            return predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())

        return fn

    return append(docs, "lang_pred string, score double, ambiguous boolean", make, drop=() if keep_text else (text_col,))
