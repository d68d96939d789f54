"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Ftrl, feature_rows, held_out, labelled_sample, score_texts, sigmoid
from .words import Words, byte_values, mix, span_hashes

BITS = 18
#: Rows of either label that the model is fitted on.
PER_CLASS = 1500
EPOCHS = 4
#: Kinds of bytes in a word's shape: small letters, capitals, digits, ASCII signs, parts of other letters.
KINDS = np.full(256, 4, np.uint8)
KINDS[:128] = 3
KINDS[97:123], KINDS[65:91], KINDS[48:58] = 0, 1, 2


def shapes(words: Words) -> np.ndarray:
    """A hash of each word's kinds of bytes, runs of one kind taken as one."""
    kind = KINDS[words.data]
    new = np.r_[True, kind[1:] != kind[:-1]][: len(kind)]
    new[words.start] = True
    at = np.flatnonzero(new)
    values = byte_values(11)[kind[at]]
    return span_hashes(values, np.searchsorted(at, words.start), np.searchsorted(at, words.end), 11)


def ngrams(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and pairs of words, as written without capitals and by shape, and words that repeat the one before."""
    one, shape = words.hashes(7, fold=True), shapes(words)
    pair = words.windows(2)
    grams = [
        (words.doc, one),
        (words.doc[pair], mix(one[pair] + np.uint64(3) * one[pair + 1])) if len(pair) else None,
        (words.doc, mix(shape ^ np.uint64(101))),
        (words.doc[pair], mix(shape[pair] + np.uint64(5) * shape[pair + 1])) if len(pair) else None,
    ]
    same = pair[one[pair] == one[pair + 1]]
    grams.append((words.doc[same], np.full(len(same), mix(np.array([77], np.uint64))[0])))
    grams = [g for g in grams if g is not None]
    return np.concatenate([g[0] for g in grams]), (
        np.concatenate([g[1] for g in grams]) >> np.uint64(64 - bits)
    ).astype(np.int64)


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, epochs: int = EPOCHS):
    """Weights and bias, learned from at most ``per_class`` rows of either label; without rows, zeros."""
    rows = feature_rows(labelled_sample(docs, labels, "quality", per_class), ngrams, bits)
    size = 1 << bits
    model = Ftrl(size + 1, alpha=0.3, beta=1.0, l1=0.02, l2=0.01)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            label, at, counts = rows[i]
            values = np.r_[counts * (SCALE / max(counts.sum(), 1)), 1.0]
            model.step(np.r_[at, size], values, lambda score, y=label: float(sigmoid(score)) - y)
    weights = model.weights(np.arange(size + 1))
    return weights[:size], float(weights[size])


#: A text's features are shares of its occurrences, times this.
SCALE = 20.0


def _as_shares(words: Words, dot: np.ndarray) -> np.ndarray:
    n = words.counts.astype(np.float64)
    one = words.hashes(7, fold=True)
    pair = words.windows(2)
    same = np.bincount(words.doc[pair[one[pair] == one[pair + 1]]], minlength=len(n)) if len(pair) else 0
    pairs = np.maximum(n - 1, 0)
    return dot * SCALE / np.maximum(2 * n + 2 * pairs + same, 1)


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Every row of ``docs`` with score (0 to 1, higher: label 1 likelier), predicted and held_out.

    Whole texts are scored; null and empty ones get the bias alone. Labels are learned from ids outside the
    held-out third only. Without any usable label all scores are 0.5. Equal texts have equal scores, repeated rows all
    stay, an empty table gives no rows. Columns named like an output column, or ``_dot``, give way, all others stay. A
    text is held whole in one task, with some dozens of bytes for each of its own.
    """
    docs = docs.drop("score", "predicted", "held_out", "_dot")
    seen = labels.filter(~held_out())
    weights, bias = train_quality(docs, seen, per_class)
    return (
        score_texts(docs, ngrams, BITS, weights, scale=_as_shares)
        .withColumn("score", 1 / (1 + F.exp(-(F.col("_dot") + F.lit(bias)))))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .withColumn("held_out", held_out())
        .drop("_dot")
    )
