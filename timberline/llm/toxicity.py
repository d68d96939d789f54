"""Toxicity by cumulative-link ordinal regression: P(grade <= k) = sigmoid(threshold_k - w.x).

The weights are shared by all thresholds. Features are the hashed words of a text, each counted once, capitals
and signs at a word's ends left out. The labels say only toxic or not; a toxic training row's grade is the number
of marker words in it: words that toxic training rows hold far more often than clean ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Ftrl, feature_rows, held_out, labelled_sample, score_texts, sigmoid
from .words import Words, byte_values, span_hashes

BITS = 20
#: Rows of either label that the model is fitted on.
PER_CLASS = 2500
EPOCHS = 6
#: Marker words in a toxic row: fewer than the first make grade 1, fewer than the second grade 2, others 3.
GRADE_AT = (2, 4)
#: A marker is in so many toxic rows at least, and so many times as often there as in clean rows.
MARKER_ROWS, MARKER_LIFT = 5, 6.0
#: L1 strength per root of the toxic training rows: what chance adds up to over n rows grows with the root of n.
L1_ROOT = 0.4
#: Folds for the choice of the decision cut, and the share of clean training rows that may pass it.
FOLDS, FALSE_ALARMS = 4, 0.004
SIGN = np.zeros(256, bool)
SIGN[33:48] = SIGN[58:65] = SIGN[91:97] = SIGN[123:127] = True


def bare_words(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and bucket of each word, without signs at its ends and without capitals."""
    start, end = words.start.copy(), words.end.copy()
    live = np.arange(len(start))
    while len(live := live[SIGN[words.data[start[live]]] & (end[live] - start[live] > 1)]):
        start[live] += 1
    live = np.arange(len(start))
    while len(live := live[SIGN[words.data[end[live] - 1]] & (end[live] - start[live] > 1)]):
        end[live] -= 1
    hashes = span_hashes(byte_values(9, fold=True)[words.data], start, end, 9)
    return words.doc, (hashes >> np.uint64(64 - bits)).astype(np.int64)


def grades(rows: list, bits: int) -> list[int]:
    clean, toxic = np.zeros(1 << bits), np.zeros(1 << bits)
    for label, at, _ in rows:
        (toxic if label else clean)[at] += 1
    n_clean, n_toxic = (max(1, sum(r[0] == k for r in rows)) for k in (0, 1))
    marker = (toxic >= MARKER_ROWS) & ((toxic / n_toxic) > MARKER_LIFT * (clean + 0.5) / n_clean)
    return [1 + int(np.searchsorted(GRADE_AT, marker[at].sum(), side="right")) if label else 0 for label, at, _ in rows]


def fit_grades(rows: list, bits: int, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the three thresholds in rising order."""
    top = len(GRADE_AT) + 1
    cuts, rate = np.arange(1.0, top + 1), 0.05
    model = Ftrl(1 << bits, alpha=1.0, beta=1.0, l1=L1_ROOT * np.sqrt(sum(r[0] for r in rows)), l2=0.1)
    grade, order = grades(rows, bits), np.random.default_rng(6)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, at = grade[i], rows[i][1]

            def slope(score: float, y: int = y) -> float:
                above = sigmoid(cuts[y] - score) if y < top else 1.0
                below = sigmoid(cuts[y - 1] - score) if y else 0.0
                p = max(above - below, 1e-6)
                if y < top:
                    cuts[y] += rate * min(above * (1 - above) / p, 5)
                if y:
                    cuts[y - 1] -= rate * min(below * (1 - below) / p, 5)
                for k in range(1, top):
                    cuts[k] = max(cuts[k], cuts[k - 1] + 0.05)
                return float(1 - above - below)

            model.step(at, np.ones(len(at)), slope)
        rate *= 0.7
    return model.weights(np.arange(1 << bits)), cuts


def cut_shift(label: np.ndarray, margin: np.ndarray) -> float:
    """Where to cut margins so that at most FALSE_ALARMS of the clean rows pass: halfway down from the least toxic
    margin that passes to the clean row that does not."""
    clean = np.sort(margin[label == 0])[::-1]
    stop = clean[int(FALSE_ALARMS * len(clean))]
    caught = margin[(label == 1) & (margin > stop)]
    return float(stop + caught.min()) / 2 if len(caught) else 0.0


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, epochs: int = EPOCHS):
    """Weights and the three thresholds in rising order; without rows, zero weights and thresholds above 0.

    The first threshold, which parts clean from toxic, is moved to where it serves training rows that the model has
    not seen: each fold of them is scored by a model of the other folds.
    """
    rows = feature_rows(labelled_sample(docs, labels, "toxic", per_class), bare_words, bits)
    weights, cuts = fit_grades(rows, bits, epochs)
    label = np.array([r[0] for r in rows], int)
    if min(np.sum(label == 0), np.sum(label == 1)) >= FOLDS:
        fold, margin = np.zeros(len(rows), int), np.zeros(len(rows))
        for k in (0, 1):
            fold[label == k] = np.arange(np.sum(label == k)) % FOLDS
        for k in range(FOLDS):
            w, c = fit_grades([r for r, f in zip(rows, fold) if f != k], bits, epochs)
            for i in np.flatnonzero(fold == k):
                margin[i] = w[rows[i][1]].sum() - c[0]
        cuts[0] = min(cuts[0] + cut_shift(label, margin), cuts[1] - 0.05)
    return weights, cuts


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Every row of ``docs`` with severity (expected grade, 0 to 3), grade (the likeliest number of thresholds
    passed) and toxic (grade 0 is less likely than all others together).

    Whole texts are graded; null and empty ones have no features. Labels are learned from ids outside the held-out
    third only. Without any usable label nothing is toxic. Equal texts have equal grades, repeated rows all stay, an empty
    table gives no rows. Columns named like an output column, or ``_dot``, give way, all others stay. A text is held
    whole in one task, with some dozens of bytes for each of its own.
    """
    docs = docs.drop("severity", "grade", "toxic", "_dot")
    weights, cuts = train_toxicity(docs, labels.filter(~held_out()), per_class)
    passed = [1 / (1 + F.exp(F.lit(float(c)) - F.col("_dot"))) for c in cuts]
    return (
        score_texts(docs, bare_words, BITS, weights, distinct=True)
        .withColumn("severity", sum(passed[1:], passed[0]))
        .withColumn("grade", sum([(p >= 0.5).cast("int") for p in passed[1:]], (passed[0] >= 0.5).cast("int")))
        .withColumn("toxic", passed[0] >= 0.5)
        .drop("_dot")
    )
