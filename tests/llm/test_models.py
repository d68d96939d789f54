"""The models' scores, worked out once more word by word in plain Python from the learned weights."""

import math
import re
import string

import numpy as np
import pytest

from timberline.llm import linear, quality, queries, toxicity
from timberline.llm.packing import pack, token_count
from timberline.llm.words import BASE, byte_values

FULL = 2**64
FOLDER = "/root/testdata/sf0.001"


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % FULL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % FULL
    return x ^ (x >> 31)


def hashed(values, seed):
    return mixed((sum(int(v) * pow(BASE, i, FULL) for i, v in enumerate(values)) + seed * 0x9E3779B97F4A7C15) % FULL)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def shape(word):
    kinds = [0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b < 128 else 4 for b in word]
    runs = [k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k]
    return hashed([byte_values(11)[k] for k in runs], 11)


def quality_score(text, weights, bias):
    words = words_of(text)
    one = [hashed([byte_values(7, True)[b] for b in w], 7) for w in words]
    form = [shape(w) for w in words]
    grams = one + [mixed((a + 3 * b) % FULL) for a, b in zip(one, one[1:])]
    grams += [mixed(s ^ 101) for s in form] + [mixed((a + 5 * b) % FULL) for a, b in zip(form, form[1:])]
    grams += [mixed(77) for a, b in zip(one, one[1:]) if a == b]
    total = sum(float(weights[g >> (64 - quality.BITS)]) for g in grams)
    return 1 / (1 + math.exp(-(total * quality.SCALE / max(len(grams), 1) + bias)))


def toxic_score(text, weights):
    signs = {b for b in range(33, 127) if chr(b) in string.punctuation}
    buckets = set()
    for w in words_of(text):
        while len(w) > 1 and w[0] in signs:
            w = w[1:]
        while len(w) > 1 and w[-1] in signs:
            w = w[:-1]
        buckets.add(hashed([byte_values(9, True)[b] for b in w], 9) >> (64 - toxicity.BITS))
    return sum(float(weights[b]) for b in buckets)


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter(~linear.held_out())
    short = [r for r in docs.collect() if len(r.text or "") < 4000]
    return docs, labels, short


def test_quality_by_hand(spark, given):
    docs, labels, short = given
    weights, bias = quality.train_quality(docs, labels)
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, FOLDER).collect()}
    assert np.abs(weights).sum() > 0 and len(short) > 50
    for r in short:
        want = quality_score(r.text, weights.astype(np.float32), bias)
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def test_toxicity_by_hand(spark, given):
    docs, labels, short = given
    weights, cuts = toxicity.train_toxicity(docs, labels)
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, FOLDER).collect()}
    assert list(cuts) == sorted(cuts)
    for r in short:
        score = toxic_score(r.text, weights.astype(np.float32))
        passed = [1 / (1 + math.exp(c - score)) for c in cuts]
        assert abs(got[r.doc_id].severity - sum(passed)) < 1e-6
        assert got[r.doc_id].grade == sum(p >= 0.5 for p in passed) and got[r.doc_id].toxic == (passed[0] >= 0.5)


def test_a_repeated_id_gives_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(3000)] + [(2, None), (2, "b")], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    assert linear.labelled_sample(docs, labels, "quality", 10).count() == 2


def least_padding(lengths, buckets):
    """By the textbook recurrence over sorted lengths."""
    n = len(lengths)
    total = np.r_[0, np.cumsum(lengths)]
    best = np.array([lengths[j - 1] * j - total[j] if j else 0 for j in range(n + 1)])
    for _ in range(1, buckets):
        best = np.array([0] + [min(best[i] + lengths[j - 1] * (j - i) - (total[j] - total[i]) for i in range(j)) for j in range(1, n + 1)])
    return int(best[n])


def test_packing_query_by_hand(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op2_packing(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.n_tokens == len(words_of(texts[r.doc_id])) for r in rows)
    assert sum(r.padded_length - r.n_tokens for r in rows) == least_padding(sorted(r.n_tokens for r in rows), 16)
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    last = {b: max(k for c, k in batches if c == b) for b, _ in batches}
    for (bucket, batch), members in batches.items():
        room = max(1, 65_536 // max(members[0].padded_length, 1))
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) == room or batch == last[bucket]


def test_packing_of_odd_tables(spark):
    names = ["_length", "_chunk", "_row", "length", "deal", "chunk", "rest", "id", "bucket"]
    rows = [(None if k % 2 else 7, None, *("x" for _ in names)) for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    got = pack(docs.withColumn("n_tokens", token_count()), chunk_rows=300)
    assert set(got.columns) == {"doc_id", "text", "n_tokens", *names, "padded_length", "batch", "slot"}
    assert sorted((r.batch, r.slot) for r in got.collect()) == [(0, k) for k in range(5000)]
    long = spark.createDataFrame([(1, "w " * 200_000), (2, "w")], "doc_id long, text string").withColumn("n_tokens", token_count())
    assert {r.doc_id: (r.n_tokens, r.padded_length) for r in pack(long).collect()} == {1: (200_000, 200_000), 2: (1, 1)}
