import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from timberline.llm import substring_dedup as module
from timberline.llm.exact_dedup import exact_dedup
from timberline.llm.queries import op9_substring_dedup
from timberline.llm.substring_dedup import anchors_of, substring_dedup
from timberline.llm.words import chunks

SCHEMA = "doc_id long, text string, lang string, kept string, spans string"


def brute_substrings(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def random_texts(seed, n, vocabulary):
    rng = random.Random(seed)
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 60))] for _ in range(12)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(passages)) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 50))]
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            words += part
        texts.append("".join(w + rng.choice([" ", "\n", "\t ", " \x0b"]) for w in words))
    return texts


@pytest.mark.parametrize("vocabulary", [["a"], ["a", "b"], [f"wörd{i}" for i in range(40)]])
def test_substrings_match_brute_force(spark, vocabulary, monkeypatch):
    texts = random_texts(len(vocabulary), 60, vocabulary) + ["", None, " \n", "x " * 500, " a b"]
    rows = [(i if i % 9 else None, t, "en", "k", "s") for i, t in enumerate(texts)] + [(1, texts[1], "en", "k", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for window, part in ((35, 500), (12, 2)):
        monkeypatch.setattr(module, "PART", part)
        got = substring_dedup(docs, window=window, anchor=8).collect()
        want = brute_substrings([r[1] for r in rows], window)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == Counter(
            (row[0], *w) for row, w in zip(rows, want)
        )
        assert set(got[0].asDict()) == {"doc_id", "text", "lang", "kept", "spans", "n_words", "n_removed"}


def test_substring_query_on_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute_substrings([r.text for r in rows], 35)
    got = {r.doc_id: r for r in op9_substring_dedup(spark, sf_dir).collect()}
    assert len(got) == len(rows) and sum(w[1] for w in want) > 0
    for row, (n, gone, kept) in zip(rows, want):
        r = got[row.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_substrings_of_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_dedup_cases(spark):
    texts = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, "c" * 200_000), (8, "c" * 200_000), (None, "n"), (None, "a"), (9, "r"), (9, "r")]
    docs = spark.createDataFrame([(i, t, "en", "old", "s") for i, t in texts], SCHEMA).repartition(4)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs).collect())
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    want = Counter()
    for i, t in texts:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert exact_dedup(docs.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [1, 4])
def test_exact_dedup_of_hot_texts(spark, monkeypatch, hot):
    """With texts looked up by broadcast and by join, and columns that pose as the operator's own."""
    from timberline.llm import exact_dedup as module

    monkeypatch.setattr(module, "HOT", hot)
    rows = [(k, "hot" if k % 3 == 0 else f"t{k % 50}", "x", "y") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _dedup_digest string, kept string").repartition(6)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()}
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(t, []).append(i)
    assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t, _, _ in rows}


def test_exact_dedup_tells_contents_of_one_digest_apart(spark, monkeypatch):
    from timberline.llm import exact_dedup as module

    class Weak:
        def __getattr__(self, name):
            return getattr(module_f, name)

        def sha2(self, column, bits):
            return module_f.lit("same")

    module_f = module.F
    monkeypatch.setattr(module, "F", Weak())
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(["a", "b", "a", None, ""])], SCHEMA)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs).collect()}
    assert got == {0: (2, 2), 2: (2, 2), 1: (1, 1), 3: (4, 2), 4: (4, 2)}


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_anchors_in_pieces(monkeypatch, piece):
    rng = random.Random(piece)
    texts = [" ".join(rng.choices("abc", k=k)) for k in (0, 34, 35, 300, 36, 1000)] + ["x " * 200]
    (_, _, words), = chunks(pa.array(texts))
    whole = anchors_of(words, 35, 8)
    monkeypatch.setattr(module, "PIECE", piece)
    assert len(whole[0]) and all(np.array_equal(a, b) for a, b in zip(whole, anchors_of(words, 35, 8), strict=True))


def test_factors_reach_as_far_as_they_match():
    block = np.array([[0, 1, 2, 3, 4, 5, 6, 0], [9, 1, 2, 3, 4, 8, 6, 7], [1, 1, 1, 1, 1, 1, 1, 1]], np.uint64)
    begin, length = module.factors_of(block, block[[0, 0, 0]], 3)
    assert begin.tolist() == [1, 1, 3] and length.tolist() == [6, 4, 0]


def test_long_texts_and_clashing_columns(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    long = " ".join(f"a{k}" for k in range(150_000))
    docs = spark.createDataFrame([(1, long + " " + passage, "1"), (2, passage + " end", "2"), (2, None, "3")], "doc_id long, text string, row_hash string")
    got = {r.row_hash: r for r in substring_dedup(docs).collect()}
    assert got["1"].text == long and got["1"].n_removed == 60 and got["2"].text == "end" and got["3"].text == ""
