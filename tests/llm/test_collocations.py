import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from timberline.llm import collocations as module
from timberline.llm.collocations import burst, collocations, decoded, encoded

SCHEMA = "doc_id long, text string, lang string, n long"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    if 100 * a >= 80 * found[p[i : i + n]]:
                        dropped.add(p[i : i + n])
        rows = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def texts(seed, n, vocabulary):
    rng = random.Random(seed)
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(2, 6))] for _ in range(8)]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.3:
                parts[-1:] = [parts[-1] + rng.choice(".,;:!?\n\x0b\r\x0c")]
        yield "".join(w + rng.choice([" ", " ", "\t ", "  "]) for w in parts)


@pytest.mark.parametrize("buffer, hot", [(1 << 20, 256), (50, 3), (50, 1000)])
@pytest.mark.parametrize("vocabulary", [["a"], ["a", "B", "b"], [f"Wörd{i}" for i in range(25)]])
def test_phrases_match_brute_force(spark, vocabulary, buffer, hot, monkeypatch):
    monkeypatch.setattr(module, "BUFFER", buffer)
    monkeypatch.setattr(module, "HOT", hot)  # with 1000, most words are hot and prefixes have several words
    langs = ["en", "de", None, "und", ""]
    rows = [(t, langs[i % 5]) for i, t in enumerate(texts(len(vocabulary), 120, vocabulary))]
    rows += [(None, "en"), ("", None), ("...", "de"), ("same words here again " * 3, "en"), ("same words here again " * 3, "en")]
    docs = spark.createDataFrame([(i, *row, 1) for i, row in enumerate(rows)], SCHEMA).repartition(3)
    for least, top in ((3, 2000), (4, 7)):
        got = collocations(docs, least=least, top=top)
        assert tuple(got.columns) == COLUMNS
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, top)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, 1), (2, " ", "en", 1)], SCHEMA)).count() == 0


def test_very_long_text(spark):
    text = "the same few words go on " * 50_000
    rows = [(text, "en"), ("x", "en")]
    docs = spark.createDataFrame([(i, *row, 1) for i, row in enumerate(rows)], SCHEMA)
    assert sorted(tuple(r) for r in collocations(docs).collect()) == brute(rows, 30, 2000)


def test_scores_beyond_64_bits(spark):
    """The same expression that scores phrases, over counts that no test table can have."""
    score = "CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"
    a, l, r = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 9_200_000_000_000_000_000
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(score).first()[0] == 2_000_000 * a // (l + r)


def test_runs_come_back():
    rng = np.random.default_rng(1)
    for n, words, most in ((0, 1, 1), (1, 5, 3), (500, 40, 200), (90_000, 80_000, 2**40)):
        windows = np.sort(rng.integers(0, 2**63, words).astype(np.uint64))[rng.integers(0, words, (n, 4))]
        windows = windows[np.lexsort(windows.T[::-1])]
        counts = rng.integers(1, most + 1, n)
        ids, places, back = decoded(encoded(windows, counts))
        assert (ids[places] == windows).all() and (back == counts).all()


def test_containers_burst_only_where_phrases_can_be_frequent():
    windows = np.array([[1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 6, 0], [7, 8, 9, 0]])
    counts = np.array([2, 1, 1, 1])
    got = {tuple(p): t for phrases, total in burst(windows, counts, np.zeros(10, bool), 3) for p, t in zip(phrases.tolist(), total.tolist())}
    assert got == {(1, 2, 0, 0): 4, (1, 2, 3, 0): 3}
    hot = np.zeros(10, bool)
    hot[[7, 8]] = True
    got = {tuple(p): t for phrases, total in burst(windows, counts, hot, 3) for p, t in zip(phrases.tolist(), total.tolist())}
    assert got == {(1, 2, 0, 0): 4, (1, 2, 3, 0): 3, (7, 8, 0, 0): 1}
    got = {tuple(p): t for phrases, total in burst(windows, counts, np.zeros(10, bool), 3, 3) for p, t in zip(phrases.tolist(), total.tolist())}
    assert got == {(1, 2, 3, 0): 3}
