import hashlib
import random

import numpy as np
import pytest

from timberline.llm import fingerprints as module
from timberline.llm.fingerprints import BINS, ROOT, edited_likeness, fingerprints, fingerprints_of, likeness, parsed
from timberline.llm.queries import op11_fingerprints
from timberline.llm.words import BASE

MASK = 2**64 - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def brute_levels(text):
    """Phrases of each level as byte ranges, with names made one symbol at a time."""
    symbols, ranges, bits, levels = list(text), [(i, i + 1) for i in range(len(text))], 8, []
    while symbols and (not levels or len(symbols) > 1):
        merged, spans = [], []
        k = 0
        while k < len(symbols):
            n = k
            while n < len(symbols) and symbols[n] == symbols[k]:
                n += 1
            runs = n - k
            merged.append(symbols[k] if runs == 1 else mix(mix((symbols[k] + 0x632BE59BD9B4E019) & MASK) + runs & MASK))
            spans.append((ranges[k][0], ranges[n - 1][1]))
            k = n
        # a level without runs keeps its width
        wide = bits if len(merged) == len(symbols) else 64
        labels = merged
        for turn in range(module.ROUNDS):
            new = []
            for i, x in enumerate(labels):
                before = labels[i - 1] if i else ~x & (2**wide - 1 if turn == 0 else 255)
                place = ((x ^ before) & -(x ^ before)).bit_length() - 1
                new.append(2 * place + (x >> place & 1))
            labels = new
        assert all(a != b for a, b in zip(labels, labels[1:])) and max(labels) < 8
        starts = [0] + [i for i in range(2, len(labels) - 1) if labels[i - 1] < labels[i] > labels[i + 1]]
        symbols, ranges = [], []
        for a, b in zip(starts, [*starts[1:], len(merged)]):
            seed = (11 + len(levels)) * 0x9E3779B97F4A7C15
            total = sum(mix((x + 0x9E3779B97F4A7C15) & MASK) * pow(BASE, i, 2**64) for i, x in enumerate(merged[a:b]))
            symbols.append(mix((total + seed) & MASK))
            ranges.append((spans[a][0], spans[b - 1][1]))
        bits = 64
        levels.append(list(zip(symbols, ranges)))
    return levels


def brute_fingerprint(text):
    levels = brute_levels(text)
    out = list((levels[-1][0][0] if levels else 0).to_bytes(8, "big"))
    for k, bins in enumerate(BINS):
        row = [None] * bins
        for name, _ in levels[k] if k < len(levels) else []:
            value = mix(name ^ 0xD6E8FEB86659FD93)
            at = name % bins
            row[at] = value if row[at] is None else min(row[at], value)
        out += [0 if x is None else 1 + x % 255 for x in row]
    return bytes(out)


def buffers(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts])]


def random_texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "aa", "the", "wörd", "x" * 20, "   ", "日本", "\n", "b1"] + ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60)]
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))).encode() for _ in range(n)] + [b"", b"x", b"xy", b"xxx", b"a" * 500, b"ab" * 300]


@pytest.mark.parametrize("slice_", [1 << 20, 7])
def test_parsing_symbol_by_symbol(slice_, monkeypatch):
    monkeypatch.setattr(module, "SLICE", slice_)
    texts = random_texts(1, 30)
    got = fingerprints_of(*buffers(texts))
    assert [row.tobytes() for row in got] == [brute_fingerprint(x) for x in texts]
    assert got.shape == (len(texts), ROOT + sum(BINS))


def test_equal_substrings_share_interior_phrases_at_any_offset():
    rng = random.Random(3)
    passage = " ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(300)).encode()
    for shift in range(1, 40):
        other = "".join(rng.choices("uvwxyz ", k=shift)).encode() + passage + b" end"
        (_, one), (_, two) = parsed(*buffers([passage])), parsed(*buffers([other]))
        for level in range(len(BINS)):
            a, b = set(one[level][0].tolist()), set(two[level][0].tolist())
            # but for a few phrases at either border
            assert len(a - b) <= 8 and len(a & b) > 0.7 * len(a)


def test_likeness_is_of_shared_phrases():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n)).encode()
    for n in (5, 30, 400, 3000):
        one, two = [text(n) for _ in range(20)], [text(n) for _ in range(20)]
        _, edited = module._edited(one, two)
        a, b, c = (fingerprints_of(*buffers(x)) for x in (one, two, edited))
        assert 0.45 < likeness(a, c).mean() < 0.7 and likeness(a, b).mean() < 0.06
        assert (likeness(a, a) == 1).all()
    none = fingerprints_of(*buffers([b""]))
    assert likeness(none, none) == 1 and likeness(none, a[:1]) == 0


def brute_rows(rows):
    """Of (doc_id, text) rows, in order of id and digest, what the operator gives."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (np.frombuffer(brute_fingerprint(x.encode()), np.uint8)[None] for x in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), round(float(likeness(a, b)[0]), 9), round(float(likeness(a, c)[0]), 9)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def collected(df):
    return sorted(((r.doc_id, *(r[c] for c in COLUMNS[1:5]), round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_rows_in_order_match_brute_force(spark, n):
    texts = [t.decode() for t in random_texts(7, 40)][:n]
    rows = [(i * 3 % 41, t) for i, t in enumerate(texts)]
    if n > 2:
        rows += [(None, "no id"), (None, None), (5, None), (5, ""), *[(6, "same text here")] * 9, (10**15, "日本語のテキスト" * 5)]
    docs = spark.createDataFrame([(i, t, "k", "old") for i, t in rows], "doc_id long, text string, lang string, fingerprint string")
    got = edited_likeness(docs.repartition(3))
    assert collected(got) == brute_rows(rows)
    assert got.columns == ["doc_id", "lang", *COLUMNS[1:]]


def test_long_text_and_fingerprints_of_repeated_rows(spark):
    long = "word and other words " * 60_000
    docs = spark.createDataFrame([(1, long), (2, "x"), (2, "x"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint) for r in fingerprints(docs).collect()}
    assert len(got) == 3 and {len(f) for _, f in got} == {2 * (ROOT + sum(BINS))}
    first = next(r for r in edited_likeness(docs).collect() if r.doc_id == 1)
    assert first.n_chars == len(long) and first.edited_sha256 == hashlib.sha256((long[: len(long) - len(long) // 4] + "x").encode()).hexdigest()


def test_query(spark, sf_dir):
    got = op11_fingerprints(spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    some = sorted(rows)[:12]
    want = {r[0]: r for r in brute_rows(some)}
    for r in got.filter("doc_id < 11").collect():
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == want[r.doc_id][1:4]
    assert got.count() == len(rows)
