import random

import pytest

from timberline.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, lang string, line int, n string"


def brute(rows, threshold):
    order = sorted({(i if i is not None else 2**63 - 1, t or "") for i, t in rows}, key=lambda r: r[0])
    earlier, gone = [], {}
    for i, text in order:
        for k, line in enumerate(text.split("\n")):
            tokens = frozenset(w for w in line.replace("\t", " ").replace("\x0b", " ").replace("\r", " ").split(" ") if w)
            if not tokens:
                continue
            if any(len(tokens & o) / len(tokens | o) >= threshold for o in earlier):
                gone.setdefault((i, text), []).append(k)
            earlier.append(tokens)
    return gone


@pytest.mark.parametrize("seed,vocabulary,threshold", [(1, 6, 0.8), (2, 40, 0.8), (3, 400, 0.8), (4, 40, 0.9)])
def test_lines_match_brute_force(spark, seed, vocabulary, threshold):
    rng = random.Random(seed)
    words = [f"wörd{i}" for i in range(vocabulary)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(base)) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 25))]
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(words)
            rng.shuffle(line)
            lines.append(rng.choice([" ", "\t", " \r"]).join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (None, rows[3][1]), (5, rows[5][1]), (103, " ".join(words) + "\n" + " ".join(words))]
    docs = spark.createDataFrame([(i, t, "en", 1, "n") for i, t in rows], SCHEMA).repartition(5)
    want = brute(rows, threshold)
    got = line_dedup(docs, threshold).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in got:
        text = texts[r.doc_id]
        gone = want.get((r.doc_id if r.doc_id is not None else 2**63 - 1, text), [])
        assert list(r.removed) == gone, (r.doc_id, gone)
        lines = text.split("\n")
        assert r.n_lines == len(lines) and r.text == "\n".join(x for k, x in enumerate(lines) if k not in gone)


def test_no_lines(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_that_a_short_key_would_confuse(spark):
    """Two texts of equal 32-bit hash under one id, and under none."""
    from pyspark.sql import functions as F

    seen, pair, low = {}, None, 0
    while pair is None:
        rows = spark.range(low, low + 200_000).select(F.concat(F.lit("t"), F.col("id")).alias("t")).select("t", F.hash("t").alias("h")).collect()
        low += 200_000
        for r in rows:
            if r.h in seen:
                pair = (seen[r.h], r.t)
                break
            seen[r.h] = r.t
    a, b = pair
    docs = spark.createDataFrame([(1, a), (7, a), (7, b), (None, a), (None, b)], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.text) for r in line_dedup(docs).collect())
    assert got == sorted([(1, a), (7, ""), (7, b), (99, ""), (99, "")])


def test_long_lines_other_columns_and_a_cluster(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    near = long.replace("w17 ", "other ")
    rows = [(1, long), (2, near + "\nnew line"), (3, "\n".join(["x"] * 2000)), (4, None)]
    rows += [(10 + k, f"template of a line with number {k} inside of it and more") for k in range(300)]
    docs = spark.createDataFrame([(i, t, "d", "r", 5) for i, t in rows], "doc_id long, text string, did string, row_hash string, line int")
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert set(got[1].asDict()) == {"doc_id", "text", "did", "row_hash", "line", "n_lines", "removed"} and got[1].did == "d" and got[1].line == 5
    assert got[1].text == long and got[2].text == "new line" and got[3].text == "x" and len(got[3].removed) == 1999 and got[4].text == ""
    assert got[10].removed == [] and all(got[10 + k].removed == [0] for k in range(1, 300))


def test_all_gaps_part_words(spark):
    """Signs between words count alike in texts that have each of them, alone and beside others; only ASCII ones do."""
    same = [f"one{g}two{g}three" for g in (" ", "\t", "\x0b", "\x0c", "\r", " \t\r")]
    rows = list(enumerate([*same, "one two three", "three\ttwo one\n\t\r\n \x0b", "\x0c"]))
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].removed for k in range(9)] == [[]] + [[0]] * 5 + [[], [0], []]
    assert got[6].text == rows[6][1] and got[7].text == "\t\r\n \x0b" and got[8].text == "\x0c"


def test_only_texts_with_other_gaps_are_translated(spark):
    """translate takes a sign at a time, so most texts must not go through it: it is asked for once, in a branch."""
    from timberline.llm import line_dedup as module

    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = module._lines(module._keyed(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == plan.count("THEN translate(") == 1


def test_long_lines_that_only_share_words_stay_out_of_the_exact_part(spark):
    """Lines of 150 tokens differ in most of 64 bits' slots by chance alone, and would all be read again; one shuffle of
    prefix rows serves both sides."""
    from pyspark.sql import functions as F

    from timberline.llm import line_dedup as module

    rng = random.Random(7)
    lines = [" ".join(f"w{rng.randrange(1500)}" for _ in range(160)) for _ in range(150)]
    near = lines[0].split(" ")
    near[3] = "other"
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*lines, " ".join(near)])], "doc_id long, text string")
    names = F.xxhash64("codes").alias("x"), F.xxhash64(F.lit(1), "codes").alias("y")
    described = module._described(module._lines(module._keyed(docs)), module.rarity(docs), 0.8, module.COARSE)
    assert not described.schema["codes"].dataType.containsNull  # else codes are sorted as objects
    sets = module._sets(described.select(*module.PLACE, *names, "n", *module.COARSE, "prefix"))
    assert sorted(r.did for r in module._partners(sets, 0.8).collect()) == [0, 150]
    tokens = module._tokens(sets, module.COARSE).hint("merge")
    met = tokens.alias("a").join(tokens.alias("b"), module._fits(0.8, module.COARSE) & (F.col("a.number") != F.col("b.number")), "left_semi")
    met = met.select("number")
    met.collect()
    assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()


def test_words_of_long_texts_are_counted_by_line(spark, monkeypatch):
    from timberline.llm import line_dedup as module

    docs = spark.createDataFrame([(1, "a\tb\na c"), (2, None), (3, "")], "doc_id long, text string")
    ranks = [spark.range(1).select(module.rarity(docs).alias("r")).head().r]
    monkeypatch.setattr(module, "LONG", 0)
    ranks.append(spark.range(1).select(module.rarity(docs).alias("r")).head().r)
    assert ranks[0] == ranks[1] and len(ranks[0]) == module.RARITY_SLOTS and sorted(ranks[0])[-2:] == [0, 2]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_rows_of_one_token_meet_by_class_of_size(spark, threshold):
    """Lines of a frequent token meet only those of like size, and no pair that may match is kept apart."""
    from timberline.llm import line_dedup as module

    sizes = [*range(1, 60), 99, 100, 101, 124, 125, 126, 1000, 1250, 10**6]
    rows = [(n, n, [5] * (n - module.math.ceil(threshold * n - 1e-9) + 1 if n < 200 else 1)) for n in sizes]
    lines = spark.createDataFrame(rows, "number long, n int, prefix array<long>")
    plain = [(r.n, r.i) for r in module._tokens(lines, ()).collect()]
    keys = {}
    for r in module._classed(module._tokens(lines, ()), threshold).collect():
        keys.setdefault((r.n, r.most), set()).add(r.token)

    def most(n, i):
        return int((n - i) * (1 + threshold) / threshold - n + 1e-6)

    for n, i in plain:
        for m, k in plain:
            need = (n + m) * threshold / (1 + threshold) - 1e-9
            if n - i >= need and m - k >= need:
                assert keys[n, most(n, i)] & keys[m, most(m, k)], (n, i, m, k)
    assert not keys[10, most(10, 0)] & keys[1000, most(1000, 0)]


def test_hashes_are_not_kept_after_use(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e"), (2, "c b a\nx")], "doc_id long, text string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = {r.doc_id: r.removed for r in line_dedup(docs).collect()}
    assert got == {1: [], 2: [0]} and spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_edges_part_tokens_evenly():
    import numpy as np

    from timberline.llm import line_dedup as module

    rng = np.random.default_rng(1)
    counts = rng.zipf(1.3, module.RARITY_SLOTS).clip(0, 10**6)
    mass = np.bincount(module._ranks(counts), weights=counts, minlength=64) / counts.sum()
    edges = module._edges(counts, 4)
    below = [mass[: e >> 57].sum() + mass[e >> 57] * (e % 2**57) / 2**57 for e in edges]
    assert np.allclose(below, [0.25, 0.5, 0.75], atol=0.01)
    empty = module._edges(np.zeros(module.RARITY_SLOTS, np.int64), 4)
    assert empty[0] < empty[1] < empty[2]
