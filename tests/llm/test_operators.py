import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from timberline.llm import queries
from timberline.llm.jaccard_join import ngram_jaccard_join, one_of_each_class
from timberline.llm.packing import optimal_bounds, pack
from timberline.llm.pieces import decode_pieces, encode_pieces
from timberline.llm.quality import quality_scores
from timberline.llm.toxicity import toxicity
from timberline.llm.vectors import nearest

DOCS = "doc_id long, text string, score string, ids string, class_id string"


def brute_bounds(lengths, counts, buckets):
    best = None
    n = len(lengths)

    def cuts(start, left):
        if left == 1:
            yield [n - 1]
            return
        for end in range(start, n - left + 1):
            for rest in cuts(end + 1, left - 1):
                yield [end, *rest]

    for k in range(1, min(buckets, n) + 1):
        for ends in cuts(0, k):
            cost, j = 0, 0
            for e in ends:
                cost += sum((lengths[e] - lengths[i]) * counts[i] for i in range(j, e + 1))
                j = e + 1
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
    counts = [rng.randint(1, 20) for _ in lengths]
    k = rng.randint(1, 5)
    bounds = optimal_bounds(np.array(lengths), np.array(counts), k)
    cost = sum((min(b for b in bounds if b >= x) - x) * c for x, c in zip(lengths, counts))
    assert len(bounds) <= k and cost == brute_bounds(lengths, counts, k)


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i if i % 50 else None, rng.choice([None, 0, -4, 7, 7, 30, 1500, 90_000, rng.randint(1, 400)]), "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long, batch string")
    got = pack(docs, budget=2000, buckets=4, chunk_rows=700).collect()
    assert len(got) == len(rows)
    by_batch = defaultdict(list)
    for r in got:
        assert r.padded_length >= max(r.n_tokens or 0, 0)
        by_batch[r.bucket, r.batch].append(r)
    last = {b: max(k for c, k in by_batch if c == b) for b, _ in by_batch}
    for (bucket, batch), members in by_batch.items():
        room = max(1, 2000 // max(members[0].padded_length, 1))
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) == room or (batch == last[bucket] and len(members) <= room)
    assert pack(docs.limit(0)).collect() == []


def test_packing_of_long_texts_is_exact(spark):
    lengths = {1000: 3, 1025: 9, 1031: 1, 2590: 4, 2593: 2, 6001: 5, 6013: 1, 20_020: 1}
    docs = spark.createDataFrame([(k, n) for k, n in enumerate(n for n, c in lengths.items() for _ in range(c))], "doc_id long, n_tokens long")
    got = pack(docs, buckets=4).collect()
    assert sum(r.padded_length - r.n_tokens for r in got) == brute_bounds(list(lengths), list(lengths.values()), 4)
    assert all(r.padded_length == max(o.n_tokens for o in got if o.bucket == r.bucket) for r in got)


def test_bounds_of_many_lengths_and_large_counts():
    lengths, counts = np.arange(1, 4000) * 7, np.arange(1, 4000) % 97 + 1
    same = optimal_bounds(lengths, counts, 16)
    assert len(same) == 16 and optimal_bounds(lengths, counts.astype(object) * 10**17, 16) == same


def brute_neighbours(vectors, k):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_graph_search_recall_and_cases(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]  # copies
    good = [(i, x[i].tolist()) for i in range(3000)]
    bad = [(20_000, None), (20_020, [0.0] * 16), (20_040, [float("nan")] * 16), (20_060, [None] * 16), (None, x[0].tolist())]
    table = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<float>, score int").repartition(5)
    got = nearest(table, lambda i: i % 20 == 0, k=20, shard_rows=1000).collect()
    want = brute_neighbours(good, 20)
    assert {r.query_id for r in got} == set(want)
    lists = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        lists[r.query_id].append((r.vec_id, r.score))
        assert abs(r.score - float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float))) < 1e-9
    hits = sum(len({i for i, _ in lists[q]} & {i for i, _ in want[q]}) for q in want)
    assert all(len(v) == 20 for v in lists.values()) and hits / (20 * len(want)) > 0.95
    assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for v in lists.values() for a, b in zip(v, v[1:]))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(few, lambda i: i % 20 == 0).collect()] == [(0, 1, 1, 2.0)]
    assert nearest(few.limit(0), lambda i: i % 20 == 0).collect() == []


def test_graph_search_on_given_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute_neighbours([(r.vec_id, r.embedding) for r in rows], 20)
    got = {(r.query_id, r.vec_id) for r in queries.op1_graph_search(spark, sf_dir).collect()}
    assert len(got & {(q, i) for q, v in want.items() for i, _ in v}) / sum(map(len, want.values())) > 0.95


def test_pieces_match_the_library(spark, sf_dir):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = [None, "", " ", "  a  b ", "▁a\n\n\tb", "x" * 3000, " " * 200, "ab" * 400, "🙂漢字é", "<s> </s> <0x0A>"]
    texts += ["".join(rng.choice("aabeinot \n.▁é漢🙂01\r\x00") for _ in range(rng.randint(1, 150))) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(i, t, "s", "i", "c") for i, t in enumerate(texts)], DOCS).repartition(4)
    rows = encode_pieces(docs, queries.piece_model())
    for r in rows.collect():
        want = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == library.decode(want)
    for r in decode_pieces(rows, queries.piece_model()).collect():
        assert r.decoded == library.decode(np.frombuffer(r.ids, "<u4").tolist())


def test_pieces_of_long_runs_repeated_rows_clashing_columns_and_nothing(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    run = "".join(rng.choice("etaoinshrdlu") for _ in range(30_000))  # one word
    schema = "doc_id long, text string, ids string, decoded int, rest string"
    rows = [(1, run, "i", 0, "r")] * 2 + [(None, "a b", None, None, None)]
    got = encode_pieces(spark.createDataFrame(rows, schema), queries.piece_model()).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1] and {r.rest for r in got} == {"r", None}
    for r in got:
        want = library.encode(run if r.doc_id else "a b", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == library.decode(want)
    assert encode_pieces(spark.createDataFrame([], schema), queries.piece_model()).collect() == []


def test_classifiers_keep_rows_and_other_columns(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.limit(3).selectExpr("doc_id", "text", "'x' AS score", "1 AS severity", "2 AS _dot", "3 AS own")
    twice = rows.unionByName(rows)
    for found, column in ((quality_scores(twice, labels), "score"), (toxicity(twice, labels), "severity")):
        got = found.collect()
        assert len(got) == 6 and all(r.own == 3 and isinstance(r[column], float) for r in got)
        assert len({(r.doc_id, r[column]) for r in got}) == 3 and "_dot" not in found.columns
    for empty in (quality_scores(rows.limit(0), labels), toxicity(rows.limit(0), labels)):
        assert empty.collect() == []


def word_grams(text, n=5):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_classes(rows, threshold=0.8):
    sets = [word_grams(t) for _, t in rows]
    different = [s for s in dict.fromkeys(sets) if s]
    links, parent = Counter(), {s: s for s in different}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(different):
        for b in different[:i]:
            if len(a & b) / len(a | b) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return [(i, least.get(root(s)), links[s], sets.count(s)) if s else (i, i, 0, 1) for (i, _), s in zip(rows, sets)]


@pytest.mark.parametrize("block", [1024, 8])
def test_near_copies_match_brute_force(spark, block):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.randint(40, 120))] for _ in range(6)]
    texts = []
    for _ in range(90):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(" ".join(text))
    texts += [" ".join(rng.choice(words) for _ in range(50)) for _ in range(30)] + [None, "", " \n", "a b", "a  b", "a b c"]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (7, texts[8])]
    docs = spark.createDataFrame([(i, t, "s", "i", "c") for i, t in rows], DOCS).repartition(5)
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_jaccard_join(docs, block=block).collect())
    assert got == Counter(brute_classes(rows))
    kept = {r.doc_id for r in one_of_each_class(docs).collect()}
    assert kept == {i for i, c, _, _ in brute_classes(rows) if i == c}
    assert ngram_jaccard_join(docs.limit(0)).collect() == []


def test_near_copies_on_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in queries.op7_ngram_jaccard_join(spark, sf_dir).collect())
    assert got == Counter(brute_classes(rows))


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op3_quality_classifier(spark, folder).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == is_held_out(r.doc_id) for r in rows)
    tried = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in tried) / len(tried) > 0.95


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    tried = [r for r in queries.op5_toxicity(spark, folder).collect() if is_held_out(r.doc_id) and r.doc_id in labels]
    toxic, clean = [r for r in tried if labels[r.doc_id]], [r for r in tried if not labels[r.doc_id]]
    # about an eighth of the toxic labels there are on texts without any toxic word
    assert sum(r.toxic for r in toxic) / len(toxic) > 0.75 and sum(r.toxic for r in clean) / len(clean) < 0.01
    assert all(0 <= r.severity <= 3 and r.toxic == (r.grade > 0) for r in tried)


INSULTS = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron"}


def test_one_insult_is_enough(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op5_toxicity(spark, folder).collect() if labels.get(r.doc_id)]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    one = [r for r in rows if len(INSULTS & {w.strip(string.punctuation).lower() for w in (texts[r.doc_id] or "").split()}) == 1]
    assert len(one) == 8 and sum(r.toxic for r in one) >= 6


def test_toxicity_of_few_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    tried = [r for r in queries.op5_toxicity(spark, folder).collect() if is_held_out(r.doc_id) and r.doc_id in labels]
    toxic, clean = [r for r in tried if labels[r.doc_id]], [r for r in tried if not labels[r.doc_id]]
    assert len(toxic) == 18 and sum(r.toxic for r in toxic) >= 12 and sum(r.toxic for r in clean) / len(clean) < 0.02


def test_classifiers_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "s", "i", "c"), (2, "", "s", "i", "c"), (None, "idiot " * 3, "s", "i", "c"), (3, "x " * 50_000, "s", "i", "c"), (3, "y", "s", "i", "c")], DOCS)
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 1), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        assert len(quality_scores(docs, some).collect()) == 5
        assert len(toxicity(docs, some).collect()) == 5
    assert quality_scores(docs.limit(0), labels).collect() == [] and toxicity(docs.limit(0), labels).collect() == []


def test_merge_order_of_runs_of_spaces():
    """Runs in which each merge makes a pair that ranks as high, alone and among other words."""
    import sentencepiece

    from timberline.llm.pieces import Pieces

    model = queries.piece_model()
    library, pieces = sentencepiece.SentencePieceProcessor(model_proto=model), Pieces(model)
    rng = random.Random(8)
    texts = [" " * n + w for n in (1, 2, 15, 16, 17, 33, 100, 5000) for w in ("", "the", "\n")]
    texts += ["".join(rng.choice(["  ", " " * rng.randint(1, 40), "a", "an", " t", "h", ".", "▁"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    words = [pieces.words(t) for t in texts]
    ids, sizes = pieces.encode_words([w for ws in words for w in ws])
    at, sizes = 0, iter(sizes.tolist())
    for t, ws in zip(texts, words):
        n = sum(next(sizes) for _ in ws)
        assert ids[at : at + n].tolist() == library.encode(t), repr(t)
        at += n


def test_models_of_another_kind_are_refused(monkeypatch):
    from timberline.llm import pieces

    monkeypatch.setattr(pieces.Pieces, "_pair_ranks", lambda self, a, b: (np.full(len(a), pieces.NONE), np.full(len(a), -1)))
    with pytest.raises(ValueError):
        pieces.check_model(queries.piece_model())


def test_graph_search_scores_are_of_the_given_doubles(spark):
    rows = [(0, [1.0, 1e-9]), (1, [1e300, 0.0]), (2, [1e-3, 3.0]), (3, [1.0 + 1e-12, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 1e300), (2, 3, 2.0), (3, 4, 1.0), (4, 2, 1e-3 + 3e-9)]


def test_near_copies_of_long_texts_and_clashing_columns(spark):
    rng = random.Random(1)
    long = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(60_000)]
    near = list(long)
    near[100] = "else"
    rows = [(1, " ".join(long), "x", "y"), (2, " ".join(near), "x", "y"), (3, "x " * 50_000, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, row_hash string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(docs).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    kept = one_of_each_class(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3}
