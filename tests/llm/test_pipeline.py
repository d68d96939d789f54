import corpus_pipeline
from tests.llm.test_dedup import brute_substrings
from tests.llm.test_operators import brute_classes


def test_stages_follow_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(corpus_pipeline.stash(stage(spark, steps[-1], sf_dir)))
        assert steps[-1].columns == docs.columns
    clean, whole, apart, cut = ({r.doc_id: r for r in s.collect()} for s in steps[1:])
    last = {}
    for i, r in clean.items():
        last[r.text or ""] = max(i, last.get(r.text or "", i))
    assert set(whole) == set(last.values())
    rows = sorted((i, r.text) for i, r in whole.items())
    assert set(apart) == {i for i, c, _, _ in brute_classes(rows) if i == c}
    texts = sorted((i, r.text) for i, r in apart.items())
    for (i, _), (_, _, kept) in zip(texts, brute_substrings([t for _, t in texts], 35)):
        assert cut[i].text == kept and cut[i].n_chars == len(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, steps[-1], sf_dir).collect()
    assert sorted(r.doc_id for r in packed) == sorted(cut)
    assert all(r.n_tokens == len(cut[r.doc_id].text.split()) and r.padded_length >= r.n_tokens for r in packed)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and further columns; and no rows at all."""
    passage, six, seven = (" ".join(f"{w}{k}" for k in range(50)) for w in "pqr")
    rows = [
        (1, "some clean words here", "en", "web", 4, "x"), (1, "some clean words here", "en", "web", 4, "x"), (2, None, None, None, None, None), (3, "", "en", "web", 0, "x"),
        (None, "a text without an id", None, None, None, None), (None, "another text without an id", None, None, None, None), (5, "w " * 100_000, "en", "web", 1, "x"),
        (6, passage + " " + six, "en", "web", 1, "x"), (7, seven + " " + passage, "en", "web", 1, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    for k, given in enumerate((rows, [])):
        folder = str(tmp_path / str(k))
        spark.createDataFrame(given, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stash(stage(spark, docs, folder))
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        packed = corpus_pipeline.run(spark, folder).collect()
        if given:
            ids = [r.doc_id for r in packed]
            # empty texts are copies of each other; the greatest id stays, and rows that repeat it
            assert sorted(i for i in ids if i is not None) == [1, 1, 3, 5, 6, 7] and ids.count(None) == 2
            assert {r.doc_id: r.text for r in docs.collect()}[6] == six
        else:
            assert packed == []
