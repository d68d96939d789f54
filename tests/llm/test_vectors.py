import numpy as np
import pytest

from timberline.llm.vectors import build_graph, nearest, raised


def recall(spark, x, **more):
    """The share of the true 20 nearest that are found, over all queries; scores must be exact."""
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df.repartition(3), lambda i: i % 20 == 0, k=20, **more).collect()
    asks = np.arange(0, len(x), 20)
    scores = x[asks] @ x.T
    scores[np.arange(len(asks)), asks] = -np.inf
    top = [set(np.argsort(-row, kind="stable")[:20].tolist()) for row in scores]
    for r in got:
        assert np.isclose(r.score, x[r.query_id] @ x[r.vec_id], rtol=1e-12, atol=0)
    assert len(got) == 20 * len(asks)
    return sum(r.vec_id in top[r.query_id // 20] for r in got) / len(got)


@pytest.mark.parametrize("kind", ["gaussian", "outlier", "spread", "clustered"])
def test_recall_on_vectors_of_any_shape(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 24))
    if kind == "outlier":  # one vector 10,000 times as long
        x[7] *= 1e4
    if kind == "spread":  # norms over several orders of magnitude
        x *= np.exp(rng.normal(size=(2000, 1)) * 2)
    if kind == "clustered":
        x = rng.normal(size=(20, 24))[rng.integers(0, 20, 2000)] + 0.1 * x
    assert recall(spark, x, shard_rows=1200) >= 0.93


def test_vectors_of_several_dimensions_meet_their_own_kind(spark):
    rows = [(i, [float(i + 1)] * (1 + i % 3)) for i in range(60)] + [(60, [1e300, -1e300]), (61, [1e-300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, lambda i: i % 20 == 0, k=5).collect()
    size = {i: len(v) for i, v in rows}
    assert got and all(size[r.query_id] == size[r.vec_id] for r in got)
    best = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0]
    assert best == [(57, 58.0), (54, 55.0), (51, 52.0), (48, 49.0), (45, 46.0)]


def test_answers_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(9).normal(size=(600, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, nearest(df.repartition(n), lambda i: i % 20 == 0, k=5, shard_rows=250).collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_graphs_keep_to_their_degree():
    graph, entries = build_graph(raised(np.random.default_rng(2).normal(size=(700, 6))), degree=12)
    assert graph.shape == (700, 12) and len(entries) == 16
    for k, row in enumerate(graph):
        there = row[row >= 0]
        assert len(set(there.tolist())) == len(there) and k not in there
