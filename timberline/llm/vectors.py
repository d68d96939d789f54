"""Approximate nearest neighbours by largest inner product, on robust-pruned directed graphs.

Equal vectors are one node. Nodes are dealt, by a hash of the vector, into shards of about ``shard_rows`` in which all
norms are within a factor of two, so that no long vector hides the differences between short ones; a task builds a
shard's graph:
batches of nodes search the graph so far greedily, what they visit is proposed as neighbours, and relaxed distance
pruning keeps diverse ones (a candidate goes if a kept neighbour is closer to it than 1/ALPHA of its own distance).
Graphs are written once; then each block of queries meets each shard and runs a beam search there, and the shards'
finds are merged. Inner products become distances by one more coordinate that gives all nodes of a shard one norm.

How wide a beam must be depends on the vectors: in each shard, some queries are also answered by all inner products, and
the beam is doubled until RECALL of these answers is found; in the worst case it holds the whole shard. So the answers
depend on the rows alone, not on the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stash

SHARD_ROWS = 8192
#: Share of the true answers that some PROBES queries of a shard and block must find.
RECALL, PROBES = 0.95, 48
#: Components of the queries of a block: the larger a block, the fewer times each shard is read.
QUERY_BLOCK = 1 << 22
DEGREE, BEAM, ALPHA, STEP = 32, 72, 1.2, 4
SEEDS, BATCH = 16, 512


def raised(vectors: np.ndarray) -> np.ndarray:
    """Vectors, scaled to components of at most 1, with a coordinate more, so that all have the largest norm."""
    vectors = scaled(vectors)
    norm = (vectors**2).sum(1)
    rest = np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))
    return np.c_[vectors, rest].astype(np.float32)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Double-precision vectors, all divided by the largest component: what is nearest to what stays the same."""
    vectors = vectors.astype(np.float64)
    return vectors / max(np.abs(vectors).max(initial=0), np.finfo(np.float64).tiny)


def beam_search(graph: np.ndarray, nodes: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes met (-1 where fewer) and their distances, all queries in step."""
    q = len(queries)
    own = (nodes**2).sum(1)
    met = np.zeros((q, len(nodes)), bool)
    ids = np.full((q, beam), -1)
    near = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    row = np.arange(q)[:, None]

    def meet(live: np.ndarray, found: np.ndarray) -> None:
        """Merges found nodes (-1: none) into the beams of some queries."""
        at = live[:, None]
        found = np.sort(found, axis=1)
        fresh = (found >= 0) & ~met[at, found]
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        who, which = np.nonzero(fresh)
        met[live[who], found[who, which]] = True
        found = np.where(fresh, found, -1)
        length = own[found] - 2 * np.einsum("qd,qrd->qr", queries[live], nodes[found])
        length[~fresh] = np.inf
        all_ids, all_near = np.c_[ids[live], found], np.c_[near[live], length]
        all_done = np.c_[done[live], ~fresh]
        best = np.argpartition(all_near, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(all_near, best, 1), axis=1, kind="stable"), 1)
        ids[live], near[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_near, all_done))

    meet(np.arange(q), np.tile(entries, (q, 1)))
    while True:
        live = np.flatnonzero((~done).any(1))
        if not len(live):
            return np.where(np.isfinite(near), ids, -1), near
        open_ = np.argsort(done[live], axis=1, kind="stable")[:, :STEP]  # the nearest that are not expanded
        chosen = np.take_along_axis(ids[live], open_, 1)
        spent = np.take_along_axis(done[live], open_, 1)
        done[live[:, None], open_] = True
        around = graph[chosen]
        around[spent] = -1
        meet(live, around.reshape(len(live), -1))


def robust_prune(nodes: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each point, nearest first, out of its candidates (-1: none)."""
    candidates = np.sort(candidates, axis=1)
    bad = (candidates < 0) | (candidates == points[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    spot = nodes[candidates]
    length = ((spot - nodes[points][:, None, :]) ** 2).sum(2)
    length[bad] = np.inf
    out = np.full((len(points), degree), -1)
    row = np.arange(len(points))
    for k in range(degree):
        best = length.argmin(1)
        live = np.isfinite(length[row, best])
        if not live.any():
            break
        out[live, k] = candidates[row[live], best[live]]
        between = ((spot - spot[row, best][:, None, :]) ** 2).sum(2)
        length[(alpha * alpha * between <= length) & live[:, None]] = np.inf
        length[row, best] = np.inf
    return out


def build_graph(nodes: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each node (-1: none) and the nodes that searches start from."""
    n = len(nodes)
    rng = np.random.default_rng(41)
    centre = int(((nodes - nodes.mean(0)) ** 2).sum(1).argmin())
    order = rng.permutation(n)
    order = np.r_[centre, order[order != centre]]
    entries = order[: min(SEEDS, n)]
    graph = np.full((n, degree), -1)

    def join(points: np.ndarray, candidates: np.ndarray) -> None:
        graph[points] = robust_prune(nodes, points, candidates, degree, alpha)
        source = np.repeat(points, degree)
        target = graph[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        who, first, many = np.unique(target, return_index=True, return_counts=True)
        # of many that point to one node in a batch, as many as it may have neighbours are proposed
        place = np.arange(len(target)) - np.repeat(first, many)
        back = np.full((len(who), degree), -1)
        keep = place < degree
        back[np.repeat(np.arange(len(who)), many)[keep], place[keep]] = source[keep]
        for low in range(0, len(who), BATCH):
            part = slice(low, low + BATCH)
            both = np.c_[graph[who[part]], back[part]]
            graph[who[part]] = robust_prune(nodes, who[part], both, degree, alpha)

    first = order[: min(n, BATCH)]
    join(first, np.tile(first, (len(first), 1)))
    low = len(first)
    while low < n:
        points = order[low : low + min(low, BATCH)]
        found, _ = beam_search(graph, nodes, nodes[points], entries, beam)
        join(points, np.c_[found, graph[points]])
        low += len(points)
    return graph, entries


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    nodes = raised(_matrix(table.column("vector"), np.float64))
    graph, entries = build_graph(nodes)
    start = np.zeros(len(nodes), bool)
    start[entries] = True
    edges = pa.ListArray.from_arrays(pa.array(np.arange(0, graph.size + 1, graph.shape[1], dtype=np.int32)), pa.array(graph.ravel().astype(np.int32)))
    return pa.table(
        {
            "dims": table.column("dims"),
            "layer": table.column("layer"),
            "shard": table.column("shard"),
            "node": table.column("node"),
            "place": pa.array(np.arange(len(nodes), dtype=np.int32)),
            "start": pa.array(start),
            "vector": table.column("vector"),
            "edges": edges,
        }
    )


def _wide_enough(vectors: np.ndarray, asks: np.ndarray, ask, k: int) -> int:
    """The beam at which probes among the queries find RECALL of the ``k`` greatest inner products."""
    probes = np.unique(np.linspace(0, len(asks) - 1, PROBES).astype(np.int64))
    most, n = min(k, len(vectors)), len(vectors)
    true = -np.sort(-(asks[probes] @ vectors.T), axis=1)[:, most - 1]
    beam = min(max(BEAM, k), max(n, k))
    while beam < n:
        _, exact = ask(probes, beam)
        # found are those at least as near as the last of the true ones, rounding aside
        hits = (exact[:, :most] >= true[:, None] - 1e-9 * np.abs(true[:, None])).sum()
        if hits >= RECALL * most * len(probes):
            break
        beam = min(2 * beam, n)
    return beam


def _layer(vector: str = "vector"):
    """The whole part of the norm's logarithm to base 2, for components of any size."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return F.floor(F.log2(most) + F.log2(F.aggregate(F.transform(vector, lambda x: (x / most) * (x / most)), F.lit(0.0), lambda a, x: a + x)) / 2).cast("int")


def _search(k: int):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        query, found, score = [], [], []
        if shard.num_rows and asked.num_rows:
            shard = shard.sort_by("place")
            vectors = _matrix(shard.column("vector"), np.float64)
            nodes, graph = raised(vectors), _matrix(shard.column("edges"), np.int64)
            entries = np.flatnonzero(shard.column("start").to_numpy())
            names, asks = shard.column("node").to_numpy(), _matrix(asked.column("vector"), np.float64)
            ids = asked.column("query").to_numpy()
            # a query's length does not matter to what is nearest to it
            plain = np.stack([scaled(x) for x in asks])
            plain /= np.sqrt((plain**2).sum(1, keepdims=True))
            plain = np.c_[plain, np.zeros(len(plain))].astype(np.float32)

            def ask(which: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
                at, _ = beam_search(graph, nodes, plain[which], entries, beam)
                exact = np.stack([(vectors[a] * x).sum(1) for a, x in zip(at, asks[which])])
                exact[at < 0] = -np.inf
                best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                return np.take_along_axis(at, best, 1), np.take_along_axis(exact, best, 1)

            beam = _wide_enough(vectors, asks, ask, k)
            for low in range(0, len(asks), BATCH):
                at, exact = ask(np.arange(low, min(low + BATCH, len(asks))), beam)
                there = at >= 0
                query.append(np.repeat(ids[low : low + BATCH], there.sum(1)))
                found.append(names[at[there]])
                score.append(exact[there])
        return pa.table(
            {
                "query": pa.array(np.concatenate(query) if query else [], pa.int64()),
                "node": pa.array(np.concatenate(found) if found else [], pa.int64()),
                "score": pa.array(np.concatenate(score) if score else [], pa.float64()),
            }
        )

    return run


def usable(vector: str = "embedding"):
    """Vectors that are not null, have no null or non-finite component, and are not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of largest inner product found for each query row.

    Queries are the usable rows for which ``is_query`` (a condition on the id) holds; candidates are all usable rows
    but those of the query's own id. Scores are exact inner products in double precision; ties go to the lesser id.
    Rows with a null id or an unusable vector take no part; vectors are compared with those of their own length;
    repeated rows count once. An id with several vectors asks with all of them, and is found once, with its best score.
    Vectors are searched as single-precision copies, scaled so that none overflows; the copies have no part in scores.
    Vectors of very different lengths are in shards of their own; vectors without any structure take wider beams.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector")
    )
    rows = rows.withColumn("asks", F.coalesce(is_query(F.col("id")), F.lit(False)))
    # of equal vectors, the least k + 1 ids can be among the answers
    by_vector = Window.partitionBy("vector").orderBy("id")
    least = rows.dropDuplicates(["id", "vector"]).withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1)
    copies = least.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("node"))
    asked = rows.filter("asks").select("vector").distinct().withColumn("asks", F.lit(True))
    nodes = stash(
        copies.join(asked, "vector", "left")
        .withColumn("node", F.monotonically_increasing_id())
        .withColumns({"dims": F.size("vector"), "layer": _layer()})
    )
    asking = nodes.agg(F.coalesce(F.sum(F.when(F.col("asks"), F.col("dims").cast("long"))), F.lit(0))).first()[0]
    blocks = max(1, -(-asking // QUERY_BLOCK))
    sizes = nodes.groupBy("dims", "layer").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(sizes, ["dims", "layer"]).select("dims", "layer", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int").alias("shard"), "node", "vector")
    graphs = stash(
        dealt.groupBy("dims", "layer", "shard").applyInArrow(
            _build,
            "dims int, layer int, shard int, node bigint, place int, start boolean, vector array<double>, edges array<int>",
        )
    )
    meeting = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # every query meets every shard of its number of dimensions
    shards = graphs.select(F.col("dims").alias("of"), F.col("layer").alias("l"), F.col("shard").alias("s")).distinct()
    asking = nodes.filter("asks").select(
        "dims", F.col("node").alias("query"), "vector", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    )
    asking = asking.join(shards, F.col("dims") == F.col("of")).select("dims", F.col("l").alias("layer"), F.col("s").alias("shard"), "block", "query", "vector")
    keys = ["dims", "layer", "shard", "block"]
    found = meeting.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(
        _search(k + 1), "query bigint, node bigint, score double"
    )
    nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    answers = (
        found.join(nodes.select("node", "ids"), "node")
        .select("query", "score", F.explode("ids").alias("id"))
        .withColumn("n", F.row_number().over(nearest_first))
        .filter(F.col("n") <= k + 1)
        .select("query", "score", "id")
    )
    whose = rows.filter("asks").select("id", "vector").distinct().join(
        nodes.filter("asks").select("vector", F.col("node").alias("query")), "vector"
    ).select(F.col("id").alias("query_id"), "query")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        whose.join(answers, "query")
        .filter("query_id != id")
        .groupBy("query_id", "id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(ranked).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
