import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest

from timberline.llm import prefix_trie as module
from timberline.llm.prefix_trie import prefix_trie
from timberline.llm.queries import ORACLES, op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_nodes(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            pair = (role or "", text or "")
            tie = hashlib.md5((hashlib.md5(pair[0].encode()).hexdigest() + hashlib.md5(pair[1].encode()).hexdigest()).encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, tie), pair))
    own = {c: [p for _, p in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        bytes_ = len(node[-1][1].encode()) if node else 0
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * bytes_
    return Counter(
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def conversations(seed, n, spread):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 12])):
            role = rng.choice(["user", "assistant", None]) if spread > 1 else "user"
            rows.append((c, turn if turn else None, role, rng.choice(["", None, "é" * turn, *(f"text {k}" for k in range(spread))]), "x"))
    return rows


@pytest.mark.parametrize("subtree", [1, 12, 100_000])
@pytest.mark.parametrize("spread", [1, 2, 30])
def test_nodes_match_brute_force(spark, subtree, spread, monkeypatch):
    monkeypatch.setattr(module, "PIECE", 64)  # three ids a piece
    rows = conversations(spread, 60, spread)
    rows += [(1000 + c, t, "user", f"hot {t}", "x") for c in range(40) for t in range(9)]  # copies
    long = 60 if subtree == 100_000 else 3  # Spark peels a heavy node a step
    rows += [(2001, t, "user", f"long {t}", "x") for t in range(5 * long)]  # grows turn by turn
    rows += [(2000 + 5 * k, t, "user", f"long {t}", "x") for k in range(1, 5) for t in range(long * k)]
    rows += [(None, 1, "user", "nobody's", "x"), (-7, 0, "a", "negative", "x"), (-7, 0, "a", "negative", "x"), (-7, 0, None, None, "x")]
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), subtree=subtree)
    assert tuple(got.columns) == COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == brute_nodes(rows)


def test_no_rows_and_no_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "")], SCHEMA)).count() == 0


def test_conversations_without_turns_left_belong_to_the_root(spark):
    ids = [c for c in range(10_000, 10_200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0]
    rows = [(c, 0, "user", "one turn", "") for c in ids]
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(tuple(r) for r in got) == brute_nodes(rows)
    assert [(r.depth, r.n_convs, r.n_leaves) for r in got] == [(0, len(ids), 1)]


def test_very_long_texts_count_as_bytes(spark):
    rows = [(5, 0, "user", "é" * 700_000, ""), (10, 0, "user", "é" * 700_000, "")]
    want = brute_nodes(rows)
    assert Counter(tuple(r) for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_query_matches_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = con.execute(ORACLES["op12_prefix_trie"])
    names = [c[0] for c in found.description]
    want = Counter(tuple(row[names.index(c)] for c in COLUMNS) for row in found.fetchall())
    assert Counter(tuple(r) for r in op12_prefix_trie(spark, sf_dir).select(*COLUMNS).collect()) == want
