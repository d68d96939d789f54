"""The trie of conversation prefixes, built from its deepest turns upwards by truncation peeling.

A node is a distinct sequence of first turns. Starting at the greatest depth, each step merges the conversations that end
there with the nodes that survive from the step before, emits the merged nodes with what they have gathered, strips the
last turn off each, and groups again: nodes are found and summed in the same pass, and no node is looked at twice.

1. A turn becomes a digest and a length, a conversation a path: the digests of its prefixes, end to end, each made
   from the one before. Texts do not leave the first step.
2. Equal conversations become one path, with their number, least id, and the hash of their ids. Ids are sorted in ranges
   that split large groups, written as text a range at a time, and hashed piece by piece.
3. The turns of the paths below every node are counted. A *subtree* is cut off at each path's shallowest node with at
   most SUBTREE turns below it (or a single path): it is dealt to one task, which peels it from its own deepest
   turn, so that long conversations take no steps of Spark.
4. What is left are few, heavy nodes. Spark peels them depth by depth: one aggregation for each, in which a hot node
   sends one row from each task. The steps are as many as the deepest heavy node has turns.

Paths and turns are compared by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import grouped
from .tables import stash

#: Turns of paths in a subtree that one task peels, at most, unless it is a single path.
SUBTREE = 100_000
#: Bytes of a prefix's digest.
KEY = 16
#: Bytes of ids that go out as one row, at most.
PIECE = 1 << 16
#: The hash where no conversation ends.
NONE = hashlib.sha256().hexdigest()


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and size (UTF-8 bytes of the text) of turns, in order of turn, null first; turns of
    one number in order of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        # digests of equal length, so that no role and text run into each other
        F.unhex(F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))))).alias("digest"),
        F.octet_length(text).cast("long").alias("size"), role.alias("role"), text.alias("text"),
    )
    # the digest of role and text stands for both where turns have one number
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "tie"))
    rows = rows.withColumn("tie", F.col("digest")).drop("role", "text")
    return rows.select("conv_id", number.alias("pos"), "digest", "size")


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from that with the id c - c % 5."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id and its turns (pos, digest, size) in order, for every conversation, also those left without turns."""
    heads = turns.filter("pos <= 8").select(F.col("conv_id").alias("base"), F.col("pos").alias("at"), "digest", "size")
    convs = turns.filter("pos = 1").select("conv_id").withColumn("h", borrowed(F.col("conv_id")))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    taken = convs.join(heads, "base").filter("at <= h").select("conv_id", F.col("at").alias("pos"), "digest", "size")
    own = turns.filter(F.col("pos") > borrowed(F.col("conv_id")))
    turn = F.struct("pos", "digest", "size")
    none = convs.select("conv_id", F.lit(None).cast("struct<pos:int,digest:binary,size:bigint>").alias("turn"))
    rows = taken.select("conv_id", turn.alias("turn")).unionByName(own.select("conv_id", turn.alias("turn"))).unionByName(none)
    # a conversation's own turns and the first ones of another never share a place: those have pos <= h
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def _path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column("turns")
        flat = turns.flatten()
        digests = flat.field("digest").to_pylist()
        sizes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(turns.value_lengths().to_numpy())].astype(np.int32)), flat.field("size"))
        paths, done = [], 0
        for n in turns.value_lengths().to_pylist():
            key, path = bytes(KEY), []
            for digest in digests[done : done + n]:
                key = hashlib.md5(key + digest).digest()
                path.append(key)
            done += n
            paths.append(b"".join(path))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.binary()), sizes], ["conv_id", "path", "sizes"])


def _last(path: str = "path") -> Column:
    """The digest of the whole prefix; 16 zero bytes for the root."""
    return F.when(F.octet_length(path) == 0, F.lit(bytearray(KEY))).otherwise(F.substring(path, -KEY, KEY))


def _stripped(path: str = "path") -> Column:
    return F.expr(f"substring({path}, 1, octet_length({path}) - {KEY})")


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a partition, sorted by key and id, as text, at most PIECE bytes a row."""
    for rows in grouped(batches, ["last"]):
        ids = rows.column("conv_id").to_numpy()
        for a in range(0, len(ids), PIECE // 21):
            part = ids[a : a + PIECE // 21].tolist()
            yield pa.RecordBatch.from_arrays(
                [rows.column("last").combine_chunks().slice(0, 1), pa.array(part[:1], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([",".join(map(str, part))])],
                ["last", "conv_id", "n", "ids"],
            )


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash, number and least of each key's ids, from pieces sorted by key and first id, one after another."""
    now, state, n, least = None, None, 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.array([n], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "n_convs", "ends_sha256"])

    for batch in batches:
        for key, first, count, ids in zip(*(batch.column(c).to_pylist() for c in ("last", "conv_id", "n", "ids"))):
            if key != now:
                if state:
                    yield row()
                now, state, n, least = key, hashlib.sha256(), 0, first
            elif n:
                state.update(b",")
            state.update(ids.encode())
            n += count
    if state:
        yield row()


def _peel(path: list[bytes], sizes: list[np.ndarray], conv: np.ndarray, n: np.ndarray, ends: list[str], cut: int) -> Iterator[tuple]:
    """Nodes of a subtree from the deepest to those of depth ``cut``: depth, path, last size, own columns, parent's id.

    Survivors are held by the digest of their prefix, so that grouping again is one look-up a node.
    """
    ending: dict[int, list[int]] = {}
    for i, p in enumerate(path):
        ending.setdefault(len(p) // KEY, []).append(i)
    depth = max(ending)
    # digest -> [a row whose path it is a prefix of, least id, conversations, children, leaves, saved, hash of ends, node rows of its children]
    below: dict[bytes, list] = {}
    while depth >= cut:
        here: dict[bytes, list] = {}
        at = (depth - 1) * KEY
        for node in below.values():  # survivors, stripped of their last turn
            key = path[node[0]][at : at + KEY]
            found = here.get(key)
            if found is None:
                here[key] = [node[0], node[1], node[2], 1, node[4], node[5], NONE, [node]]
            else:
                found[1] = min(found[1], node[1])
                found[2] += node[2]
                found[3] += 1
                found[4] += node[4]
                found[5] += node[5]
                found[7].append(node)
        for i in ending.get(depth, ()):  # conversations that end here
            key = path[i][at:]
            found = here.get(key)
            if found is None:
                here[key] = [i, int(conv[i]), int(n[i]), 0, 0, 0, ends[i], []]
            else:
                found[1] = min(found[1], int(conv[i]))
                found[2] += int(n[i])
                found[6] = ends[i]
        for node in here.values():
            node[4] = node[4] or 1
            node[5] += (node[2] - 1) * int(sizes[node[0]][depth - 1])
            for child in node[7]:
                yield depth + 1, child, node[1]
            node[7] = None
        below = here
        depth -= 1
    for node in below.values():
        yield cut, node, None


_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, path binary, sizes array<bigint>"


def _subtree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peels each subtree; its top keeps path and sizes for what is peeled above it."""
    for rows in grouped(batches, ["top"]):
        path = rows.column("path").to_pylist()
        sizes = [x.values.to_numpy() for x in rows.column("sizes").combine_chunks()]
        cut = rows.column("cut")[0].as_py()
        found = list(_peel(path, sizes, rows.column("conv_id").to_numpy(), rows.column("n_convs").to_numpy(), rows.column("ends_sha256").to_pylist(), cut))
        top = [depth == cut for depth, _, _ in found]
        columns = [
            pa.array([node[1] for _, node, _ in found], pa.int64()),
            pa.array([depth for depth, _, _ in found], pa.int64()),
            pa.array([parent for _, _, parent in found], pa.int64()),
            *(pa.array([node[k] for _, node, _ in found], pa.int64()) for k in (2, 3, 4, 5)),
            pa.array([node[6] for _, node, _ in found], pa.string()),
            pa.array([path[node[0]][: cut * KEY] if is_top else None for is_top, (_, node, _) in zip(top, found)], pa.binary()),
            pa.array([sizes[node[0]][:cut].tolist() if is_top else None for is_top, (_, node, _) in zip(top, found)], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _NODE.split(", ")])


def paths_of(conversations: DataFrame) -> DataFrame:
    """One row for each distinct rebuilt conversation: path, sizes, n_convs, conv_id (the least), ends_sha256."""
    paths = stash(rebuilt(stash(own_turns(conversations))).mapInArrow(_path_batches, "conv_id bigint, path binary, sizes array<bigint>"))
    ids = paths.select(_last().alias("last"), "conv_id").repartitionByRange("last", "conv_id").sortWithinPartitions("last", "conv_id")
    pieces = ids.mapInArrow(_id_pieces, "last binary, conv_id bigint, n bigint, ids string")
    ends = pieces.repartition("last").sortWithinPartitions("last", "conv_id").mapInArrow(_hash_batches, "conv_id bigint, n_convs bigint, ends_sha256 string")
    return stash(paths.join(ends, "conv_id"))


def prefix_trie(conversations: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first, those of one number by a digest of role and text; null roles and texts
    count as empty. Rows without conv_id belong to no conversation and make no node. Repeated rows are repeated turns.
    A conversation left without turns belongs to the root alone. Texts are taken whole, as digest and length; a
    conversation's digests, 24 bytes a turn, have to fit one row. An empty table has no nodes, not even a root. Columns
    other than conv_id, turn, role and text are not read.
    """
    paths = paths_of(conversations)
    turns = paths.select(
        "conv_id", F.size("sizes").alias("n"), F.posexplode(F.expr(f"transform(sequence(1, size(sizes)), k -> substring(path, (k - 1) * {KEY} + 1, {KEY}))")).alias("k", "key")
    ).filter("n > 0")
    heavy = stash(
        turns.groupBy("key").agg(F.sum("n").alias("turns"), F.count(F.lit(1)).alias("paths")).filter((F.col("turns") > subtree) & (F.col("paths") > 1)).select("key")
    )
    above = turns.join(heavy, "key").groupBy("conv_id").agg(F.max(F.col("k") + 1).alias("above"))
    dealt = paths.join(above, "conv_id", "left").withColumn("cut", F.coalesce("above", F.lit(0)) + 1)
    # paths that end at a heavy node, or without any turn, wait for it; all others are in a subtree
    waiting = stash(dealt.withColumn("n", F.size("sizes")))
    light = waiting.filter("n >= cut").withColumn("top", F.expr(f"substring(path, (cut - 1) * {KEY} + 1, {KEY})"))
    peeled = stash(
        light.select("top", "cut", "path", "sizes", "conv_id", "n_convs", "ends_sha256").repartition("top").sortWithinPartitions("top").mapInArrow(_subtree_batches, _NODE)
    )
    done = [peeled.filter("path is null")]
    tops = peeled.filter("path is not null")
    ended = waiting.filter("n < cut").select("path", "sizes", F.col("n").cast("long").alias("depth"), "conv_id", "n_convs", "ends_sha256")
    deepest = tops.agg(F.max("depth")).first()[0] or 0
    survivors = None
    for depth in range(deepest, -1, -1):
        # conversations that end here, subtrees that begin here, and nodes that survive from the step before
        own = ended.filter(F.col("depth") == depth).select(
            "path", "sizes", "conv_id", "n_convs", F.lit(0).cast("long").alias("n_children"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "ends_sha256"
        )
        if survivors is not None:
            child = survivors.select(
                _stripped().alias("path"), F.slice("sizes", 1, depth).alias("sizes"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                F.lit(None).cast("string").alias("ends_sha256"),
            )
            own = own.unionByName(child)
        merged = own.groupBy("path", "sizes").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
        )
        last = F.coalesce(F.try_element_at("sizes", F.lit(-1)), F.lit(0)) if depth else F.lit(0)
        merged = merged.select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * last).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"), "path", "sizes",
        )
        begun = tops.filter(F.col("depth") == depth).drop("parent_conv_id")
        now = stash(merged.unionByName(begun.select(merged.columns)))
        if survivors is not None:
            done.append(_with_parents(survivors, now))
        survivors = now
    done.append(survivors.withColumn("parent_conv_id", F.lit(None).cast("long")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = done[0].select(columns)
    for part in done[1:]:
        out = out.unionByName(part.select(columns))
    return out


def _with_parents(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    named = parents.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(named, _stripped() == F.col("parent"))
