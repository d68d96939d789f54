"""Near-duplicate texts: Jaccard similarity of word n-gram sets, found by MinHash banding and verified in full.

Texts of equal n-gram sets form a copy class, so copies never meet each other. Each class has MinHash bands, as many
as the target recall needs at the threshold. Classes that share a band meet in its bucket, where their whole n-gram
sets are compared; a pair that shares several buckets counts in the first. A bucket that only repeats another one's
members is left out. Large buckets are cut into blocks and each two blocks meet in a group of their own, so no task
holds more than two blocks; what leaves a group is one row for each class, with its number of links and the root of
its component in the group, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import components, grouped
from .tables import row_key, stash, text_key
from .words import Words, chunks, mix, signed, span_hashes

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
BLOCK = 1024


def choose_bands(threshold: float, recall: float, rows: int = 4) -> tuple[int, int]:
    """Bands and rows of each, so that a pair at the threshold shares a band with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and hash of each different n-gram; a text of 1 to n - 1 words has one gram, all its words."""
    hashes = words.hashes(21)
    first = words.windows(n)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    gram = np.r_[span_hashes(hashes, first, first + n, 22), span_hashes(hashes, words.first[short], words.first[short + 1], 22)]
    doc = np.r_[words.doc[first], short] if len(words) else np.zeros(0, np.int64)
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])][: len(gram)]
    return doc[new], gram[new]


def _signature_batches(n: int, bands: int, rows: int):
    rng = np.random.default_rng(23)
    turn = rng.integers(0, 2**63, (bands, rows, 2), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in chunks(batch.column("text")):
                doc, gram = gram_sets(words, n)
                if not len(doc):
                    continue
                start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                have = doc[start]
                ids = np.empty((len(have), 2), ">u8")
                for k, salt in enumerate((31, 32)):
                    ids[:, k] = np.add.reduceat(mix(gram + np.uint64(salt)), start)
                signs = np.empty((len(have), bands), np.uint64)
                for b in range(bands):
                    sign = np.full(len(have), b + 1, np.uint64)
                    for flip, factor in turn[b]:
                        sign = mix(sign + np.minimum.reduceat((gram ^ flip) * (factor | np.uint64(1)), start))
                    signs[:, b] = sign
                part = batch.slice(first, last - first)
                chosen = pa.array(have)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(chosen),
                        part.column("row_hash").take(chosen),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(have), [None, pa.py_buffer(ids.tobytes())]).cast(pa.binary()),
                        pa.array(np.diff(np.r_[start, len(doc)]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, signs.size + 1, bands, dtype=np.int32)), pa.array(signed(signs.ravel()))),
                    ],
                    ["doc_id", "row_hash", "set_id", "size", "bands"],
                )

    return run


def _set_batches(n: int):
    """The n-gram hashes, packed and sorted, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in chunks(batch.column("text")):
                doc, gram = gram_sets(words, n)
                edge = np.searchsorted(doc, np.arange(last - first + 1))
                packed = [gram[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("set_id"), part.column("buckets"), pa.array(packed, pa.binary())],
                    ["set_id", "buckets", "grams"],
                )

    return run


def links_of(sets: list[np.ndarray], buckets: list[np.ndarray], bucket: int, block: np.ndarray, threshold: float) -> np.ndarray:
    """Which two of some sets are as similar as the threshold, in a matrix, for pairs of this group alone."""
    k = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    different, code = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(k), size.astype(np.int64))
    shared = np.bincount(code, minlength=len(different)) > 1
    code = (np.cumsum(shared) - 1)[code][(kept := shared[code])]
    member = member[kept]
    order = np.argsort(code, kind="stable")
    code, member = code[order], member[order]
    both = np.zeros((k, k), np.float64)
    width = max(64, min(8192, 4_000_000 // k))
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, (low, low + width))
        has = np.zeros((k, width), np.float32)
        has[member[a:b], code[a:b] - low] = 1
        both += has @ has.T
    near = both / np.maximum(size[:, None] + size[None, :] - both, 1) >= threshold
    np.fill_diagonal(near, False)
    if (block != block[0]).any():
        near &= block[:, None] != block[None, :]
    if near.any():  # pairs that share an earlier bucket count there
        earlier = [b[b < bucket] for b in buckets]
        names, code = np.unique(np.concatenate(earlier), return_inverse=True)
        if len(names):
            owner = np.repeat(np.arange(k), [len(b) for b in earlier])
            for low in range(0, len(names), width):
                inside = (code >= low) & (code < low + width)
                has = np.zeros((k, width), np.float32)
                has[owner[inside], code[inside] - low] = 1
                near &= (has @ has.T) == 0
    return near


def roots_of(near: np.ndarray) -> np.ndarray:
    """The first member of each one's component."""
    root = np.arange(len(near))
    while True:
        least = np.minimum(root, np.where(near, root[None, :], len(near)).min(1))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _link_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["bucket", "one", "two"]):
            ids = group.column("set_id").to_pylist()
            first = sorted(dict(zip(ids, range(len(ids)), strict=True)).items())  # repeated rows repeat sets
            at = [i for _, i in first]
            sets = [np.frombuffer(group.column("grams")[i].as_buffer(), np.uint64) for i in at]
            buckets = [np.asarray(group.column("buckets")[i].values) for i in at]
            block = np.array([group.column("block")[i].as_py() for i in at])
            near = links_of(sets, buckets, group.column("bucket")[0].as_py(), block, threshold)
            links, root = near.sum(1), roots_of(near)
            used = np.flatnonzero(links).tolist()
            if used:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([first[i][0] for i in used], pa.binary()),
                        pa.array([first[root[i]][0] for i in used], pa.binary()),
                        pa.array(links[used], pa.int64()),
                    ],
                    ["a", "b", "links"],
                )

    return run


def ngram_jaccard_join(
    docs: DataFrame, threshold: float = THRESHOLD, n: int = GRAM, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_hash (of the text), class_id, n_links, n_copies.

    class_id is the least doc_id of all rows that links connect; n_links counts the other n-gram sets as similar as
    ``threshold``; n_copies counts the rows of equal n-gram set, the row itself included. Words are kept as written.
    Null, empty and blank texts have no n-grams and no links: each is a class of its own (class_id is its doc_id).
    A null doc_id takes part in links, but names a class only where it has no other id. Repeated rows are copies like
    others; columns but doc_id and text are left out. Texts are taken whole: one task holds a text's n-grams, and an
    empty table gives no rows.
    """
    bands, rows = choose_bands(threshold, recall)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(*row_key(), "text")
    signs = stash(
        keyed.mapInArrow(
            _signature_batches(n, bands, rows),
            f"doc_id {id_type}, row_hash binary, set_id binary, size int, bands array<bigint>",
        )
    )
    sets = signs.groupBy("set_id", "bands").agg(
        F.min(F.struct("doc_id", "row_hash")).alias("shown"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies")
    )
    met = sets.select("set_id", F.explode("bands").alias("bucket"))
    h, g = F.xxhash64("set_id"), F.xxhash64("set_id", F.lit(1))
    buckets = (
        met.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("members"), F.bit_xor(h).alias("x"), F.bit_xor(g).alias("y"), F.min(h).alias("z"))
        .filter("members > 1")
        .groupBy("members", "x", "y", "z")
        .agg(F.min("bucket").alias("bucket"))
    )
    members = (
        met.join(buckets.select("bucket", "members"), "bucket")
        .groupBy("set_id")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "members"))).alias("buckets"))
    )
    shown = sets.join(members, "set_id").select("set_id", "buckets", F.col("shown.doc_id").alias("_id"), F.col("shown.row_hash").alias("_hash"))
    grams = keyed.join(
        shown, keyed["doc_id"].eqNullSafe(shown["_id"]) & (keyed["row_hash"] == shown["_hash"])
    ).select("set_id", "buckets", "text").mapInArrow(
        _set_batches(n), "set_id binary, buckets array<struct<bucket: bigint, members: bigint>>, grams binary"
    )
    blocks = F.ceil(F.col("at.members") / block).cast("int")
    dealt = (
        grams.select("set_id", "grams", F.col("buckets.bucket").alias("buckets"), F.explode("buckets").alias("at"))
        .withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(2)), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("set_id", "grams", "buckets", F.col("at.bucket").alias("bucket"), "block",
                F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    )
    links = stash(
        dealt.repartition("bucket", "one", "two")
        .sortWithinPartitions("bucket", "one", "two")
        .mapInArrow(_link_batches(threshold), "a binary, b binary, links bigint")
    )
    rooted = components(links.select("a", "b"))
    counted = links.groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("n_links"))
    named = sets.select("set_id", "least", "n_copies").join(rooted.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.withColumn("root", F.coalesce("root", "set_id"))
    classes = named.join(named.groupBy("root").agg(F.min("least").alias("class_id")), "root").join(counted, "set_id", "left")
    by_row = signs.select("doc_id", "row_hash", "set_id").join(
        classes.select("set_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "set_id"
    ).drop("set_id")
    blank = keyed.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return by_row.unionByName(
        blank.select("doc_id", "row_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    )


def one_of_each_class(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their class; rows that repeat it with the same text all stay."""
    found = ngram_jaccard_join(docs, **settings).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = found.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (text_key("text") == kept["_hash"]), "left_semi")
