"""Groups of rows inside Arrow tasks, and connected components by shuffles alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stash


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of equal keys, one table at a time, of a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in keys)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            c = batch.column(k)
            c = c.fill_null(-1) if c.null_count else c
            values = c.to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
        new[0] = bool(held) and key(held[-1], held[-1].num_rows - 1) != key(batch, 0)
        first = 0
        for cut in np.flatnonzero(new).tolist():
            if cut > first:
                held.append(batch.slice(first, cut - first))
            if held:
                yield pa.Table.from_batches(held)
                held = []
            first = cut
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of ``edges`` (columns a and b).

    Alternates large-star and small-star steps until the edges no longer change; each step is an aggregate and a
    join, and is written to the shared folder. Nodes must compare by ``<``; loops and repeated edges do no harm.
    """
    now = stash(_directed(edges.filter("a != b")))
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(both.groupBy("a").agg(F.min("b").alias("least")), "a").filter("b > a")
        large = _directed(large.select(F.col("b").alias("a"), F.least("a", "least").alias("b")))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("least")), "a")
        small = small.select("a", F.col("least").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("least").alias("b")))
        now = stash(_directed(small))
        sign = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == before:
            break
        before = sign
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from its greater node a to its lesser node b."""
    return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
