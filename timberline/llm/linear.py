"""Sparse linear models over hashed text features, trained with follow-the-regularised-leader updates.

The training sample is bounded (a parameter of each operator); its feature rows are made on the executors and
fitted on the driver. Scoring covers every text on the executors, as sums of weights over feature buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, chunks

#: Features of some texts: the row and the bucket of each occurrence.
Features = Callable[[Words, int], tuple[np.ndarray, np.ndarray]]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ftrl:
    """Per-coordinate FTRL-proximal for sparse rows; ``gradient(score)`` gives a row's slope at its score."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, values: np.ndarray, gradient: Callable[[float], float]) -> None:
        w = self.weights(at)
        g = gradient(float(w @ values)) * values
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, label of at most ``per_class`` ids for either label, those with the least hash; one row an id.

    Labels other than 0 and 1, and ids with both, take no part.
    """
    one = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    one = one.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    one = one.withColumn("order", F.xxhash64(F.lit("sample"), "doc_id")).drop("most")
    chosen = None
    for k in (0, 1):
        part = one.filter(F.col("label") == k).orderBy("order", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * per_class short rows are broadcast; of an id's texts, the one of least hash is taken
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())).alias("text"))


def feature_rows(sample: DataFrame, features: Features, bits: int) -> list:
    """label, buckets, counts of every row of a bounded sample, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in chunks(batch.column("text")):
                doc, bucket = features(words, bits)
                key, count = np.unique((doc.astype(np.int64) << 32) | bucket.astype(np.int64), return_counts=True)
                edges = np.searchsorted(key >> 32, np.arange(last - first + 1)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(v.astype(np.int32)))
                    for v in (key & 0xFFFFFFFF, count)
                ]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), *lists], ["doc_id", "label", "buckets", "counts"]
                )

    id_type = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "label", "text").mapInArrow(
        run, f"doc_id {id_type}, label int, buckets array<int>, counts array<int>"
    )
    table = rows.toArrow().sort_by("doc_id").combine_chunks()
    out = []
    for i in range(table.num_rows):
        out.append(
            (
                table.column("label")[i].as_py(),
                np.asarray(table.column("buckets")[i].values),
                np.asarray(table.column("counts")[i].values, dtype=np.float64),
            )
        )
    return out


def score_texts(
    docs: DataFrame,
    features: Features,
    bits: int,
    weights: np.ndarray,
    column: str = "_dot",
    scale: Callable[[Words, np.ndarray], np.ndarray] | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Adds the dot product of each text's features with ``weights``; ``distinct`` counts a bucket once a text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = [np.zeros(0)]
            for first, last, words in chunks(batch.column("text")):
                doc, bucket = features(words, bits)
                each = shared.value[bucket]
                used = np.flatnonzero(each)
                doc, bucket, each = doc[used], bucket[used], each[used]
                if distinct:
                    _, used = np.unique((doc.astype(np.int64) << 32) | bucket.astype(np.int64), return_index=True)
                    doc, each = doc[used], each[used]
                dot = np.bincount(doc, each.astype(np.float64), minlength=last - first)
                dots.append(scale(words, dot) if scale else dot)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(dots))], [*batch.schema.names, "dot"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    packed = docs.select(F.struct(*names).alias("rest"), "text")
    schema = StructType([*packed.schema.fields, StructField("dot", DoubleType())])
    return packed.mapInArrow(run, schema).select("rest.*", "text", F.col("dot").alias(column))


def held_out(id_col: str = "doc_id"):
    """True for the third of ids that no model here learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
