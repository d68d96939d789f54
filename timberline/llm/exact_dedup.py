"""Exact deduplication that no large group of copies can stall.

Three combining steps, each of which compares whole contents beside their SHA-256 digests:

1. within each input task, equal texts become one row (the partial aggregation before the first shuffle);
2. rows are dealt by digest and salt, so that a group of copies is spread over ``salts`` tasks and sends at
   most one row from each input task;
3. the salts' winners, at most ``salts`` rows a text, are combined into one winner a text.

Documents then learn their winner by digest: those of the hottest texts, of which there is a proven few, from a
broadcast table, all others by a join in which no key has more than a thousandth of the rows. A digest that stands for several contents (``variants`` over 1)
is told apart by the content itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stash

SALTS = 16
#: Texts with more than one in HOT of all rows are looked up by broadcast; there are fewer than HOT of them.
HOT = 1000


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per different text: digest, content, keep_id, group_size."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("content"),
    ).withColumn("digest", F.sha2(F.col("content"), 256))
    salted = (
        rows.groupBy("digest", "content", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    # by digest alone, at most ``salts`` rows a text, so that the variants of a digest meet as well
    return salted.repartition("digest").groupBy("digest", "content").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row of ``docs`` (its other columns stay).

    Null texts count as empty. The largest id stays; a null id stays only where the group has no other
    (keep_id is then null). Of rows that repeat the largest id with one text all are marked kept, as they
    cannot be told apart. Texts of any length are compared whole, by digest and then by content. Empty input gives an empty result. Input columns named like an output column, or
    starting with ``_dedup``, give way to the result.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c not in (id_col, text_col) and (c in added or c.startswith("_dedup"))])
    found = stash(
        winners(docs, id_col, text_col, salts).select(
            F.col("digest").alias("_dedup_digest"), "keep_id", "group_size",
            # only a digest of several contents needs the content again
            F.count(F.lit(1)).over(Window.partitionBy("digest")).alias("_dedup_variants"), F.col("content").alias("_dedup_content"),
        ).withColumn("_dedup_content", F.when(F.col("_dedup_variants") > 1, F.col("_dedup_content")))
    )
    rows = docs.withColumn("_dedup_digest", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    total = found.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    # a text with more than a HOT-th of all rows: there are fewer than HOT of them, so that they can be broadcast
    is_hot = F.col("_dedup_variants") == 1 if total < HOT else (F.col("_dedup_variants") == 1) & (F.col("group_size") * HOT > total)
    hot, cold = found.filter(is_hot).drop("_dedup_content"), found.filter(~is_hot)
    out = rows.join(F.broadcast(hot), "_dedup_digest")
    rows = rows.join(F.broadcast(hot.select("_dedup_digest")), "_dedup_digest", "left_anti")
    out = out.unionByName(rows.join(cold.filter("_dedup_variants = 1").drop("_dedup_content"), "_dedup_digest"))
    twins = cold.filter("_dedup_variants > 1")
    if not twins.isEmpty():
        out = out.unionByName(
            rows.join(
                twins.withColumnRenamed("_dedup_digest", "_dedup_other"),
                (F.col("_dedup_digest") == F.col("_dedup_other"))
                & (F.coalesce(F.col(text_col), F.lit("")) == F.col("_dedup_content")),
            ).drop("_dedup_other", "_dedup_content")
        )
    return (
        out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
        .withColumnRenamed("_dedup_digest", "text_sha256")
        .drop("_dedup_variants")
    )
