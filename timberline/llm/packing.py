"""Packing texts into token-budget batches inside length buckets of least padding.

Bucket boundaries come from dynamic programming over the histogram of all lengths: the cost of a bucket is what its
members are short of its longest one. The histogram has one entry for each different length, and only it goes to the
driver: k different lengths take k * (k - 1) / 2 words at least, so W words have some sqrt(2 W) of them at most.
Inside a bucket, rows are numbered without a global sort: rows are dealt into chunks by a hash, numbered there, and a
chunk's numbers start where those of the chunks before it end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stash

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Rows of a chunk, on average.
CHUNK_ROWS = 100_000


def token_count(text_col: str = "text"):
    """Words of a text, split at ASCII space characters; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over sorted lengths with the least total padding.

    Divide and conquer over the last bucket's first entry, which rises with the number of entries covered.
    Of equal costs the fewest buckets, then the leftmost cut.
    """
    n = len(lengths)
    if not n:
        return []
    # exact whole numbers: no sum here exceeds the longest length times all rows
    kind = np.int64 if int(lengths[-1]) * sum(map(int, counts)) < 2**62 else object
    lengths, counts = lengths.astype(kind), counts.astype(kind)
    rows = np.r_[np.zeros(1, kind), np.cumsum(counts)]
    total = np.r_[np.zeros(1, kind), np.cumsum(lengths * counts)]
    cost = lengths * rows[1:] - total[1:]
    cuts: list[np.ndarray] = []
    best = (cost[-1], 0)
    for k in range(1, min(buckets, n)):
        new, cut = cost.copy(), np.arange(n)
        stack = [(k, n - 1, k, n - 1)]
        while stack:
            low, high, a, b = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            end = min(mid, b) + 1
            value = cost[a - 1 : end - 1] + lengths[mid] * (rows[mid + 1] - rows[a:end]) - (total[mid + 1] - total[a:end])
            at = int(np.argmin(value))
            new[mid], cut[mid] = value[at], a + at
            stack += [(low, mid - 1, a, a + at), (mid + 1, high, a + at, b)]
        cost = new
        cuts.append(cut)
        if cost[-1] < best[0]:
            best = (cost[-1], k)
    bounds, j = [], n - 1
    for k in range(best[1], 0, -1):
        bounds.append(int(lengths[j]))
        j = cuts[k - 1][j] - 1
    return sorted([*bounds, int(lengths[j])])


def pack(
    rows: DataFrame,
    length_col: str = "n_tokens",
    id_col: str = "doc_id",
    buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds bucket (from 0), padded_length, batch (from 0 inside its bucket) and slot to every row.

    A batch has at most ``budget`` tokens with padding; a row that is longer alone makes its own batch, padded to its
    bucket's bound (``budget // padded_length`` is then taken as 1). Null and negative lengths count as 0; rows of
    length 0 form a bucket's worth of their own bound. All batches of a bucket but its last are full. Rows of equal id
    and length are interchangeable, repeated rows each get a slot. Only lengths are read, so texts may be of any length;
    an empty table gives no rows. Input columns named like an output column give way, all others stay.
    """
    kept = [c for c in rows.columns if c not in ("bucket", "padded_length", "batch", "slot")]
    length = F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long")
    # written once: lengths are counted once, and rows keep their chunk, whatever their ids
    sized = stash(
        rows.select(
            F.struct(*kept).alias("rest"), F.col(id_col).alias("id"), length.alias("length"),
            F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("deal"),
        )
    )
    histogram = sized.groupBy("length").count().toPandas().sort_values("length")
    total = int(histogram["count"].sum())
    bounds = optimal_bounds(histogram["length"].to_numpy(), histogram["count"].to_numpy(), buckets)
    chunk_count = max(1, -(-total // chunk_rows))
    bucket, padded = F.lit(0), F.lit(bounds[0] if bounds else 0).cast("long")
    for k, bound in enumerate(bounds[:-1]):
        bucket = F.when(F.col("length") > bound, k + 1).otherwise(bucket)
        padded = F.when(F.col("length") > bound, F.lit(bounds[k + 1]).cast("long")).otherwise(padded)
    dealt = sized.select("*", bucket.alias("bucket"), padded.alias("padded_length"), F.pmod("deal", F.lit(chunk_count)).cast("int").alias("chunk"))
    sums = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket and chunk: at most buckets * (rows / chunk_rows + 1)
    starts = dealt.groupBy("bucket", "chunk").count().select("bucket", "chunk", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "chunk").orderBy("id", "length", "deal")
    numbered = dealt.withColumn("row", F.row_number().over(inside) - 1).join(starts, ["bucket", "chunk"])
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1)))).cast("long")
    place = F.col("start") + F.col("row")
    return numbered.select(
        "rest.*", "bucket", "padded_length", F.floor(place / room).cast("long").alias("batch"), (place % room).cast("long").alias("slot")
    )
