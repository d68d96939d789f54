"""Running sums, numbers and percentiles over a whole order, without one task that holds it all.

Rows are range-partitioned by the order; sums run inside each range and start where those of the ranges before end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stash


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each name of ``sums``, the sum of a value up to and with the row, in ``order``, apart for ``keys``.

    The order must be total. Values must not be null.
    """
    ranges = rows.withColumns({f"_v{k}": v for k, v in enumerate(sums.values())}).repartitionByRange(*keys, *order)
    dealt = stash(ranges.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", *keys).agg(*(F.sum(f"_v{k}").alias(f"_t{k}") for k in range(len(sums))))
    # a row for each range and key
    starts = totals.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_k_{c}") for c in keys), *(F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_s{k}") for k in range(len(sums))))
    same = F.col("_part") == F.col("_p")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    local = dealt.withColumns({f"_r{k}": F.sum(f"_v{k}").over(inside) for k in range(len(sums))})
    out = local.join(starts, same)
    return out.select(*rows.columns, *((F.col(f"_r{k}") + F.col(f"_s{k}")).alias(name) for k, name in enumerate(sums)))


def numbered(rows: DataFrame, order: list[str], name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds each row's number, from 1, in a total order."""
    return running(rows, order, {name: F.lit(1).cast("long")}, keys)


#: What a percentile is called, its share of 100 and its method.
Percentiles = dict[str, tuple[float, str]]


def exact_percentiles(rows: DataFrame, column: str, wanted: Percentiles, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key (one in all without keys, null if no value) with the wanted percentiles of a column.

    ``nearest_rank`` is the value at rank ceil(p / 100 * n), the least for 0; ``linear`` interpolates. Equal values are
    counted before the shuffle, counts are summed along ranges of values, and the values at the wanted ranks are taken:
    no task holds all values of a key. Nulls do not count.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    summed = running(counts, ["_x"], {"_upto": F.col("_c")}, keys)
    totals = summed.groupBy(*(F.col(k).alias(f"_t_{k}") for k in keys)).agg(F.max("_upto").alias("_n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    joined = summed.join(totals, same) if keys else summed.join(F.broadcast(totals))  # without keys, one row

    def at(rank: Column) -> Column:
        """The value at a rank from 0."""
        return F.min(F.when(F.col("_upto") > rank, F.col("_x")))

    found, out, n = {}, {}, F.col("_n")
    for name, (p, method) in wanted.items():
        if method == "linear":
            place = (n - 1) * p / 100
            found |= {f"_{name}_low": at(F.floor(place)), f"_{name}_high": at(F.ceil(place)), f"_{name}_part": F.max(place - F.floor(place))}
            low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
            out[name] = low + (high - low) * F.col(f"_{name}_part")
        else:
            found[name] = at(F.greatest(F.ceil(n * p / 100) - 1, F.lit(0)))
            out[name] = F.col(name)
    return joined.groupBy(*keys).agg(*(c.alias(k) for k, c in found.items())).select(*keys, *(c.alias(k) for k, c in out.items()))


def with_percentiles(groups: DataFrame, rows: DataFrame, column: str, wanted: Percentiles, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds percentiles of ``rows`` to one row for each key, or to a single row."""
    found = exact_percentiles(rows, column, wanted, keys)
    if not keys:
        return groups.join(F.broadcast(found), how="left")  # one row each
    found = found.withColumnsRenamed({k: f"_p_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    return groups.join(found, same, "left").drop(*(f"_p_{k}" for k in keys))
