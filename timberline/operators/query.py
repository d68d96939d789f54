"""Sorting, paging, facets and single-key aggregation of filtered events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import attribute
from ..functions.text import floor_time
from ..plans.requests import Aggregation, EventQuery, EventSort, Limits, RequestError
from ..schema import severity_rank
from ..sources.shared import stash
from .filters import apply_filter


def sort_order(sort: tuple[EventSort, ...]) -> list[Column]:
    """Nulls last in both directions; ties by the latest sequence."""
    sort = sort or (EventSort("timestamp"), EventSort("sequence"))
    out = []
    for s in sort:
        c = severity_rank() if s.field == "severity" else F.col(s.field)
        out.append(c.desc_nulls_last() if s.descending else c.asc_nulls_last())
    if all(s.field != "sequence" for s in sort):
        out.append(F.col("sequence").desc())
    return out


def page(events: DataFrame, query: EventQuery, limits: Limits = Limits()) -> DataFrame:
    """The events of a page in order."""
    limit = limits.page_default if query.limit is None else query.limit
    if limits.page is not None and limit > limits.page:
        raise RequestError(f"a page has at most {limits.page} events")
    ordered = apply_filter(events, query.filter).orderBy(*sort_order(query.sort))
    return (ordered.offset(query.offset) if query.offset else ordered).limit(limit)


def ranked_page(events: DataFrame, query: EventQuery, limits: Limits = Limits()) -> DataFrame:
    """``page`` with each row's position (from 1) in the whole order; only the rows up to the page's end are ranked."""
    limit = limits.page_default if query.limit is None else query.limit
    order = sort_order(query.sort)
    head = apply_filter(events, query.filter).orderBy(*order).limit(query.offset + limit)
    return head.withColumn("position", F.row_number().over(Window.orderBy(*order))).filter(F.col("position") > query.offset)


def facet_value(events: DataFrame, name: str) -> Column:
    """The values, an array, that an event has for a facet or group field."""
    if name in ("tag", "tags"):
        return F.col("tags")
    if name == "parser_name":
        return F.array(attribute("parser_name"))
    return F.array(F.col(name))


def labelled(values: Column, name: str, label: str) -> Column:
    """Each value of an array in a struct with a name."""
    return F.transform(values, lambda v: F.struct(F.lit(name).alias(label), v.alias("value")))


def facets(events: DataFrame, names: tuple[str, ...], limits: Limits = Limits()) -> DataFrame:
    """facet, value, count and position of the commonest values of each facet, in one scan of ``events``.

    Of each part of the counted values, only a facet's first ones go on to the task that ranks them.
    """
    if limits.facet_fields is not None and len(names) > limits.facet_fields:
        raise RequestError(f"at most {limits.facet_fields} facets")
    many = [n for n in names if n in ("tag", "tags")]
    none = F.array().cast("array<struct<facet:string,value:string>>")
    scalars = [F.struct(F.lit(n).alias("facet"), F.get(facet_value(events, n), F.lit(0)).cast("string").alias("value")) for n in names if n not in many]
    pairs = F.concat(F.array(*scalars) if scalars else none, *(F.coalesce(labelled(facet_value(events, n), n, "facet"), none) for n in many))
    counts = events.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy("facet").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limits.facet_values)


def aggregate(events: DataFrame, request: Aggregation) -> DataFrame:
    """key, value, sample_count and position, for time buckets also bucket_start and bucket_end (outside).

    Null keys are left out; buckets come in time order and are named by their start in UTC, others by value.
    """
    rows = apply_filter(events, request.filter)
    times = {}
    if request.group_by == "time_bucket":
        start = floor_time("timestamp", request.bucket_seconds)
        keyed = rows.select(F.date_format(start, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("key"), start.alias("start"), "duration_ms")
        keyed = keyed.withColumn("key", F.regexp_replace("key", "Z$", "+00:00"))
        end = F.timestamp_seconds(F.unix_seconds(F.min("start")) + request.bucket_seconds)
        times = {"bucket_start": F.min("start"), "bucket_end": end}
    elif request.group_by == "tag":
        keyed = rows.select(F.explode("tags").alias("key"), "duration_ms")
    else:
        keyed = rows.select(F.element_at(facet_value(rows, request.group_by), 1).alias("key"), "duration_ms")
    fine = F.when(~F.isnan("duration_ms") & (F.abs("duration_ms") < float("inf")), F.col("duration_ms"))
    samples = F.count(fine)
    metric = {
        "count": (F.count(F.lit(1)).cast("double"), F.lit(None).cast("long")),
        "sum_duration_ms": (F.coalesce(F.sum(fine), F.lit(0.0)), samples),
        "average_duration_ms": (F.avg(fine), samples),
    }[request.metric]
    out = keyed.filter("key is not null").groupBy("key").agg(metric[0].alias("value"), metric[1].alias("sample_count"), *(c.alias(n) for n, c in times.items()))
    order = [F.asc("key")] if request.group_by == "time_bucket" else [F.col("value").desc_nulls_last(), F.asc("key")]
    top = out.orderBy(*order).limit(request.limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


@dataclass(frozen=True)
class QueryResult:
    """Rows as DataFrames; counts, where asked for, as numbers."""

    events: DataFrame | None
    facets: DataFrame | None
    total: int | None
    returned: int
    has_more: bool
    next_offset: int | None


def run_query(events: DataFrame, query: EventQuery, limits: Limits = Limits()) -> QueryResult:
    """A page, its facets over all that matches, and the page's place.

    The page, of bounded size, is found once and kept as a small table of its own; the number of all matches is one
    more pass, only where it is asked for.
    """
    matched = apply_filter(events, query.filter)
    total = matched.count() if query.include_total else None
    limit = limits.page_default if query.limit is None else query.limit
    rows, returned = None, 0
    if query.include_events:
        rows = stash(page(events, query, limits).coalesce(1))
        returned = rows.count()
        rows = rows.orderBy(*sort_order(query.sort))
    more = query.offset + returned < total if total is not None else returned == limit
    return QueryResult(
        rows,
        facets(matched, query.facets, limits) if query.facets else None,
        total,
        returned,
        bool(rows is not None and more),
        query.offset + returned if rows is not None and more else None,
    )
