"""Event filters as one Column predicate, which Catalyst pushes into the scan where it can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import attribute, attribute_exists, attribute_variant, kind_of
from ..functions.text import fold_case, instant
from ..plans.requests import EventFilter, Scalar

IN_COLUMNS = {
    "event_ids": "id", "severities": "severity", "source_types": "source_type", "event_types": "event_type",
    "hosts": "host", "services": "service", "client_ips": "client_ip", "user_ids": "user_id",
    "correlation_ids": "correlation_id",
}


def attribute_equals(path: str, value: Scalar) -> Column:
    """Equality by kind: numbers as numbers, a boolean only to itself, null only to a null that is there."""
    kind = kind_of(attribute_variant(path))
    if value is None:
        return kind == "null"
    if isinstance(value, bool):
        return (kind == "boolean") & (attribute(path, "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        return (kind == "number") & (attribute(path, "double") == F.lit(float(value)))
    return (kind == "string") & (attribute(path) == F.lit(value))


def predicate(events: DataFrame, f: EventFilter) -> Column:
    """The condition of a filter over ``events``; a column that is absent matches nothing."""
    parts: list[Column] = []
    for name, column in IN_COLUMNS.items():
        if values := getattr(f, name):
            parts.append(F.col(column).isin(*values) if column in events.columns else F.lit(False))
    if f.exclude_event_ids:
        parts.append(~F.col("id").isin(*f.exclude_event_ids))
    if f.start_time is not None:
        parts.append(F.col("timestamp") >= instant(f.start_time))
    if f.end_time is not None:
        parts.append(F.col("timestamp") < instant(f.end_time))
    if f.parser_names:
        parts.append(attribute("parser_name").isin(*f.parser_names))
    if f.tags_any:
        parts.append(F.arrays_overlap("tags", F.array(*map(F.lit, f.tags_any))))
    if f.tags_all:
        parts.append(F.size(F.array_except(F.array(*map(F.lit, f.tags_all)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    if f.message_contains:
        if f.case_sensitive:
            parts.append(F.contains(F.col("message"), F.lit(f.message_contains)))
        else:
            parts.append(F.contains(fold_case("message"), fold_case(F.lit(f.message_contains))))
    parts += [attribute_exists(p) for p in f.attribute_exists]
    parts += [attribute_equals(p, v) for p, v in f.attribute_equals.items()]
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def apply_filter(events: DataFrame, f: EventFilter) -> DataFrame:
    return events if f == EventFilter() else events.filter(predicate(events, f))
