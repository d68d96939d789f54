"""Typed requests: plain frozen records, checked when made, independent of Spark."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import datetime
from typing import Any

from ..functions.extract import check_path
from ..schema import SEVERITIES, SOURCE_TYPES

Scalar = str | int | float | bool | None
VALUES_PER_FIELD, VALUES_IN_ALL, TEXT_LIMIT = 100, 500, 512


@dataclass(frozen=True)
class Limits:
    """What a request may ask for; None turns a limit off."""

    page_default: int = 100
    page: int | None = 1000
    facet_values: int = 100
    facet_fields: int | None = 8
    groups: int | None = 1000
    top: int | None = 100
    buckets: int = 2000
    bucket_seconds: int = 300
    events: int | None = None


class RequestError(ValueError):
    """A request that cannot be run."""


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise RequestError(message)


@dataclass(frozen=True)
class EventFilter:
    """Fields are joined by AND, values inside a field by OR; empty means no constraint. start is inside, end not."""

    event_ids: tuple[str, ...] = ()
    exclude_event_ids: tuple[str, ...] = ()
    start_time: datetime | None = None
    end_time: datetime | None = None
    severities: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    event_types: tuple[str, ...] = ()
    parser_names: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()
    services: tuple[str, ...] = ()
    client_ips: tuple[str, ...] = ()
    user_ids: tuple[str, ...] = ()
    correlation_ids: tuple[str, ...] = ()
    tags_any: tuple[str, ...] = ()
    tags_all: tuple[str, ...] = ()
    message_contains: str | None = None
    case_sensitive: bool = False
    attribute_exists: tuple[str, ...] = ()
    attribute_equals: dict[str, Scalar] = field(default_factory=dict)

    def __post_init__(self) -> None:
        total = 0
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, (tuple, list)):
                value = tuple(sorted({str(v).strip() for v in value} - {""}))
                if f.name in ("severities", "source_types"):
                    value = tuple(sorted({v.lower() for v in value}))
                object.__setattr__(self, f.name, value)
                _require(len(value) <= VALUES_PER_FIELD, f"{f.name} has over {VALUES_PER_FIELD} values")
                total += len(value)
        _require(total + len(self.attribute_equals) <= VALUES_IN_ALL, f"a filter has over {VALUES_IN_ALL} values")
        _require(set(self.severities) <= set(SEVERITIES), "an unknown severity")
        _require(set(self.source_types) <= set(SOURCE_TYPES), "an unknown source type")
        _require(not self.message_contains or len(self.message_contains) <= TEXT_LIMIT, "message_contains is too long")
        if self.start_time is not None and self.end_time is not None:
            _require(self.start_time < self.end_time, "start_time must be before end_time")
        for path in (*self.attribute_exists, *self.attribute_equals):
            try:
                check_path(path)
            except ValueError as error:
                raise RequestError(str(error)) from None


# Fixed values.
SORT_FIELDS = ("timestamp", "inserted_at", "sequence", "severity", "event_type", "host")


@dataclass(frozen=True)
class EventSort:
    field: str
    descending: bool = True

    def __post_init__(self) -> None:
        _require(self.field in SORT_FIELDS, f"cannot sort by {self.field}")


# Fixed values.
FACET_FIELDS = ("severity", "source_type", "event_type", "parser_name", "host", "service", "tags")


@dataclass(frozen=True)
class EventQuery:
    filter: EventFilter = field(default_factory=EventFilter)
    sort: tuple[EventSort, ...] = ()
    offset: int = 0
    limit: int | None = None
    facets: tuple[str, ...] = ()
    include_events: bool = True
    include_total: bool = True

    def __post_init__(self) -> None:
        names = [s.field for s in self.sort]
        _require(len(set(names)) == len(names), "a sort field is repeated")
        _require(self.offset >= 0 and (self.limit is None or self.limit >= 1), "offset or limit is out of range")
        _require(set(self.facets) <= set(FACET_FIELDS), "an unknown facet")
        object.__setattr__(self, "facets", tuple(dict.fromkeys(self.facets)))


# Fixed values.
GROUPS = ("severity", "source_type", "event_type", "parser_name", "host", "service", "tag", "time_bucket")
METRICS = ("count", "sum_duration_ms", "average_duration_ms")


@dataclass(frozen=True)
class Aggregation:
    group_by: str
    metric: str = "count"
    bucket_seconds: int | None = None
    limit: int = 100
    filter: EventFilter = field(default_factory=EventFilter)

    def __post_init__(self) -> None:
        _require(self.group_by in GROUPS, f"cannot group by {self.group_by}")
        _require(self.metric in METRICS, f"unknown metric {self.metric}")
        _require(1 <= self.limit <= 1000, "limit is out of range")
        _require(self.group_by != "tag" or self.metric == "count", "tags have counts only")
        if self.group_by == "time_bucket":
            _require(self.bucket_seconds is not None and 1 <= self.bucket_seconds <= 86_400, "bucket_seconds is out of range")
        else:
            _require(self.bucket_seconds is None, "bucket_seconds is for time buckets")


# Fixed values.
COMPARISON_METRICS = (
    "event_count", "error_rate", "critical_rate", "average_duration", "p50_duration", "p95_duration", "p99_duration",
    "server_error_rate", "client_error_rate", "throughput",
)
GROUP_FIELDS = ("severity", "source_type", "event_type", "parser", "host", "service", "endpoint", "http_status", "http_method")
# Parts of names, between dots, that no group key may have.
SENSITIVE = {
    "api_key", "apikey", "auth", "authorization", "client_ip", "cookie", "correlation_id", "credential", "credentials",
    "message", "password", "passwd", "raw_message", "secret", "server_ip", "session", "session_id", "set_cookie",
    "source", "token", "trace_id", "user_id",
}


def check_group_field(name: str) -> str:
    """A path that may be grouped by: none of its parts, ``-`` taken as ``_`` and case aside, tells of secrets or persons."""
    clean = check_path(name)
    _require(not {p.lower().replace("-", "_") for p in clean.split(".")} & SENSITIVE, f"cannot group by {clean}")
    return clean


@dataclass(frozen=True)
class AnalysisRequest:
    """Which reports to make of which events."""

    filter: EventFilter = field(default_factory=EventFilter)
    start_time: datetime | None = None
    end_time: datetime | None = None
    modules: tuple[str, ...] = ("summary", "distributions", "timeline", "latency", "http", "insights")
    distributions: tuple[str, ...] = ("severity", "event_type", "service", "host")
    top: int = 10
    bucket_seconds: int | None = None
    percentiles: tuple[float, ...] = (50, 90, 95, 99)
    percentile_method: str = "nearest_rank"
    duration_field: str | None = None
    samples: int = 0

    def __post_init__(self) -> None:
        _require(set(self.modules) <= {"summary", "distributions", "timeline", "latency", "http", "insights"}, "an unknown module")
        _require(len(self.distributions) <= 20, "over 20 distributions")
        for name in self.distributions:
            check_group_field(name)
        _require(all(0 <= p <= 100 for p in self.percentiles) and len(self.percentiles) <= 20, "percentiles are out of range")
        _require(self.percentile_method in ("nearest_rank", "linear"), "an unknown percentile method")
        _require(self.bucket_seconds is None or 1 <= self.bucket_seconds <= 31_536_000, "bucket_seconds is out of range")
        if self.start_time is not None and self.end_time is not None:
            _require(self.start_time < self.end_time, "start_time must be before end_time")


@dataclass(frozen=True)
class ComparisonRequest:
    baseline: EventFilter
    comparison: EventFilter
    metrics: tuple[str, ...] = COMPARISON_METRICS
    groups: tuple[str, ...] = ()
    top: int = 10
    minimum_group_count: int = 1
    include_new: bool = True
    include_disappeared: bool = True
    significant_percent: float = 20.0
    minimum_samples: int = 10
    percentile_method: str = "nearest_rank"
    throughput: str = "per_minute"

    def __post_init__(self) -> None:
        _require(bool(self.metrics) and set(self.metrics) <= set(COMPARISON_METRICS), "an unknown metric")
        _require(set(self.groups) <= set(GROUP_FIELDS) and len(self.groups) <= 9, "an unknown group field")
        _require(self.throughput in ("per_minute", "count"), "an unknown throughput unit")


def as_dict(request: Any) -> dict:
    """A request as plain values."""
    return {f.name: as_dict(v) if hasattr(v := getattr(request, f.name), "__dataclass_fields__") else v for f in fields(request)}
