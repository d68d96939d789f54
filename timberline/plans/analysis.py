"""Analysis and comparison requests, run over one prepared DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import with_extracts
from ..functions.text import instant, preview
from ..operators import comparison, reports
from ..operators.filters import apply_filter
from ..operators.ordering import exact_percentiles
from ..sources.shared import stash
from .insights import Insight, Thresholds, comparison_insights, comparison_warnings, insights
from .requests import AnalysisRequest, ComparisonRequest, Limits, RequestError


@dataclass
class Analysis:
    """Reports as DataFrames; insights and warnings as values."""

    summary: dict | None = None
    distributions: DataFrame | None = None
    timeline: DataFrame | None = None
    latency: dict[str, DataFrame] = field(default_factory=dict)
    http: dict[str, DataFrame] = field(default_factory=dict)
    insights: list[Insight] = field(default_factory=list)
    samples: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


def prepared(events: DataFrame, request: AnalysisRequest) -> DataFrame:
    """The request's events with what its reports read."""
    rows = apply_filter(events, request.filter)
    if request.start_time is not None:
        rows = rows.filter(F.col("timestamp") >= instant(request.start_time))
    if request.end_time is not None:
        rows = rows.filter(F.col("timestamp") < instant(request.end_time))
    return with_extracts(rows, duration_field=request.duration_field)


def analyze(events: DataFrame, request: AnalysisRequest, limits: Limits = Limits(), thresholds: Thresholds = Thresholds()) -> Analysis:
    """Runs the asked modules over one written projection; what is collected is a few bounded rows."""
    # written once for all reports: a lost executor costs no second extraction, and nothing has to be unpersisted
    rows = stash(prepared(events, request).drop("message", "raw_message"))
    out, widened, order = Analysis(), False, request.modules
    summary = reports.summary(rows).first().asDict() if {"summary", "insights"} & set(order) else None
    if limits.events is not None and summary and summary["event_count"] > limits.events:
        raise RequestError(f"an analysis covers at most {limits.events} events")
    out.summary = summary if "summary" in order else None
    if "distributions" in order:
        out.distributions = reports.distributions(rows, request.distributions, request.top, limits)
    if "timeline" in order:
        first, last = reports.bounds(rows, request.start_time, request.end_time)
        if first is not None and last is not None:
            seconds, widened = reports.choose_bucket(first, last, request.bucket_seconds, limits)
            out.timeline = reports.timeline(rows, seconds, first, last, limits=limits)
            out.warnings += ["TIME_BUCKET_ADJUSTED"] * widened
    if "latency" in order:
        out.latency = {
            "summary": reports.latency(rows, request.percentiles, request.percentile_method), "histogram": reports.histogram(rows),
            "slowest": reports.slowest(rows, request.top),
            **{f"by_{k}": reports.latency_by(rows, f"x_{k}", request.top) for k in ("service", "event_type", "endpoint")},
        }
    if "http" in order:
        out.http = {
            "summary": reports.http_summary(rows), "endpoints": reports.busiest_endpoints(rows, request.top),
            "slowest": reports.slowest_endpoints(rows, request.top), "failing": reports.failing_endpoints(rows, request.top),
            "by_method": reports.status_by(rows, "x_method", request.top), "by_service": reports.status_by(rows, "x_service", request.top),
            "distributions": reports.http_distributions(rows, request.top, limits),
        }
        low, high = reports.bounds(reports.http_events(rows), request.start_time, request.end_time)
        if low is not None and high is not None:
            size, _ = reports.choose_bucket(low, high, request.bucket_seconds, limits)
            out.http["timeline"] = reports.timeline(reports.http_events(rows), size, low, high, limits=limits)
    if "insights" in order:
        top = {r.field: (r.value, r.percentage) for r in reports.distributions(rows, ("service", "host", "event_type"), 1).collect()}
        http = reports.http_summary(rows).first().asDict()
        p95 = exact_percentiles(rows, "x_duration", {"p95": (95.0, request.percentile_method)}).first()[0] if 95 in request.percentiles else None
        late = reports.out_of_order(rows).first()[0]
        out.insights = insights(summary, top, http, p95, late, widened, thresholds)
    if request.samples:
        out.samples = samples(apply_filter(events, request.filter), request.samples)
    return out


def samples(events: DataFrame, k: int) -> DataFrame:
    """k events spread evenly, in nine columns, messages cut short."""
    message = F.coalesce(F.nullif(preview("message"), F.lit("")), F.lit("(empty)"))
    return reports.even_sample(events, k).select(
        "id", "sequence", "timestamp", "severity", "source_type", "event_type", "service", "host", message.alias("message")
    )


@dataclass
class Comparison:
    metrics: DataFrame
    groups: DataFrame | None
    insights: list[Insight]
    warnings: list[str]


def compare(events: DataFrame, request: ComparisonRequest) -> Comparison:
    rows = with_extracts(events)
    metrics = comparison.metrics(rows, request)
    found = [r.asDict() for r in metrics.collect()]  # a row for each metric
    return Comparison(
        metrics, comparison.groups(rows, request) if request.groups else None,
        comparison_insights(found), comparison_warnings(found, request.minimum_samples),
    )


# Lengths of the preset periods.
PERIODS = {"1h": timedelta(hours=1), "24h": timedelta(hours=24), "7d": timedelta(days=7)}


def preset_periods(name: str, now: datetime) -> tuple[tuple[datetime, datetime], tuple[datetime, datetime]]:
    """The period that ends now, and the one before it."""
    length = PERIODS[name]
    return (now - length, now), (now - 2 * length, now - length)
