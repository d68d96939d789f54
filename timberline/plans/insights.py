"""Rules over the few numbers that reports leave: what to tell a reader."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

LEVELS = {"critical": 0, "warning": 1, "info": 2}


@dataclass(frozen=True)
class Insight:
    code: str
    level: str
    value: float | None = None
    details: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Thresholds:
    error_warning: float = 0.05
    error_critical: float = 0.20
    p95_warning_ms: float | None = None
    p95_critical_ms: float | None = None
    share_warning: float = 50.0
    share_critical: float = 80.0
    few: int = 10
    missing_status: float = 0.5
    duration_coverage: float = 0.2


def _graded(code: str, value: float | None, warning: float | None, critical: float | None, **details: Any) -> list[Insight]:
    if value is None or (warning is None and critical is None):
        return []
    if critical is not None and value >= critical:
        return [Insight(code, "critical", value, details)]
    if warning is not None and value >= warning:
        return [Insight(code, "warning", value, details)]
    return []


def insights(summary: dict, shares: dict[str, tuple[str, float]] | None = None, http: dict | None = None, p95: float | None = None,
             out_of_order: int = 0, bucket_widened: bool = False, t: Thresholds = Thresholds()) -> list[Insight]:
    """Insights in order of level, then code. ``shares`` has the commonest service, host and event_type with its
    percentage of all events."""
    n = summary["event_count"]
    if n == 0:
        return [Insight("NO_EVENTS", "info", 0)]
    found: list[Insight] = []
    if n < t.few:
        found.append(Insight("LOW_SAMPLE_SIZE", "info", n))
    found += _graded("HIGH_ERROR_RATE", summary["error_rate"], t.error_warning, t.error_critical)
    if summary["critical_count"] > 0:
        found += _graded("HIGH_CRITICAL_RATE", summary["critical_rate"], t.error_warning, t.error_critical)
    found += _graded("LATENCY_P95_HIGH", p95, t.p95_warning_ms, t.p95_critical_ms)
    if n >= t.few:
        names = {"service": "SINGLE_SERVICE_CONCENTRATION", "host": "SINGLE_HOST_CONCENTRATION", "event_type": "DOMINANT_EVENT_TYPE"}
        for name, code in names.items():
            if name in (shares or {}):
                key, share = shares[name]
                found += _graded(code, share, t.share_warning, t.share_critical, key=key)
    if http and http["http_event_count"]:
        if http["unknown_count"] / http["http_event_count"] > t.missing_status:
            found.append(Insight("MISSING_HTTP_STATUS_DATA", "warning", http["unknown_count"] / http["http_event_count"]))
        found += _graded("HIGH_SERVER_ERROR_RATE", http["server_error_rate"], t.error_warning, t.error_critical)
    if summary["duration_count"] / n < t.duration_coverage:
        found.append(Insight("MISSING_DURATION_DATA", "warning", summary["duration_count"] / n))
    if out_of_order:
        found.append(Insight("OUT_OF_ORDER_TIMESTAMPS", "warning", out_of_order))
    if bucket_widened:
        found.append(Insight("TIME_BUCKET_ADJUSTED", "info"))
    by_code = {i.code: i for i in found}
    return sorted(by_code.values(), key=lambda i: (LEVELS[i.level], i.code))


def comparison_insights(metrics: list[dict]) -> list[Insight]:
    """Spikes among compared metrics."""
    codes = {"error_rate": "ERROR_SPIKE", "server_error_rate": "SERVER_ERROR_SPIKE"}
    return [
        Insight(codes[m["metric"]], "warning", m["comparison"], {"baseline": m["baseline"]})
        for m in metrics
        if m["metric"] in codes and m["significant"] and m["direction"] in ("increased", "new") and m["comparison"]
    ]


def comparison_warnings(metrics: list[dict], minimum: int) -> list[str]:
    by_name = {m["metric"]: m for m in metrics}
    out = []
    for side in ("baseline", "comparison"):
        least = min((m[f"{side}_samples"] for m in metrics), default=0)
        if by_name.get("event_count", {}).get(f"{side}_samples", least) == 0:
            out.append(f"EMPTY_{side.upper()}")
        elif least < minimum:
            out.append("LOW_SAMPLE_SIZE")
        if "throughput" in by_name and by_name["throughput"][side] is None:
            out.append("ZERO_TIME_SPAN")
    return list(dict.fromkeys(out))
