"""Two periods or populations of one set of events, compared in a single scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dimension
from ..plans.requests import ComparisonRequest
from ..sources.shared import stash
from .filters import predicate
from .ordering import exact_percentiles
from .reports import count_where, summary_severity

#: Metrics for which more is worse, and those that few samples make unsure.
WORSE_UP = ("error_rate", "critical_rate", "average_duration", "p50_duration", "p95_duration", "p99_duration", "server_error_rate", "client_error_rate")
GROUP_COLUMNS = {
    "severity": "severity", "source_type": "source_type", "event_type": "x_event_type", "parser": "x_parser", "host": "x_host",
    "service": "x_service", "endpoint": "x_endpoint", "http_status": "x_status", "http_method": "x_method",
}


def scopes(events: DataFrame, request: ComparisonRequest) -> DataFrame:
    """Rows of either scope, with flags in_base and in_comp (a row may be in both)."""
    flags = events.withColumns(
        {"in_base": F.coalesce(predicate(events, request.baseline), F.lit(False)), "in_comp": F.coalesce(predicate(events, request.comparison), F.lit(False))}
    )
    return flags.filter("in_base or in_comp")


def _metric(name: str, flag: str, request: ComparisonRequest) -> tuple[Column, Column]:
    """A metric of the rows with a flag, and how many samples it has."""
    on = F.col(flag)
    folded = summary_severity()
    n, http = count_where(on), count_where(on & F.col("x_http"))
    status, ms = F.col("x_status"), F.when(on, F.col("x_duration"))
    if name == "event_count":
        return n.cast("double"), n
    if name == "error_rate":
        return F.try_divide(count_where(on & folded.isin("error", "critical")).cast("double"), n.cast("double")), n
    if name == "critical_rate":
        return F.try_divide(count_where(on & (folded == "critical")).cast("double"), n.cast("double")), n
    if name == "average_duration":
        return F.avg(ms), F.count(ms)
    if name.endswith("_duration"):  # joined afterwards
        return F.lit(None).cast("double"), F.count(ms)
    if name == "server_error_rate":
        return F.try_divide(count_where(on & F.col("x_http") & (status >= 500)).cast("double"), http.cast("double")), http
    if name == "client_error_rate":
        return F.try_divide(count_where(on & F.col("x_http") & status.between(400, 499)).cast("double"), http.cast("double")), http
    if request.throughput == "count":
        return n.cast("double"), n
    at = F.when(on, F.unix_micros(F.col("timestamp").cast("timestamp")))
    span = (F.max(at) - F.min(at)) / 1e6
    return F.when(span > 0, n * 60 / span), n


def judged(rows: DataFrame, request: ComparisonRequest, low_sample: Column, rate_like: Column) -> DataFrame:
    """Adds absolute and percent change, direction and significance to base and comparison values."""
    base, comp = F.col("baseline"), F.col("comparison")
    change = comp - base
    percent = F.when((base == 0) & (comp == 0), 0.0).when(base != 0, F.abs(change) / F.abs(base) * 100)
    direction = (
        F.when(base.isNull() & comp.isNull(), "undefined")
        .when(base.isNull() | ((base == 0) & (comp != 0)), "new")
        .when(comp.isNull(), "removed")
        .when(change > 0, "increased").when(change < 0, "decreased").otherwise("unchanged")
    )
    rows = rows.withColumns({"absolute_change": change, "percent_change": percent, "direction": direction})
    strong = (F.col("percent_change") >= request.significant_percent) | F.col("direction").isin("new", "removed")
    return rows.withColumn("significant", F.coalesce(strong, F.lit(False)) & ~(low_sample & rate_like))


def metrics(events: DataFrame, request: ComparisonRequest) -> DataFrame:
    """metric, baseline, comparison, changes, direction, significance and reading of each metric."""
    aggs = []
    for name in request.metrics:
        for side, flag in (("b", "in_base"), ("c", "in_comp")):
            value, samples = _metric(name, flag, request)
            aggs += [value.alias(f"{name}_{side}"), samples.alias(f"{name}_{side}n")]
    # read for values and percentiles: what they need is extracted once
    rows = stash(scopes(events, request).select("in_base", "in_comp", "severity", "timestamp", "x_http", "x_status", "x_duration"))
    wide = rows.agg(*aggs)
    asked = {m: (float(m[1:3]), request.percentile_method) for m in request.metrics if m in ("p50_duration", "p95_duration", "p99_duration")}
    if asked:
        sides = F.array_compact(F.array(F.when(F.col("in_base"), "b"), F.when(F.col("in_comp"), "c")))
        found = exact_percentiles(rows.select(F.explode(sides).alias("side"), "x_duration"), "x_duration", asked, ("side",))
        both = found.agg(*(F.max(F.when(F.col("side") == side, F.col(m))).alias(f"{m}_{side}") for m in asked for side in "bc"))
        wide = wide.drop(*both.columns).join(F.broadcast(both))  # one row each
    parts = [
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_b").cast("double").alias("baseline"), F.col(f"{m}_c").cast("double").alias("comparison"),
                 F.col(f"{m}_bn").alias("baseline_samples"), F.col(f"{m}_cn").alias("comparison_samples"))
        for m in request.metrics
    ]
    rows = wide.select(F.explode(F.array(*parts)).alias("m")).select("m.*")
    low = (F.col("baseline_samples") < request.minimum_samples) | (F.col("comparison_samples") < request.minimum_samples)
    rows = judged(rows, request, low, F.col("metric").isin(*WORSE_UP))
    worse, up, down = F.col("metric").isin(*WORSE_UP), F.col("direction") == "increased", F.col("direction") == "decreased"
    reading = F.when(F.col("direction").isin("new", "removed", "undefined"), "unknown").when(worse & up, "degraded").when(worse & down, "improved").otherwise("neutral")
    return rows.withColumn("reading", reading)


def groups(events: DataFrame, request: ComparisonRequest) -> DataFrame:
    """field, key, counts and shares in both scopes, the change of share in points, and the position inside a field."""
    pairs = [
        F.struct(F.lit(f).alias("field"), dimension(F.col(GROUP_COLUMNS[f]).cast("string")).alias("key")) for f in request.groups
    ]
    total = F.struct(F.lit("").alias("field"), F.lit("").alias("key"))
    counts = (
        scopes(events, request).select("in_base", "in_comp", F.explode(F.array(total, *pairs)).alias("p"))
        .filter("p.key is not null").groupBy("p.field", "p.key")
        .agg(count_where(F.col("in_base")).alias("baseline_count"), count_where(F.col("in_comp")).alias("comparison_count"))
    )
    whole = counts.filter("field = ''").select(F.col("baseline_count").alias("tb"), F.col("comparison_count").alias("tc"))
    share = lambda n, t: F.coalesce(F.try_divide(F.col(n) * 100.0, F.col(t).cast("double")), F.lit(0.0))
    # one row of totals
    rows = counts.filter("field != ''").join(F.broadcast(whole)).select(
        "field", "key", "baseline_count", "comparison_count", share("baseline_count", "tb").alias("baseline_share"), share("comparison_count", "tc").alias("comparison_share"),
        F.col("baseline_count").cast("double").alias("baseline"), F.col("comparison_count").cast("double").alias("comparison"),
    )
    rows = rows.withColumn("point_change", F.col("comparison_share") - F.col("baseline_share"))
    rows = rows.filter(F.greatest("baseline_count", "comparison_count") >= request.minimum_group_count)
    if not request.include_new:
        rows = rows.filter("baseline_count > 0")
    if not request.include_disappeared:
        rows = rows.filter("comparison_count > 0")
    low = (F.col("baseline_count") < request.minimum_samples) | (F.col("comparison_count") < request.minimum_samples)
    rows = judged(rows, request, low, F.lit(True)).drop("baseline", "comparison")
    order = Window.partitionBy("field").orderBy(F.desc(F.abs("point_change")), F.desc("comparison_count"), F.asc("key"))
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= request.top)
