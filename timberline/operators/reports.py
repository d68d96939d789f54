"""Statistical reports over events that ``with_extracts`` has prepared: summary, distributions, percentiles, timeline,
latency and HTTP."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import DURATIONS, attribute_variant, scalar_text, status_class
from ..functions.text import dimension, floor_time, micros, ratio
from ..plans.requests import Limits, RequestError, check_group_field
from .ordering import Percentiles, numbered, with_percentiles
from ..sources.shared import stash
from .query import labelled

ERRORS, CRITICALS = ("error",), ("critical", "fatal")


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


# ---- summary -------------------------------------------------------------------------------------------------------


def summary_severity(severity: str = "severity") -> Column:
    """The summary's folding: notice counts as info and fatal as critical."""
    c = F.col(severity)
    return F.when(c == "notice", "info").when(c == "fatal", "critical").when(c.isin("trace", "debug", "info", "warning", "error", "critical"), c).otherwise("unknown")


def timeline_severity(severity: str = "severity") -> Column:
    """The timeline's folding: only fatal counts as critical."""
    return F.when(F.col(severity) == "fatal", "critical").otherwise(F.col(severity))


#: What the summary counts the different values of.
DISTINCT = {"event_types": "x_event_type", "services": "x_service", "hosts": "x_host", "parsers": "x_parser", "source_types": "source_type"}


def summary(events: DataFrame) -> DataFrame:
    """One row: counts by severity, rates, distinct values, time span, duplicates, coverage.

    Distinct values of all fields are counted as pairs of field and value, in one shuffle of different pairs.
    """
    folded = summary_severity()
    span = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6
    aggs = [F.count(F.lit(1)).alias("event_count")]
    aggs += [count_where(folded == s).alias(f"{s}_count") for s in ("trace", "debug", "info", "warning", "error", "critical", "unknown")]
    aggs += [
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count("x_duration").alias("duration_count"), F.count("x_status").alias("status_count"),
    ]
    fields = {n: dimension(c) for n, c in DISTINCT.items()} | {"contents": F.col("content_hash")}
    pairs = events.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in fields.items()))).alias("p"))
    distinct = pairs.select("p.*").filter("value is not null").distinct().agg(*(count_where(F.col("field") == n).alias(f"distinct_{n}") for n in fields))
    row = events.agg(*aggs).join(F.broadcast(distinct))  # one row each
    row = row.withColumn("duplicate_content_count", F.col("event_count") - F.col("distinct_contents")).drop("distinct_contents")
    return row.withColumns(
        {
            "error_rate": ratio(F.col("error_count") + F.col("critical_count"), "event_count"),
            "critical_rate": ratio("critical_count", "event_count"),
            "span_seconds": span,
            "events_per_second": F.when(span > 0, F.col("event_count") / span),
            "events_per_minute": F.when(span > 0, F.col("event_count") * 60 / span),
        }
    )


def out_of_order(events: DataFrame) -> DataFrame:
    """One row, out_of_order: events older than the one before them in sequence order.

    The sequence is cut into ranges that are ordered apart; each range's first event is compared with the last one of
    the nearest range before it that has any. Only one row per range meets in one task.
    """
    ranges = events.select("sequence", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at")).repartitionByRange("sequence").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy("sequence")
    marked = ranges.withColumn("late", (F.col("at") < F.lag("at").over(inside)).cast("long"))
    parts = marked.groupBy("part").agg(
        F.coalesce(F.sum("late"), F.lit(0)).alias("late"), F.min_by("at", "sequence").alias("first"), F.max_by("at", "sequence").alias("last")
    )
    before = F.lag("last").over(Window.orderBy("part"))
    return parts.select("late", F.coalesce((F.col("first") < before).cast("long"), F.lit(0)).alias("edge")).agg(
        F.coalesce(F.sum(F.col("late") + F.col("edge")), F.lit(0)).alias("out_of_order")
    )


# ---- distributions -------------------------------------------------------------------------------------------------


def group_value(events: DataFrame, name: str) -> Column:
    """The value, for tags an array, of a distribution field; a name that is none of the known ones is an attribute path."""
    known = {
        "severity": "severity", "source_type": "source_type", "event_type": "x_event_type", "parser": "x_parser",
        "parser_name": "x_parser", "host": "x_host", "service": "x_service", "method": "x_method",
        "http_method": "x_method", "endpoint": "x_endpoint",
    }
    if name in ("tag", "tags"):
        return F.filter(F.transform(F.array_distinct("tags"), lambda t: dimension(t)), lambda t: t.isNotNull())
    if name in ("http_status", "status_code"):
        return F.col("x_status").cast("string")
    if name == "status_class":
        return F.when(F.col("x_status").isNotNull(), status_class(F.col("x_status")))
    if name in known:
        return dimension(known[name])
    return dimension(scalar_text(attribute_variant(check_group_field(name))))


def distributions(events: DataFrame, names: tuple[str, ...], top: int = 10, limits: Limits = Limits()) -> DataFrame:
    """The commonest values of each field: field, value, count, percentage and position, and of the field, on each row:
    total_count (events), matched_value_count, missing_count (events without a value), unique_values, other_count (of
    values not shown) and truncated.

    Percentages are of all events, those without the field too. All fields are counted in one scan; only the first
    ``top`` values of each part of a field's values are sorted in one task. Over ``limits.groups`` different values of
    a field are an error, found when the result is made.
    """
    if limits.top is not None and top > limits.top:
        raise RequestError(f"top is at most {limits.top}")
    names = tuple(dict.fromkeys(names))
    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"))

    many = [n for n in names if n in ("tag", "tags")]
    scalars = F.array(pair("", F.lit("")), *(pair(n, group_value(events, n)) for n in names if n not in many))
    lists = [F.when(F.size(t := F.coalesce(group_value(events, n), F.array().cast("array<string>"))) == 0, F.array(pair(n, F.lit(None)))).otherwise(labelled(t, n, "field")) for n in many]
    pairs = F.concat(scalars, *lists) if lists else scalars
    counts = events.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("count"))
    total = counts.filter("field = ''").select(F.col("count").alias("total_count"))
    there = F.when(F.col("value").isNotNull(), F.col("count"))
    of_field = counts.filter("field != ''").groupBy("field").agg(
        F.coalesce(F.sum(there), F.lit(0)).alias("matched_value_count"), F.count(there).alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing_count"),
    )
    if limits.groups is not None:
        message = F.concat(F.lit("too many different values of "), F.col("field"))
        of_field = of_field.withColumn("unique_values", F.when(F.col("unique_values") > limits.groups, F.raise_error(message).cast("long")).otherwise(F.col("unique_values")))
    by_field = Window.partitionBy("field").orderBy(F.desc("count"), F.asc("value"))
    ranked = counts.filter("field != '' and value is not null").withColumn("position", F.row_number().over(by_field)).filter(F.col("position") <= top)
    shown = F.sum("count").over(Window.partitionBy("field"))  # of at most ``top`` rows
    # one row for each asked field, and one in all
    return ranked.withColumn("shown", shown).join(F.broadcast(of_field), "field").join(F.broadcast(total)).select(
        "field", "value", "count", (F.col("count") * 100 / F.col("total_count")).alias("percentage"), "position", "total_count",
        "matched_value_count", "missing_count", "unique_values", (F.col("matched_value_count") - F.col("shown")).alias("other_count"),
        (F.col("unique_values") > top).alias("truncated"),
    )


# ---- percentiles ---------------------------------------------------------------------------------------------------


def percentile_name(p: float) -> str:
    return f"p{p:g}".replace(".", "_")


def wanted(percentiles: tuple[float, ...], method: str) -> Percentiles:
    return {percentile_name(p): (p, method) for p in percentiles}


def descriptive(rows: DataFrame, column: str, percentiles: tuple[float, ...] = (50, 90, 95, 99), method: str = "nearest_rank",
                keys: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """count, min, max, mean, median, population deviation and percentiles of a column for each key, and ``more``."""
    if not more:
        rows = stash(rows.select(*keys, column))
    groups = rows.groupBy(*keys).agg(
        F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"),
        F.stddev_pop(column).alias("stddev"), *more,
    )
    return with_percentiles(groups, rows, column, {"median": (50.0, "linear")} | wanted(percentiles, method), keys)


# ---- timeline ------------------------------------------------------------------------------------------------------

# Bucket sizes in seconds.
LADDER = (1, 5, 10, 30, 60, 300, 900, 1800, 3600, 21_600, 43_200, 86_400)


def choose_bucket(first: datetime | int, last: datetime | int, seconds: int | None, limits: Limits = Limits()) -> tuple[int, bool]:
    """The bucket size for a span (times, or microseconds since 1970), and whether it is wider than the default: an asked
    size that makes too many buckets is an error, the default widens along the ladder."""
    low, high = micros(first), micros(last)

    def count(size: int) -> int:
        return -(-high // (size * 1_000_000)) - low // (size * 1_000_000)

    if seconds is not None:
        if count(seconds) > limits.buckets:
            raise RequestError(f"buckets of {seconds} s make more than {limits.buckets}")
        return seconds, False
    for size in (limits.bucket_seconds, *(s for s in LADDER if s > limits.bucket_seconds)):
        if count(size) <= limits.buckets:
            return size, size != limits.bucket_seconds
    raise RequestError("the time span is too long for any bucket size")


def _at() -> Column:
    return F.unix_micros(F.col("timestamp").cast("timestamp"))


def bounds(events: DataFrame, start: datetime | None, end: datetime | None) -> tuple[int | None, int | None]:
    """First and last (outside) microsecond since 1970: as given, else of the events. Times reach the driver as whole
    numbers, so that its own zone does not matter."""
    low, high = (None if t is None else micros(t) for t in (start, end))
    if low is None or high is None:
        first, last = events.agg(F.min(_at()), F.max(_at())).first()
        low = first if low is None else low
        high = (None if last is None else last + 1) if high is None else high
    return low, high


def timeline(events: DataFrame, seconds: int | None = None, start: datetime | int | None = None, end: datetime | int | None = None,
             condition: Column | None = None, limits: Limits = Limits()) -> DataFrame:
    """One row per epoch-aligned bucket, empty ones included: counts, error rate, average and p95 duration, 5xx.

    ``start`` and ``end`` (outside), times or microseconds since 1970, default to the events' own first and last times.
    """
    rows = events.filter(condition) if condition is not None else events
    # read for bounds, counts and percentiles: what these need is extracted once
    rows = stash(rows.select("timestamp", "severity", "x_duration", "x_status"))
    first, last = bounds(rows, start, end)
    spark = events.sparkSession
    if first is None or last is None:
        spine = spark.range(0).select(F.timestamp_seconds("id").alias("bucket_start"))
        seconds = seconds or limits.bucket_seconds
    else:
        seconds, _ = choose_bucket(first, last, seconds, limits)
        spine = spark.range(first // (seconds * 1_000_000), -(-last // (seconds * 1_000_000)), 1, 1).select(F.timestamp_seconds(F.col("id") * seconds).alias("bucket_start"))
        rows = rows.filter((_at() >= first) & (_at() < last))
    folded = timeline_severity()
    rows = rows.withColumn("bucket_start", floor_time(F.col("timestamp").cast("timestamp"), seconds))
    counted = rows.groupBy("bucket_start").agg(
        F.count(F.lit(1)).alias("event_count"), count_where(folded == "warning").alias("warning_count"),
        count_where(folded == "error").alias("error_count"), count_where(folded == "critical").alias("critical_count"),
        F.avg("x_duration").alias("average_duration_ms"), count_where(F.col("x_status") >= 500).alias("server_error_count"),
    )
    counted = with_percentiles(counted, rows, "x_duration", {"p95_duration_ms": (95, "nearest_rank")}, ("bucket_start",))
    # the spine has at most limits.buckets rows
    out = spine.join(counted, "bucket_start", "left")
    out = out.fillna(0, ["event_count", "warning_count", "error_count", "critical_count", "server_error_count"])
    return out.withColumn("error_rate", ratio(F.col("error_count") + F.col("critical_count"), "event_count"))


def timeline_rollup(buckets: DataFrame) -> DataFrame:
    """One row: buckets, empty ones, largest and average count, the earliest largest bucket."""
    return buckets.agg(
        F.count(F.lit(1)).alias("bucket_count"), count_where(F.col("event_count") == 0).alias("empty_bucket_count"),
        F.max("event_count").alias("max_count"), F.avg("event_count").alias("average_count"),
        F.min_by("bucket_start", F.struct(-F.col("event_count"), F.col("bucket_start"))).alias("peak_start"),
    )


def coarsen(buckets: DataFrame, points: int = 120) -> DataFrame:
    """At most ``points`` rows: neighbours summed, error rates taken anew, durations left out."""
    order = Window.orderBy("bucket_start")
    numbered = buckets.withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    step = F.ceil(F.col("n") / points)
    counts = ("event_count", "warning_count", "error_count", "critical_count", "server_error_count")
    out = numbered.groupBy(F.floor(F.col("k") / step).alias("k")).agg(F.min("bucket_start").alias("bucket_start"), *(F.sum(c).alias(c) for c in counts))
    return out.drop("k").withColumn("error_rate", ratio(F.col("error_count") + F.col("critical_count"), "event_count"))


# ---- latency -------------------------------------------------------------------------------------------------------

# Upper bounds, outside, of the latency histogram in ms; the last bucket has none.
HISTOGRAM = (10, 50, 100, 250, 500, 1000, 2000, 5000, 10_000)


def latency(events: DataFrame, percentiles: tuple[float, ...] = (50, 90, 95, 99), method: str = "nearest_rank") -> DataFrame:
    """One row: samples, events without and with invalid durations, statistics, percentiles, commonest field."""
    events = stash(events.select("x_duration", "x_duration_invalid", "x_duration_field"))  # read three times
    row = descriptive(
        events, "x_duration", percentiles, method,
        more=(count_where(F.col("x_duration").isNull() & ~F.col("x_duration_invalid")).alias("missing_count"), count_where(F.col("x_duration_invalid")).alias("invalid_count")),
    )
    fields = events.filter("x_duration_field is not null").groupBy("x_duration_field").count()
    # of equals the one that is looked for first
    place = F.array_position(F.array(*map(F.lit, DURATIONS)), F.col("x_duration_field"))
    best = fields.orderBy(F.desc("count"), place, F.asc("x_duration_field")).limit(1).select(F.col("x_duration_field").alias("detected_field"))
    return row.join(best, how="left")


def histogram(events: DataFrame) -> DataFrame:
    """All ten latency buckets: position, lower and upper bound, count and percentage of samples."""
    bounds = F.array(*(F.lit(float(b)) for b in HISTOGRAM))
    place = F.size(F.filter(bounds, lambda b: b <= F.col("x_duration")))
    counted = events.filter("x_duration is not null").groupBy(place.alias("position")).agg(F.count(F.lit(1)).alias("count"))
    low, high = [0.0, *map(float, HISTOGRAM)], [*map(float, HISTOGRAM), None]
    spine = events.sparkSession.createDataFrame(list(zip(range(10), low, high, strict=True)), "position int, lower_ms double, upper_ms double")
    out = spine.join(counted, "position", "left").fillna(0, ["count"])
    return out.withColumn("percentage", ratio(F.col("count") * 100, F.sum("count").over(Window.partitionBy())))


def slowest(events: DataFrame, top: int = 10) -> DataFrame:
    """The events of longest duration, then earliest, and their position."""
    order = [F.desc("x_duration"), F.asc("timestamp"), F.asc("sequence"), F.asc("id")]
    head = events.filter("x_duration is not null").orderBy(*order).limit(top)
    return head.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def latency_by(events: DataFrame, key: str, top: int = 10) -> DataFrame:
    """Of the keys with most samples: count, min, max, mean and p95. Percentiles are taken of these keys alone."""
    rows = stash(events.filter("x_duration is not null").select(dimension(key).alias("key"), "x_duration").filter("key is not null"))
    order = [F.desc("sample_count"), F.asc("key")]
    chosen = rows.groupBy("key").agg(F.count(F.lit(1)).alias("sample_count")).orderBy(*order).limit(top)
    chosen = chosen.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    # at most ``top`` keys
    kept = rows.join(F.broadcast(chosen), "key")
    groups = kept.groupBy("key", "sample_count", "position").agg(
        F.min("x_duration").alias("min"), F.max("x_duration").alias("max"), F.avg("x_duration").alias("mean")
    )
    return with_percentiles(groups, kept, "x_duration", {"p95": (95, "nearest_rank")}, ("key",))


# ---- HTTP ----------------------------------------------------------------------------------------------------------


def http_events(events: DataFrame) -> DataFrame:
    return events.filter("x_http")


def http_summary(events: DataFrame) -> DataFrame:
    """One row over HTTP events: counts by status class and rates of all HTTP events."""
    s = F.col("x_status")
    row = http_events(events).agg(
        F.count(F.lit(1)).alias("http_event_count"), F.count("x_status").alias("with_status_count"),
        *(count_where(F.floor(s / 100) == k).alias(f"status_{k}xx") for k in range(1, 6)),
    )
    return row.withColumns(
        {
            "unknown_count": F.col("http_event_count") - F.col("with_status_count"),
            "non_error_count": F.col("status_1xx") + F.col("status_2xx") + F.col("status_3xx"),
            "client_error_rate": ratio("status_4xx", "http_event_count"),
            "server_error_rate": ratio("status_5xx", "http_event_count"),
            "error_rate": ratio(F.col("status_4xx") + F.col("status_5xx"), "http_event_count"),
            "missing_status_data": ratio(F.col("http_event_count") - F.col("with_status_count"), "http_event_count") > 0.5,
        }
    )


def endpoints(events: DataFrame) -> DataFrame:
    """One row per endpoint: requests, share, errors, samples, average and longest duration, methods, services, times."""
    http = http_events(events)
    total = http.agg(F.count(F.lit(1)).alias("total"))
    s = F.col("x_status")
    by = http.filter("x_endpoint is not null").groupBy(dimension("x_endpoint").alias("endpoint")).agg(
        F.count(F.lit(1)).alias("requests"), count_where(s.between(400, 499)).alias("client_errors"), count_where(s >= 500).alias("server_errors"),
        F.count("x_duration").alias("samples"), F.avg("x_duration").alias("average_ms"), F.max("x_duration").alias("max_ms"),
        F.array_sort(F.collect_set("x_method")).alias("methods"), F.array_sort(F.collect_set(dimension("x_service"))).alias("services"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )
    return by.join(F.broadcast(total)).withColumns(
        {"percentage": F.col("requests") * 100 / F.col("total"), "error_rate": ratio(F.col("client_errors") + F.col("server_errors"), "requests")}
    ).drop("total")


def endpoint_p95(groups: DataFrame, events: DataFrame) -> DataFrame:
    """Adds p95_ms of the durations of each endpoint."""
    rows = http_events(events).filter("x_endpoint is not null and x_duration is not null").select(dimension("x_endpoint").alias("endpoint"), "x_duration")
    return with_percentiles(groups, rows, "x_duration", {"p95_ms": (95, "nearest_rank")}, ("endpoint",))


def _top(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    return rows.orderBy(*order).limit(top).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def _detailed(chosen: DataFrame, events: DataFrame, top: int, p95: bool) -> DataFrame:
    """Adds top_status_codes (code, count) and, if ``p95`` is asked for, p95_ms to a few endpoints."""
    # at most ``top`` endpoints
    rows = http_events(events).withColumn("endpoint", dimension("x_endpoint")).join(F.broadcast(chosen.select("endpoint")), "endpoint", "left_semi")
    codes = rows.filter("x_status is not null").groupBy("endpoint", F.col("x_status").cast("string").alias("code")).count()
    first = Window.partitionBy("endpoint").orderBy(F.desc("count"), F.asc("code"))
    codes = codes.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= top)
    codes = codes.groupBy("endpoint").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "code", "count"))), lambda c: F.struct(c["code"].alias("code"), c["count"].alias("count"))).alias("top_status_codes"))
    out = chosen.join(codes, "endpoint", "left")
    return with_percentiles(out, rows, "x_duration", {"p95_ms": (95, "nearest_rank")}, ("endpoint",)) if p95 else out


def _requests(events: DataFrame) -> DataFrame:
    """What reports of endpoints read, extracted once."""
    return stash(http_events(events).select("x_http", "x_endpoint", "x_status", "x_duration", "x_method", "x_service", "timestamp"))


def busiest_endpoints(events: DataFrame, top: int = 10) -> DataFrame:
    events = _requests(events)
    return _detailed(_top(endpoints(events), [F.desc("requests"), F.asc("endpoint")], top), events, top, True)


def slowest_endpoints(events: DataFrame, top: int = 10, samples: int = 5) -> DataFrame:
    events = _requests(events)
    rows = endpoint_p95(endpoints(events).filter(F.col("samples") >= samples), events)
    return _detailed(_top(rows, [F.desc("p95_ms"), F.desc("average_ms"), F.desc("requests"), F.asc("endpoint")], top), events, top, False)


def failing_endpoints(events: DataFrame, top: int = 10, requests: int = 10) -> DataFrame:
    events = _requests(events)
    rows = endpoints(events).filter((F.col("requests") >= requests) & (F.col("error_rate") > 0))
    return _detailed(_top(rows, [F.desc("error_rate"), F.desc("requests"), F.asc("endpoint")], top), events, top, True)


def http_distributions(events: DataFrame, top: int = 10, limits: Limits = Limits()) -> DataFrame:
    """``distributions`` of status class, status code, method and endpoint over HTTP events."""
    return distributions(http_events(events), ("status_class", "status_code", "http_method", "endpoint"), top, limits)


def status_by(events: DataFrame, key: str, top: int = 10) -> DataFrame:
    """Status classes by method or service."""
    s = F.col("x_status")
    rows = http_events(events).select(dimension(key).alias("key"), s).filter("key is not null").groupBy("key").agg(
        F.count(F.lit(1)).alias("total"), *(count_where(F.floor(s / 100) == k).alias(f"status_{k}xx") for k in range(1, 6)), count_where(s.isNull()).alias("unknown"),
    ).withColumn("error_rate", ratio(F.col("status_4xx") + F.col("status_5xx"), "total"))
    return _top(rows, [F.desc("total"), F.asc("key")], top)


# ---- samples -------------------------------------------------------------------------------------------------------


def even_sample(events: DataFrame, k: int) -> DataFrame:
    """k events spread evenly over the sequence: those at places floor(i * n / k).

    Places are found from running counts of sequence ranges, so no task holds all events; only the order's columns are
    sorted. Events are ordered by sequence, then id.
    """
    order = ["sequence", "id"]
    placed = numbered(events.select(*order), order, "_n").withColumn("_n", F.col("_n") - 1)
    total = F.col("_total")
    # a place is taken if some i has floor(i * n / k) = place
    i = F.ceil(F.col("_n") * F.lit(k) / total)
    hit = (F.floor(i * total / F.lit(k)) == F.col("_n")) & (i < k)
    totals = placed.agg(F.coalesce(F.max("_n") + 1, F.lit(0)).alias("_total"))
    chosen = placed.join(F.broadcast(totals)).filter((total <= k) | hit).select(*order)
    return events.join(F.broadcast(chosen), order, "left_semi")  # k rows


def hash_sample(events: DataFrame, k: int) -> DataFrame:
    """The k events of least SHA-256 of content hash, id and sequence."""
    name = F.concat_ws(":", "content_hash", "id", F.col("sequence").cast("string"))
    return events.withColumn("sample_key", F.sha2(name, 256)).orderBy("sample_key").limit(k)
