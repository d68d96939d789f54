"""The engine's operators as queries over the given tables, each with SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.extract import EXTRACTS, with_extracts
from .functions.text import dimension, fold_case, once, preview
from .operators import comparison, parse, query, reports, store
from .operators.filters import apply_filter
from .plans.requests import Aggregation, ComparisonRequest, EventFilter, EventQuery, EventSort, Limits
from .sources.parsers import Registry
from .sources.shared import dealt_by_rows, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A canonical view of the events table, the same text in both engines.
CANONICAL = {
    "event_id": "event_id",
    "id": "concat('evt_', event_id)",
    "sequence": "event_id - event_id % 4 + CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 2 END",
    "timestamp": "CAST(ts AS TIMESTAMP)",
    "severity": "CASE event_type WHEN 'error' THEN CASE WHEN user_id % 5 = 0 THEN 'fatal' WHEN user_id % 3 = 0 THEN 'critical' ELSE 'error' END "
    "WHEN 'purchase' THEN 'notice' WHEN 'signup' THEN 'warning' WHEN 'click' THEN 'debug' ELSE 'info' END",
    "source_type": "CASE WHEN user_id % 4 = 0 THEN 'nginx' ELSE 'application' END",
    "event_type": "event_type",
    "message": "concat(event_type, ' of user ', user_id)",
    "host": "CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('host', user_id % 7) END",
    "service": "concat('svc', user_id % 5)",
    "user_id": "concat('u', user_id)",
    "client_ip": "concat('10.0.', user_id % 9, '.', user_id)",
    "correlation_id": "concat('c', event_id % 1000)",
    "duration_ms": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END",
    "http_status": "CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 302 WHEN 3 THEN 404 WHEN 4 THEN 500 WHEN 5 THEN 503 ELSE NULL END",
    "http_method": "CASE event_id % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'POST' ELSE NULL END",
    "http_path": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('/api/', event_type, CASE WHEN user_id % 2 = 0 THEN '/' ELSE '' END, '?u=', user_id) END",
    "attributes_json": "concat(substr(props, 1, length(props) - 1), ', \"parser_name\": \"p', user_id % 3, '\"', CASE WHEN event_id % 26 = 0 THEN concat(', \"latency_ms\": ', value) ELSE '' END, "
    "CASE WHEN user_id % 7 = 0 THEN ', \"gone\": null' ELSE '' END, '}')",
    "estimated_size_bytes": "CAST(100 + event_id % 50 AS BIGINT)",
    "content": "concat(event_type, '|', user_id % 50, '|', event_id % 97)",
}


def canonical(spark: SparkSession, sf_dir: str, dealt: bool = False, costly: bool = False) -> DataFrame:
    """The view; ``dealt`` to all cores, or for ``costly`` work such as parsing, to tasks of so many rows."""
    rows = table(spark, sf_dir, "events")
    rows = (dealt_by_rows(rows) if costly else spread(rows) if dealt else rows).selectExpr(*(f"{e} AS {n}" for n, e in CANONICAL.items()), "concat('t', user_id % 3) AS tag")
    return rows.withColumns(
        {"tags": F.array("tag", "event_type"), "attributes": F.parse_json("attributes_json"), "content_hash": F.sha2(F.col("content").cast("binary"), 256)}
    ).drop("tag", "attributes_json", "content")


def extracted(spark: SparkSession, sf_dir: str, *only: str, dealt: bool = False) -> DataFrame:
    """The canonical view with what its reports read, or with some of it; ``dealt`` to all cores where only counts are
    made of it (sums of doubles depend on the order in their last digit, which rounding can show)."""
    return with_extracts(canonical(spark, sf_dir, dealt), only=only or EXTRACTS)


EV = (
    "WITH ev AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CANONICAL.items())
    + ", [concat('t', user_id % 3), event_type] AS tags, concat('p', user_id % 3) AS parser_name FROM events), "
    "x AS (SELECT *, sha256(content) AS content_hash, CASE WHEN event_id % 13 = 0 THEN CAST(json_extract_string(attributes_json, '$.latency_ms') AS DOUBLE) ELSE duration_ms END AS x_duration, "
    "CASE WHEN event_id % 26 = 0 THEN 'latency_ms' WHEN event_id % 13 != 0 THEN 'duration_ms' END AS x_field, "
    "CASE WHEN http_path IS NOT NULL THEN concat('/api/', event_type) END AS x_endpoint, upper(http_method) AS x_method, http_status AS x_status, "
    "(source_type = 'nginx' OR http_status IS NOT NULL OR http_method IS NOT NULL OR http_path IS NOT NULL) AS x_http, "
    "CASE severity WHEN 'notice' THEN 'info' WHEN 'fatal' THEN 'critical' ELSE severity END AS folded FROM ev) "
)


def register(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- dashboard -----------------------------------------------------------------------------------------------------


@register(
    "dashboard",
    EV + """, g AS (SELECT 'severity' AS panel, severity AS key, count(*) AS n FROM x GROUP BY severity UNION ALL SELECT 'parser', parser_name, count(*) FROM x GROUP BY parser_name),
    r AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY n DESC, key) AS position FROM g) SELECT panel, key, n, CAST(position AS INT) AS position FROM r WHERE position <= 10""",
)
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = query.facets(canonical(spark, sf_dir), ("severity", "parser_name"), Limits(facet_values=10))
    panel = F.when(F.col("facet") == "parser_name", "parser").otherwise(F.col("facet"))
    return rows.select(panel.alias("panel"), F.col("value").alias("key"), F.col("count").alias("n"), "position")


# ---- filters -------------------------------------------------------------------------------------------------------

START, END = datetime(2024, 1, 5), datetime(2024, 1, 12, 12)
FILTERS: dict[str, tuple[EventFilter, str]] = {
    "event_ids": (EventFilter(event_ids=("evt_3", "evt_77", "evt_500")), "id IN ('evt_3', 'evt_77', 'evt_500')"),
    "exclude_ids": (EventFilter(exclude_event_ids=("evt_3", "evt_77")), "id NOT IN ('evt_3', 'evt_77')"),
    "time_range": (EventFilter(start_time=START, end_time=END), "timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-12 12:00:00'"),
    "severities": (EventFilter(severities=("ERROR", "fatal")), "severity IN ('error', 'fatal')"),
    "source_types": (EventFilter(source_types=("nginx",)), "source_type = 'nginx'"),
    "event_types": (EventFilter(event_types=("click", "view")), "event_type IN ('click', 'view')"),
    "parser_names": (EventFilter(parser_names=("p1",)), "parser_name = 'p1'"),
    "hosts": (EventFilter(hosts=("host1", "host2")), "host IN ('host1', 'host2')"),
    "services": (EventFilter(services=("svc3",)), "service = 'svc3'"),
    "client_ips": (EventFilter(client_ips=("10.0.1.10", "10.0.2.20")), "client_ip IN ('10.0.1.10', '10.0.2.20')"),
    "user_ids": (EventFilter(user_ids=("u7", "u8")), "user_id IN ('u7', 'u8')"),
    "correlation_ids": (EventFilter(correlation_ids=("c5",)), "correlation_id = 'c5'"),
    "tags_any": (EventFilter(tags_any=("t1", "signup")), "list_has_any(tags, ['t1', 'signup'])"),
    "tags_all": (EventFilter(tags_all=("t1", "signup")), "list_has_all(tags, ['t1', 'signup'])"),
    "message_contains": (EventFilter(message_contains="USER 14"), "contains(lower(message), 'user 14')"),
    "message_contains_exact": (EventFilter(message_contains="of user 14", case_sensitive=True), "contains(message, 'of user 14')"),
    "attribute_exists": (EventFilter(attribute_exists=("gone", "k")), "json_exists(attributes_json, '$.gone') AND json_exists(attributes_json, '$.k')"),
    "attribute_number": (EventFilter(attribute_equals={"k": 7.0}), "json_extract_string(attributes_json, '$.k') = '7'"),
    "attribute_text": (EventFilter(attribute_equals={"parser_name": "p2"}), "parser_name = 'p2'"),
    "attribute_null": (EventFilter(attribute_equals={"gone": None}), "json_type(attributes_json, '$.gone') = 'NULL'"),
    "attribute_kind": (EventFilter(attribute_equals={"k": "7"}), "false"),
    "combined": (
        EventFilter(start_time=START, severities=("error", "critical"), services=("svc1", "svc2"), tags_any=("t0", "t1"), message_contains="error"),
        "timestamp >= TIMESTAMP '2024-01-05' AND severity IN ('error', 'critical') AND service IN ('svc1', 'svc2') AND list_has_any(tags, ['t0', 't1']) AND contains(message, 'error')",
    ),
}
for _name, (_filter, _where) in FILTERS.items():
    register(f"filter_{_name}", EV + f"SELECT id, sequence, severity FROM x WHERE {_where}")(
        lambda spark, sf_dir, f=_filter: apply_filter(canonical(spark, sf_dir), f).select("id", "sequence", "severity")
    )


@register("filter_text_folded", "SELECT doc_id FROM documents WHERE contains(replace(lower(text), 'ß', 'ss'), 'strasse') OR contains(replace(lower(text), 'ß', 'ss'), 'sssch')")
def filter_text_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = once(dealt_by_rows(table(spark, sf_dir, "documents").select("doc_id", "text")), {"folded": fold_case("text")})
    hit = F.contains("folded", fold_case(F.lit("STRASSE"))) | F.contains("folded", fold_case(F.lit("ßsch")))
    return docs.filter(hit).select("doc_id")


# ---- order and pages -----------------------------------------------------------------------------------------------

_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(("trace", "debug", "info", "notice", "warning", "error", "critical", "fatal", "unknown"), 1)) + " END"
SORTS = {
    "default": ((), 0, "timestamp DESC NULLS LAST, sequence DESC"),
    "severity": ((EventSort("severity"), EventSort("timestamp", False)), 0, f"{_RANK} DESC NULLS LAST, timestamp ASC NULLS LAST, sequence DESC"),
    "host_up": ((EventSort("host", False),), 50, "host ASC NULLS LAST, sequence DESC"),
    "host_down": ((EventSort("host"), EventSort("event_type", False)), 20, "host DESC NULLS LAST, event_type ASC NULLS LAST, sequence DESC"),
    "sequence_up": ((EventSort("sequence", False),), 900, "sequence ASC"),
}
for _name, (_sort, _offset, _order) in SORTS.items():
    register(
        f"page_{_name}",
        EV + f", r AS (SELECT id, severity, host, CAST(row_number() OVER (ORDER BY {_order}) AS INT) AS position FROM x) SELECT * FROM r WHERE position > {_offset} AND position <= {_offset + 100}",
    )(lambda spark, sf_dir, s=_sort, o=_offset: query.ranked_page(canonical(spark, sf_dir), EventQuery(sort=s, offset=o, limit=100)).select("id", "severity", "host", "position"))

# ---- facets and aggregation ----------------------------------------------------------------------------------------

_FACETS = {"severity": "severity", "source_type": "source_type", "event_type": "event_type", "parser_name": "parser_name", "host": "host", "service": "service"}
_FACET_SQL = " UNION ALL ".join([f"SELECT '{n}' AS facet, {c} AS value, count(*) AS count FROM x WHERE {c} IS NOT NULL GROUP BY {c}" for n, c in _FACETS.items()] + ["SELECT 'tags', tag, count(*) FROM (SELECT unnest(tags) AS tag FROM x) GROUP BY tag"])


@register("facets", EV + f", g AS ({_FACET_SQL}) SELECT facet, value, count, CAST(row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS INT) AS position FROM g")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.facets(canonical(spark, sf_dir), (*_FACETS, "tags"))


_METRIC_SQL = {
    "count": ("CAST(count(*) AS DOUBLE)", "CAST(NULL AS BIGINT)"),
    "sum_duration_ms": ("round(coalesce(sum(duration_ms), 0), 6)", "count(duration_ms)"),
    "average_duration_ms": ("round(avg(duration_ms), 6)", "count(duration_ms)"),
}
for _group, _key in {**_FACETS, "tag": "tag", "time_bucket": "strftime(time_bucket(INTERVAL 3600 SECONDS, timestamp), '%Y-%m-%dT%H:%M:%S+00:00')"}.items():
    for _metric, (_value, _samples) in _METRIC_SQL.items():
        if _group == "tag" and _metric != "count":
            continue
        _from = "(SELECT unnest(tags) AS tag, duration_ms FROM x)" if _group == "tag" else "x"
        _order = "key" if _group == "time_bucket" else "value DESC NULLS LAST, key"
        _times = ", min(time_bucket(INTERVAL 3600 SECONDS, timestamp)) AS bucket_start, min(time_bucket(INTERVAL 3600 SECONDS, timestamp)) + INTERVAL 1 HOUR AS bucket_end" if _group == "time_bucket" else ""
        register(
            f"aggregate_{_group}_{_metric}",
            EV + f", g AS (SELECT {_key} AS key, {_value} AS value, {_samples} AS sample_count{_times} FROM {_from} WHERE {_key} IS NOT NULL GROUP BY 1), "
            f"r AS (SELECT *, CAST(row_number() OVER (ORDER BY {_order}) AS INT) AS position FROM g) SELECT * FROM r WHERE position <= 1000",
        )(
            lambda spark, sf_dir, g=_group, m=_metric: rounded(
                ntz(query.aggregate(canonical(spark, sf_dir), Aggregation(g, m, 3600 if g == "time_bucket" else None, 1000)), *(("bucket_start", "bucket_end") if g == "time_bucket" else ())), "value"
            )
        )

# ---- analysis ------------------------------------------------------------------------------------------------------


@register(
    "summary",
    EV + """SELECT count(*) AS event_count, 0 AS trace_count, count(*) FILTER (folded = 'debug') AS debug_count, count(*) FILTER (folded = 'info') AS info_count,
    count(*) FILTER (folded = 'warning') AS warning_count, count(*) FILTER (folded = 'error') AS error_count, count(*) FILTER (folded = 'critical') AS critical_count, 0 AS unknown_count,
    count(DISTINCT event_type) AS distinct_event_types, count(DISTINCT service) AS distinct_services, count(DISTINCT host) AS distinct_hosts, count(DISTINCT parser_name) AS distinct_parsers,
    count(DISTINCT source_type) AS distinct_source_types, count(*) - count(DISTINCT content) AS duplicate_content_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
    count(x_duration) AS duration_count, count(x_status) AS status_count, round(count(*) FILTER (folded IN ('error', 'critical')) / count(*), 6) AS error_rate,
    round(count(*) FILTER (folded = 'critical') / count(*), 6) AS critical_rate, round(epoch_us(max(timestamp)) / 1e6 - epoch_us(min(timestamp)) / 1e6, 6) AS span_seconds,
    round(count(*) / (epoch_us(max(timestamp)) / 1e6 - epoch_us(min(timestamp)) / 1e6), 6) AS events_per_second,
    round(count(*) * 60 / (epoch_us(max(timestamp)) / 1e6 - epoch_us(min(timestamp)) / 1e6), 6) AS events_per_minute FROM x""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = reports.summary(extracted(spark, sf_dir, "x_duration", "x_status", "x_event_type", "x_service", "x_host", "x_parser", dealt=True))
    return rounded(ntz(row, "first_seen", "last_seen"), "error_rate", "critical_rate", "span_seconds", "events_per_second", "events_per_minute")


@register("out_of_order", EV + "SELECT count(*) AS out_of_order FROM (SELECT timestamp, lag(timestamp) OVER (ORDER BY sequence) AS before FROM x) WHERE timestamp < before")
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.out_of_order(canonical(spark, sf_dir))


_FIELDS = {
    "severity": "severity", "source_type": "source_type", "event_type": "event_type", "parser": "parser_name", "host": "host", "service": "service",
    "http_method": "x_method", "http_status": "CAST(x_status AS VARCHAR)", "status_class": "CASE WHEN x_status IS NOT NULL THEN concat(x_status // 100, 'xx') END", "k": "json_extract_string(attributes_json, '$.k')",
}
_DIST = " UNION ALL ".join([f"SELECT '{n}' AS field, {c} AS value FROM x WHERE {c} IS NOT NULL" for n, c in _FIELDS.items()] + ["SELECT 'tags', unnest(tags) FROM x"])


@register(
    "distributions",
    EV + f""", p AS ({_DIST}), g AS (SELECT field, value, count(*) AS count FROM p GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS INT) AS position, count(*) OVER (PARTITION BY field) AS unique_values, CAST(sum(count) OVER (PARTITION BY field) AS BIGINT) AS matched_value_count FROM g)
    SELECT field, value, count, round(count * 100 / (SELECT count(*) FROM x), 6) AS percentage, position, (SELECT count(*) FROM x) AS total_count, matched_value_count,
    CASE WHEN field = 'tags' THEN 0 ELSE (SELECT count(*) FROM x) - matched_value_count END AS missing_count, unique_values,
    CAST(matched_value_count - sum(count) OVER (PARTITION BY field) AS BIGINT) AS other_count, unique_values > 5 AS truncated FROM r WHERE position <= 5""",
)
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.distributions(extracted(spark, sf_dir, "x_status", "x_method", "x_event_type", "x_service", "x_host", "x_parser", dealt=True), (*_FIELDS, "tags"), 5), "percentage")


for _method, _fn in {"nearest_rank": "quantile_disc", "linear": "quantile_cont"}.items():

    @register(
        f"percentiles_{_method}",
        EV + "SELECT event_type, count(x_duration) AS count, min(x_duration) AS min, max(x_duration) AS max, round(avg(x_duration), 6) AS mean, round(median(x_duration), 6) AS median, "
        "round(stddev_pop(x_duration), 6) AS stddev, " + ", ".join(f"round({_fn}(x_duration, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99)) + " FROM x GROUP BY event_type",
    )
    def percentiles(spark: SparkSession, sf_dir: str, method: str = _method) -> DataFrame:
        rows = reports.descriptive(extracted(spark, sf_dir, "x_duration"), "x_duration", (50, 90, 95, 99), method, ("event_type",))
        return rounded(rows, "mean", "median", "stddev", "p50", "p90", "p95", "p99")


_SPINE = """, spine AS (SELECT unnest(generate_series(time_bucket(INTERVAL 3600 SECONDS, {low}), {high}, INTERVAL 3600 SECONDS)) AS bucket_start),
    g AS (SELECT time_bucket(INTERVAL 3600 SECONDS, timestamp) AS b, count(*) AS n, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'error') AS e,
    count(*) FILTER (severity IN ('critical', 'fatal')) AS c, avg(x_duration) AS a, quantile_disc(x_duration, 0.95) AS p, count(*) FILTER (x_status >= 500) AS s FROM x WHERE {where} GROUP BY 1),
    t AS (SELECT bucket_start, coalesce(n, 0) AS event_count, coalesce(w, 0) AS warning_count, coalesce(e, 0) AS error_count, coalesce(c, 0) AS critical_count, round(a, 6) AS average_duration_ms, round(p, 6) AS p95_duration_ms,
    coalesce(s, 0) AS server_error_count, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE (e + c) / n END, 6) AS error_rate FROM spine LEFT JOIN g ON bucket_start = b) """
_ALL = _SPINE.format(low="(SELECT min(timestamp) FROM x)", high="(SELECT max(timestamp) FROM x)", where="true")
_HTTP = _SPINE.format(low="(SELECT min(timestamp) FROM x WHERE x_http)", high="(SELECT max(timestamp) FROM x WHERE x_http)", where="x_http")
_BUCKETS = ("event_count", "warning_count", "error_count", "critical_count", "server_error_count")


@register("timeline", EV + _ALL + "SELECT * FROM t")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.timeline(extracted(spark, sf_dir, "x_duration", "x_status"), 3600)
    return rounded(ntz(rows, "bucket_start"), "average_duration_ms", "p95_duration_ms", "error_rate")


@register("timeline_http", EV + _HTTP + "SELECT * FROM t")
def timeline_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.timeline(extracted(spark, sf_dir, "x_duration", "x_http"), 3600, condition=F.col("x_http"))
    return rounded(ntz(rows, "bucket_start"), "average_duration_ms", "p95_duration_ms", "error_rate")


@register(
    "timeline_rollup",
    EV + _HTTP + "SELECT count(*) AS bucket_count, count(*) FILTER (event_count = 0) AS empty_bucket_count, max(event_count) AS max_count, round(avg(event_count), 6) AS average_count, "
    "(SELECT min(bucket_start) FROM t WHERE event_count = (SELECT max(event_count) FROM t)) AS peak_start FROM t",
)
def timeline_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ntz(reports.timeline_rollup(timeline_http(spark, sf_dir)), "peak_start"), "average_count")


#: The same by the day.
_HTTP_ALL = _HTTP.replace("3600 SECONDS", "86400 SECONDS")


@register("timeline_http_all", EV + _HTTP_ALL + "SELECT * FROM t")
def timeline_http_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.timeline(extracted(spark, sf_dir, "x_duration", "x_http"), 86_400, condition=F.col("x_http"))
    return rounded(ntz(rows, "bucket_start"), "average_duration_ms", "p95_duration_ms", "error_rate")


@register("timeline_rollup_all", ORACLES["timeline_rollup"].replace(_HTTP, _HTTP_ALL))
def timeline_rollup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ntz(reports.timeline_rollup(timeline_http_all(spark, sf_dir)), "peak_start"), "average_count")


@register(
    "timeline_coarse",
    EV + _ALL + """, k AS (SELECT *, row_number() OVER (ORDER BY bucket_start) - 1 AS i, count(*) OVER () AS n FROM t)
    SELECT min(bucket_start) AS bucket_start, """ + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _BUCKETS) + """,
    round(coalesce(sum(error_count + critical_count) / nullif(sum(event_count), 0), 0), 6) AS error_rate FROM k GROUP BY i // CAST(ceil(n / 120) AS BIGINT)""",
)
def timeline_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ntz(reports.coarsen(reports.timeline(extracted(spark, sf_dir, "x_duration", "x_status"), 3600)), "bucket_start"), "error_rate")


@register(
    "latency",
    EV + "SELECT count(x_duration) AS count, min(x_duration) AS min, max(x_duration) AS max, round(avg(x_duration), 6) AS mean, round(median(x_duration), 6) AS median, round(stddev_pop(x_duration), 6) AS stddev, "
    + ", ".join(f"round(quantile_disc(x_duration, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99))
    + ", count(*) FILTER (x_duration IS NULL) AS missing_count, CAST(0 AS BIGINT) AS invalid_count, (SELECT x_field FROM x WHERE x_field IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS detected_field FROM x",
)
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.latency(extracted(spark, sf_dir, "x_duration")), "mean", "median", "stddev", "p50", "p90", "p95", "p99")


_EDGES = (0, *reports.HISTOGRAM)
_PLACES = "CASE " + " ".join(f"WHEN x_duration < {b} THEN {k}" for k, b in enumerate(reports.HISTOGRAM)) + " ELSE 9 END"


@register(
    "latency_histogram",
    EV + f", g AS (SELECT {_PLACES} AS position, count(*) AS n FROM x WHERE x_duration IS NOT NULL GROUP BY 1), s AS (SELECT CAST(position AS INT) AS position, lower_ms, upper_ms FROM (VALUES "
    + ", ".join(f"({k}, {float(a)}, {float(_EDGES[k + 1]) if k < 9 else 'CAST(NULL AS DOUBLE)'})" for k, a in enumerate(_EDGES))
    + ") AS v(position, lower_ms, upper_ms)) SELECT s.position, CAST(lower_ms AS DOUBLE) AS lower_ms, CAST(upper_ms AS DOUBLE) AS upper_ms, coalesce(n, 0) AS count, round(coalesce(n, 0) * 100 / (SELECT count(x_duration) FROM x), 6) AS percentage FROM s LEFT JOIN g ON s.position = g.position",
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.histogram(extracted(spark, sf_dir, "x_duration")), "percentage")


@register("slowest_events", EV + ", r AS (SELECT id, x_duration AS duration, CAST(row_number() OVER (ORDER BY x_duration DESC, timestamp, sequence, id) AS INT) AS position FROM x WHERE x_duration IS NOT NULL) SELECT * FROM r WHERE position <= 25")
def slowest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.slowest(extracted(spark, sf_dir, "x_duration"), 25).select("id", F.col("x_duration").alias("duration"), "position")


for _name, _col in {"service": "service", "event_type": "event_type", "endpoint": "x_endpoint"}.items():
    register(
        f"latency_by_{_name}",
        EV + f", g AS (SELECT {_col} AS key, count(*) AS sample_count, min(x_duration) AS min, max(x_duration) AS max, round(avg(x_duration), 6) AS mean, quantile_disc(x_duration, 0.95) AS p95 FROM x WHERE x_duration IS NOT NULL AND {_col} IS NOT NULL GROUP BY 1), "
        "r AS (SELECT *, CAST(row_number() OVER (ORDER BY sample_count DESC, key) AS INT) AS position FROM g) SELECT * FROM r WHERE position <= 3",
    )(lambda spark, sf_dir, k=f"x_{_name}": rounded(reports.latency_by(extracted(spark, sf_dir, "x_duration", k), k, 3), "mean"))


@register(
    "http_summary",
    EV + "SELECT count(*) AS http_event_count, count(x_status) AS with_status_count, " + ", ".join(f"count(*) FILTER (x_status // 100 = {k}) AS status_{k}xx" for k in range(1, 6))
    + ", count(*) - count(x_status) AS unknown_count, count(*) FILTER (x_status < 400) AS non_error_count, round(count(*) FILTER (x_status // 100 = 4) / count(*), 6) AS client_error_rate, "
    "round(count(*) FILTER (x_status // 100 = 5) / count(*), 6) AS server_error_rate, round(count(*) FILTER (x_status >= 400) / count(*), 6) AS error_rate, count(*) - count(x_status) > 0.5 * count(*) AS missing_status_data FROM x WHERE x_http",
)
def http_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.http_summary(extracted(spark, sf_dir, "x_http")), "client_error_rate", "server_error_rate", "error_rate")


_ENDPOINTS = """, e AS (SELECT x_endpoint AS endpoint, count(*) AS requests, count(*) FILTER (x_status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (x_status >= 500) AS server_errors, count(x_duration) AS samples,
    round(avg(x_duration), 6) AS average_ms, quantile_disc(x_duration, 0.95) AS p95_ms, max(x_duration) AS max_ms, array_to_string(list_sort(list(DISTINCT x_method) FILTER (x_method IS NOT NULL)), ',') AS methods,
    array_to_string(list_sort(list(DISTINCT service)), ',') AS services, min(timestamp) AS first_seen, max(timestamp) AS last_seen, round(count(*) * 100 / (SELECT count(*) FROM x WHERE x_http), 6) AS percentage,
    round(count(*) FILTER (x_status >= 400) / count(*), 6) AS error_rate FROM x WHERE x_http AND x_endpoint IS NOT NULL GROUP BY 1),
    c AS (SELECT endpoint, string_agg(concat(x_status, ':', n), ',' ORDER BY k) AS top_status_codes FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY n DESC, CAST(x_status AS VARCHAR)) AS k FROM
    (SELECT x_endpoint AS endpoint, x_status, count(*) AS n FROM x WHERE x_http AND x_status IS NOT NULL GROUP BY 1, 2)) WHERE k <= 4 GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS position FROM e WHERE {where}) SELECT r.*, top_status_codes FROM r LEFT JOIN c USING (endpoint) WHERE position <= 4"""
for _name, _fn, _order, _where in (
    ("busiest", reports.busiest_endpoints, "requests DESC, endpoint", "true"),
    ("slowest", reports.slowest_endpoints, "p95_ms DESC, average_ms DESC, requests DESC, endpoint", "samples >= 5"),
    ("failing", reports.failing_endpoints, "error_rate DESC, requests DESC, endpoint", "requests >= 10 AND error_rate > 0"),
):
    register(f"endpoints_{_name}", EV + _ENDPOINTS.format(order=_order, where=_where))(
        lambda spark, sf_dir, f=_fn: ntz(rounded(f(extracted(spark, sf_dir), 4), "average_ms", "percentage", "error_rate"), "first_seen", "last_seen").withColumns(
            {c: F.array_join(c, ",") for c in ("methods", "services")} | {"top_status_codes": F.array_join(F.transform("top_status_codes", lambda c: F.concat_ws(":", c["code"], c["count"])), ",")}
        )
    )
for _name, _col in {"method": "x_method", "service": "service"}.items():
    register(
        f"status_by_{_name}",
        EV + f", g AS (SELECT {_col} AS key, count(*) AS total, " + ", ".join(f"count(*) FILTER (x_status // 100 = {k}) AS status_{k}xx" for k in range(1, 6))
        + f", count(*) FILTER (x_status IS NULL) AS unknown, round(count(*) FILTER (x_status >= 400) / count(*), 6) AS error_rate FROM x WHERE x_http AND {_col} IS NOT NULL GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY total DESC, key) AS INT) AS position FROM g",
    )(lambda spark, sf_dir, k=f"x_{_name}": rounded(reports.status_by(extracted(spark, sf_dir, "x_http", k), k), "error_rate"))


@register("even_sample", EV + ", r AS (SELECT id, row_number() OVER (ORDER BY sequence) - 1 AS i, count(*) OVER () AS n FROM x) SELECT id FROM r WHERE i IN (SELECT (j * (SELECT count(*) FROM x)) // 37 FROM range(37) t(j))")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.even_sample(canonical(spark, sf_dir), 37).select("id")


@register("hash_sample", EV + "SELECT id FROM x ORDER BY sha256(concat(content_hash, ':', id, ':', sequence)) LIMIT 50")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.hash_sample(canonical(spark, sf_dir), 50).select("id")


@register("text_helpers", "SELECT doc_id, CASE WHEN length(p) > 200 THEN concat(left(p, 199), '…') ELSE p END AS preview, CASE WHEN length(text) > 256 THEN concat(left(text, 238), '…#', left(sha256(text), 16)) ELSE text END AS dimension FROM (SELECT doc_id, coalesce(text, '') AS text, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')) AS p FROM documents)")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", preview("text").alias("preview"), dimension("text").alias("dimension"))


# ---- comparison ----------------------------------------------------------------------------------------------------

MIDDLE = datetime(2024, 1, 15)
COMPARED = ComparisonRequest(EventFilter(end_time=MIDDLE), EventFilter(start_time=MIDDLE, services=("svc1", "svc2", "svc3")), groups=("service", "host", "severity", "http_status"), top=5)
_SIDE = """SELECT CAST(count(*) AS DOUBLE) AS event_count, count(*) FILTER (folded IN ('error', 'critical')) / count(*) AS error_rate, count(*) FILTER (folded = 'critical') / count(*) AS critical_rate, avg(x_duration) AS average_duration,
    quantile_disc(x_duration, 0.5) AS p50_duration, quantile_disc(x_duration, 0.95) AS p95_duration, quantile_disc(x_duration, 0.99) AS p99_duration,
    count(*) FILTER (x_http AND x_status >= 500) / count(*) FILTER (x_http) AS server_error_rate, count(*) FILTER (x_http AND x_status BETWEEN 400 AND 499) / count(*) FILTER (x_http) AS client_error_rate,
    count(*) * 60 / (epoch_us(max(timestamp)) / 1e6 - epoch_us(min(timestamp)) / 1e6) AS throughput FROM x WHERE """
_A, _B = "timestamp < TIMESTAMP '2024-01-15'", "timestamp >= TIMESTAMP '2024-01-15' AND service IN ('svc1', 'svc2', 'svc3')"
_JUDGE = """round({c} - {b}, 6) AS absolute_change, round(CASE WHEN {b} = 0 AND {c} = 0 THEN 0 WHEN {b} != 0 THEN abs({c} - {b}) / abs({b}) * 100 END, 6) AS percent_change,
    CASE WHEN {b} = 0 AND {c} != 0 THEN 'new' WHEN {c} > {b} THEN 'increased' WHEN {c} < {b} THEN 'decreased' ELSE 'unchanged' END AS direction"""


@register(
    "comparison_metrics",
    EV + f", a AS (UNPIVOT ({_SIDE}{_A}) ON COLUMNS(*) INTO NAME metric VALUE baseline), b AS (UNPIVOT ({_SIDE}{_B}) ON COLUMNS(*) INTO NAME metric VALUE comparison), j AS (SELECT metric, baseline, comparison, "
    + _JUDGE.format(b="baseline", c="comparison")
    + ", coalesce(abs(comparison - baseline) / nullif(abs(baseline), 0) * 100 >= 20, false) AS significant FROM a JOIN b USING (metric)) "
    "SELECT metric, round(baseline, 6) AS baseline, round(comparison, 6) AS comparison, absolute_change, percent_change, direction, significant, "
    "CASE WHEN metric IN ('event_count', 'throughput') OR direction = 'unchanged' THEN 'neutral' WHEN direction = 'increased' THEN 'degraded' ELSE 'improved' END AS reading FROM j",
)
def comparison_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comparison.metrics(extracted(spark, sf_dir, "x_duration", "x_http"), COMPARED)
    return rounded(rows.drop("baseline_samples", "comparison_samples"), "baseline", "comparison", "absolute_change", "percent_change")


_GROUPED = " UNION ALL ".join(f"SELECT '{n}' AS field, CAST({c} AS VARCHAR) AS key, a, b FROM f WHERE {c} IS NOT NULL" for n, c in {"service": "service", "host": "host", "severity": "severity", "http_status": "x_status"}.items())


@register(
    "comparison_groups",
    EV + f", f AS (SELECT *, CAST({_A} AS INT) AS a, CAST({_B} AS INT) AS b FROM x), p AS ({_GROUPED}), g AS (SELECT field, key, CAST(sum(a) AS BIGINT) AS baseline_count, CAST(sum(b) AS BIGINT) AS comparison_count FROM p GROUP BY 1, 2 HAVING sum(a) + sum(b) > 0), "
    "s AS (SELECT *, baseline_count * 100 / (SELECT sum(a) FROM f) AS bs, comparison_count * 100 / (SELECT sum(b) FROM f) AS cs FROM g), "
    "r AS (SELECT field, key, baseline_count, comparison_count, round(bs, 6) AS baseline_share, round(cs, 6) AS comparison_share, round(cs - bs, 6) AS point_change, "
    + _JUDGE.format(b="baseline_count", c="comparison_count").replace("AS absolute_change", "AS absolute_change").replace("round(comparison_count - baseline_count, 6)", "CAST(comparison_count - baseline_count AS DOUBLE)")
    + ", baseline_count >= 10 AND comparison_count >= 10 AND abs(comparison_count - baseline_count) / baseline_count * 100 >= 20 AS significant, CAST(row_number() OVER (PARTITION BY field ORDER BY abs(cs - bs) DESC, comparison_count DESC, key) AS INT) AS position FROM s) SELECT * FROM r WHERE position <= 5",
)
def comparison_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(comparison.groups(extracted(spark, sf_dir, "x_status", "x_service", "x_host", dealt=True), COMPARED), "baseline_share", "comparison_share", "point_change", "percent_change", "absolute_change")


# ---- formats: events written as lines, then read back -----------------------------------------------------------------

_STATUS = "coalesce(http_status, 200)"
LINES = {
    "access": ("apache_nginx_access", "concat(client_ip, ' - ', user_id, ' [', date_format(timestamp, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', event_type, ' HTTP/1.1\" ', " + _STATUS + ", ' ', event_id, ' \"-\" \"agent ', service, '\"')"),
    "nginx_error": ("apache_nginx_error", "concat(date_format(timestamp, 'yyyy/MM/dd HH:mm:ss'), ' [', CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warn' END, '] 7#9: *', event_id, ' ', message, ', client: ', client_ip, ', server: s, request: \"GET /', event_type, ' HTTP/1.1\", host: \"', service, '\"')"),
    "apache_error": ("apache_nginx_error", "concat('[', date_format(timestamp, 'EEE MMM dd HH:mm:ss yyyy'), '] [notice] [client ', client_ip, '] ', message)"),
    "rfc5424": ("rfc5424_syslog", "concat('<', 128 + event_id % 8, '>1 ', date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), ' ', coalesce(host, '-'), ' ', service, ' ', event_id, ' ', event_type, CASE WHEN event_id % 2 = 0 THEN ' - ' ELSE ' [a@1 k=\"v]\\\\\"\" e=\"2\"] ' END, message)"),
    "rfc3164": ("rfc3164_syslog", "concat('<', 128 + event_id % 8, '>', date_format(timestamp, 'MMM dd HH:mm:ss'), ' ', coalesce(host, 'h'), ' ', service, '[', event_id, ']: ', message)"),
    "redis": ("redis_log", "concat(event_id, ':M ', date_format(timestamp, 'dd MMM yyyy HH:mm:ss.SSS'), ' * ', CASE event_id % 3 WHEN 0 THEN 'Ready to accept connections' WHEN 1 THEN 'Background saving started by pid 3' ELSE message END)"),
    "json": ("json_log", "to_json(named_struct('timestamp', date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"), 'level', upper(severity), 'message', message, 'service', service, 'host', named_struct('name', host), 'http_status', http_status, 'duration_ms', duration_ms, 'extra', event_id))"),
    "windows": ("windows_event_xml", "concat('<Event xmlns=\"http://schemas.microsoft.com/win/2004/08/events/event\"><System><Provider Name=\"', service, '\"/><EventID>', event_id, '</EventID><Level>', event_id % 6, '</Level><TimeCreated SystemTime=\"', date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '\"/><Channel>App</Channel><Computer>', coalesce(host, 'h'), '</Computer></System><EventData><Data Name=\"b\">2</Data><Data Name=\"a\">', user_id, '</Data></EventData></Event>')"),
}
_SECOND, _MS = "date_trunc('second', timestamp)", "date_trunc('millisecond', timestamp)"
_SYSLOG_SEVERITY = "list_extract(['fatal', 'fatal', 'critical', 'error', 'warning', 'notice', 'info', 'debug'], CAST(event_id % 8 AS INT) + 1)"
#: What comes back: parser, timestamp, severity, event_type, message, host, http_status, duration_ms.
READ_BACK = {
    "access": (_SECOND, "'info'", "'webserver.access'", f"concat('GET /', event_type, ' -> ', {_STATUS})", "client_ip", _STATUS, "NULL"),
    "nginx_error": (_SECOND, "CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warning' END", "'webserver.error'", "message", "service", "NULL", "NULL"),
    "apache_error": (_SECOND, "'notice'", "'webserver.error'", "message", "NULL", "NULL", "NULL"),
    "rfc5424": (_SECOND, _SYSLOG_SEVERITY, "concat('syslog.', event_type)", "message", "host", "NULL", "NULL"),
    "rfc3164": (_SECOND, _SYSLOG_SEVERITY, "concat('syslog.', service)", "message", "coalesce(host, 'h')", "NULL", "NULL"),
    "redis": (_MS, "'info'", "CASE event_id % 3 WHEN 0 THEN 'redis.lifecycle.ready' WHEN 1 THEN 'redis.persistence.bgsave_started' ELSE 'redis.message' END", "CASE event_id % 3 WHEN 0 THEN 'Redis is ready to accept connections.' WHEN 1 THEN 'Redis background save started.' ELSE 'Redis emitted a log message.' END", "NULL", "NULL", "NULL"),
    "json": ("timestamp", "severity", "NULL", "message", "host", "http_status", "round(duration_ms, 6)"),
    "windows": (_SECOND, "list_extract(['unknown', 'critical', 'error', 'warning', 'info', 'debug'], CAST(event_id % 6 AS INT) + 1)", "concat('windows.event.', event_id)", "concat('Windows Event ', event_id, ': a=', user_id, ', b=2')", "coalesce(host, 'h')", "NULL", "NULL"),
}


def written_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = canonical(spark, sf_dir, costly=True)
    return rows.select(F.lit(kind).alias("file"), F.col("event_id").alias("position"), F.expr(LINES[kind][1]).alias("value"))


def read_back(parsed: DataFrame) -> DataFrame:
    e = F.col("event")
    return parsed.filter("status = 'success'").select(
        F.col("position").alias("event_id"), "parser", e["timestamp"].cast("timestamp_ntz").alias("timestamp"), e["severity"].alias("severity"), e["event_type"].alias("event_type"),
        e["message"].alias("message"), e["host"].alias("host"), e["http_status"].alias("http_status"), F.round(e["duration_ms"], 6).alias("duration_ms"),
    )


_BACK_TYPES = ("TIMESTAMP", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "INT", "DOUBLE")
_BACK_NAMES = ("timestamp", "severity", "event_type", "message", "host", "http_status", "duration_ms")
for _kind, (_parser, _) in LINES.items():
    _year = "make_timestamp(year(current_date), month(timestamp), day(timestamp), hour(timestamp), minute(timestamp), CAST(second(timestamp) AS DOUBLE))" if _kind == "rfc3164" else None
    _cols = ", ".join(f"CAST({(_year if _year and n == 'timestamp' else e)} AS {t}) AS {n}" for n, e, t in zip(_BACK_NAMES, READ_BACK[_kind], _BACK_TYPES, strict=True))
    register(f"parse_{_kind}", EV + f"SELECT event_id, '{_parser}' AS parser, {_cols} FROM x")(
        lambda spark, sf_dir, k=_kind: read_back(parse.parse(written_lines(spark, sf_dir, k), Registry()))
    )


@register(
    "parse_iis",
    EV + "SELECT event_id, 'iis_w3c' AS parser, date_trunc('second', timestamp) AS timestamp, CASE WHEN http_status >= 500 THEN 'error' WHEN http_status >= 400 THEN 'warning' ELSE 'info' END AS severity, 'iis.request' AS event_type, "
    "concat('GET /', event_type, CASE WHEN http_status IS NULL THEN '' ELSE concat(' -> ', http_status) END) AS message, CAST(NULL AS VARCHAR) AS host, CAST(http_status AS INT) AS http_status, CAST(event_id % 100 AS DOUBLE) AS duration_ms FROM x",
)
def parse_iis(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = "concat(date_format(timestamp, 'yyyy-MM-dd HH:mm:ss'), ' GET /', event_type, ' ', coalesce(cast(http_status as string), '-'), ' ', event_id % 100)"
    rows = canonical(spark, sf_dir, costly=True)
    heads = rows.filter("event_id = 0").select(F.lit("iis").alias("file"), F.lit(-1).cast("long").alias("position"), F.lit("#Fields: date time cs-method cs-uri-stem sc-status time-taken").alias("value"))
    lines = rows.select(F.lit("iis").alias("file"), F.col("event_id").alias("position"), F.expr(row).alias("value")).unionByName(heads)
    return read_back(parse.parse(lines, Registry()))


@register(
    "parse_statistics",
    EV + ", l AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'skipped' WHEN event_id % 10 = 1 THEN 'failure' ELSE 'success' END AS s FROM x) SELECT count(*) AS seen, count(*) FILTER (s = 'success') AS success, count(*) FILTER (s = 'failure') AS failure, count(*) FILTER (s = 'skipped') AS skipped, "
    "CAST(0 AS BIGINT) AS header, CAST(0 AS BIGINT) AS comment, count(*) FILTER (s != 'skipped') AS attempted, round(count(*) FILTER (s = 'success') / count(*) FILTER (s != 'skipped'), 6) AS success_rate FROM l",
)
def parse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = written_lines(spark, sf_dir, "rfc5424")
    mixed = lines.withColumn("value", F.when(F.col("position") % 10 == 0, " ").when(F.col("position") % 10 == 1, "not a log line").otherwise(F.col("value")))
    return rounded(parse.statistics(parse.parse(mixed, mode="file")).drop("characters", "first_event", "last_event"), "success_rate")


_RULES = EV + """, l AS (SELECT concat('file', event_id % 3) AS file, event_id AS position, CASE WHEN user_id IN ('u1', 'u2', 'u3', 'u4', 'u5', 'u6', 'u7', 'u8') OR event_type = 'error' THEN 1 ELSE 0 END AS bad FROM x),
    c AS (SELECT *, row_number() OVER w AS n, sum(bad) OVER w AS failed, sum(1 - bad) OVER w AS good FROM l WINDOW w AS (PARTITION BY file ORDER BY position)),
    r AS (SELECT *, CASE WHEN bad = 1 THEN count(*) FILTER (bad = 1) OVER (PARTITION BY file, good ORDER BY position) ELSE 0 END AS row_of FROM c),
    e AS (SELECT file, min(n) AS stop FROM r WHERE {stop} GROUP BY file) SELECT r.file, position FROM r LEFT JOIN e USING (file) WHERE stop IS NULL OR n <= stop"""
for _name, _rules, _stop in (
    ("errors", parse.StopRules(max_errors=40, consecutive_errors=None), "bad = 1 AND failed >= 40"),
    ("consecutive", parse.StopRules(consecutive_errors=4), "row_of >= 4"),
    ("rate", parse.StopRules(consecutive_errors=None, error_rate=0.24), "bad = 1 AND n >= 100 AND failed / n > 0.24"),
    ("records", parse.StopRules(max_records=120, consecutive_errors=None), "n >= 120"),
):

    def _stopped(spark: SparkSession, sf_dir: str, rules: parse.StopRules = _rules) -> DataFrame:
        bad = F.col("user_id").isin(*(f"u{k}" for k in range(1, 9))) | (F.col("event_type") == "error")
        rows = canonical(spark, sf_dir).select(F.concat(F.lit("file"), F.col("event_id") % 3).alias("file"), F.col("event_id").alias("position"), F.when(bad, "failure").otherwise("success").alias("status"))
        return parse.stopped(rows, rules).select("file", "position")

    register(f"stop_{_name}", _RULES.replace("{stop}", _stop))(_stopped)

# ---- store ---------------------------------------------------------------------------------------------------------

NOW = datetime(2024, 1, 31)
#: What is stored of the whole table; all else comes in. Once even ids, once the first half of the time.
_STORED, _EARLY = "event_id % 2 = 0", "timestamp < TIMESTAMP '2024-01-15'"


def _halves(spark: SparkSession, sf_dir: str, stored: str = _STORED) -> tuple[DataFrame, DataFrame]:
    rows = canonical(spark, sf_dir).withColumn("arrival", F.col("event_id"))
    keep = ["id", "sequence", "timestamp", "severity", "content_hash", "estimated_size_bytes"]
    return rows.filter(stored).select(*keep), rows.filter(f"NOT ({stored})").select(*keep, "arrival")


_WRITE = EV + f""", s AS (SELECT * FROM x WHERE {_STORED}), old AS (SELECT content_hash, arg_min(id, sequence) AS old_id, min(sequence) AS old_sequence FROM s GROUP BY 1),
    i AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY event_id, id) AS copy FROM x WHERE NOT ({_STORED})), j AS (SELECT i.*, old_id, old_sequence FROM i LEFT JOIN old USING (content_hash)),
    fresh AS (SELECT id, CAST((SELECT max(sequence) FROM s) + row_number() OVER (ORDER BY event_id, id) AS BIGINT) AS sequence, severity FROM j WHERE copy = 1 AND old_id IS NULL) """


@register("store_write_ignore", _WRITE + "SELECT id, sequence, severity FROM s UNION ALL SELECT * FROM fresh")
def store_write_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.write(*_halves(spark, sf_dir)).table.select("id", "sequence", "severity")


@register("store_write_replace", _WRITE + ", changed AS (SELECT old_id AS id, old_sequence AS sequence, severity FROM j WHERE copy = 1 AND old_id IS NOT NULL) SELECT id, sequence, severity FROM s WHERE id NOT IN (SELECT id FROM changed) UNION ALL SELECT * FROM changed UNION ALL SELECT * FROM fresh")
def store_write_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.write(*_halves(spark, sf_dir), policy="replace").table.select("id", "sequence", "severity")


@register("store_outcomes", _WRITE + "SELECT id, CASE WHEN copy > 1 OR old_id IS NOT NULL THEN 'ignored' ELSE 'inserted' END AS outcome FROM j")
def store_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.write(*_halves(spark, sf_dir)).outcomes


_WRITE_ALL = _WRITE.replace(_STORED, _EARLY)


@register("store_write_all_ignore", _WRITE_ALL + "SELECT id, sequence, severity FROM s UNION ALL SELECT * FROM fresh")
def store_write_all_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.write(*_halves(spark, sf_dir, _EARLY)).table.select("id", "sequence", "severity")


@register("store_write_all_replace", _WRITE_ALL + ", changed AS (SELECT old_id AS id, old_sequence AS sequence, severity FROM j WHERE copy = 1 AND old_id IS NOT NULL) SELECT id, sequence, severity FROM s WHERE id NOT IN (SELECT id FROM changed) UNION ALL SELECT * FROM changed UNION ALL SELECT * FROM fresh")
def store_write_all_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.write(*_halves(spark, sf_dir, _EARLY), policy="replace").table.select("id", "sequence", "severity")


@register("store_outcomes_all", _WRITE_ALL + "SELECT id, CASE WHEN copy > 1 OR old_id IS NOT NULL THEN 'ignored' ELSE 'inserted' END AS outcome FROM j")
def store_outcomes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.write(*_halves(spark, sf_dir, _EARLY)).outcomes


@register("store_retention", EV + "SELECT id FROM x WHERE timestamp >= TIMESTAMP '2024-01-21'")
def store_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.retained(canonical(spark, sf_dir), 10 * 86_400, NOW, "timestamp").select("id")


for _policy, _order in {"oldest_inserted": "sequence DESC", "oldest_event_timestamp": "timestamp DESC, sequence DESC"}.items():
    register(
        f"store_capacity_{_policy}",
        EV + f", r AS (SELECT id, row_number() OVER (ORDER BY {_order}) AS n, sum(estimated_size_bytes) OVER (ORDER BY {_order} ROWS UNBOUNDED PRECEDING) AS b FROM x) SELECT id FROM r WHERE n <= 600 AND b <= 70000",
    )(lambda spark, sf_dir, p=_policy: store.within_capacity(canonical(spark, sf_dir), 600, 70_000, p).select("id"))


@register("store_statistics", EV + "SELECT count(*) AS event_count, CAST(sum(estimated_size_bytes) AS BIGINT) AS total_bytes, count(DISTINCT content_hash) AS contents, min(timestamp) AS first_event, max(timestamp) AS last_event, max(sequence) AS last_sequence FROM x")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntz(store.statistics(canonical(spark, sf_dir)), "first_event", "last_event")


@register("store_delete", EV + "SELECT id FROM x WHERE severity != 'debug'")
def store_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical(spark, sf_dir)
    return store.delete(rows, rows.filter("severity = 'debug'").select("id")).select("id")


@register("store_get", EV + "SELECT id, message FROM x WHERE id = 'evt_42'")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get(canonical(spark, sf_dir), "evt_42").select("id", "message")
