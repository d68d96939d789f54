import gzip
import io
import json
import random
import subprocess
import sys
import time
import tracemalloc
import zipfile
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from timberline.functions import extract, text
from timberline.functions.extract import with_extracts
from timberline.functions.text import fold_case, redis_endpoint, summary_text
from timberline.operators import parse, query, reports, store
from timberline.operators.filters import apply_filter
from timberline.operators.normalize import Defaults, normalize
from timberline.operators.ordering import exact_percentiles
from timberline.plans.analysis import analyze, compare, preset_periods
from timberline.plans.insights import insights
from timberline.plans.requests import Aggregation, AnalysisRequest, ComparisonRequest, EventFilter, EventQuery, EventSort, Limits, RequestError
from timberline.queries import EV, ORACLES, QUERIES, canonical
from timberline.sources import encoding as encodings
from timberline.sources import ingest
from timberline.sources import lines as lines_module
from timberline.sources.parsers import Context, LogFormat, Registry
from timberline.streaming import live

BASE = datetime(2024, 3, 1, 10)


def events(spark, rows):
    """Rows of (seconds, severity, duration, status, service, path, attributes)."""
    data = [
        (f"e{k}", k + 1, BASE + timedelta(seconds=s), sev, "application", "m", "m", svc, f"h{k % 2}" if k % 3 else None, d, st, p, a, ["t"], f"c{k % 4}", 100)
        for k, (s, sev, d, st, svc, p, a) in enumerate(rows)
    ]
    schema = (
        "id string, sequence long, timestamp timestamp, severity string, source_type string, event_type string, message string, service string, host string, duration_ms double, "
        "http_status int, http_path string, a string, tags array<string>, content_hash string, estimated_size_bytes long"
    )
    return spark.createDataFrame(data, schema).withColumn("attributes", F.parse_json(F.coalesce("a", F.lit("{}")))).drop("a")


def test_extractors(spark):
    rows = [
        (0, "info", 5.0, 200, "s", "/a/", None), (1, "info", None, None, "s", None, '{"request_time": 2.5, "status": "404"}'),
        (2, "info", None, None, None, None, '{"latency_us": 1500, "service": {"name": " x "}}'), (3, "info", None, None, None, None, '{"latency_ms": true, "duration_us": -1}'),
        (4, "info", None, 999, "s", "http://h/api/items/?q=1#f", '{"latency_ms": "7"}'), (5, "info", None, None, "s", "/concrete/1", '{"route_template": "/items/{id}", "method": "get"}'),
    ]
    got = extract.with_extracts(events(spark, rows)).orderBy("sequence").collect()
    assert [r.x_duration for r in got] == [5.0, 2500.0, 1.5, None, None, None]
    assert [r.x_duration_field for r in got][:3] == ["duration_ms", "request_time", "latency_us"]
    assert [r.x_duration_invalid for r in got] == [False, False, False, True, True, False]
    assert [r.x_status for r in got] == [200, 404, None, None, None, None]
    assert [r.x_endpoint for r in got] == ["/a", None, None, None, "/api/items", "/items/{id}"]
    assert got[2].x_service == "x" and got[5].x_method == "GET" and [r.x_http for r in got] == [True, True, False, False, True, True]


@pytest.mark.parametrize("raw,want", [("/a/b/", "/a/b"), ("a", "/a"), ("/", "/"), ("https://x.y/z?q", "/z"), ("/a b/", "/a b"), ("//", "/"), ("?q", "/")])
def test_endpoints(spark, raw, want):
    assert spark.range(1).select(extract.endpoint(F.lit(raw)).alias("e")).first().e == want


def test_text_functions(spark):
    row = spark.range(1).select(
        text.fold_case(F.lit("STRAßE ﬁ")).alias("fold"), text.preview(F.lit("a\x00\n b" + "c" * 300)).alias("preview"), text.dimension(F.lit("d" * 300)).alias("dim"),
        text.severity(F.lit(" WARN ")).alias("warn"), text.severity(F.lit("odd")).alias("odd"), text.severity(F.lit("odd"), lenient=True).alias("lenient"), text.source_type(F.lit("http")).alias("http"),
        text.timestamp(F.lit("2024-01-02T03:04:05+0200")).cast("timestamp_ntz").alias("ts"), text.timestamp(F.lit("2024")).alias("year"), text.redis_endpoint(F.lit("[::1]:6379")).alias("redis"),
    ).first()
    assert row.fold == "strasse fi" and len(row.preview) == 200 and row.preview.startswith("a bccc") and len(row.dim) == 256
    assert (row.warn, row.odd, row.lenient, row.http, row.year) == ("warning", None, "unknown", None, None)
    assert row.ts == datetime(2024, 1, 2, 1, 4, 5) and (row.redis.host, row.redis.port) == ("::1", 6379)


def test_percentiles_and_timeline(spark):
    rows = extract.with_extracts(events(spark, [(0, "info", 4.0, 200, "s", "/a", None), (30, "error", 1.0, 503, "s", "/a", None), (150, "fatal", 3.0, None, "s", None, None), (120, "warning", 2.0, None, "s", None, None)]))
    row = exact_percentiles(rows, "x_duration", {"p50": (50, "nearest_rank"), "p95": (95, "nearest_rank"), "p0": (0, "nearest_rank"), "l": (50, "linear")}).first()
    assert (row.p50, row.p95, row.p0, row.l) == (2.0, 4.0, 1.0, 2.5)
    buckets = reports.timeline(rows, 60).orderBy("bucket_start").collect()
    assert [(b.event_count, b.error_count, b.critical_count, b.error_rate) for b in buckets] == [(2, 1, 0, 0.5), (0, 0, 0, 0.0), (2, 0, 1, 0.5)]
    assert reports.out_of_order(rows).first()[0] == 1
    assert reports.choose_bucket(BASE, BASE + timedelta(days=10), None)[1] is True
    with pytest.raises(RequestError):
        reports.choose_bucket(BASE, BASE + timedelta(days=1), 1)


def test_query_and_requests(spark):
    rows = events(spark, [(k % 4, "info" if k % 2 else "error", None if k == 2 else float(k), None, "s", None, None) for k in range(12)])
    result = query.run_query(rows, EventQuery(sort=(EventSort("host", False),), offset=2, limit=5, facets=("severity", "tags")))
    assert (result.total, result.returned, result.has_more, result.next_offset) == (12, 5, True, 7)
    assert {(r.facet, r.value): r["count"] for r in result.facets.collect()} == {("severity", "error"): 6, ("severity", "info"): 6, ("tags", "t"): 12}
    hosts = [r.host for r in query.page(rows, EventQuery(sort=(EventSort("host"),))).collect()]
    assert hosts[-4:] == [None] * 4 and hosts[0] == "h1"
    got = query.aggregate(rows, Aggregation("severity", "average_duration_ms")).orderBy("position").collect()
    assert [(r.key, r.sample_count) for r in got] == [("info", 6), ("error", 5)]
    for bad in (lambda: EventFilter(severities=("x",)), lambda: EventFilter(start_time=BASE, end_time=BASE), lambda: Aggregation("tag", "sum_duration_ms"), lambda: EventSort("x"),
                lambda: EventFilter(attribute_exists=("__a",)), lambda: AnalysisRequest(distributions=("user.password",)), lambda: EventFilter(hosts=tuple(map(str, range(101)))),
                lambda: query.page(rows, EventQuery(limit=5000), Limits())):
        with pytest.raises(RequestError):
            bad()


def test_filter_is_pushed_down(spark, tmp_path):
    events(spark, [(0, "info", 1.0, None, "s", None, None)]).drop("attributes").write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    plan = apply_filter(stored, EventFilter(severities=("error",), start_time=BASE)).select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(severity,error)" in plan and "GreaterThanOrEqual(timestamp" in plan and "ReadSchema: struct<id:string,timestamp:timestamp,severity:string>" in plan


def test_analysis_comparison_and_insights(spark):
    rows = events(spark, [(k, "error" if k % 4 == 0 else "info", float(k), 500 if k % 4 == 0 else 200, "s", "/a", None) for k in range(40)])
    out = analyze(rows, AnalysisRequest(samples=4))
    codes = {i.code: i.level for i in out.insights}
    assert codes["HIGH_ERROR_RATE"] == "critical" and codes["HIGH_SERVER_ERROR_RATE"] == "critical" and codes["SINGLE_SERVICE_CONCENTRATION"] == "critical"
    assert out.summary["event_count"] == 40 and out.samples.count() == 4 and out.http["summary"].first().status_5xx == 10
    assert [r["count"] for r in out.latency["histogram"].orderBy("position").collect()] == [10, 30, 0, 0, 0, 0, 0, 0, 0, 0]
    middle = BASE + timedelta(seconds=20)
    found = compare(rows.withColumn("severity", F.when(F.col("timestamp") < middle, "info").otherwise(F.col("severity"))), ComparisonRequest(EventFilter(end_time=middle), EventFilter(start_time=middle), groups=("service",)))
    by_name = {r.metric: r for r in found.metrics.collect()}
    assert by_name["error_rate"].direction == "new" and by_name["error_rate"].significant and [i.code for i in found.insights] == ["ERROR_SPIKE"]
    assert insights({"event_count": 0})[0].code == "NO_EVENTS"
    assert preset_periods("1h", BASE) == ((BASE - timedelta(hours=1), BASE), (BASE - timedelta(hours=2), BASE - timedelta(hours=1)))


def test_formats_detection_and_statuses(spark):
    lines = "\n".join(
        ['1.2.3.4 - bob [10/Oct/2023:13:55:36 +0200] "GET /x HTTP/1.1" 404 12', '{"time": "2024-01-01T00:00:00Z", "level": "warn", "msg": "m", "service": {"name": "a"}}', "", "free text",
         "<34>1 2023-10-11T22:14:15.003Z host app - ID47 - said", "2023/01/02 03:04:05 [error] 1#2: *3 open() failed, client: 1.1.1.1, host: \"h\"", '[Wed Oct 11 14:32:52 2023] [error] [client 1.2.3.4] denied',
         '{"level": "info"}', "#Software: Microsoft Internet Information Services", "#Fields: date time cs-method cs-uri-stem sc-status", "2024-01-01 00:00:01 GET /i 500"]
    )
    got = parse.parse(parse.lines_of(spark, lines)).orderBy("position").collect()
    assert [(r.parser, r.status, r.error) for r in got] == [
        ("apache_nginx_access", "success", None), ("json_log", "success", None), (None, "skipped", None), (None, "failure", "NO_FORMAT"), ("rfc5424_syslog", "success", None),
        ("apache_nginx_error", "success", None), ("apache_nginx_error", "success", None), ("json_log", "failure", "INVALID_TIMESTAMP"), (None, "comment", None), ("iis_w3c", "header", None), ("iis_w3c", "success", None),
    ]
    assert got[1].event.service == "a" and got[1].event.severity == "warning" and json.loads(got[5].event.attributes)["client"] == "1.1.1.1" and got[10].event.severity == "error"
    assert parse.events(parse.parse(parse.lines_of(spark, lines), mode="file")).count() == 6
    assert parse.quarantine(parse.parse(parse.lines_of(spark, "x" * 100), limit=50)).first().error == "RECORD_TOO_LARGE"


def test_registry(spark):
    registry = Registry()
    registry.register(LogFormat("mine", 1, "application", lambda x: F.when(x.startswith("1.2"), 0.99).otherwise(0.0), Registry().get("apache_nginx_access").event, tags=("own",)))
    with pytest.raises(ValueError):
        registry.register(registry.get("mine"))
    assert registry.active()[0].name == "mine" and [f.name for f in registry.find(tag="own")] == ["mine"]
    registry.enable("mine", False)
    assert registry.find(tag="own") == []


def test_ingestion(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("b.log", "zipped\n")
        z.writestr("a.bin", b"\x00")
    files = {
        "a.log": b"one\r\ntwo\n", "u16.log": "hé".encode("utf-16"), "w.log": "caf\xe9".encode("cp1252"), "bin.log": b"\x7fELF\x00\x01" * 50, "g.log.gz": gzip.compress(b"zip me\n"),
        "z.zip": packed.getvalue(), "bad.gz": b"\x1f\x8bnope", "nest.gz": gzip.compress(gzip.compress(b"x")), "big.gz": gzip.compress(b"x" * 3000),
    }
    got = {r.path: r for r in ingest.ingest(ingest.bytes_rows(spark, files), ingest.IngestOptions(max_unpacked=2000)).collect()}
    assert got["a.log"].line_ends.crlf == 1 and got["a.log"].warnings == ["MIXED_LINE_ENDINGS"] and got["u16.log"].text == "hé" and got["w.log"].encoding == "cp1252"
    assert [got[k].error for k in ("bin.log", "bad.gz", "nest.gz", "big.gz")] == ["BINARY_CONTENT", "ARCHIVE_MALFORMED", "ARCHIVE_NESTED", "ARCHIVE_TOO_LARGE"]
    assert got["g.log.gz"].text == "zip me\n" and (got["z.zip"].text, got["z.zip"].entry) == ("zipped\n", "b.log")
    lines = ingest.to_lines(ingest.ingest(ingest.bytes_rows(spark, {"a.log": b"one\r\ntwo\n"})))
    assert [r.value for r in lines.orderBy("position").collect()] == ["one", "two"]


def test_store(spark):
    rows = events(spark, [(k, "info", None, None, "s", None, None) for k in range(6)]).withColumn("arrival", F.col("sequence"))
    first, second = rows.filter("sequence <= 2").drop("arrival"), rows.filter("sequence > 2")
    written = store.write(first, second)
    assert {r.id: r.outcome for r in written.outcomes.collect()} == {"e2": "inserted", "e3": "inserted", "e4": "ignored", "e5": "ignored"}
    assert sorted(r.sequence for r in written.table.collect()) == [1, 2, 3, 4]
    with pytest.raises(store.ConflictError):
        store.write(first, second, "reject")
    with pytest.raises(store.ConflictError):
        store.write(first, second.withColumn("id", F.lit("e0")))
    assert {r.id for r in store.within_capacity(written.table, events=3, size=250).collect()} == {"e3", "e2"}
    named = store.with_identity(rows.drop("id", "content_hash"), "content_hash")
    assert named.filter("id rlike '^evt_[0-9a-f]{32}$'").count() == 6 and named.select("content_hash").distinct().count() == 6


def same_as_sql(spark, sf_dir, name):
    """The rows of a query, after comparison with those of its SQL."""
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
        found = sql.execute(ORACLES[name])
        names, want = [d[0] for d in found.description], found.fetchall()
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r) for r in got.select(*names).collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    return rows


def test_store_queries_take_in_the_whole_table(spark, sf_dir):
    times = {f"evt_{r.event_id}": r.ts for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()}
    splits = {"": lambda i: int(i[4:]) % 2 == 0, "_all": lambda i: times[i] < datetime(2024, 1, 15)}
    for end, is_stored in splits.items():
        outcomes = dict(same_as_sql(spark, sf_dir, f"store_outcomes{end}"))
        stored = {i for i in times if is_stored(i)}
        assert stored and set(outcomes) == set(times) - stored
        inserted = {i for i, outcome in outcomes.items() if outcome == "inserted"}
        for name in (f"store_write{end}_ignore", f"store_write{end}_replace"):
            rows = same_as_sql(spark, sf_dir, name)
            assert {r[0] for r in rows} == stored | inserted and len(rows) == len(stored) + len(inserted)


def test_http_timeline_queries_take_in_all_http_events(spark, sf_dir):
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
        http = sql.execute(EV + "SELECT count(*) FROM x WHERE x_http").fetchone()[0]
    for end in ("", "_all"):  # by the hour, by the day
        rows = same_as_sql(spark, sf_dir, f"timeline_http{end}")
        assert sum(r[1] for r in rows) == http
        (rollup,) = same_as_sql(spark, sf_dir, f"timeline_rollup{end}")
        assert rollup[0] == len(rows)


def test_streams(spark, tmp_path):
    from timberline.streaming import live

    folder = tmp_path / "in"
    folder.mkdir()
    line = '{"time": "2024-01-01T00:0%d:00Z", "level": "error", "msg": "m%d", "http_status": 500}'
    (folder / "a.log").write_text("\n".join(line % (k, k) for k in (0, 1, 1, 2)) + "\nnoise\n")
    stream = live.event_stream(live.line_stream(spark, str(folder)))
    q = live.deduplicated(stream).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 3
    q = live.live_timeline(stream, "1 minute").writeStream.format("memory").queryName("buckets").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.bucket_start.minute, r.event_count, r.server_errors) for r in spark.table("buckets").collect()) == [(0, 1, 1), (1, 2, 2), (2, 1, 1)]


def test_entry_works_without_corpus_operators(tmp_path):
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['timberline.llm'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'summary' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    )
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_python_formats_and_plugins(spark):
    from timberline.sources.plugins import Plugins, python_format

    def parse_line(line):
        if "bad" in line:
            raise ValueError("no")
        at, _, text = line[3:].partition(" ")
        return {"timestamp": datetime.fromisoformat(at), "severity": "error", "message": text, "tags": ["own"], "attributes": '{"a": 1}'}

    class Plugin:
        closed = False

        def __init__(self, mark):
            self.formats = [python_format("mine", lambda line: 0.99 if line.startswith(mark) else 0.0, parse_line)]

        def close(self):
            Plugin.closed = True

    plugins = Plugins(Registry(), {"mine": {"mark": "## "}, "odd": {"nothing": 1}})
    assert plugins.load("mine", lambda mark: Plugin(mark)).formats == ["mine"]
    assert "unknown options" in plugins.load("odd", lambda: []).error and "TypeError" in plugins.load("none", [1]).error
    assert "registered already" in plugins.load("again", lambda: Plugin("x")).error and plugins.load("gone", "no.such:thing").error
    assert plugins.load_packages() == [] and plugins.registry.get("mine").name == "mine"
    with pytest.raises(ValueError):
        Plugins(Registry(), {"odd": {"nothing": 1}}, "raise").load("odd", lambda: [])
    lines = parse.lines_of(spark, "## 2024-01-01T00:00:00 hello there\n## bad\n<34>1 2023-10-11T22:14:15.003Z host app - ID47 - said")
    got = parse.parse(lines, plugins.registry).orderBy("position").collect()
    assert [(r.parser, r.status) for r in got] == [("mine", "success"), ("mine", "failure"), ("rfc5424_syslog", "success")]
    assert got[0].event.message == "hello there" and got[0].event.tags == ["own"] and got[0].event.source_type == "application"
    assert plugins.close() == [] and Plugin.closed


def test_progress_and_collections(spark):
    parsed = parse.parse(parse.lines_of(spark, "\n".join(f'{{"time": "2024-01-01T00:00:0{k}Z", "level": "info", "msg": "m{k}"}}' for k in range(5)) + "\nfree text\n"))
    rows, seen = parse.observed(parsed)
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"seen": 6, "success": 5, "failure": 1, "skipped": 0, "header": 0, "comment": 0}
    few = parse.collected(parsed, 3, 5)
    assert len(few.events) == 3 and few.more_events and len(few.failures) == 1 and not few.more_failures


@pytest.mark.parametrize(
    "code,level,changes",
    [
        ("NO_EVENTS", "info", {"event_count": 0}), ("LOW_SAMPLE_SIZE", "info", {"event_count": 9}), ("HIGH_ERROR_RATE", "warning", {"error_rate": 0.05}),
        ("HIGH_ERROR_RATE", "critical", {"error_rate": 0.2}), ("HIGH_CRITICAL_RATE", "warning", {"critical_rate": 0.06, "critical_count": 6}), ("LATENCY_P95_HIGH", "critical", {"p95": 50.0}),
        ("SINGLE_SERVICE_CONCENTRATION", "warning", {"shares": {"service": ("s", 60.0)}}), ("SINGLE_HOST_CONCENTRATION", "critical", {"shares": {"host": ("h", 80.0)}}),
        ("DOMINANT_EVENT_TYPE", "warning", {"shares": {"event_type": ("e", 50.0)}}), ("MISSING_HTTP_STATUS_DATA", "warning", {"http": {"http_event_count": 10, "unknown_count": 6, "server_error_rate": 0.0}}),
        ("HIGH_SERVER_ERROR_RATE", "critical", {"http": {"http_event_count": 10, "unknown_count": 0, "server_error_rate": 0.3}}), ("MISSING_DURATION_DATA", "warning", {"duration_count": 10}),
        ("OUT_OF_ORDER_TIMESTAMPS", "warning", {"late": 1}), ("TIME_BUCKET_ADJUSTED", "info", {"widened": True}),
    ],
)
def test_insight_rules(code, level, changes):
    from timberline.plans.insights import Thresholds

    summary = {"event_count": 100, "error_rate": 0.0, "critical_rate": 0.0, "critical_count": 0, "duration_count": 100} | {k: v for k, v in changes.items() if "_" in k}
    ms = Thresholds(p95_warning_ms=10, p95_critical_ms=40)
    got = insights(summary, changes.get("shares"), changes.get("http"), changes.get("p95"), changes.get("late", 0), changes.get("widened", False), ms)
    assert [(i.code, i.level) for i in got] == [(code, level)]
    several = insights(summary | {"event_count": 100, "error_rate": 0.1}, None, None, 99.0, 2, True, ms)
    order = [({"critical": 0, "warning": 1, "info": 2}[i.level], i.code) for i in several]
    assert len(order) >= 4 and order == sorted(order)


def test_even_sample_of_a_large_table(spark):
    n, k = 2_000_000, 997
    rows = spark.range(n).select(F.col("id").alias("sequence"), F.concat(F.lit("e"), "id").alias("id")).repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = sorted(r.sequence for r in reports.even_sample(rows, k).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [i * n // k for i in range(k)]
    assert reports.even_sample(rows.filter("sequence < 5"), 9).count() == 5 and reports.even_sample(rows.limit(0), 3).count() == 0


def test_an_id_of_two_contents_in_a_batch_is_an_error(spark):
    rows = events(spark, [(k, "info", None, None, "s", None, None) for k in range(4)]).withColumn("arrival", F.col("sequence"))
    with pytest.raises(store.ConflictError):
        store.write(rows.drop("arrival").limit(0), rows.withColumn("id", F.lit("e9")))


def test_group_fields_that_tell_of_persons_are_refused():
    from timberline.plans.requests import check_group_field

    for name in ("user_id", "a.client-ip", "Trace_ID", "http.session", "auth", "source", "message"):
        with pytest.raises(RequestError):
            check_group_field(name)
    assert check_group_field("tokens_used") == "tokens_used" and check_group_field("sourced.by") == "sourced.by"


def test_groups_over_the_limit_are_an_error(spark):
    rows = extract.with_extracts(events(spark, [(k, "info", None, None, f"s{k}", None, None) for k in range(6)]))
    assert reports.distributions(rows, ("service",), limits=Limits(groups=6)).count() == 6
    with pytest.raises(Exception, match="too many different values of service"):
        reports.distributions(rows, ("service",), limits=Limits(groups=5)).collect()


@pytest.mark.parametrize(
    "line,want",
    [
        ('h - - [01/Feb/2024:10:00:00 +0100] "PROPFIND /dav HTTP/2.0" 207 -', ("propfind", "/dav", 207, None)),
        (r'h - "a b" [01/Feb/2024:10:00:00 +0100] "GET /q?x=\"y\" HTTP/1.1" 200 5 "-" "say \"hi\"" 0.25', ("get", r'/q?x=\"y\"', 200, 250.0)),
        ('h - - [01/Feb/2024:10:00:00 +0100] "GET /old" 200 5', ("get", "/old", 200, None)),
        ('h - - [01/Feb/2024:10:00:00 +0100] "-" 408 -', (None, None, 408, None)),
    ],
)
def test_access_lines(spark, line, want):
    (r,) = parse.parse(parse.lines_of(spark, line), mode="apache_nginx_access").collect()
    e = r.event
    assert r.status == "success" and (e.http_method, e.http_path, e.http_status, e.duration_ms) == want and e.timestamp == datetime(2024, 2, 1, 9)


def test_files_in_micro_batches(spark, tmp_path):
    from timberline.streaming import live

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("#Fields: date time cs-method cs-uri-stem sc-status\n2024-01-01 00:00:01 GET /i 500\nfree text\n")
    seen = []
    q = live.foreach_files(live.line_stream(spark, str(folder)), lambda rows, number: seen.extend(parse.by_parser(rows).collect()), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.parser or "", r.error or "", r.lines) for r in seen) == [("iis_w3c", "", 1), ("iis_w3c", "INVALID_TIMESTAMP", 1)]


def test_values_cleaned_and_invalid(spark):
    """What is no duration, no status and no text, among columns and attributes."""
    rows = [
        (0, "info", float("nan"), 99, " ", "", '{"latency_ms": -1}'), (1, "info", -5.0, 600, None, None, '{"latency_ms": null, "duration_us": 2e105}'),
        (2, "info", None, None, None, None, '{"elapsed_ms": [1], "status": 404.0, "service": {"name": true}}'), (3, "info", float("inf"), None, None, None, '{"request_time": 0}'),
    ]
    got = extract.with_extracts(events(spark, rows)).orderBy("sequence").collect()
    assert [(r.x_duration, r.x_duration_invalid) for r in got] == [(None, True), (None, True), (None, True), (0.0, False)]
    assert [r.x_status for r in got] == [None, None, 404, None] and [r.x_service for r in got] == [None, None, "True", None]
    loose = extract.with_extracts(events(spark, [(0, "info", None, None, None, None, '{"latency_ms": "12.5"}')]), strict=False, only=("x_duration",)).first()
    assert loose.x_duration == 12.5 and "x_status" not in loose.asDict()
    row = reports.latency(extract.with_extracts(events(spark, rows))).first()
    assert (row["count"], row.invalid_count, row.missing_count, row.detected_field) == (1, 3, 0, "request_time")


def test_event_store_commits_whole_versions(spark, tmp_path):
    rows = events(spark, [(k, "info", None, None, "s", None, None) for k in range(6)]).withColumn("arrival", F.col("sequence")).drop("attributes")
    kept = store.EventStore(spark, str(tmp_path / "events"), rows.drop("arrival").schema, buckets=4)
    assert kept.read().count() == 0
    assert kept.add(rows.filter("sequence <= 2")) == {"inserted": 2, "replaced": 0, "ignored": 0}
    before = kept.state()
    assert kept.add(rows.filter("sequence > 2")) == {"inserted": 2, "replaced": 0, "ignored": 2}
    # the first write's files are still in use, those of the second stand beside them
    assert all(set(parts) <= set(kept.state()["parts"][b]) for b, parts in before["parts"].items())
    assert kept.add(rows.filter("sequence > 4"), "replace")["replaced"] == 2 and kept.read().count() == 4
    assert sorted(r.sequence for r in kept.read().collect()) == [1, 2, 3, 4]
    with pytest.raises(store.ConflictError):
        kept.add(rows, "reject")
    (tmp_path / "events" / "v9").write_text('{"parts": ')  # a writer that did not end
    assert kept.versions() == [1, 2, 3] and kept.read().count() == 4
    (tmp_path / "events" / "v9").unlink()
    with pytest.raises(store.StaleError):
        kept._commit(before, before["parts"])  # made from a version that is not the newest
    assert kept.delete(kept.read().filter("sequence = 1").select("id")) == 1
    assert kept.read().count() == 3 and kept.vacuum(2) == 2
    assert kept.evict(events=2) == 1 and sorted(r.sequence for r in kept.read().collect()) == [3, 4]
    kept.clear()
    assert kept.read().count() == 0 and store.statistics(kept.read()).first().event_count == 0
    again = store.EventStore(spark, str(tmp_path / "events"), rows.drop("arrival").schema, buckets=4)
    assert again.counters() == {"inserted": 4, "ignored": 2, "replaced": 2, "evicted": 1, "expired": 0, "writes": 3, "deletes": 1, "clears": 1}
    assert again.add(rows.filter("sequence = 6")) == {"inserted": 1, "replaced": 0, "ignored": 0}
    assert [r.sequence for r in again.read().collect()] == [5]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    rows = events(spark, [(k, "info", None, None, f"s{k}", None, None) for k in range(6)]).withColumn("arrival", F.col("sequence")).drop("attributes")
    rows = rows.withColumn("content_hash", F.col("id"))
    mine, other = (store.EventStore(spark, str(tmp_path / "events"), rows.drop("arrival").schema, buckets=4) for _ in range(2))
    write = store.write

    def slow(*args):
        done = write(*args)
        monkeypatch.setattr(store, "write", write)
        other.add(rows.filter("id in ('e0', 'e1')"))  # comes in between
        return done

    monkeypatch.setattr(store, "write", slow)
    assert mine.add(rows.filter("id not in ('e0', 'e1')"))["inserted"] == 4
    assert sorted(r.sequence for r in mine.read().collect()) == [1, 2, 3, 4, 5, 6] and mine.versions() == [1, 2]


def test_small_writes_do_not_shuffle_what_is_stored(spark):
    rows = events(spark, [(k, "info", None, None, "s", None, None) for k in range(6)]).withColumn("arrival", F.col("sequence")).drop("attributes")
    done = store.write(rows.drop("arrival").filter("sequence <= 3"), rows.filter("sequence > 3"))
    plan = done.table._jdf.queryExecution().executedPlan().toString()
    stored = plan.split("Union")[1]
    assert "SortMergeJoin" not in stored.split("Scan")[0]


# ---- lines, encodings, streams, zones --------------------------------------------------------------------------------


def test_numbers_of_lines_over_several_splits(spark, tmp_path):
    texts = {"a.log": [f"line {k} " + "y" * (k % 80) for k in range(3000)], "b.log": ["one\r", "two", "", "three"], "c.log": []}
    for name, lines in texts.items():
        (tmp_path / name).write_bytes("\n".join(lines).encode())
    options = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        rows = parse.read_lines(spark, str(tmp_path))
        got = {(r.file.rsplit("/", 1)[1], r.position): r.value for r in rows.collect()}
        bounded = {(r.file.rsplit("/", 1)[1], r.position): (r.value, r.characters) for r in lines_module.bounded_lines(spark, str(tmp_path), limit=60, split=7000).collect()}
    finally:
        for key in options:
            spark.conf.unset(key)
    want = {(name, k): line.rstrip("\r") for name, lines in texts.items() for k, line in enumerate(lines, 1)}
    assert got == want
    assert bounded == {k: (v if len(v) <= 60 else None, len(v)) for k, v in want.items()}
    for packed in ("a.log.gz", "b.zip"):
        with pytest.raises(ValueError, match="packed"):
            parse.read_lines(spark, packed)
    with pytest.raises(ValueError, match="utf-16"):
        lines_module.bounded_lines(spark, str(tmp_path), encoding="utf-16")


def test_bounded_lines_of_ranges_match_splitting_the_whole(monkeypatch):
    rng = random.Random(2)
    for _ in range(200):
        monkeypatch.setattr(lines_module, "CHUNK", rng.choice([1, 3, 64]))
        text = "".join(rng.choice(["a", "é", "\n", "\r\n", "bc", "x" * rng.randint(0, 30)]) for _ in range(rng.randint(0, 40)))
        data, limit, split = text.encode(), rng.choice([0, 3, 10, 100]), rng.choice([1, 2, 5, 17, 1000])
        got = [x for a in range(0, len(data), split) for x in lines_module.range_lines(io.BytesIO(data), a, min(a + split, len(data)), limit, "utf-8")]
        want, offset = [], 0
        for line in data.split(b"\n")[: None if data[-1:] not in (b"\n", b"") else -1]:
            plain = line.decode().rstrip("\r")
            want.append((offset, plain if len(plain) <= limit else None, len(plain) > limit))
            offset += len(line) + 1
        assert [(o, t, x) for o, t, _, _, x in got] == want


class Endless:
    """A stream of one line of a gigabyte, made as it is read."""

    size = 1 << 30

    def __init__(self):
        self.at = 0

    def read(self, n):
        n = min(n, self.size - self.at)
        self.at += n
        return b"x" * n

    def seek(self, at):
        self.at = at

    def tell(self):
        return self.at


def test_a_line_of_a_gigabyte_is_drained(spark):
    tracemalloc.start()
    try:
        (line,) = lines_module.range_lines(Endless(), 0, Endless.size, 1 << 20, "utf-8")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert line == (0, None, "x" * 200, Endless.size, True) and peak < 64 << 20
    rows = spark.createDataFrame([("f", 1, None, "x" * 200, 1 << 30, True)], "file string, position long, value string, preview string, characters long, oversized boolean")
    (row,) = parse.quarantine(parse.parse(rows)).collect()
    assert (row.error, row.value, row.preview) == ("RECORD_TOO_LARGE", None, "x" * 200)


TEXTS = {
    "cp1252": "Größere Mühlen für die Häuser der Öffentlichkeit; Les élèves étaient déjà à l’école",
    "iso-8859-2": "Połączenie z serwerem zostało zamknięte; błąd krytyczny w źródle żądania",
    "iso-8859-5": "Ошибка подключения к базе данных: превышено время ожидания",
    "cp1251": "Ошибка подключения к базе данных: превышено время ожидания",
    "koi8-r": "Ошибка подключения к базе данных: превышено время ожидания",
    "iso-8859-7": "Σφάλμα σύνδεσης με τη βάση δεδομένων του συστήματος",
    "utf-16-le": "Ошибка подключения; and plain words",
    "utf-16-be": "Größere Mühlen",
}


@pytest.mark.parametrize("encoding", TEXTS)
def test_encodings_without_a_mark_are_found(encoding):
    data = TEXTS[encoding].encode(encoding)
    name, confidence = encodings.detect(data)
    assert data.decode(name) == TEXTS[encoding] and confidence >= encodings.ENOUGH


def test_unsure_encodings_are_told_of(spark):
    files = {"a.log": TEXTS["iso-8859-5"].encode("iso-8859-5"), "b.log": b"x\xe9", "c.log": "Œuvre “x”".encode("cp1252"), "d.log": b"plain", "e.bin": b"\x7fELF" + b"\0\1" * 9, "f.log": b""}
    got = {r.path: (r.encoding, set(r.warnings)) for r in ingest.ingest(ingest.bytes_rows(spark, files)).collect()}
    assert got["a.log"] == ("iso-8859-5", set()) and got["d.log"] == ("utf-8", set()) and got["f.log"] == ("utf-8", set())
    assert got["b.log"] == ("cp1252", {"ENCODING_LOW_CONFIDENCE", "ENCODING_FALLBACK_USED"})
    assert got["c.log"] == ("cp1252", {"ENCODING_LOW_CONFIDENCE"}) and got["e.bin"][0] is None
    assert encodings.detect(b"ascii alone") is None and encodings.detect(b"") is None


def test_files_over_several_micro_batches_parse_and_stop_as_one(spark, tmp_path):
    head = ["#Software: Microsoft Internet Information Services 10.0", "#Fields: date time cs-method cs-uri-stem sc-status time-taken"]
    iis = head + [f"2024-01-01 00:00:{k:02d} GET /a{k} 200 {k}" for k in range(12)] + ["#Fields: date time sc-status cs-uri-stem"] + [f"2024-01-01 00:01:{k:02d} 404 /b{k}" for k in range(8)]
    good = '{"time": "2024-01-01T00:00:00Z", "level": "info", "msg": "m"}'
    mixed = [good] * 4 + ["junk"] * 3 + [good] + ["junk"] * 9
    rows = [(name, k, line) for name, lines in (("iis.log", iis), ("j.log", mixed)) for k, line in enumerate(lines)]
    rules = parse.StopRules(consecutive_errors=5)
    whole = parse.parse(spark.createDataFrame(rows, "file string, position long, value string"))
    columns = ["file", "position", "status", "event"]
    want = sorted(map(tuple, parse.stopped(whole.select("file", "position", "status", F.to_json("event").alias("event")), rules).select(*columns).collect()))
    calls = []

    def tell(counts):
        calls.append(counts)
        raise ValueError("somebody else's error")

    listener = live.Progress(tell)
    before = spark.conf.get(live.PROVIDER[0])
    spark.conf.set(*live.PROVIDER)
    spark.streams.addListener(listener)
    (tmp_path / "in").mkdir()
    try:
        lines = spark.readStream.schema("file string, position long, value string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        out = live.observed_stream(live.parsed_stream(lines, rules=rules))
        query = out.writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "ck")).start()
        for k, (low, high) in enumerate(((0, 5), (5, 13), (13, 99))):
            (tmp_path / "part").write_text("\n".join(json.dumps(dict(zip(("file", "position", "value"), r))) for r in rows if low <= r[1] < high))
            (tmp_path / "part").rename(tmp_path / "in" / f"{k}.json")
            query.processAllAvailable()
            time.sleep(0.5)
        seen = len(calls)
        query.stop()
    finally:
        spark.streams.removeListener(listener)
        spark.conf.set(live.PROVIDER[0], before)
    got = spark.table("sessions")
    assert sorted(map(tuple, got.select(*columns).collect())) == want
    assert [tuple(r) for r in got.filter("stopped is not null").select("file", "position", "stopped").collect()] == [("j.log", 12, "consecutive_errors")]
    assert seen >= 2 and listener.errors == listener.calls and sum(c["seen"] for c in calls) == len(want)


def test_timelines_do_not_depend_on_the_drivers_zone(spark, sf_dir, monkeypatch):
    rows = with_extracts(canonical(spark, sf_dir), only=("x_duration", "x_status"))
    got = []
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        monkeypatch.setenv("TZ", zone)
        time.tzset()
        try:
            line = reports.timeline(rows).select("event_count", F.unix_micros("bucket_start").alias("at"))
            part = apply_filter(canonical(spark, sf_dir), EventFilter(start_time=datetime(2024, 1, 5), end_time=datetime(2024, 1, 12))).count()
            got.append((line.agg(F.sum("event_count"), F.min("at"), F.count(F.lit(1))).first(), part))
        finally:
            monkeypatch.undo()
            time.tzset()
    assert got[0][0][0] == 1000 and got[0] == got[1] == got[2]


def test_attributes_keep_kinds_and_depth(spark):
    rows = spark.createDataFrame(
        [('{"n": 5, "o": {"p": 1, "q": [1, null, true]}, "z": null}', "m"), ("[1]", "m"), (None, "m"), ("bad", "m")], "attributes string, message string"
    ).withColumn("timestamp", F.lit("2024-01-01"))
    got = normalize(rows, None, Defaults(attributes={"n": 1, "r": {"deep": [1, 2.5]}}))
    assert [json.loads(r.a) for r in got.select(F.to_json("attributes").alias("a")).collect()] == [
        {"n": 5, "o": {"p": 1, "q": [1, None, True]}, "r": {"deep": [1, 2.5]}, "z": None}, *[{"n": 1, "r": {"deep": [1, 2.5]}}] * 3
    ]
    found = apply_filter(got, EventFilter(attribute_equals={"n": 5, "z": None}, attribute_exists=("o.p", "r.deep")))
    assert found.count() == 1


def test_every_letter_folds_as_unicode_says(spark):
    letters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = [("".join(letters[k : k + 64]) + "x",) for k in range(0, len(letters), 64)] + [("STRASSE straße",), ("ΣΊΣΥΦΟΣ ﬃ İ",), (None,)]
    got = spark.createDataFrame(rows, "t string").select("t", fold_case("t").alias("f")).collect()
    assert all(r.f == (None if r.t is None else r.t.casefold()) for r in got)


def test_letters_fold_the_same_beside_any_other(spark):
    """Each way of folding, and texts that must change from one to another for a single letter."""
    rows = [(f"STRAẞE {x} ÉÇß\nЖŸ“”漢{x}",) for x in ("", "ſ", "ΑΣ", "İ", "ŉ", "µ", "ﬃ", "😀", "Ა", "Ꭰ", "\u0345", "ǰ")]
    got = spark.createDataFrame(rows, "t string").select("t", fold_case("t").alias("f")).collect()
    assert [r.f for r in got] == [r.t.casefold() for r in got]


def test_folded_filter_works_on_rows_dealt_out(spark, sf_dir):
    """A row group is read by one task: folding and the filter come after the rows are dealt, and fold a text once."""
    found = QUERIES["filter_text_folded"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert -1 < plan.index("Filter") < plan.index("Generate") < plan.index("Exchange RoundRobin") and plan.count("octet_length") == 1


REDIS_FORMS = {
    "1:M 01 Jan 2024 10:00:00.123456 * x": (1, "master", 123456, None), "[1234] 01 Jan 10:00:00 # x": (1234, None, 0, None),
    "01 Jan 2024 10:00:00.5 . x": (None, None, 500000, None), "9:z 1 Jan 2024 10:00:00 - x": (9, "unknown", 0, None),
    "2024-01-01T10:00:00.1Z stdout F 7:S 01 Jan 2024 10:00:00 * x": (7, "replica", 0, "stdout"),
    "Jan  1 10:00:00 box redis-server[77]: 12:C 1 Jan 2024 10:00:00 * x": (12, "child", 0, "redis-server[77]"),
}


@pytest.mark.parametrize("line", REDIS_FORMS)
def test_redis_forms(spark, line):
    (r,) = parse.parse(parse.lines_of(spark, line), Registry(context=Context(year=2024))).collect()
    pid, role, micros, process = REDIS_FORMS[line]
    found = json.loads(r.event.attributes)
    assert (r.parser, r.status, r.event.timestamp) == ("redis_log", "success", datetime(2024, 1, 1, 10, 0, 0, micros))
    assert (found.get("pid"), found.get("role"), found.get("outer_process")) == (pid, role, process)


def test_redis_endpoints_and_summaries(spark):
    rows = spark.createDataFrame([("host:6379",), ("[::1]:1",), ("host",), ("host:99999",), ("",)], "e string")
    got = [(r.x.host, r.x.port) for r in rows.select(redis_endpoint("e").alias("x")).collect()]
    assert got == [("host", 6379), ("::1", 1), ("host", None), ("host", None), (None, None)]
    (r,) = spark.createDataFrame([(" a  b\n" + "x" * 400,)], "t string").select(summary_text("t").alias("s")).collect()
    assert r.s.startswith("a b xx") and r.s.endswith("...") and len(r.s) == 300
