"""Paths, empty contents, kinds of content, and plugins that are started together."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from timberline import report_queries
from timberline.operators import parse
from timberline.sources import encoding, ingest, lines
from timberline.sources.parsers import LogFormat, Registry
from timberline.sources.plugins import Plugins
from timberline.sources.shared import dealt_by_rows


def test_links_pipes_and_sizes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (tmp_path / "far.log").write_text("elsewhere\n")
    (folder / "a.log").write_text("one\n")
    (folder / "empty.log").write_text("")
    (folder / "large.log").write_text("x" * 3000)
    (folder / "link.log").symlink_to(tmp_path / "far.log")
    os.mkfifo(folder / "pipe.log")

    def errors(**options):
        got = ingest.read_files(spark, str(folder), ingest.IngestOptions(max_bytes=2000, **options)).collect()
        assert all((r.content is None) == (r.error is not None) for r in got)
        return {r.path.rsplit("/", 1)[1]: r.error for r in got}

    want = {"a.log": None, "large.log": "FILE_TOO_LARGE", "link.log": "SYMLINK_NOT_ALLOWED"}  # Spark passes over files without a length
    assert errors() == want
    assert errors(follow_symlinks=True) == want | {"link.log": None}
    with pytest.raises(ValueError, match="NOT_REGULAR_FILE"):
        ingest.read_files(spark, f"{folder}/pipe.log")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in ingest.ingest(ingest.read_files(spark, f"{folder}/[a]*.log")).collect()}
    assert got == {"a.log": ("one\n", None)}
    for read in (lines.numbered_lines, lines.bounded_lines):
        for name in ("link.log", "pipe.log"):
            with pytest.raises(ValueError, match="SYMLINK_NOT_ALLOWED|NOT_REGULAR_FILE"):
                read(spark, f"{folder}/{name}")
        assert [r.value for r in read(spark, f"{folder}/link.log", follow_symlinks=True).collect()] == ["elsewhere"]
        with pytest.raises(LookupError):
            read(spark, f"{folder}/a.log", encoding="no-such-code")


def test_content_is_never_read_of_files_over_the_limit(spark, tmp_path):
    (tmp_path / "a.log").write_text("x" * 3000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # to read more fails the job
    try:
        assert [r.error for r in ingest.read_files(spark, str(tmp_path), ingest.IngestOptions(max_bytes=100)).collect()] == ["FILE_TOO_LARGE"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_empty_texts(spark):
    files = ingest.text_rows(spark, {"a.log": "", "b.log": "\ufeff", "c.log": "x"})
    assert {r.path: (r.text, r.error) for r in ingest.ingest(files).collect()} == {"a.log": (None, "EMPTY_CONTENT"), "b.log": (None, "EMPTY_CONTENT"), "c.log": ("x", None)}
    allowed = ingest.ingest(files, ingest.IngestOptions(allow_empty=True)).collect()
    assert {r.path: (r.text, r.error, "EMPTY_CONTENT_ALLOWED" in r.warnings) for r in allowed} == {"a.log": ("", None, True), "b.log": ("", None, True), "c.log": ("x", None, False)}


def test_kind_of_content_counts_where_no_extension_does(spark):
    redis = "12:M 01 Jan 2024 10:00:00.123 * Ready to accept connections"
    told = '{"timestamp": "2024-01-01T00:00:00Z", "level": "info", "message": "x"}'
    rows = [("a", 0, redis, None), ("b", 0, redis, "text/plain; charset=utf-8"), ("c", 0, redis, "Application/JSON"), ("d", 0, told, "application/json"), ("e.log", 0, redis, "application/json"), ("f", 0, redis, "image/png")]
    got = parse.parse(spark.createDataFrame(rows, "file string, position long, value string, content_type string")).collect()
    assert {r.file: r.parser for r in got} == {"a": "redis_log", "b": "redis_log", "c": None, "d": "json_log", "e.log": "redis_log", "f": "redis_log"}


class Closing:
    def __init__(self, log, *names):
        self.log, self.formats = log, [made(n) for n in names]

    def close(self):
        self.log.append([f.name for f in self.formats])


def made(name):
    return LogFormat(name, 500, "application", lambda line: F.lit(0.0), lambda line: F.lit(None))


def test_plugins_start_together():
    log, registry = [], Registry()
    plugins = Plugins(registry, most=4)
    got = plugins.start({"a": lambda: Closing(log, "one", "two"), "b": lambda: Closing(log, "three", "one"), "c": [1], "d": made("four"), "e": made("five")})
    assert [r.formats for r in got] == [["one", "two"], [], [], ["four"], []]
    assert [(r.error or "").split(":")[0] for r in got] == ["", "ValueError", "TypeError", "", "OverflowError"]
    assert {"one", "two", "four"} <= set(registry.formats) and "three" not in registry.formats and log == [["three", "one"]]
    assert plugins.close() == [] and log == [["three", "one"], ["one", "two"]]
    assert plugins.load_packages("no.such.group", required=True)[0].error.startswith("LookupError")


def test_one_failure_leaves_the_registry_as_it_was():
    log, registry = [], Registry()
    before = dict(registry.formats)
    plugins = Plugins(registry, on_error="raise")
    with pytest.raises(TypeError):
        plugins.start({"a": lambda: Closing(log, "one"), "b": [1]})
    assert registry.formats == before and log == [["one"]] and [r.formats for r in plugins.loaded] == [[], []]


def test_taken_names():
    registry = Registry()
    plugins = Plugins(registry, duplicates="replace")
    first, second = made("mine"), made("mine")
    assert plugins.load("a", first).error is None and plugins.load("b", second).error is None and registry.get("mine") is second
    assert plugins.load("c", made("json_log")).error.startswith("PermissionError") and registry.get("json_log") is not None
    assert Plugins(registry, duplicates="replace", replace_builtin=True).load("d", made("json_log")).error is None
    with pytest.raises(ValueError):
        Plugins(registry, duplicates="other")


def uniform_documents(spark, tmp_path):
    """Texts that pack by more than a hundred times among others, each as a document of every kind of file."""
    texts = ["word " * 9000, "Erin.\nErin. " * 4000, "x" * 150_000, "plain"]
    rows = [(64 * k + j, texts[j % 4]) for k in (0, 1, 3) for j in range(32)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return dict(rows)


def test_uniform_documents_come_back_from_packed_files(spark, tmp_path):
    texts = uniform_documents(spark, tmp_path)
    got = {r.path: r for r in report_queries.ingest_files(spark, str(tmp_path)).collect()}
    packed = {p: r for p, r in got.items() if p.endswith((".gz", ".zip"))}
    assert len(packed) == 24 and all(r.error is None and r.characters == len(texts[int(p[1:].split(".")[0])]) for p, r in packed.items())
    counts = {r.path: r.n_lines for r in report_queries.ingest_lines(spark, str(tmp_path)).collect()}
    assert set(counts) == {p for p, r in got.items() if r.error is None} and counts["d5.log.gz"] == 4001
    lines_of = report_queries.archive_line_rows(spark, str(tmp_path))
    assert {r.doc_id for r in lines_of.filter("error is null").collect()} == set(texts) and lines_of.filter("error is not null").count() == 0
    bomb = ingest.ingest(ingest.bytes_rows(spark, {"bomb.gz": gzip.compress(b"x" * 90000)})).first()
    assert bomb.error == "ARCHIVE_RATIO"  # others' archives are judged as before


def test_short_texts_are_read_in_their_encoding():
    for text in ("A", "A.", "De.", "Er\u00f6."):
        assert encoding.detect(text.encode("utf-16-le")) == ("utf-16-le", 1.0) and encoding.wide(text.encode("utf-16-be"))[0] == "utf-16-be"
    for text in ("А.", "Де.", "Ре.", "Ер.", "Ле"):
        name, confidence = encoding.detect(text.encode("iso-8859-5"))
        assert name == "iso-8859-5" and encoding.ENOUGH <= confidence < encoding.SURE
    for text in ("à", "3 ÷ 4", "3 × 4", "20 °C", "À la", "École", "µs", "a ± b", "© 2020"):  # at most as likely otherwise: left to the fallbacks
        found = encoding.detect(text.encode("cp1252"))
        assert found[0] == "cp1252" or found[1] < encoding.ENOUGH
    assert all(encoding.wide(data) is None for data in (b"", b"ab", b"\0\0", b"\1\0", b"A\0\4\4"))


def test_short_documents_in_every_encoding(spark, tmp_path):
    rows = [(4 * k + j, text) for k, text in enumerate(("A.", "De.", "Re.", "Er\u00f6.")) for j in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.encoding for r in report_queries.detected_encodings(spark, str(tmp_path)).collect()}
    assert got == {d: "utf-8" if d % 4 < 2 and d != 13 else ("utf-8", "cp1252", "iso-8859-5", "utf-16-le")[d % 4] for d, _ in rows}


def test_costly_rows_are_dealt_by_their_number(spark, tmp_path):
    """One row group in many splits of a file: all but one of them are empty, and yet rows reach tasks evenly."""
    spark.range(3000).selectExpr("id", "repeat(uuid(), 40) AS text").coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = spark.read.parquet(str(tmp_path / "one"))
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in dealt_by_rows(rows, 100).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) == 30 and sum(sizes) == 3000 and max(sizes) <= 130


def test_json_texts_that_look_like_other_kinds(spark):
    line = '{"timestamp": "2024-01-01T00:00:00Z", "level": "info", "message": "[a]", "service": "true", "host": true, "app": {"x": 1}, "env": 7, "user_id": ["u"], "source": null, "logger": " l "}'
    row = parse.parse(parse.lines_of(spark, line), mode="json_log").first()
    e = row.event
    assert (row.status, e.message, e.service, e.host, e.application, e.environment, e.user_id, e.source) == ("success", "[a]", "true", "True", None, "7", None, "l")
    assert '"json_profile":"generic","json_profile_confidence":1.0' in e.attributes


def test_parsing_carries_no_pieces_of_formats(spark):
    """Every row goes through one step of all formats; columns of formats it does not have would be copied at each."""
    plan = parse.parse(parse.lines_of(spark, "junk"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") <= 8
