"""Lines to events: detection by row or file, parsing, batch policies, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once, record_preview
from ..schema import EVENT
from ..sources.lines import bounded_lines, numbered_lines, plain
from ..sources.parsers import LogFormat, Registry, extension_of, iis_header, with_detection
from ..sources.shared import stash
from .ordering import running

LINE_LIMIT, VOTERS = 1 << 20, 20
#: Rows up to which a table of one row a file is broadcast.
BROADCAST, BROADCAST_BYTES = 50_000, 64 << 20


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", bounded: bool = False, limit: int = LINE_LIMIT) -> DataFrame:
    """file, position (the line's number, from 1) and value of every line; ``bounded`` lines are never held whole above
    ``limit`` characters, and come with preview, characters and oversized."""
    return bounded_lines(spark, path, limit, encoding=encoding) if bounded else numbered_lines(spark, path, encoding)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as single records, without the line ends at their end; an empty file has none."""
    rows = spark.read.option("wholetext", True).text(plain(path)).filter("value != ''")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("position"), F.rtrim("value", F.lit("\r\n")).alias("value"))


def lines_of(spark: SparkSession, text: str, name: str = "text") -> DataFrame:
    return spark.createDataFrame([(name, k, v) for k, v in enumerate(text.splitlines())], "file string, position long, value string")


def small(rows: DataFrame) -> DataFrame | None:
    """Writes a table of one row a file, so that it is made once; marked for broadcast if it has at most BROADCAST rows
    and BROADCAST_BYTES bytes, left to a shuffled join if it has more, None if it is empty."""
    kept = stash(rows)
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, size = kept.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if not n:
        return None
    return F.broadcast(kept) if n <= BROADCAST and size <= BROADCAST_BYTES else kept


def with_headers(lines: DataFrame) -> DataFrame:
    """Adds the field names that the last ``#Fields:`` line before a row gives, or null.

    A file's few header lines are gathered and looked up by position; the file's rows need no common order, and no
    shuffle unless there are over BROADCAST files with headers.
    """
    heads = lines.filter("value like '#Fields:%'").select("file", F.struct("position", iis_header(F.col("value")).alias("names")).alias("head"))
    by_file = heads.groupBy(F.col("file").alias("_file")).agg(F.array_sort(F.collect_list("head")).alias("_heads"))
    found = small(by_file)
    if found is None:
        return lines.withColumn("header", F.lit(None).cast("array<string>"))
    joined = lines.join(found, F.col("file") == F.col("_file"), "left")
    before = F.filter("_heads", lambda h: h["position"] < F.col("position"))
    return joined.withColumn("header", F.try_element_at(before, F.lit(-1))["names"]).drop("_file", "_heads")


def vote(lines: DataFrame, formats: list[LogFormat], voters: int = VOTERS) -> DataFrame:
    """file and parser: the format that most of a file's first lines have, then the surest, then by priority.

    Of each part of a file only the first lines are shuffled.
    """
    first = Window.partitionBy("file").orderBy("position")
    head = lines.filter(F.trim("value") != "").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= voters)
    kind = [c for c in ("content_type",) if c in lines.columns]
    found = with_detection(head.select("file", "value", *kind), formats, extension=extension_of(F.col("file")), content_type=F.col(kind[0]) if kind else None).filter("detected is not null")
    tally = found.groupBy("file", "detected.name").agg(F.count(F.lit(1)).alias("n"), F.avg("detected.confidence").alias("confidence"))
    places = {f.name: k for k, f in enumerate(formats)}
    place = F.element_at(F.create_map(*(F.lit(x) for pair in places.items() for x in pair)), F.col("name"))
    return tally.groupBy("file").agg(F.min_by("name", F.struct(-F.col("n"), -F.col("confidence"), place)).alias("parser"))


def parse(lines: DataFrame, registry: Registry | None = None, mode: str = "row", mixed: bool = True, limit: int = LINE_LIMIT) -> DataFrame:
    """Adds parser, confidence, ambiguous (of the line's detection), status (success, failure, skipped, header,
    comment), error and event to every line.

    ``mode`` is ``row`` (each line by itself), ``file`` (a vote of the file's first lines; with ``mixed``, lines that
    have not the voted form are taken by themselves) or a format's name. Over-long lines fail and lose their text.
    Lines may come with a column header, the field names that hold for them; without it, a file's header lines are
    looked up. With it, all but ``file`` mode also works on streams. A column content_type (such as ``application/json``)
    narrows the formats of files whose names have no extension.
    """
    registry = registry or Registry()
    formats = registry.active() if mode in ("row", "file") else [registry.get(mode)]
    iis = any(f.name == "iis_w3c" for f in formats)
    lines = lines.drop("parser", "confidence", "ambiguous", "status", "error", "event")
    rows = lines if "header" in lines.columns else with_headers(lines) if iis else lines.withColumn("header", F.lit(None).cast("array<string>"))
    long = F.coalesce(F.length("value") > limit, F.lit(False))
    if "oversized" in lines.columns:  # found so by the reader, which has let go of the text
        long = long | F.col("oversized")
    rows = rows.withColumns({"too_long": long, "value": F.when(F.length("value") <= limit, F.col("value"))})
    directive = F.coalesce(F.startswith("value", F.lit("#")), F.lit(False))
    known = F.when(F.col("header").isNotNull() & ~directive, "iis_w3c")
    if mode in ("row", "file"):
        rows = with_detection(rows, formats, extension=extension_of(F.col("file")), content_type=F.col("content_type") if "content_type" in lines.columns else None)
        own = F.coalesce(F.col("detected.name"), known)
        chosen = own
        if mode == "file":
            votes = small(vote(lines, formats).withColumnsRenamed({"file": "_file", "parser": "_vote"}))
            rows = rows.withColumn("_vote", F.lit(None).cast("string")) if votes is None else rows.join(votes, F.col("file") == F.col("_file"), "left").drop("_file")
            chosen = F.col("_vote")
            if mixed:
                fits = F.lit(False)
                for f in formats:
                    fits = fits | ((F.col("_vote") == f.name) & ((f.detect(F.col("value")) > 0) | (F.col("header").isNotNull() if f.name == "iis_w3c" else F.lit(False))))
                chosen = F.when(F.coalesce(fits, F.lit(False)), F.col("_vote")).otherwise(F.coalesce(own, F.col("_vote")))
        told = F.coalesce(F.col("detected.name") == F.col("parser"), F.lit(False))
        rows = once(rows, {"parser": chosen}).drop("_vote")
        rows = rows.withColumns({"confidence": F.when(told, F.col("detected.confidence")), "ambiguous": F.when(told, F.col("detected.ambiguous"))}).drop("detected")
    else:
        rows = rows.withColumns({"parser": F.lit(mode), "confidence": F.lit(1.0), "ambiguous": F.lit(False)})
    event = F.coalesce(*(F.when(F.col("parser") == f.name, f.event(F.col("value"), F.col("header"))) for f in formats))
    rows = once(rows, {"event": event})
    blank = F.coalesce(F.trim("value") == "", F.lit(False))
    status = (
        F.when(F.col("too_long"), "failure").when(blank, "skipped")
        .when(directive & F.startswith("value", F.lit("#Fields:")), "header").when(directive & ((F.col("parser") == "iis_w3c") | F.col("parser").isNull()), "comment")
        .when(F.col("event").isNull(), "failure").when(invalid_event().isNotNull(), "failure").otherwise("success")
    )
    error = F.when(F.col("too_long"), "RECORD_TOO_LARGE").when(F.col("parser").isNull(), "NO_FORMAT").when(F.col("event").isNull(), "NO_MATCH").otherwise(invalid_event())
    rows = rows.withColumn("status", status)
    return rows.withColumn("error", F.when(F.col("status") == "failure", error)).drop("too_long", "header")


def invalid_event() -> Column:
    e = F.col("event")
    return F.when(e["timestamp"].isNull(), "INVALID_TIMESTAMP").when(F.coalesce(F.trim(e["message"]), F.lit("")) == "", "MISSING_MESSAGE").when(e["severity"].isNull(), "INVALID_SEVERITY").when(e["duration_ms"] < 0, "INVALID_DURATION")


def events(parsed: DataFrame, schema_version: str = "1.0") -> DataFrame:
    """Canonical events of the lines that parsed, with their file and position."""
    good = parsed.filter("status = 'success'")
    out = good.select("file", "position", F.col("value").alias("raw_message"), "event.*").withColumns(
        {
            "attributes": F.try_parse_json("attributes"), "schema_version": F.lit(schema_version),
            "event_id": F.uuid(), "ingested_at": F.current_timestamp(),
        }
    )
    return out.select(*(f.name for f in EVENT.fields), "file", "position")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Lines that failed, and why; the whole line stays beside its preview."""
    preview = record_preview("value")
    if "preview" in parsed.columns:
        preview = F.coalesce(preview, record_preview("preview"))
    return parsed.filter("status = 'failure'").select("file", "position", "parser", "error", preview.alias("preview"), "value")


def statistics(parsed: DataFrame) -> DataFrame:
    """One row: lines by status, characters, first and last event time, success rate of those tried."""
    s = F.col("status")
    row = parsed.agg(
        F.count(F.lit(1)).alias("seen"), *(F.count_if(s == k).alias(k) for k in ("success", "failure", "skipped", "header", "comment")),
        F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("characters"), F.min("event.timestamp").alias("first_event"), F.max("event.timestamp").alias("last_event"),
    )
    return row.withColumns({"attempted": F.col("success") + F.col("failure"), "success_rate": F.coalesce(F.try_divide(F.col("success"), F.col("success") + F.col("failure")), F.lit(0.0))})


def by_parser(parsed: DataFrame) -> DataFrame:
    return parsed.filter("status in ('success', 'failure')").groupBy("parser", "error").agg(F.count(F.lit(1)).alias("lines"))


def observed(parsed: DataFrame, name: str = "parsing") -> tuple[DataFrame, Observation]:
    """The same lines, and how many of them have passed by status once an action on them has ended.

    Named metrics also reach every listener for query execution or streaming progress, at no further pass.
    """
    seen = Observation(name)
    s = F.col("status")
    return parsed.observe(seen, F.count(F.lit(1)).alias("seen"), *(F.count_if(s == k).alias(k) for k in ("success", "failure", "skipped", "header", "comment"))), seen


@dataclass(frozen=True)
class Collected:
    """A few parsed lines on the driver, and whether there are more."""

    events: list
    failures: list
    more_events: bool
    more_failures: bool


def collected(parsed: DataFrame, events: int = 1000, failures: int = 100) -> Collected:
    """At most so many events and failures, the first by file and position."""

    def first(rows: DataFrame, most: int) -> tuple[list, bool]:
        found = rows.orderBy("file", "position").limit(most + 1).collect()
        return found[:most], len(found) > most

    good, more_good = first(parsed.filter("status = 'success'").select("file", "position", "parser", "event"), events)
    bad, more_bad = first(parsed.filter("status = 'failure'").select("file", "position", "parser", "error"), failures)
    return Collected(good, bad, more_good, more_bad)


@dataclass(frozen=True)
class StopRules:
    """When a file's parsing ends; None turns a rule off."""

    max_records: int | None = None
    max_errors: int | None = None
    consecutive_errors: int | None = 100
    error_rate: float | None = None
    rate_after: int = 100

    def broken(self, seen: int, tried: int, failed: int, errors: int, failure: bool) -> str | None:
        """The rule that stops a file whose last row, a failure or not, gives these counts (``errors``: in a row)."""
        if failure and self.max_errors is not None and failed >= self.max_errors:
            return "max_errors"
        if failure and self.consecutive_errors is not None and errors >= self.consecutive_errors:
            return "consecutive_errors"
        if failure and self.error_rate is not None and tried >= self.rate_after and failed / tried > self.error_rate:
            return "error_rate"
        return "max_records" if self.max_records is not None and seen >= self.max_records else None


def stopped(parsed: DataFrame, rules: StopRules, keys: tuple[str, ...] = ("file",), position: str = "position") -> DataFrame:
    """The rows of each file up to the one, included, at which a rule stops it.

    Rows need a status and a position. Runs of errors are found from the number of successes before each error.
    """
    fail, tried = (F.col("status") == "failure").cast("long"), F.col("status").isin("success", "failure").cast("long")
    sums = {"_n": F.lit(1).cast("long"), "_failed": fail, "_tried": tried, "_good": (F.col("status") == "success").cast("long")}
    counted = running(parsed, [position], sums, keys)
    stop = F.lit(False)
    if rules.max_records is not None:
        stop = stop | (F.col("_n") >= rules.max_records)
    if rules.max_errors is not None:
        stop = stop | ((fail == 1) & (F.col("_failed") >= rules.max_errors))
    if rules.error_rate is not None:
        stop = stop | ((fail == 1) & (F.col("_tried") >= rules.rate_after) & (F.col("_failed") / F.col("_tried") > rules.error_rate))
    if rules.consecutive_errors is not None:
        # failures since the last success: those counted so far, less those counted at that success
        islands = counted.filter("status = 'failure'").groupBy(*keys, F.col("_good").alias("_island")).agg((F.min("_failed") - 1).alias("_base"))
        renamed = islands.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        same = F.col("_good") == F.col("_island")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        counted = counted.join(renamed, same, "left")
        stop = stop | ((fail == 1) & (F.col("_failed") - F.col("_base") >= rules.consecutive_errors))
    ends = counted.filter(stop).groupBy(*keys).agg(F.min("_n").alias("_end")).withColumnsRenamed({k: f"_e_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    out = counted.join(ends, same, "left").filter(F.col("_end").isNull() | (F.col("_n") <= F.col("_end")))
    return out.select(*parsed.columns)
