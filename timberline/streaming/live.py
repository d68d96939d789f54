"""The same parsing over a stream of lines, with event-time windows, late data and deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.parse import StopRules, parse
from ..operators.reports import count_where, timeline_severity
from ..operators.store import content_hash
from ..schema import EVENT
from ..sources.parsers import Registry, with_detection


def line_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """file, position and value of lines that appear in a folder."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("position"), "value")


def event_stream(lines: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Events of stateless formats, line by line; formats with header lines need whole files (``foreach_files``)."""
    formats = [f for f in (registry or Registry()).active() if f.name != "iis_w3c"]
    rows = with_detection(lines, formats).withColumn("parser", F.col("detected.name"))
    made = []
    for f in formats:
        rows, name, _ = f.staged(rows, header=False)
        made.append(name)
    rows = rows.withColumn("event", F.coalesce(*made)).filter("event is not null and event.timestamp is not null")
    fields = [f.name for f in EVENT.fields if f.name not in ("schema_version", "event_id", "ingested_at", "raw_message", "attributes")]
    return rows.select(F.col("value").alias("raw_message"), *(F.col(f"event.{f}").alias(f) for f in fields), F.col("event.attributes").alias("attributes"))


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each content once within the watermark."""
    hashed = events.withColumn("content_hash", content_hash(events))
    return hashed.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["content_hash"])


def live_timeline(events: DataFrame, bucket: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per time bucket and folded severity, once the watermark has passed."""
    rows = events.withWatermark("timestamp", late)
    return rows.groupBy(F.window("timestamp", bucket), timeline_severity().alias("severity")).agg(
        F.count(F.lit(1)).alias("event_count"), count_where(F.col("http_status") >= 500).alias("server_errors")
    ).select(F.col("window.start").alias("bucket_start"), "severity", "event_count", "server_errors")


# ---- sessions: what is known of a file lasts from one micro-batch to the next ---------------------------------------------

_HEADED = "file string, position long, value string, header array<string>"
_COUNTS = "seen long, tried long, failed long, run long, stopped string"
#: The state store that these operators need; sessions of streams set it.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Session(StatefulProcessor):
    """State of one value for each file, dropped after ``idle`` seconds without lines."""

    SCHEMA = ""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", self.SCHEMA)

    def again(self, timers: Any) -> None:
        """Moves the file's timer."""
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 1000 * self.idle)

    def handleExpiredTimer(self, key: Any, timers: Any, expired: Any) -> Iterator[pd.DataFrame]:  # noqa: N802  (Spark's name)
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Headed(_Session):
    SCHEMA = "header array<string>"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        names = list(self.state.get()[0]) if self.state.exists() else None
        lines = pd.concat(list(rows)).sort_values("position", kind="stable")
        headers = []
        for value in lines["value"]:
            headers.append(names)
            if value is not None and value[:8].lower() == "#fields:" and value[8:].strip():
                names = value[8:].lower().split()
        if names is not None:
            self.state.update((names,))
        self.again(timers)
        yield pd.DataFrame({"file": lines["file"], "position": lines["position"], "value": lines["value"], "header": headers})


class _Stopped(_Session):
    SCHEMA = _COUNTS

    def __init__(self, idle: int | None, rules: StopRules):
        super().__init__(idle)
        self.rules = rules

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        seen, tried, failed, errors, why = self.state.get() if self.state.exists() else (0, 0, 0, 0, None)
        lines = pd.concat(list(rows)).sort_values("position", kind="stable")
        marks: list[str | None] = []
        for status in lines["status"] if why is None else ():
            seen += 1
            tried += status in ("success", "failure")
            failed += status == "failure"
            errors = errors + 1 if status == "failure" else 0 if status == "success" else errors
            why = self.rules.broken(seen, tried, failed, errors, status == "failure")
            marks.append(why)
            if why:
                break
        self.state.update((seen, tried, failed, errors, why))
        self.again(timers)
        if marks:
            kept = lines.iloc[: len(marks)]
            yield kept.assign(stopped=pd.Series(marks, index=kept.index, dtype=object))


def _sessions(rows: DataFrame, processor: _Session, schema: StructType | str) -> DataFrame:
    return rows.groupBy("file").transformWithStateInPandas(processor, schema, "Append", "None" if processor.idle is None else "ProcessingTime")


def headed(lines: DataFrame, idle: int | None = None) -> DataFrame:
    """Adds the field names of the last ``#Fields:`` line of the row's file, from this or an earlier micro-batch.

    ``lines`` has file, position and value; a file's lines come in order of position, in one micro-batch or in several.
    A file's state is forgotten after ``idle`` seconds without lines. A task holds one file's lines of one
    micro-batch. The session needs the state store of PROVIDER.
    """
    return _sessions(lines.select("file", "position", "value"), _Headed(idle), _HEADED)


def until_stopped(parsed: DataFrame, rules: StopRules, idle: int | None = None) -> DataFrame:
    """The rows of each file up to the one at which a rule stops it, and in ``stopped``, on that row, the rule's name:
    as ``operators.parse.stopped``, with counts that last from one micro-batch to the next.

    ``parsed`` has file, position and status; its other columns go along. Once a file has stopped, its later lines are
    dropped until its state is forgotten, after ``idle`` seconds without lines.
    """
    return _sessions(parsed, _Stopped(idle, rules), StructType([*parsed.schema, StructField("stopped", StringType())]))


def parsed_stream(lines: DataFrame, registry: Registry | None = None, rules: StopRules | None = None, idle: int | None = None) -> DataFrame:
    """Lines of a stream parsed with all formats, those with header lines too, up to where ``rules`` stop their files.

    file, position, value, parser, confidence, status, error and the event as JSON.
    """
    parsed = parse(headed(lines, idle), registry)
    flat = parsed.select("file", "position", "value", "parser", "confidence", "status", "error", F.to_json("event").alias("event"))
    return flat if rules is None else until_stopped(flat, rules, idle)


class Progress(StreamingQueryListener):
    """Calls ``tell`` with the counts that ``observed`` names, after each micro-batch; its errors are counted, and stop
    nothing."""

    def __init__(self, tell: Callable[[dict[str, int]], None], name: str = "parsing"):
        self.tell, self.name, self.calls, self.errors = tell, name, 0, 0

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802  (Spark's names)
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.calls += 1
            try:
                self.tell(row.asDict())
            except Exception:  # noqa: BLE001  (somebody else's code)
                self.errors += 1

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        pass


def observed_stream(parsed: DataFrame, name: str = "parsing") -> DataFrame:
    """The same rows, with counts by status under ``name`` in the progress of each micro-batch."""
    s = F.col("status")
    return parsed.observe(name, F.count(F.lit(1)).alias("seen"), *(F.count_if(s == k).alias(k) for k in ("success", "failure", "skipped", "header", "comment")))


def foreach_files(lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, registry: Registry | None = None) -> StreamingQuery:
    """Parses each micro-batch as a batch, header lines and all, and hands it to ``sink`` (parsed lines, batch number)."""

    def one(batch: DataFrame, number: int) -> None:
        sink(parse(batch.withColumn("position", F.monotonically_increasing_id()), registry), number)

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
