"""The canonical event and its fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Severities in their sort order.
SEVERITIES = ("trace", "debug", "info", "notice", "warning", "error", "critical", "fatal", "unknown")
SEVERITY_RANK = {name: k for k, name in enumerate(SEVERITIES, 1)}

# Kinds of source.
SOURCE_TYPES = (
    "iis", "redis", "json", "xml", "csv", "nginx", "apache", "windows_event", "syslog", "linux_syslog",
    "kubernetes", "openshift", "jenkins", "application", "http", "file", "database", "unknown",
)
#: Kinds that a text may name; the others come from code only.
NAMED_SOURCE_TYPES = tuple(s for s in SOURCE_TYPES if s not in ("http", "file", "database"))

_TEXT = (
    "event_type", "service", "application", "environment", "host", "source", "trace_id", "correlation_id",
    "user_id", "client_ip", "server_ip", "http_method", "http_path",
)

EVENT = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw_message", T.StringType()),
        *(T.StructField(name, T.StringType()) for name in _TEXT),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("attributes", T.VariantType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

#: Added when an event is stored.
STORED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("inserted_at", T.TimestampType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("estimated_size_bytes", T.LongType()),
        T.StructField("source_batch_id", T.StringType()),
    ]
)


def severity_rank(severity: str | Column = "severity") -> Column:
    """The place of a severity in the sort order; null for null."""
    column = F.col(severity) if isinstance(severity, str) else severity
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        out = F.when(column == name, rank).otherwise(out)
    return out


def conform(events: DataFrame) -> DataFrame:
    """Adds columns of the canonical event that ``events`` lacks, as nulls."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in EVENT.fields if f.name not in events.columns}
    return events.withColumns(missing) if missing else events


def invalid(events: DataFrame) -> Column:
    """Why a row cannot be an event, or null."""
    return F.coalesce(
        F.when(F.col("timestamp").isNull(), "timestamp is missing"),
        F.when(F.coalesce(F.trim("message"), F.lit("")) == "", "message is blank"),
        F.when(~F.col("http_status").between(100, 599), "http_status is out of range"),
        F.when((F.col("duration_ms") < 0) | F.isnan("duration_ms") | (F.abs("duration_ms") == float("inf")), "duration_ms is invalid"),
        F.when(~F.col("severity").isin(*SEVERITIES), "severity is unknown"),
        F.when(~F.col("source_type").isin(*SOURCE_TYPES), "source_type is unknown"),
    )
