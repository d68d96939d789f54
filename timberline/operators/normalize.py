"""Raw columns to canonical events: aliases, defaults from context, required fields."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number, severity, source_type, timestamp
from ..schema import EVENT, conform


@dataclass(frozen=True)
class Defaults:
    """What stands for a field that a row lacks, and attributes that all rows get."""

    source_type: str = "application"
    service: str | None = None
    application: str | None = None
    environment: str | None = None
    host: str | None = None
    attributes: dict[str, Any] = field(default_factory=dict)


def normalize(rows: DataFrame, aliases: dict[str, str] | None = None, defaults: Defaults = Defaults()) -> DataFrame:
    """Adds error and the canonical columns to every row; the row's own columns of other names go.

    ``aliases`` names the column that stands for a canonical field, where there is one. Severities, kinds of source,
    times and durations are read from text. A row without a time, a message or a known severity gets an error, and
    is kept. Attributes, a variant or JSON, are joined with those of ``defaults``, of which the row's own win; numbers,
    booleans, nulls, lists and nested objects stay what they are. Attributes that are no object count as none.
    """
    aliases = aliases or {}

    def given(name: str) -> Column:
        for column in (aliases.get(name), name):
            if column and column in rows.columns:
                return F.col(column)
        return F.lit(None).cast("string")

    def text(name: str) -> Column:
        value, stands = given(name).cast("string"), getattr(defaults, name, None)
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(stands)) if stands else value

    kinds = dict(rows.dtypes)
    own = lambda name: kinds.get(aliases.get(name, name), kinds.get(name, "string"))
    at = given("timestamp").cast("timestamp") if own("timestamp").startswith("timestamp") else timestamp(given("timestamp"))
    message = F.trim(given("message").cast("string"))
    tags = given("tags") if own("tags").startswith("array") else F.when(given("tags").isNotNull(), F.array(given("tags").cast("string")))
    mine = given("attributes")
    mine = mine if own("attributes") == "variant" else F.try_parse_json(mine.cast("string"))
    # the top level as a map from names to variants
    mine = F.coalesce(F.try_variant_get(mine, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    stands = F.create_map(*(c for k, v in defaults.attributes.items() for c in (F.lit(k), F.parse_json(F.lit(json.dumps(v)))))).cast("map<string,variant>")
    both = F.map_concat(F.map_filter(stands, lambda k, _: ~F.map_contains_key(mine, k)), mine)
    made = {
        "timestamp": at,
        "severity": severity(given("severity").cast("string")),
        "source_type": F.when(given("source_type").isNull(), defaults.source_type).otherwise(source_type(given("source_type"))),
        "message": message,
        "raw_message": message,
        "duration_ms": number(given("duration_ms")),
        "http_status": given("http_status").try_cast("int"),
        "tags": F.coalesce(tags, F.array().cast("array<string>")),
        "attributes": F.to_variant_object(both),
    }
    made |= {f.name: text(f.name) for f in EVENT.fields if f.name not in made and f.name not in ("schema_version", "event_id", "ingested_at")}
    out = conform(rows.select(*(c.alias(n) for n, c in made.items())))
    error = (
        F.when(F.col("timestamp").isNull(), "timestamp is required").when(F.coalesce("message", F.lit("")) == "", "message is required")
        .when(F.col("severity").isNull(), "severity is unknown").when(F.col("source_type").isNull(), "source_type is unknown")
    )
    return out.withColumn("error", error)
