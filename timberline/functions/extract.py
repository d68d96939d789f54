"""Values found in the canonical columns or, failing these, in attributes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean, once

# Where durations, statuses, methods and paths are looked for, in this order.
DURATIONS = {
    "duration_ms": 1.0, "latency_ms": 1.0, "response_time_ms": 1.0, "elapsed_ms": 1.0, "request_time_ms": 1.0,
    "request_time": 1000.0, "duration_us": 0.001, "latency_us": 0.001,
}
STATUSES = ("http_status", "status_code", "http.status_code", "status", "sc_status")
METHODS = ("http_method", "method", "http.method", "cs_method")
PATHS = ("http_path", "route_template", "http.route", "path", "url.path", "request_path", "uri", "cs_uri_stem")
ROUTES = ("route_template", "http.route")
#: Units by the last part of a name.
UNITS = DURATIONS | {"time_taken_ms": 1.0}
HTTP_SOURCES = ("http", "iis", "apache", "nginx")
LARGEST = 1e100

_PART = re.compile(r"(?!__)[A-Za-z0-9_-]+")


def check_path(path: str) -> str:
    """A dotted attribute path: up to 256 characters and 10 parts of letters, digits, ``_`` and ``-``."""
    parts = path.strip().split(".")
    if len(path) > 256 or len(parts) > 10 or not all(_PART.fullmatch(p) for p in parts):
        raise ValueError(f"not a safe attribute path: {path!r}")
    return ".".join(parts)


def variant_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in check_path(path).split("."))


def attribute(path: str, kind: str = "string", column: str = "attributes") -> Column:
    """The value at a dotted path through objects, as ``kind``; null if absent or of another kind."""
    return F.try_variant_get(column, variant_path(path), kind)


def attribute_variant(path: str, column: str = "attributes") -> Column:
    return F.try_variant_get(column, variant_path(path), "variant")


def attribute_exists(path: str, column: str = "attributes") -> Column:
    """True for a value that is there, a null too."""
    return attribute_variant(path, column).isNotNull()


#: The first letters of a variant's type, for each kind of scalar.
NUMBERS, TEXT, TRUTH, NOTHING = ("BIG", "DOU", "DEC", "INT", "FLO", "SMA", "TIN"), "STR", "BOO", "VOI"


def kind_code(value: Column) -> Column:
    """Three letters of a variant's type: those above, OBJ or ARR; null if absent."""
    return F.left(F.schema_of_variant(value), F.lit(3))


def kind_of(value: Column) -> Column:
    """object, array, boolean, string, number, null or absent."""
    names = {"OBJ": "object", "ARR": "array", TRUTH: "boolean", TEXT: "string", NOTHING: "null"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), kind_code(value)), F.when(value.isNull(), "absent").otherwise("number"))


def scalar_text(value: Column) -> Column:
    """A scalar as stripped text, booleans as True and False; null for containers and blanks."""
    kind, text = kind_code(value), F.try_variant_get(value, "$", "string")
    return clean(F.when(kind == TRUTH, F.initcap(text)).when(kind.isin(TEXT, *NUMBERS), text))


def there(value: Column) -> Column:
    """True for a value that is there and not null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return otherwise if out is None else out


def first_value(events: DataFrame, paths: tuple[str, ...]) -> Column:
    """The first value of some attribute paths that is there and not null."""
    none = F.lit(None).cast("variant")
    if "attributes" not in events.columns:
        return none
    return _first([(there(attribute_variant(p)), attribute_variant(p)) for p in paths], none)


def with_duration(events: DataFrame, field: str | None = None, strict: bool = True) -> DataFrame:
    """Adds x_duration (ms), x_duration_field and x_duration_invalid.

    ``field`` is looked at first, then the known names; the first valid value wins. A value is valid if it is a
    finite number of at least 0; booleans never are, strings only if not ``strict``. An event with values but no valid
    one is invalid.
    """
    names = list(dict.fromkeys([*([field] if field else []), *DURATIONS]))
    rows, looked = events, {}
    if "attributes" in events.columns:
        looked = {name: f"_d{k}" for k, name in enumerate(names)}
        rows = once(rows, {c: attribute_variant(name) for name, c in looked.items()})
        kinds = NUMBERS if strict else (TEXT, *NUMBERS)

        def number(c: str) -> Column:
            good = F.col(c).isNotNull() & kind_code(F.col(c)).isin(*kinds)
            return F.when(good, F.try_variant_get(c, "$", "double"))

        rows = once(rows, {f"{c}n": number(c) for c in looked.values()} | {f"{c}t": there(F.col(c)) for c in looked.values()})
    cases = []
    for name in names:
        if name == "duration_ms" and name in events.columns:
            own = F.col(name).cast("double")
            cases.append((name, own.between(0, LARGEST), own, own.isNotNull()))
        if c := looked.get(name):
            value = F.col(f"{c}n")
            cases.append((name, value.between(0, LARGEST), value * UNITS.get(name.rsplit(".", 1)[-1], 1.0), F.col(f"{c}t")))
    seen = reduce(lambda a, b: a | b, (c[3] for c in cases), F.lit(False))
    rows = rows.withColumns(
        {
            "x_duration": _first([(ok, ms) for _, ok, ms, _ in cases], F.lit(None).cast("double")),
            "x_duration_field": _first([(ok, F.lit(name)) for name, ok, _, _ in cases], F.lit(None).cast("string")),
            "_seen": seen,
        }
    )
    rows = rows.withColumn("x_duration_invalid", F.col("_seen") & F.col("x_duration").isNull())
    return rows.drop("_seen", *(c + end for c in looked.values() for end in ("", "n", "t")))


def _column(events: DataFrame, name: str) -> Column:
    return F.col(name) if name in events.columns else F.lit(None).cast("string")


def _paths(field: str | None, known: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*([field] if field else []), *known]))


def status(events: DataFrame, value: Column, field: str | None = None) -> Column:
    """A status from 100 to 599: a whole number or three digits."""
    kind, text = kind_code(value), F.trim(F.try_variant_get(value, "$", "string"))
    found = F.when(kind.isin(TEXT, *NUMBERS) & text.rlike(r"^\d{3}$"), text).try_cast("int")
    own = _column(events, "http_status").cast("int")
    chosen = F.coalesce(own, found) if field is None else F.coalesce(found, own)
    return F.when(chosen.between(100, 599), chosen)


def with_http(events: DataFrame, wanted: set[str], status_field: str | None, method_field: str | None, path_field: str | None) -> DataFrame:
    """Adds x_status, x_method and x_path, or those that are wanted. The first value that is there decides; a route
    template comes before any concrete path unless ``path_field`` names one."""
    looked = {
        "x_status": {"_status": _paths(status_field, STATUSES)}, "x_method": {"_method": _paths(method_field, METHODS)},
        "x_path": {"_route": (path_field,) if path_field else ROUTES, "_path": PATHS},
    }
    rows, made = events, []
    for name, columns in looked.items():
        if name in wanted:  # one step for each, so that generated methods stay small
            rows = once(rows, {c: first_value(events, paths) for c, paths in columns.items()})
            made += columns
    out: dict[str, Column] = {}
    if "x_status" in wanted:
        out["x_status"] = status(events, F.col("_status"), status_field)
    if "x_method" in wanted:
        value, own = scalar_text(F.col("_method")), clean(_column(events, "http_method"))
        out["x_method"] = F.upper(F.coalesce(own, value) if method_field is None else F.coalesce(value, own))
    if "x_path" in wanted:
        out["x_path"] = F.coalesce(scalar_text(F.col("_route")), clean(_column(events, "http_path")), scalar_text(F.col("_path")))
    return rows.withColumns(out).drop(*made) if out else rows


def endpoint(path: Column, keep_slash: bool = False) -> Column:
    """A path without scheme, host, query, fragment and (unless kept) trailing slash, with a leading one."""
    text = F.regexp_replace(F.trim(path), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    text = F.regexp_replace(text, r"[?#].*$", "")
    text = F.when(text.startswith("/"), text).otherwise(F.concat(F.lit("/"), text))
    if not keep_slash:
        text = F.when(F.length(text) > 1, F.regexp_replace(text, "/+$", "")).otherwise(text)
        text = F.when(text == "", "/").otherwise(text)
    return F.when(path.isNotNull(), text)


def status_class(code: Column) -> Column:
    return F.when(code.isNull(), "unknown").otherwise(F.concat(F.floor(code / 100).cast("string"), F.lit("xx")))


def text_field(events: DataFrame, *paths: str) -> Column:
    """Trimmed text of a column of the first name, or of the first attribute path that has any."""
    own = [clean(paths[0])] if dict(events.dtypes).get(paths[0]) == "string" else []
    found = [scalar_text(attribute_variant(p)) for p in paths] if "attributes" in events.columns else []
    return F.coalesce(*own, *found, F.lit(None).cast("string"))


def tags(column: str = "tags") -> Column:
    return F.filter(F.transform(column, lambda t: clean(t)), lambda t: t.isNotNull())


#: What reports read, and where it may be found.
TEXT_FIELDS = {
    "x_service": ("service", "service.name"), "x_host": ("host", "host.name"), "x_event_type": ("event_type",),
    "x_parser": ("parser_name", "parser.name", "parser"),
}
EXTRACTS = ("x_duration", "x_status", "x_method", "x_path", *TEXT_FIELDS, "x_endpoint", "x_http")


def with_extracts(events: DataFrame, duration_field: str | None = None, status_field: str | None = None,
                  method_field: str | None = None, path_field: str | None = None, strict: bool = True,
                  only: tuple[str, ...] = EXTRACTS) -> DataFrame:
    """Adds x_duration, x_duration_field, x_duration_invalid, x_status, x_method, x_path, x_endpoint, x_service, x_host,
    x_event_type, x_parser and x_http: what all reports read, or those that ``only`` names."""
    wanted = set(only)
    events = events.drop(*EXTRACTS, "x_duration_field", "x_duration_invalid")  # those of an earlier extraction
    if wanted & {"x_endpoint", "x_http"}:
        wanted.add("x_path")
    if "x_http" in wanted:
        wanted |= {"x_status", "x_method"}
    rows = with_duration(events, duration_field, strict) if "x_duration" in wanted else events
    rows = with_http(rows, wanted, status_field, method_field, path_field)
    texts = {name: text_field(events, *paths) for name, paths in TEXT_FIELDS.items() if name in wanted}
    rows = once(rows, texts) if texts else rows
    if "x_endpoint" in wanted:
        rows = once(rows, {"x_endpoint": endpoint(F.col("x_path"))})
    if "x_http" in wanted:
        found = F.col("x_status").isNotNull() | F.col("x_method").isNotNull() | F.col("x_path").isNotNull()
        rows = rows.withColumn("x_http", found | F.coalesce(F.col("source_type").isin(*HTTP_SOURCES), F.lit(False)))
    return rows
