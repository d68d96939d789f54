"""Log formats as Column expressions: how sure a line's form is, and the event that it stands for.

A format is a ``LogFormat``: ``detect`` gives a confidence from 0 to 1, and ``steps`` lead from the line to a struct of
canonical fields, null where the line does not have the form. Each step names columns made of those of the steps before
it; ``staged`` adds them to a table a few at a time, so that every piece of a line is found once and generated methods
stay small enough to be compiled. Detection picks one format per row or file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache, reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import scalar_text
from ..functions.text import clean, let, lookup, number, once, severity, timestamp
from ..schema import EVENT

FIELDS = [f for f in EVENT.fields if f.name not in ("schema_version", "event_id", "ingested_at", "raw_message")]
ATTRIBUTES = "attributes"
#: Columns by name: the pieces of a line, or what is made of them.
Pieces = dict[str, Column]
#: Columns that one generated method makes.
AT_ONCE = 6
#: Columns of formats that were made before.
_STAGES: dict[tuple, list[Pieces]] = {}


def record(**values: Column) -> Column:
    """A struct of all canonical fields, those not given as nulls; attributes are a struct or text of JSON."""
    out = []
    for f in FIELDS:
        value = values.get(f.name)
        if f.name == ATTRIBUTES:
            value = F.lit(None).cast("string") if value is None else value
        else:
            value = F.lit(None).cast(f.dataType) if value is None else value.cast(f.dataType)
        out.append(value.alias(f.name))
    return F.struct(*out)


#: A sign that no text holds (Unicode sets it aside), between the groups of a match.
SPLIT = "\uffff"


def match(line: Column, pattern: str, n: int) -> Column:
    """All ``n`` groups of a pattern that covers the line, from one match of it; an array of another size if there is none."""
    groups = F.regexp_replace(line, pattern, SPLIT.join(f"${k}" for k in range(1, n + 1)))
    return F.when(~F.contains(line, F.lit(SPLIT)), F.split(groups, SPLIT))


def groups(found: Column, names: tuple[str, ...]) -> Pieces:
    """The groups of ``match`` by name; null if the line does not match or the group took no part or is empty."""
    there = F.size(found) == len(names)
    return {name: F.when(there, F.nullif(F.get(found, F.lit(k)), F.lit(""))) for k, name in enumerate(names)}


def dashless(text: Column) -> Column:
    return F.nullif(text, F.lit("-"))


@dataclass(frozen=True)
class Context:
    """What is known about lines beside their text."""

    vendor: str = "generic"
    year: int | None = None
    zone: str = "UTC"


@dataclass(frozen=True)
class LogFormat:
    """``steps`` end with one that makes the column ``event``; ``parse``, a single expression, may take their place."""

    name: str
    priority: int
    source_type: str
    detect: Callable[[Column], Column]
    parse: Callable[[Column], Column] | None = None
    version: str = "1.0.0"
    tags: tuple[str, ...] = ()
    extensions: tuple[str, ...] = (".log", ".txt")
    #: Kinds of content, which count where a file has no extension; none for any.
    content_types: tuple[str, ...] = ("text/plain",)
    enabled: bool = True
    #: Signs, as a class of a pattern, with which a line of the format can begin, white space aside; None for any.
    heads: str | None = None
    steps: tuple[Callable[[Pieces], Pieces], ...] = ()

    def staged(self, rows: DataFrame, header: bool = True) -> tuple[DataFrame, str, list[str]]:
        """Adds the event, in the column whose name is returned, of rows whose column parser has the format's name; the
        last value names the columns made on the way. Lines are in the column value, field names, if any, in header."""
        key = (self, header, id(SparkContext._gateway))
        if key not in _STAGES:  # columns are the same for all tables, and there are many of them
            _STAGES[key] = self._stages(header)
        stages, out = _STAGES[key], f"_event_{self.name}"
        for named in stages:
            rows = once(rows, named)
        return rows, out, [n for named in stages for n in named if n != out]

    def _stages(self, header: bool) -> list[Pieces]:
        steps = self.steps or (lambda p: {"event": self.parse(p["line"])},)
        chosen, out, stages = F.col("parser") == self.name, f"_event_{self.name}", []
        pieces: Pieces = {"line": F.col("value"), "header": F.col("header") if header else F.lit(None).cast("array<string>")}
        for k, step in enumerate(steps):
            items = [(n, F.when(chosen, c)) for n, c in step(pieces).items()]
            for low in range(0, len(items), AT_ONCE):
                stages.append({out if n == "event" else f"_{self.name}_{k}_{n}": c for n, c in items[low : low + AT_ONCE]})
            pieces |= {n: F.col(out if n == "event" else f"_{self.name}_{k}_{n}") for n, _ in items}
        return stages

    def event(self, line: Column, header: Column | None = None) -> Column:
        """The event as one expression, for a single column or a stream."""
        if not self.steps:
            return self.parse(line)
        none = F.lit(None).cast("array<string>")

        def go(k: int, pieces: Pieces) -> Column:
            made = self.steps[k](pieces)
            if k == len(self.steps) - 1:
                return made["event"]
            return let(F.struct(*(c.alias(n) for n, c in made.items())), lambda s: go(k + 1, pieces | {n: s[n] for n in made}))

        return go(0, {"line": line, "header": none if header is None else header})


# ---- JSON ----------------------------------------------------------------------------------------------------------

# Where each canonical field is looked for in a JSON record.
JSON_PATHS: dict[str, tuple[str, ...]] = {
    "timestamp": ("timestamp", "time", "datetime"),
    "severity": ("level", "severity", "log.level"),
    "message": ("message", "msg", "body"),
    "event_type": ("event_type", "event.type"),
    "service": ("service", "service.name"),
    "application": ("application", "app"),
    "environment": ("environment", "env"),
    "host": ("host", "host.name", "hostname"),
    "source": ("source", "logger", "loggerName", "SourceContext"),
    "trace_id": ("trace_id", "trace.id", "TraceId"),
    "correlation_id": ("correlation_id", "correlation.id"),
    "user_id": ("user_id", "user.id"),
    "client_ip": ("client_ip", "client.ip"),
    "server_ip": ("server_ip", "server.ip"),
    "http_method": ("http_method", "http.request.method"),
    "http_path": ("http_path", "url.path", "http.request.path"),
    "http_status": ("http_status", "http.response.status_code"),
    "duration_ms": ("duration_ms", "duration", "elapsed"),
    "tags": ("tags", "tag"),
    "attributes": ("attributes", "context"),
}
# Fields that tell who wrote a JSON record.
JSON_PROFILES: dict[str, tuple[str, ...]] = {
    "generic": ("timestamp", "level", "message", "service"),
    "ecs": ("@timestamp", "log.level", "service.name", "event.action"),
    "opentelemetry": ("timestamp", "severity_text", "body", "resource"),
    "serilog": ("@t", "@l", "@m", "SourceContext"),
    "nlog": ("time", "level", "message", "logger"),
    "log4j": ("timeMillis", "level", "message", "loggerName"),
    "bunyan": ("time", "level", "msg", "name"),
    "pino": ("time", "level", "msg", "name"),
    "docker": ("log", "stream", "time"),
    "kubernetes": ("kubernetes", "container", "stream", "log"),
}


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split("."))


def _json(line: Column) -> Column:
    """The line's object as a variant; arrays and scalars are none."""
    value = F.try_parse_json(F.when(F.trim(line).startswith("{"), line))
    return let(value, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def json_profile(value: Column, keys: Column) -> Column:
    """Who wrote a record of these keys, and how surely: a quarter for each sign; the first of equals, generic below one
    half."""
    found = []

    def has(sign: str) -> Column:
        return F.variant_get(value, _json_path(sign), "variant").isNotNull() if "." in sign else F.coalesce(F.array_contains(keys, sign), F.lit(False))

    for k, (name, signs) in enumerate(JSON_PROFILES.items()):
        score = sum((has(s).cast("double") * 0.25 for s in signs), F.lit(0.0))
        found.append(F.struct(score.alias("confidence"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
    generic = F.struct(F.lit("generic").alias("name"), F.lit(0.4).alias("confidence"))
    return let(
        F.array_max(F.array(*found)),
        lambda best: F.when(best["confidence"] >= 0.5, F.struct(best["name"].alias("name"), best["confidence"].alias("confidence"))).otherwise(generic),
    )


def json_steps(paths: dict[str, tuple[str, ...]] | None = None, keep_record: bool = True):
    """A JSON object; ``paths`` replaces where some fields are looked for. An object in place of a text is passed over.
    Keys that no canonical field takes are counted."""
    paths = JSON_PATHS | (paths or {})
    texts = [name for name in paths if name not in ("tags", "attributes")]

    def value(p: Pieces) -> Pieces:
        return {"value": F.try_parse_json(F.when(F.trim(p["line"]).startswith("{"), p["line"]))}

    def whole(p: Pieces) -> Pieces:
        return {"whole": F.to_json(p["value"]), "keys": F.json_object_keys(F.to_json(p["value"]))}

    def found(p: Pieces) -> Pieces:
        at = lambda path, kind="variant": F.try_variant_get(p["value"], _json_path(path), kind)

        def text(path: str) -> Column:  # its kind is asked only where the text may be that of a container or a boolean
            return let(at(path, "string"), lambda t: F.when(t.rlike(r"^(?:[\[{]|(?:true|false)$)"), scalar_text(at(path))).otherwise(clean(t)))

        out = {name: F.coalesce(*(text(path) for path in paths[name])) for name in texts}
        out["tags"] = F.coalesce(*(at(path, "array<string>") for path in paths["tags"]), *(F.array(scalar_text(at(path))) for path in paths["tags"]))
        out["own"] = F.coalesce(*(F.to_json(at(path)) for path in paths["attributes"]))
        out["profile"] = json_profile(p["value"], p["keys"])
        return out

    def made(p: Pieces) -> Pieces:
        used = {path.split(".")[0] for name in paths for path in paths[name]}
        attributes = F.struct(
            F.lit("json_log").alias("parser_name"), F.lit("1.0.0").alias("parser_version"), p["profile"]["name"].alias("json_profile"),
            p["profile"]["confidence"].alias("json_profile_confidence"), F.size(F.array_except(p["keys"], F.array(*map(F.lit, sorted(used))))).alias("json_extra_keys"),
            *([p["whole"].alias("json")] if keep_record else []), p["own"].alias("context"),
        )
        return {
            "at": timestamp(p["timestamp"]), "level": severity(p["severity"]), "ms": number(p["duration_ms"]),
            "labels": F.array_distinct(F.filter(F.transform(p["tags"], lambda t: clean(t)), lambda t: t.isNotNull())),
            "attributes": F.to_json(attributes),
        }

    def event(p: Pieces) -> Pieces:
        plain = {name: p[name] for name in texts if name not in ("timestamp", "severity", "duration_ms", "http_status")}
        out = record(
            timestamp=p["at"], source_type=F.lit("json"), severity=p["level"], http_status=p["http_status"].try_cast("int"), duration_ms=p["ms"],
            tags=p["labels"], attributes=p["attributes"], **plain,
        )
        return {"event": F.when(F.startswith(p["whole"], F.lit("{")), out)}

    return value, whole, found, made, event


# ---- web servers ---------------------------------------------------------------------------------------------------

#: A text in quotes, in which a backslash takes the next sign along.
_QUOTED = r'"((?:[^"\\]|\\.)*)"'
#: Host, identity, user, time, request, status and bytes, as the common log format has them; the combined format adds
#: referrer and agent, and servers are often set up to add the seconds that a request took.
ACCESS = (
    r"^(\S+) +\S+ +(\S+(?: \S+)*?) +\[(\d{1,2}/\w{3}/\d{4}(?::\d{2}){3} [+-]\d{4})\] +" + _QUOTED + r" +(\d{3}) +(\d+|-)"
    + "(?: +" + _QUOTED + " +" + _QUOTED + r")?(?: +(\d*\.?\d+))?\s*$"
)
#: A verb of any name, a target and the protocol, which version 0.9 lacks.
REQUEST = r"^([A-Za-z]+) (\S+)(?: (HTTP/[0-9.]+))?$"
#: An access line that was cut off or set up otherwise: address, time and request are there.
LIKE_ACCESS = r"^\S+ .*\[\d{1,2}/\w{3}/\d{4}:[^\]]+\] +\"[A-Z]+ "


def _source(vendor: str) -> Column:
    return F.lit(vendor if vendor in ("nginx", "apache") else "application")


def access_steps(vendor: str = "generic"):
    """Common and combined access lines; a request time in seconds may follow."""

    names, parts = ("host", "user", "time", "request", "code", "bytes", "referer", "agent", "seconds"), ("verb", "target", "version")

    def found(p: Pieces) -> Pieces:
        return {"found": match(p["line"], ACCESS, len(names))}

    def request(p: Pieces) -> Pieces:
        g = groups(p["found"], names)
        return {"asked": match(g["request"], REQUEST, len(parts)), "at": F.try_to_timestamp(g["time"], F.lit("d/MMM/yyyy:HH:mm:ss Z"))}

    def event(p: Pieces) -> Pieces:
        p = p | groups(p["found"], names) | groups(p["asked"], parts)
        message = F.concat(F.coalesce(p["verb"], F.lit("REQUEST")), F.lit(" "), F.coalesce(p["target"], F.lit("/")), F.lit(" -> "), p["code"])
        attributes = F.struct(
            F.lit("apache_nginx_access").alias("parser_name"), F.lit("1.0.0").alias("parser_version"), F.lit(vendor).alias("vendor"), p["request"].alias("request"),
            dashless(p["user"]).alias("remote_user"), dashless(p["bytes"]).try_cast("long").alias("bytes_sent"), p["referer"].alias("http_referer"),
            p["agent"].alias("http_user_agent"), p["version"].alias("http_version"),
        )
        code = p["code"].cast("int")
        out = record(
            timestamp=p["at"], source_type=_source(vendor), severity=F.lit("info"), event_type=F.lit("webserver.access"), message=message, service=F.lit(vendor), source=F.lit(vendor),
            host=p["host"], client_ip=p["host"], http_method=F.lower(p["verb"]), http_path=p["target"], http_status=F.when(code.between(100, 599), code),
            duration_ms=p["seconds"].try_cast("double") * 1000, tags=F.array(F.lit("webserver"), F.lit("access"), F.lit(vendor)), attributes=F.to_json(attributes),
        )
        return {"event": F.when(p["host"].isNotNull(), out)}

    return found, request, event


#: Date, level, process and thread, number of the connection, message.
NGINX_ERROR = r"^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[([a-z]+)\] (\d+#\d+): (?:(\*\d+) )?(\S.*)$"
#: Date (fractions of a second aside) and year, level behind its module, client, message.
APACHE_ERROR = r"^\[\w{3} (\w{3} [ \d]\d \d\d:\d\d:\d\d)(?:\.\d+)? (\d{4})\] \[(?:\w*:)?(\w+)\](?: \[pid [^\]]+\])?(?: \[client ([^\]]+)\])? (\S.*)$"
TAIL = r", ([a-z_]+): (\"[^\"]*\"|(?:(?!, [a-z_]+: ).)*)"
#: A line with a level in brackets.
LIKE_ERROR = r"\[(?:\w+:)?(?:error|warn|crit|notice)\]"
# Severities of web server levels; others are warnings.
ERROR_LEVELS = {"error": "error", "crit": "error", "critical": "error", "warn": "warning", "warning": "warning", "notice": "notice", "info": "info"}


def error_steps(vendor: str = "generic"):
    """Error lines of either server; nginx's ``, key: value`` tail goes to attributes."""

    nginx, apache = ("date", "mark", "pid", "connection", "text"), ("day", "year", "grade", "client", "said")

    def found(p: Pieces) -> Pieces:
        return {"nginx": match(p["line"], NGINX_ERROR, len(nginx)), "apache": match(p["line"], APACHE_ERROR, len(apache))}

    def tail(p: Pieces) -> Pieces:
        p = groups(p["nginx"], nginx) | groups(p["apache"], apache)
        keys, values = (F.regexp_extract_all(p["text"], F.lit(TAIL), F.lit(k)) for k in (1, 2))
        pairs = F.map_from_entries(F.arrays_zip(keys.alias("k"), F.transform(values, lambda v: F.trim(v, F.lit('" '))).alias("v")))
        return {
            "pairs": F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs), "core": F.trim(F.regexp_replace(p["text"], r", [a-z_]+: .*$", "")),
            "level": F.lower(F.coalesce(p["mark"], p["grade"])),
            "at": F.coalesce(F.try_to_timestamp(p["date"], F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(F.concat_ws(" ", F.regexp_replace(p["day"], "  ", " "), p["year"]), F.lit("MMM d HH:mm:ss yyyy"))),
        }

    def event(p: Pieces) -> Pieces:
        p = p | groups(p["nginx"], nginx) | groups(p["apache"], apache)
        of = lambda k: F.element_at(p["pairs"], F.lit(k))
        attributes = F.struct(
            F.lit("apache_nginx_error").alias("parser_name"), F.lit("1.0.0").alias("parser_version"), F.lit(vendor).alias("vendor"), p["level"].alias("severity"),
            p["pid"].alias("pid"), p["connection"].alias("connection_id"), *(of(k).alias(k) for k in ("server", "request", "upstream", "host")),
            F.coalesce(of("client"), p["client"]).alias("client"),
        )
        out = record(
            timestamp=p["at"], source_type=_source(vendor), severity=lookup(p["level"], ERROR_LEVELS, F.lit("warning")), event_type=F.lit("webserver.error"),
            message=F.coalesce(p["core"], p["said"]), service=F.lit(vendor), source=F.lit(vendor), host=of("host"),
            tags=F.array(F.lit("webserver"), F.lit("error"), F.lit(vendor)), attributes=F.to_json(attributes),
        )
        return {"event": F.when(p["level"].isNotNull(), out)}

    return found, tail, event


# ---- syslog --------------------------------------------------------------------------------------------------------

_SD = r'(?:\[[^\s\]="]+(?:\s+[^\s\]="]+="(?:\\.|[^"\\])*")*\])+'
RFC5424 = rf"^<(\d{{1,3}})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|{_SD})(?:\s+(.*))?$"
RFC3164 = r"^<(\d{1,3})>([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?:\s*(.*)$"
# Severities of syslog's codes.
SYSLOG_LEVELS = ("fatal", "fatal", "critical", "error", "warning", "notice", "info", "debug")


def _syslog(p: Pieces, flavor: str, parser: str, kind: Column, text: Column, more: list[Column]) -> Pieces:
    pri, app, host = p["pri"].cast("int"), p["app"], p["host"]
    level = F.element_at(F.array(*map(F.lit, SYSLOG_LEVELS)), pri % 8 + 1)
    attributes = F.struct(F.lit(parser).alias("parser_name"), F.lit("1.0.0").alias("parser_version"), F.floor(pri / 8).alias("facility"), (pri % 8).alias("severity_code"), *more)
    out = record(
        timestamp=p["at"], source_type=F.lit("syslog"), severity=level, event_type=F.concat(F.lit("syslog."), F.lower(kind)), message=text, host=host, source=app, service=app, application=app,
        tags=F.array_distinct(F.array_compact(F.array(F.lit("syslog"), F.lit(flavor), F.lower(app), F.lower(host)))), attributes=F.to_json(attributes),
    )
    return {"event": F.when(pri <= 191, out)}


def rfc5424_steps():
    """Header, structured data (which may be absent) and message; an empty message becomes the message id."""

    names = ("pri", "time", "host", "app", "process", "msgid", "data", "text")

    def pieces(p: Pieces) -> Pieces:
        return p | {n: c if n in ("pri", "text") else dashless(c) for n, c in groups(p["found"], names).items()}

    def found(p: Pieces) -> Pieces:
        return {"found": match(p["line"], RFC5424, len(names))}

    def made(p: Pieces) -> Pieces:
        p = pieces(p)
        return {"at": timestamp(p["time"]), "said": F.coalesce(clean(p["text"]), p["msgid"], F.lit("-"))}

    def event(p: Pieces) -> Pieces:
        p = pieces(p)
        more = [p["process"].alias("process_id"), p["msgid"].alias("message_id"), p["data"].alias("structured_data")]
        return _syslog(p, "rfc5424", "rfc5424_syslog", F.coalesce(p["msgid"], p["app"]), p["said"], more)

    return found, made, event


def rfc3164_steps(year: int | None = None, zone: str = "UTC"):
    """Lines without a year take ``year``, or the present one; times are of ``zone``."""

    names = ("pri", "time", "host", "app", "process", "text")

    def found(p: Pieces) -> Pieces:
        return {"found": match(p["line"], RFC3164, len(names))}

    def made(p: Pieces) -> Pieces:
        p = groups(p["found"], names)
        of = F.year(F.current_timestamp()) if year is None else F.lit(year)
        when = F.concat(of.cast("string"), F.lit(" "), F.regexp_replace(p["time"], r"\s+", " "))
        return {"at": F.to_utc_timestamp(F.try_to_timestamp(when, F.lit("yyyy MMM d HH:mm:ss")), zone)}

    def event(p: Pieces) -> Pieces:
        p = p | groups(p["found"], names)
        return _syslog(p, "rfc3164", "rfc3164_syslog", p["app"], p["text"], [p["process"].alias("process_id")])

    return found, made, event


# ---- redis ---------------------------------------------------------------------------------------------------------

#: Process and role (or a bare process in brackets), day, month, perhaps year, time, marker, message; the first two may
#: be absent.
REDIS = r"(?:(\d+):([A-Za-z?]) +)?(?:\[(\d+)\] +)?(\d{1,2} +[A-Za-z]{3} +(?:\d{4} +)?\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?) +([.\-*#]) +(\S.*)$"
#: What a system log (time, host, process) or a container's log (time, stream, flag) puts in front.
REDIS_WRAPPER = r"^\s*(?:(?:[A-Za-z]{3} +\d{1,2} +\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?|\d{4}-\d\d-\d\dT\S+) +(?:(\S+) +(\S+): +|(stdout|stderr|F|P) +(?:[FP] +)?))?"
REDIS_LINE = REDIS_WRAPPER + REDIS
# Roles, and what messages stand for, first match first.
REDIS_ROLES = {"M": "master", "S": "replica", "X": "sentinel", "C": "child", "A": "child", "R": "unknown", "?": "unknown"}
REDIS_RULES = (
    ("ready to accept connections", "lifecycle", "redis.lifecycle.ready", "info", "Redis is ready to accept connections."),
    ("master <-> replica sync started", "replication", "redis.replication.sync_started", "info", "Replication synchronization started."),
    ("+sdown", "sentinel", "redis.sentinel.subjective_down", "warning", "Sentinel marked the master as subjectively down."),
    ("cluster state changed", "cluster", "redis.cluster.state_ok", "info", "Redis cluster state changed."),
    ("background saving started", "persistence", "redis.persistence.bgsave_started", "info", "Redis background save started."),
    ("warning", "generic", "redis.message", "warning", "Redis emitted a warning."),
    ("", "generic", "redis.message", "info", "Redis emitted a log message."),
)


def redis_steps(year: int | None = None, zone: str = "UTC"):
    """Server lines, bare or behind the prefix of a system's or a container's log; a summary takes the message's place.
    Lines without a year take ``year``, or the present one; times are of ``zone``."""

    names = ("outer_host", "outer_process", "stream", "server", "letter", "bracket", "time", "marker", "text")

    def matched(p: Pieces) -> Pieces:
        return {"found": match(p["line"], REDIS_LINE, len(names))}

    def made(p: Pieces) -> Pieces:
        p = groups(p["found"], names)
        text, found = F.lower(p["text"]), F.lit(None)
        for needle, category, kind, level, summary in reversed(REDIS_RULES):
            rule = F.struct(F.lit(category).alias("category"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), F.lit(summary).alias("summary"))
            found = F.when(F.contains(text, F.lit(needle)), rule).otherwise(found) if needle else rule
        of = F.year(F.current_timestamp()) if year is None else F.lit(year)
        day = F.initcap(F.regexp_replace(p["time"], " +", " "))
        day = F.regexp_replace(day, r"^(\d+ [A-Z][a-z]{2}) (?=\d\d:)", F.concat(F.lit("$1 "), of.cast("string"), F.lit(" ")))
        # fractions have any number of digits
        whole = F.try_to_timestamp(F.regexp_replace(day, r"\.\d+$", ""), F.lit("d MMM yyyy HH:mm:ss"))
        part_of = F.coalesce(F.nullif(F.regexp_extract(day, r"(\.\d+)$", 1), F.lit("")).cast("double"), F.lit(0.0))
        at = F.timestamp_micros(F.unix_micros(whole) + F.round(part_of * 1e6).cast("long"))
        code = F.upper(p["letter"])
        return {
            "rule": found, "role_code": code, "role": F.when(code.isNotNull(), lookup(code, REDIS_ROLES, F.lit("unknown"))), "at": F.to_utc_timestamp(at, zone),
            "pid": F.coalesce(p["server"], p["bracket"]), "process": F.coalesce(p["outer_process"], p["stream"]),
        }

    def event(p: Pieces) -> Pieces:
        p = p | groups(p["found"], names)
        rule, role = p["rule"], p["role"]
        attributes = F.struct(
            F.lit("redis_log").alias("parser_name"), F.lit("1.0.0").alias("parser_version"), p["pid"].cast("long").alias("pid"), role.alias("role"), p["role_code"].alias("role_code"),
            p["marker"].alias("level_marker"), rule["category"].alias("category"), p["outer_host"].alias("outer_host"), p["process"].alias("outer_process"), p["text"].alias("original_message"),
        )
        out = record(
            timestamp=p["at"], source_type=F.lit("redis"), severity=rule["level"], event_type=rule["kind"], message=rule["summary"], host=p["outer_host"],
            service=F.when(role == "sentinel", "redis-sentinel").otherwise("redis"), application=F.lit("redis"),
            tags=F.array_distinct(F.array_compact(F.array(F.lit("redis"), rule["category"], role))), attributes=F.to_json(attributes),
        )
        return {"event": F.when(p["marker"].isNotNull(), out)}

    return matched, made, event


# ---- IIS -----------------------------------------------------------------------------------------------------------


def iis_steps(strict: bool = False):
    """A W3C data line under ``header``, the array of its lower-case field names.

    Without a header nothing is parsed. Short lines lack their last fields and long ones have extra values, unless
    ``strict``, which gives null for both.
    """

    def values(p: Pieces) -> Pieces:
        return {"values": F.split(F.trim(p["line"]), r"\s+")}

    def whole(p: Pieces) -> Pieces:
        header, values = p["header"], p["values"]
        size = F.least(F.size(header), F.size(values))
        # a repeated name has no map; such headers are refused here
        ok = header.isNotNull() & (F.size(F.array_distinct(header)) == F.size(header)) & ~F.startswith(p["line"], F.lit("#")) & (F.trim(p["line"]) != "")
        if strict:
            ok = ok & (F.size(values) == F.size(header))
        rest = lambda x: F.slice(x, size + 1, F.greatest(F.size(x) - size, F.lit(0)))
        return {
            "fields": F.when(ok, F.map_from_arrays(F.slice(header, F.lit(1), size), F.slice(values, F.lit(1), size))),
            "extra": F.when(ok, rest(values)), "missing": F.when(ok, rest(header)),
        }

    def named(p: Pieces) -> Pieces:
        names = ("date", "time", "s-sitename", "s-computername", "c-ip", "s-ip", "cs-method", "cs-uri-stem", "sc-status", "time-taken", "cs-username")
        return {n.replace("-", "_"): dashless(F.element_at(p["fields"], F.lit(n))) for n in names}

    def event(p: Pieces) -> Pieces:
        code = p["sc_status"].try_cast("int")
        level = F.when(code >= 500, "error").when(code >= 400, "warning").otherwise("info")
        message = F.concat(F.coalesce(p["cs_method"], F.lit("HTTP")), F.lit(" "), F.coalesce(p["cs_uri_stem"], F.lit("request")))
        message = F.when(code.isNotNull(), F.concat(message, F.lit(" -> "), code.cast("string"))).otherwise(message)
        attributes = F.struct(
            F.lit("iis_w3c").alias("parser_name"), F.lit("1.0.0").alias("parser_version"), F.to_json(p["fields"]).alias("iis_fields"),
            p["extra"].alias("extra_values"), p["missing"].alias("missing_fields"),
        )
        out = record(
            timestamp=timestamp(F.concat_ws(" ", p["date"], p["time"])), source_type=F.lit("iis"), severity=level, event_type=F.lit("iis.request"), message=message,
            service=p["s_sitename"], host=p["s_computername"], client_ip=p["c_ip"], server_ip=p["s_ip"], http_method=p["cs_method"], http_path=p["cs_uri_stem"],
            http_status=F.when(code.between(100, 599), code), duration_ms=number(p["time_taken"]), user_id=p["cs_username"], tags=F.array(F.lit("iis")), attributes=F.to_json(attributes),
        )
        return {"event": F.when(p["fields"].isNotNull(), out)}

    return values, whole, named, event


def iis_header(line: Column) -> Column:
    """The field names of a ``#Fields:`` directive, or null."""
    return F.when(line.rlike(r"^#Fields:\s*\S"), F.split(F.lower(F.trim(F.regexp_replace(line, r"^#Fields:", ""))), r"\s+"))


# ---- Windows events ------------------------------------------------------------------------------------------------

WINDOWS_SCHEMA = (
    "System struct<Provider: struct<_Name: string>, EventID: string, Level: string, TimeCreated: struct<_SystemTime: string>, Channel: string, "
    "Computer: string, EventRecordID: string>, EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>, RenderingInfo struct<Message: string>"
)
# Severities of Windows levels.
WINDOWS_LEVELS = {"1": "critical", "2": "error", "3": "warning", "4": "info", "5": "debug"}


WINDOWS_HEAD = r"^(<\?xml[^>]*>\s*)?<Event[\s>]"


def windows_steps():
    """An Event element; EventID and TimeCreated must be there."""

    def tree(p: Pieces) -> Pieces:
        return {"xml": F.from_xml(F.when(F.trim(p["line"]).rlike(WINDOWS_HEAD), p["line"]), WINDOWS_SCHEMA, {"mode": "PERMISSIVE"})}

    def pieces(p: Pieces) -> Pieces:
        s = p["xml"]["System"]
        data = F.transform(p["xml"]["EventData"]["Data"], lambda d, k: F.struct(F.coalesce(d["_Name"], F.concat(F.lit("Data"), (k + 1).cast("string"))).alias("name"), F.coalesce(d["_VALUE"], F.lit("")).alias("value")))
        return {
            "id": clean(s["EventID"]), "record": s["EventRecordID"], "level": F.trim(s["Level"]), "at": timestamp(s["TimeCreated"]["_SystemTime"]), "host": clean(s["Computer"]),
            "provider": clean(s["Provider"]["_Name"]), "channel": clean(s["Channel"]), "data": data, "said": clean(p["xml"]["RenderingInfo"]["Message"]),
        }

    def told(p: Pieces) -> Pieces:
        return {"listed": F.array_join(F.transform(F.array_sort(p["data"]), lambda d: F.concat(d["name"], F.lit("="), d["value"])), ", ")}

    def event(p: Pieces) -> Pieces:
        text = F.concat(F.lit("Windows Event "), p["id"], F.when(F.length(p["listed"]) > 0, F.concat(F.lit(": "), p["listed"])).otherwise(F.lit("")))
        attributes = F.struct(
            F.lit("windows_event_xml").alias("parser_name"), F.lit("1.0.0").alias("parser_version"), p["id"].alias("event_id"), p["record"].alias("record_id"), p["data"].alias("event_data"),
        )
        out = record(
            timestamp=p["at"], source_type=F.lit("windows_event"), severity=lookup(p["level"], WINDOWS_LEVELS, F.lit("unknown")), event_type=F.concat(F.lit("windows.event."), p["id"]),
            message=F.coalesce(p["said"], text), host=p["host"], source=F.coalesce(p["channel"], p["provider"]), service=p["provider"], application=p["provider"],
            tags=F.array_distinct(F.array_compact(F.array(F.lit("windows-event"), F.lower(p["channel"]), F.lower(p["provider"])))), attributes=F.to_json(attributes),
        )
        return {"event": F.when(p["id"].isNotNull() & p["at"].isNotNull(), out)}

    return tree, pieces, told, event


# ---- detection -----------------------------------------------------------------------------------------------------


def _sum(*signs: tuple[float, Column]) -> Column:
    return F.least(reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for w, c in signs]), F.lit(1.0))


# The kinds of content of two formats; the others are plain text.
JSON_CONTENT = ("application/json", "application/x-ndjson", "application/jsonlines", "text/json", "text/plain")
XML_CONTENT = ("application/xml", "text/xml", "text/plain")


@cache
def builtin_formats(context: Context = Context()) -> tuple[LogFormat, ...]:
    # The confidences, priorities and extensions of each format.
    iis = ((0.75, r"^#Fields:"), (0.45, r"^#Software:.*(IIS|Internet Information)"), (0.6, r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \S+ (GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS) /"))
    windows = lambda x: F.when(F.trim(x).rlike(WINDOWS_HEAD), _sum((0.8, F.lit(True)), (0.1, x.contains("<System")), (0.1, x.contains("<EventData")))).otherwise(0.0)
    sure = lambda pattern, c: lambda x: F.when(x.rlike(pattern), c).otherwise(0.0)
    json = lambda x: F.when(F.try_parse_json(F.when(F.trim(x).startswith("{"), x)).isNotNull(), 0.9).otherwise(0.0)
    return (
        LogFormat("json_log", 90, "json", json, tags=("json",), extensions=(".json", ".jsonl", ".ndjson", ".log"), content_types=JSON_CONTENT, heads=r"{", steps=json_steps()),
        LogFormat("windows_event_xml", 95, "windows_event", windows, tags=("windows",), extensions=(".xml", ".evtx.xml", ".log"), content_types=XML_CONTENT, heads=r"<", steps=windows_steps()),
        LogFormat("iis_w3c", 100, "iis", lambda x: _sum(*((c, x.rlike(p)) for c, p in iis)), tags=("iis", "http"), extensions=(".log",), heads=r"#0-9", steps=iis_steps()),
        LogFormat("rfc5424_syslog", 100, "syslog", sure(RFC5424, 0.95), tags=("syslog",), extensions=(".log", ".txt", ".syslog"), heads=r"<", steps=rfc5424_steps()),
        LogFormat("rfc3164_syslog", 105, "syslog", sure(RFC3164, 0.98), tags=("syslog",), extensions=(".log", ".txt", ".syslog"), heads=r"<", steps=rfc3164_steps(context.year, context.zone)),
        LogFormat("redis_log", 110, "redis", sure(REDIS_LINE, 0.9), tags=("redis",), heads=r"A-Za-z0-9\[", steps=redis_steps(context.year, context.zone)),
        LogFormat("apache_nginx_access", 120, "application", lambda x: F.when(x.rlike(ACCESS), 0.9).when(x.rlike(LIKE_ACCESS), 0.75).otherwise(0.0), tags=("webserver", "http"), steps=access_steps(context.vendor)),
        LogFormat("apache_nginx_error", 121, "application", lambda x: F.when(x.rlike(NGINX_ERROR) | x.rlike(APACHE_ERROR), 0.9).when(x.rlike(LIKE_ERROR), 0.75).otherwise(0.0), tags=("webserver",), steps=error_steps(context.vendor)),
    )


@dataclass
class Registry:
    """Formats by name; plugins add to it."""

    formats: dict[str, LogFormat] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)
    context: Context = Context()

    def __post_init__(self) -> None:
        self.formats = self.formats or {f.name: f for f in builtin_formats(self.context)}

    def register(self, fmt: LogFormat, replace: bool = False) -> None:
        if fmt.name in self.formats and not replace:
            raise ValueError(f"{fmt.name} is registered already")
        self.formats[fmt.name] = fmt

    def unregister(self, name: str) -> None:
        self.formats.pop(name)

    def enable(self, name: str, on: bool = True) -> None:
        self.get(name)
        (self.disabled.discard if on else self.disabled.add)(name)

    def get(self, name: str) -> LogFormat:
        if name not in self.formats:
            raise KeyError(f"no format {name}")
        return self.formats[name]

    def active(self, extension: str | None = None) -> list[LogFormat]:
        """Enabled formats by priority; those of a file extension if any has it."""
        found = sorted((f for f in self.formats.values() if f.name not in self.disabled and f.enabled), key=lambda f: (f.priority, f.name))
        return [f for f in found if extension and extension.lower() in f.extensions] or found

    def find(self, source_type: str | None = None, tag: str | None = None) -> list[LogFormat]:
        return [f for f in self.active() if (source_type is None or f.source_type == source_type) and (tag is None or tag in f.tags)]


CONFIDENT, CLOSE = 0.60, 0.05


def extension_of(file: Column) -> Column:
    """The extension of a file's name, in small letters with its dot, without that of a packed file; null for none."""
    name = F.regexp_replace(F.lower(F.element_at(F.split(file, r"[/\\\\]"), -1)), r"\.(gz|zip)$", "")
    return F.nullif(F.regexp_extract(name, r"(\.[a-z0-9]+(?:\.xml)?)$", 1), F.lit(""))


def content_type_of(named: Column) -> Column:
    """A kind of content in small letters, without its parameters; null for none."""
    return F.nullif(F.trim(F.element_at(F.split(F.lower(named), ";"), 1)), F.lit(""))


def scores(line: Column, formats: list[LogFormat], extension: Column | None = None, first: Column | None = None, content_type: Column | None = None) -> Pieces:
    """Each format's confidence. ``first`` is the line's first sign that is no white space: only formats that can begin
    with it look at the line, which for most signs are one or two. A format with extensions takes no part in a file of another extension; if no format
    knows a file's extension, all take part. Where there is no extension, the same holds for the kind of content."""

    def fits(value: Column | None, own: tuple[str, ...], known: set[str]) -> Column | None:
        return None if value is None or not own else value.isNull() | value.isin(*own) | ~value.isin(*sorted(known))

    def of(f: LogFormat) -> Column:
        by_name = fits(extension, f.extensions, {e for g in formats for e in g.extensions})
        by_kind = fits(content_type, f.content_types, {c for g in formats for c in g.content_types})
        if by_kind is not None and extension is not None:
            by_kind = extension.isNotNull() | by_kind
        tests = [t for t in (by_name, by_kind) if t is not None]
        return F.when(reduce(lambda a, b: a & b, tests), f.detect(line)).otherwise(0.0) if tests else f.detect(line)

    def walked(f: LogFormat) -> Column:
        return of(f) if f.heads is None or first is None else F.when(F.rlike(first, F.lit(f"^[{f.heads}]")), of(f)).otherwise(0.0)

    return {f"_score_{f.name}": walked(f) for f in formats}


def best(found: Pieces, formats: list[LogFormat]) -> Column:
    """name, confidence and ambiguous of the best format: highest confidence, then priority, then name; null below
    0.60. It is ambiguous if the runner-up is within 0.05."""
    places = sorted(formats, key=lambda f: (f.priority, f.name))
    ranked = F.sort_array(F.array(*(F.struct(found[f"_score_{f.name}"].alias("confidence"), F.lit(-k).alias("place"), F.lit(f.name).alias("name")) for k, f in enumerate(places))), asc=False)

    def choose(order: Column) -> Column:
        first, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
        close = (second["confidence"] >= CONFIDENT) & (first["confidence"] - second["confidence"] <= CLOSE)
        return F.when(first["confidence"] >= CONFIDENT, F.struct(first["name"].alias("name"), first["confidence"].alias("confidence"), F.coalesce(close, F.lit(False)).alias("ambiguous")))

    return let(ranked, choose)


def detect(line: Column, formats: list[LogFormat], extension: Column | None = None) -> Column:
    """``best`` as one expression."""
    return best(scores(line, formats, extension), formats)


def with_detection(rows: DataFrame, formats: list[LogFormat], name: str = "detected", extension: Column | None = None, content_type: Column | None = None) -> DataFrame:
    """Adds ``best`` of the column value; scores and choice are steps of their own."""
    rows = once(rows, {"_first": F.left(F.ltrim("value", F.lit(" \t\r\n")), F.lit(1))} | ({"_extension": extension} if extension is not None else {}) | ({"_content": content_type_of(content_type)} if content_type is not None else {}))
    found = scores(F.col("value"), formats, F.col("_extension") if extension is not None else None, F.col("_first"), F.col("_content") if content_type is not None else None)
    items = list(found.items())
    for low in range(0, len(items), AT_ONCE):
        rows = once(rows, dict(items[low : low + AT_ONCE]))
    return once(rows, {name: best({n: F.col(n) for n in found}, formats)}).drop(*found, "_first", "_extension", "_content")
