"""Text, number and time helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NAMED_SOURCE_TYPES

ColumnLike = str | Column


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """Unicode's full case folding: letters that fold to one, these, and letters that fold to several."""
    found = {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c}
    single = {c: f for c, f in found.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in found.items() if len(f) > 1}


#: Letters that ``lower`` folds as Unicode says, the sharp s aside: of Latin scripts, Cyrillic, Chinese, Japanese; also
#: marks between words. All are older than any Unicode that Java may know.
COMMON = r"\x00-\u00b4\u00b6-\u012f\u0131-\u0148\u014a-\u017e\u0400-\u0481\u2010-\u203f\u20ac\u3000-\u9fa5"


def fold_case(c: ColumnLike) -> Column:
    """Full case folding. Text of ASCII alone and text of common letters take the short ways; only text with others is
    translated, and taken apart only before letters that fold to several."""
    text = col(c)
    letters, plain, several = _folding()
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    one = F.translate(text, letters + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", plain + "abcdefghijklmnopqrstuvwxyz")
    pieces = F.split(one, "(?=[" + "".join(several) + "])")
    unfold = lambda p: F.coalesce(F.concat(F.element_at(table, F.left(p, F.lit(1))), F.substr(p, F.lit(2))), p)
    common = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    rare = F.array_join(F.transform(pieces, unfold), "")
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).when(F.rlike(text, F.lit(f"\\A[{COMMON}]*+\\z")), common).otherwise(rare)


def clean(c: ColumnLike) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(col(c), F.lit(" \t\n\x0b\x0c\r")), F.lit(""))


def preview(c: ColumnLike, limit: int = 200, ellipsis: str = "…") -> Column:
    """One line without control characters, cut to ``limit`` characters, the mark included."""
    text = F.regexp_replace(F.regexp_replace(col(c), r"[\x00-\x1f\x7f]", " "), r"\s+", " ")
    text = F.trim(text)
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - len(ellipsis))), F.lit(ellipsis))).otherwise(text)


def record_preview(c: ColumnLike, limit: int = 200) -> Column:
    """Line ends and tabs as spaces, cut with three dots."""
    text = F.regexp_replace(col(c), r"[\r\n\t]", " ")
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)


def summary_text(c: ColumnLike, limit: int = 300) -> Column:
    """Runs of white space as one space, cut with three dots."""
    text = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 3))), F.lit("..."))).otherwise(text)


def dimension(c: ColumnLike, limit: int = 256) -> Column:
    """A group key of bounded length: a long one keeps its head and 16 digits of its SHA-256."""
    text = col(c)
    tail = F.concat(F.lit("…#"), F.left(F.sha2(text.cast("binary"), 256), F.lit(16)))
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 18)), tail)).otherwise(text)


def ratio(part: ColumnLike, whole: ColumnLike) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(col(part).cast("double"), col(whole).cast("double")), F.lit(0.0))


def floor_time(ts: ColumnLike, seconds: int) -> Column:
    """The start of the epoch-aligned bucket of ``seconds`` that holds a time."""
    return F.window(col(ts), f"{seconds} seconds")["start"]


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(t: datetime | int) -> int:
    """Microseconds since 1970 in UTC; a time without a zone is of UTC, whatever zone the driver is in."""
    if isinstance(t, int):
        return t
    return ((t if t.tzinfo else t.replace(tzinfo=timezone.utc)) - _EPOCH) // timedelta(microseconds=1)


def instant(t: datetime | int) -> Column:
    """A time of the driver as a literal that no zone can shift."""
    return F.timestamp_micros(F.lit(micros(t)))


# Names of severities in texts.
SEVERITY_NAMES = {
    "trace": "trace", "debug": "debug", "info": "info", "notice": "notice", "warning": "warning", "warn": "warning",
    "error": "error", "critical": "critical", "fatal": "fatal", "unknown": "unknown",
}
LENIENT_SEVERITY_NAMES = SEVERITY_NAMES | {"information": "info"}


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if default is None else default
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def severity(c: ColumnLike, lenient: bool = False) -> Column:
    """A canonical severity: null means unknown; an unsupported name gives null, or unknown if ``lenient``."""
    key = F.lower(F.trim(col(c)))
    names = LENIENT_SEVERITY_NAMES if lenient else SEVERITY_NAMES
    found = lookup(key, names, F.lit("unknown") if lenient else None)
    return F.when(col(c).isNull(), "unknown").otherwise(found)


def source_type(c: ColumnLike) -> Column:
    """A canonical kind of source: null means unknown; an unsupported name gives null."""
    key = F.lower(F.trim(col(c)))
    return F.when(col(c).isNull(), "unknown").when(key.isin(*NAMED_SOURCE_TYPES), key)


ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s?(Z|z|[+-]\d{2}:?\d{2})?)?$"


def timestamp(c: ColumnLike) -> Column:
    """An ISO-8601 text as a time in UTC; null if it has another form."""
    text = F.trim(col(c))
    shaped = F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(ISO_TIME), F.try_to_timestamp(shaped))


def number(c: ColumnLike) -> Column:
    """A finite number from text, or null."""
    value = F.trim(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def redis_endpoint(c: ColumnLike) -> Column:
    """host and port of ``host:port`` or ``[v6]:port``; the port may be absent, and is null above 65535."""
    pattern = r"^\s*(?:\[([0-9A-Fa-f:.]+)\]|([^\s:\[\]]+))(?::(\d{1,5}))?\s*$"
    host = F.coalesce(F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit("")), F.nullif(F.regexp_extract(col(c), pattern, 2), F.lit("")))
    port = F.regexp_extract(col(c), pattern, 3).try_cast("int")
    return F.struct(host.alias("host"), F.when(port.between(0, 65535), port).alias("port"))


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns, of names that are not there yet, which are computed once a row, however often and wherever they are
    used.

    They come out of a generator of one row, past which Catalyst neither copies expressions nor pushes filters.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: keeps nested expressions linear."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))
