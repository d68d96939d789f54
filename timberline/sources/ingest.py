"""Raw bytes to text: archives, binary check, encodings, line ends, and what to warn about.

Whatever Spark's expressions can say stays an expression; decompression with limits, decoding with ``ignore`` and the
binary check run on Arrow batches of ``binaryFile`` rows.
"""

from __future__ import annotations

import gzip
import io
import os
import stat
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import ENOUGH, SURE, detect, wide


@dataclass(frozen=True)
class IngestOptions:
    max_bytes: int = 50 << 20
    max_unpacked: int = 100 << 20
    max_ratio: float = 100.0
    max_entries: int = 100
    entry: str | None = None
    strict_entry: bool = False
    encoding: str | None = None
    errors: str = "strict"
    fallbacks: tuple[str, ...] = ("utf-8", "cp1252", "iso-8859-1")
    allow_binary: bool = False
    normalize_newlines: bool = False
    detect: bool = True
    allow_empty: bool = False
    follow_symlinks: bool = False


# Byte order marks; longer ones first.
MARKS = (("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("EFBBBF", "utf-8"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))
TEXT_NAMES = (".log", ".txt", ".json", ".jsonl", ".xml", ".csv")
# How files of programs, pictures and the like begin.
BINARY_HEADS = (b"\x7fELF", b"MZ", b"\x89PNG", b"%PDF", b"\xff\xd8\xff", b"GIF8", b"SQLite format 3")
SAMPLE, PRINTABLE = 8192, 0.95
#: Bytes below the space that texts have no use for.
CONTROLS = bytes(b for b in range(32) if b not in (9, 10, 12, 13, 27))


def archive_kind(content: Column, path: Column) -> Column:
    """gzip or zip by first bytes, then by name; null for neither."""
    head, name = F.hex(F.substring(content, 1, 4)), F.lower(path)
    return F.when(head.startswith("1F8B"), "gzip").when(head.isin("504B0304", "504B0506"), "zip").when(name.endswith(".gz"), "gzip").when(name.endswith(".zip"), "zip")


def byte_order_mark(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 4)), F.lit(None).cast("string")
    for mark, name in reversed(MARKS):
        out = F.when(head.startswith(mark), name).otherwise(out)
    return out


def mark_of(head: bytes) -> str | None:
    """The same for bytes in a task."""
    return next((name for mark, name in MARKS if head.startswith(bytes.fromhex(mark))), None)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def line_ends(text: Column) -> Column:
    """Counts of each kind of line end, whether they are mixed, and whether the last line has one."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf, cr = F.regexp_count(text, F.lit("\n")) - crlf, F.regexp_count(text, F.lit("\r")) - crlf
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.struct(lf.alias("lf"), crlf.alias("crlf"), cr.alias("cr"), (kinds > 1).alias("mixed"), text.rlike(r"[\r\n]\z").alias("trailing"))


def normalized_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def read_files(spark: SparkSession, path: str, options: IngestOptions = IngestOptions()) -> DataFrame:
    """path, content and error of each file.

    Files above the size limit are listed but not opened. Spark lists no files without a length, which takes care of
    pipes and devices in a folder; a path that is one itself is a ValueError. Local links have an error and no content,
    unless ``follow_symlinks``; other file systems have none.
    """
    if irregular(path, True):
        raise ValueError(f"{path}: NOT_REGULAR_FILE")
    rows = spark.read.format("binaryFile").load(path)
    small = F.col("length") <= options.max_bytes  # pushed to the source
    link = _irregular(options.follow_symlinks)("path")
    read = rows.filter(small).select("path", "content", link.alias("error"))
    large = rows.filter(~small).select("path", F.lit(None).cast("binary").alias("content"), F.coalesce(link, F.lit("FILE_TOO_LARGE")).alias("error"))
    return read.select("path", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error").unionByName(large)


def irregular(path: str, follow_symlinks: bool = False) -> str | None:
    """Why a local path is not to be read as a file; null for other file systems' paths and for those that are not there,
    such as patterns."""
    name = path.removeprefix("file:")
    if ":/" in name:
        return None
    try:
        mode = os.lstat(name).st_mode
        if stat.S_ISLNK(mode):
            if not follow_symlinks:
                return "SYMLINK_NOT_ALLOWED"
            mode = os.stat(name).st_mode
    except OSError:
        return None
    return None if stat.S_ISREG(mode) or stat.S_ISDIR(mode) else "NOT_REGULAR_FILE"


def _irregular(follow_symlinks: bool):
    @F.pandas_udf("string")
    def check(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: irregular(p, follow_symlinks)).astype(object)

    return check


def text_rows(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Given texts by name, as files in UTF-8."""
    return bytes_rows(spark, {k: v.encode() for k, v in texts.items()})


def bytes_rows(spark: SparkSession, sources: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(k, bytearray(v), None) for k, v in sources.items()], "path string, content binary, error string")


def gunzip(data: bytes, o: IngestOptions) -> tuple[bytes | None, str | None]:
    """At most the allowed bytes are unpacked, one more to see that there are more."""
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as file:
            out = file.read(o.max_unpacked + 1)
    except (OSError, EOFError, zlib.error):
        return None, "ARCHIVE_MALFORMED"
    if len(out) > o.max_unpacked:
        return None, "ARCHIVE_TOO_LARGE"
    if len(out) > o.max_ratio * max(len(data), 1):
        return None, "ARCHIVE_RATIO"
    return (None, "ARCHIVE_NESTED") if looks_packed(out) else (out, None)


def looks_packed(data: bytes) -> bool:
    return data.startswith((b"\x1f\x8b", b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"))


def chosen_entries(infos: list[zipfile.ZipInfo], o: IngestOptions, every: bool = False) -> tuple[list[int], str | None, bool]:
    """The numbers of the entries to read, in order of their names, or what forbids it; the last value tells that one was
    chosen among several.

    Entries that look like text by their names come first; others count only if none does.
    """
    files = [k for k, i in enumerate(infos) if not i.is_dir()]
    names = [infos[k].filename for k in files]
    if not files:
        return [], "ARCHIVE_EMPTY", False
    if len(files) > o.max_entries:
        return [], "ARCHIVE_TOO_MANY_ENTRIES", False
    if any(not n.strip() or n.strip().startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") or ":" in n for n in names):
        return [], "ARCHIVE_UNSAFE_NAME", False
    if any(infos[k].flag_bits & 1 for k in files):
        return [], "ARCHIVE_ENCRYPTED", False
    if o.entry:
        found = [k for k in files if infos[k].filename == o.entry]
        return found[:1], None if found else "ARCHIVE_ENTRY_MISSING", False
    texts = [k for k in files if infos[k].filename.lower().endswith(TEXT_NAMES)] or files
    texts.sort(key=lambda k: infos[k].filename)
    if every:
        return texts, None, False
    if o.strict_entry and len(texts) > 1:
        return [], "ARCHIVE_ENTRY_AMBIGUOUS", False
    return texts[:1], None, len(texts) > 1


def unzip(data: bytes, o: IngestOptions) -> tuple[bytes | None, str | None, str | None, bool]:
    """One entry of an archive: the asked one, or the first by name of those that look like text. The last value tells
    that it was chosen among several."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            numbers, error, auto = chosen_entries(archive.infolist(), o)
            if error:
                return None, error, None, False
            chosen = archive.infolist()[numbers[0]]
            with archive.open(chosen) as file:
                out = file.read(o.max_unpacked + 1)
    except (zipfile.BadZipFile, OSError, EOFError, zlib.error, NotImplementedError):
        return None, "ARCHIVE_MALFORMED", None, False
    if len(out) > o.max_unpacked:
        return None, "ARCHIVE_TOO_LARGE", None, False
    if len(out) > o.max_ratio * max(chosen.compress_size, 1):
        return None, "ARCHIVE_RATIO", None, False
    if looks_packed(out) or chosen.filename.lower().endswith((".zip", ".gz")):
        return None, "ARCHIVE_NESTED", None, False
    return out, None, chosen.filename, auto


UNPACKED = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType()),
        T.StructField("entry", T.StringType()), T.StructField("auto_entry", T.BooleanType()),
    ]
)


def unpacked(files: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Archives replaced by their content, within limits; other files as they are."""
    kinds = files.select("path", "content", "error", archive_kind(F.col("content"), F.col("path")).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time in memory
                path, content, error, kind = (batch.column(c)[k].as_py() for c in ("path", "content", "error", "kind"))
                entry, auto = None, False
                if content is not None and kind == "gzip":
                    content, error = gunzip(content, options)
                elif content is not None and kind == "zip":
                    content, error, entry, auto = unzip(content, options)
                yield pa.RecordBatch.from_pydict(
                    {"path": [path], "content": pa.array([content], pa.binary()), "error": pa.array([error], pa.string()), "entry": pa.array([entry], pa.string()), "auto_entry": [auto]}
                )

    return kinds.mapInArrow(run, UNPACKED)


def looks_binary(data: bytes) -> bool:
    """Signs of binary data together with few printable characters in the first bytes."""
    head = data[:SAMPLE]
    if not head or head.startswith((b"\xff\xfe", b"\xfe\xff", b"\xef\xbb\xbf", b"\x00\x00\xfe\xff")):
        return False
    controls = len(head) - len(head.translate(None, CONTROLS))
    sign = head.startswith(BINARY_HEADS) or b"\x00" in head or controls / len(head) > 0.02
    return sign and 1 - controls / len(head) - head.count(127) / len(head) < PRINTABLE or head.startswith(BINARY_HEADS)


DECODED = "text string, encoding string, used_fallback boolean, problem string, confidence double"


def decoded(files: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """path, text, encoding, confidence, warnings, sha256, line_ends and error of each unpacked file.

    The encoding is the given one, that of a byte order mark, strict UTF-8, the likeliest one if its confidence is enough
    (``encoding.detect``), or the first fallback that decodes.
    """
    o = options

    def one(data: bytes | None, mark: str | None) -> tuple:
        if data is None:
            return None, None, False, None, None
        order = [o.encoding] if o.encoding else [mark] if mark else ["utf-8"]
        guess = wide(data) if o.detect and not o.encoding and not mark else None
        if guess:
            order = [guess[0]]
        elif looks_binary(data) and not o.allow_binary:
            return None, None, False, "BINARY_CONTENT", None
        elif len(order) == 1 and order[0] == "utf-8" and not o.encoding and not mark:
            order += o.fallbacks
        allowed = "BINARY_LIKE_CONTENT_ALLOWED" if not guess and looks_binary(data) else None
        for k, name in enumerate(order):
            try:
                text = data.decode(name, o.errors if o.encoding or mark else "strict")
            except (UnicodeDecodeError, LookupError):
                if k == 0 and len(order) > 1 and o.detect:  # no UTF-8: the likeliest before the fallbacks
                    found = detect(data)
                    if found and found[1] >= ENOUGH:
                        return data.decode(found[0]), found[0], False, allowed, found[1]
                continue
            text = text.removeprefix("\ufeff")
            if not text:
                allowed = "EMPTY_CONTENT_ALLOWED" if o.allow_empty else "EMPTY_CONTENT"
            return text, name, k > 0, allowed, guess[1] if guess else ENOUGH if k > 0 else 1.0
        return None, None, False, "DECODE_FAILED", None

    @F.pandas_udf(DECODED)
    def decode(content: pd.Series, mark: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(c, m) for c, m in zip(content, mark, strict=True)], columns=["text", "encoding", "used_fallback", "problem", "confidence"])

    rows = files.withColumn("_d", decode("content", byte_order_mark(F.col("content"))))
    text = F.col("_d.text")
    ends = line_ends(text)
    bad = F.col("_d.problem").isin("BINARY_CONTENT", "DECODE_FAILED", "EMPTY_CONTENT")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_d.confidence") < SURE, "ENCODING_LOW_CONFIDENCE"), F.when(F.col("_d.used_fallback"), "ENCODING_FALLBACK_USED"), F.when(~bad, F.col("_d.problem")), F.when(ends["mixed"], "MIXED_LINE_ENDINGS"),
            F.when(F.col("auto_entry"), "ARCHIVE_ENTRY_AUTO_SELECTED"),
            F.when(~F.lower("path").rlike(r"\.(log|txt|json|jsonl|xml|csv|gz|zip)$"), "UNKNOWN_CONTENT_TYPE"),
        )
    )
    return rows.select(
        "path", F.when(~F.coalesce(bad, F.lit(False)), normalized_newlines(text) if o.normalize_newlines else text).alias("text"), F.col("_d.encoding").alias("encoding"), F.col("_d.confidence").alias("confidence"), warnings.alias("warnings"),
        sha256(F.col("content")).alias("sha256"), ends.alias("line_ends"), F.coalesce("error", F.when(bad, F.col("_d.problem"))).alias("error"), "entry",
    )


def ingest(files: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    return decoded(unpacked(files, options), options)


def to_lines(texts: DataFrame) -> DataFrame:
    """file, position and value of the lines of ingested texts."""
    lines = F.split(F.regexp_replace("text", r"(\r\n|\r|\n)\z", ""), "\r\n|\r|\n")
    return texts.filter("text is not null").select(F.col("path").alias("file"), F.posexplode(lines).alias("position", "value")).withColumn("position", F.col("position").cast("long"))
