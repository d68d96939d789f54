"""Lines of packed files, an entry a task, without holding an entry in memory.

A first job reads the central directories of zips, not their content, and chooses entries by the rules of ``ingest``.
Entries are then dealt one by one to tasks, several to a task only where they are small or there are more than four a core. A task reads its entry as a stream, CHUNK bytes at a time: once to check
its limits, its checksum and its encoding, and once more for its lines, of which each is bounded as well. So an entry
that turns out to be broken or too large gives one row with an error, and no lines.

Files are opened by pyarrow, which knows local paths, HDFS, S3 and others by their scheme.
"""

from __future__ import annotations

import codecs
import gzip
import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import CANDIDATES, ENOUGH, detect, wide
from .ingest import MARKS, SAMPLE, IngestOptions, chosen_entries, looks_binary, looks_packed, mark_of
from .lines import CHUNK, opened, range_lines
from .shared import stash

#: Packed bytes that small entries of one task have together, about.
TASK = 32 << 20
#: Bytes around signs that are no ASCII that encoding detection sees, at most, spread over the entry.
SIGNS = 1 << 18
MARK_BYTES = {name: bytes.fromhex(mark) for mark, name in MARKS}
ROWS, BYTES = 4096, 4 << 20
END = 1 << 62

ENTRIES = "file string, kind string, number int, entry string, packed bigint, size bigint, auto boolean, error string"
LINES = "file string, entry string, position bigint, value string, preview string, characters bigint, oversized boolean, encoding string, error string"
_ENTRY_SCHEMA = pa.schema([("file", pa.string()), ("kind", pa.string()), ("number", pa.int32()), ("entry", pa.string()), ("packed", pa.int64()), ("size", pa.int64()), ("auto", pa.bool_()), ("error", pa.string())])
_LINE_SCHEMA = pa.schema(
    [("file", pa.string()), ("entry", pa.string()), ("position", pa.int64()), ("value", pa.string()), ("preview", pa.string()), ("characters", pa.int64()), ("oversized", pa.bool_()), ("encoding", pa.string()), ("error", pa.string())]
)
#: What unpacking raises on bad content (bz2 an OSError). Storage that fails raises StorageError: the task fails, and is run again.
BROKEN = (zipfile.BadZipFile, OSError, EOFError, zlib.error, lzma.LZMAError, struct.error, ValueError, NotImplementedError, RuntimeError)


class StorageError(Exception):
    """A file could not be opened or read, which says nothing of its content."""


class _Raw(io.RawIOBase):
    """A file of pyarrow as Python's libraries expect one: a place before its beginning is an OSError."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer: Any) -> int:
        try:
            data = self.file.read(len(buffer))
        except OSError as error:
            raise StorageError(str(error)) from error
        buffer[: len(data)] = data
        return len(data)

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + (self.file.tell() if whence == io.SEEK_CUR else self.file.size() if whence == io.SEEK_END else 0)
        if place < 0:
            raise OSError("before the beginning of the file")
        return self.file.seek(place)


@contextmanager
def _file(path: str) -> Iterator[io.BufferedReader]:
    try:
        files, inner = opened(path)
        file = files.open_input_file(inner)
    except OSError as error:
        raise StorageError(f"{path}: {error}") from error
    with file:
        yield io.BufferedReader(_Raw(file), CHUNK)


def _listed(path: str, length: int, o: IngestOptions, every: bool) -> list[tuple]:
    """Rows of ENTRIES for one file."""
    with _file(path) as stream:
        head = stream.read(4)
        kind = "gzip" if head[:2] == b"\x1f\x8b" or path.lower().endswith(".gz") else "zip" if looks_packed(head) or path.lower().endswith(".zip") else "plain"
        if kind != "zip":
            return [(path, kind, None, None, length, None, False, None)]
        stream.seek(0)
        try:
            with zipfile.ZipFile(stream) as archive:
                infos = archive.infolist()
        except BROKEN:
            return [(path, kind, None, None, length, None, False, "ARCHIVE_MALFORMED")]
        chosen, error, auto = chosen_entries(infos, o, every)
        if error:
            return [(path, kind, None, None, length, None, False, error)]
        return [(path, kind, k, i.filename, i.compress_size, i.file_size, auto, "ARCHIVE_NESTED" if i.filename.lower().endswith((".zip", ".gz")) else None) for k in chosen for i in [infos[k]]]


def archive_entries(spark: SparkSession, path: str, options: IngestOptions = IngestOptions(), every: bool = True) -> DataFrame:
    """file, kind (gzip, zip or plain), number and name of the entry, packed bytes, size as written in the archive, auto
    (chosen among several) and error, of every entry to read: all those that look like text (or all, if none does), or
    with ``every`` off, the one that ``ingest`` takes. No content is read but first bytes and directories."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                rows = _listed(name, length, options, every)
                yield pa.RecordBatch.from_pylist([dict(zip(_ENTRY_SCHEMA.names, r, strict=True)) for r in rows], _ENTRY_SCHEMA)

    return files.mapInArrow(run, ENTRIES)


@contextmanager
def _content(path: str, kind: str, number: int | None) -> Iterator[Any]:
    """The unpacked bytes of an entry, as a stream."""
    with _file(path) as stream:
        if kind == "gzip":
            with gzip.GzipFile(fileobj=stream) as out:
                yield out
        elif kind == "zip":
            with zipfile.ZipFile(stream) as archive, archive.open(archive.infolist()[number]) as out:
                yield out
        else:
            yield stream


class _Signs:
    """Bytes around signs that are no ASCII, thinned evenly as there come more; and which bytes there are at all."""

    def __init__(self) -> None:
        self.seen, self.kept, self.size, self.step, self.count = np.zeros(256, bool), [], 0, 1, 0

    def add(self, chunk: bytes) -> None:
        data = np.frombuffer(chunk, np.uint8)
        self.seen[np.unique(data)] = True
        self.count += 1
        if self.count % self.step or chunk.isascii():
            return
        near = data > 127
        near[1:] |= data[:-1] > 127
        near[:-1] |= data[1:] > 127
        self.kept.append(data[near].tobytes())
        self.size += len(self.kept[-1])
        while self.size > SIGNS and len(self.kept) > 1:
            self.kept, self.step = self.kept[1::2], 2 * self.step
            self.size = sum(map(len, self.kept))

    def guess(self) -> tuple[str, float] | None:
        def reads(name: str) -> bool:
            try:
                bytes(np.flatnonzero(self.seen).tolist()).decode(name)
            except UnicodeDecodeError:
                return False
            return True

        return detect(b" ".join(self.kept), tuple(c for c in CANDIDATES if reads(c)))


def _readable(entry: tuple, name: str) -> bool:
    """Whether all of an entry decodes; one pass."""
    try:
        decoder = codecs.getincrementaldecoder(name)("strict")
        with _content(*entry) as stream:
            while chunk := stream.read(CHUNK):
                decoder.decode(chunk)
            decoder.decode(b"", True)
    except (UnicodeDecodeError, LookupError):
        return False
    return True


def checked(entry: tuple, packed: int, o: IngestOptions) -> tuple[str | None, str | None]:
    """The encoding of an entry (file, kind, number), or what is wrong with it."""
    path, kind, number = entry
    size, head, signs, utf8, decoder = 0, b"", _Signs(), True, codecs.getincrementaldecoder("utf-8")("strict")
    try:
        with _content(path, kind, number) as stream:
            while chunk := stream.read(CHUNK):
                size += len(chunk)
                if kind != "plain" and size > o.max_unpacked:
                    return None, "ARCHIVE_TOO_LARGE"
                head = (head + chunk)[:SAMPLE] if len(head) < SAMPLE else head
                signs.add(chunk)
                try:
                    utf8 = utf8 and decoder.decode(chunk) is not None
                except UnicodeDecodeError:
                    utf8 = False
        try:
            decoder.decode(b"", utf8)
        except UnicodeDecodeError:
            utf8 = False
    except BROKEN:
        return None, "ARCHIVE_MALFORMED"
    if kind != "plain" and size > o.max_ratio * max(packed, 1):
        return None, "ARCHIVE_RATIO"
    if kind != "plain" and looks_packed(head):
        return None, "ARCHIVE_NESTED"
    mark = mark_of(head)
    if not o.allow_empty and head.removeprefix(MARK_BYTES.get(mark, b"")) == b"":
        return None, "EMPTY_CONTENT"
    if o.encoding or mark:
        name = o.encoding or mark
        return (name, None) if o.errors != "strict" or _readable(entry, name) else (None, "DECODE_FAILED")
    guess = wide(head[: len(head) // 2 * 2]) if o.detect and size % 2 == 0 else None
    if guess and _readable(entry, guess[0]):
        return guess[0], None
    if looks_binary(head) and not o.allow_binary:
        return None, "BINARY_CONTENT"
    if utf8:
        return "utf-8", None
    guess = signs.guess() if o.detect else None
    if guess and guess[1] >= ENOUGH:
        return guess[0], None
    return next(((name, None) for name in o.fallbacks if _readable(entry, name)), (None, "DECODE_FAILED"))


class Recoded:
    """A stream of bytes as UTF-8, with line feeds for all line ends and without a byte order mark."""

    def __init__(self, stream: Any, encoding: str, errors: str):
        self.stream = stream
        self.decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder(encoding)(errors), translate=True)
        self.begun = self.ended = False

    def read(self, size: int) -> bytes:
        while not self.ended:
            chunk = self.stream.read(size)
            self.ended = not chunk
            text = self.decoder.decode(chunk, self.ended)
            if text and not self.begun:
                text, self.begun = text.removeprefix("\ufeff"), True
            if text:
                return text.encode("utf-8", "surrogatepass")
        return b""


def entry_lines(entry: tuple, encoding: str, errors: str, limit: int) -> Iterator[tuple]:
    """Position, value, preview, characters and oversized of an entry's lines."""
    with _content(*entry) as stream:
        for k, (_, text, preview, characters, oversized) in enumerate(range_lines(Recoded(stream, encoding, errors), 0, END, limit, "utf-8"), 1):
            yield k, text, preview, characters, oversized


def archive_lines(spark: SparkSession, path: str, options: IngestOptions = IngestOptions(), every: bool = True, limit: int = 1 << 20) -> DataFrame:
    """file, entry, position (line number from 1), value, preview, characters, oversized, encoding and error of the lines
    of all packed files of a folder, and of its plain ones.

    Lines end with LF, CR LF or CR. A line over ``limit`` characters has no value, only its first characters and its
    length. An archive or entry that is broken, encrypted, unsafe, packed twice or above the limits gives one row with
    an error and no position; the others of its archive are read. Empty entries are errors, or with ``allow_empty``, have
    no lines. Entries are those of ``archive_entries``.
    """
    listed = stash(archive_entries(spark, path, options, every))
    wrong = listed.filter("error is not null").select(
        "file", "entry", *(F.lit(None).cast(t).alias(n) for n, t in (("position", "bigint"), ("value", "string"), ("preview", "string"), ("characters", "bigint"), ("oversized", "boolean"), ("encoding", "string"))), "error"
    )
    entries = listed.filter("error is null")
    count, packed = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum("packed"), F.lit(0))).first()
    tasks = max(min(count, max(4 * spark.sparkContext.defaultParallelism, -(-packed // TASK))), 1)
    # rows of one archive lie side by side, so that its entries go to different tasks
    dealt = entries.withColumn("_task", (F.monotonically_increasing_id() % tasks).cast("int")).repartitionById(tasks, F.col("_task"))
    o = options

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["file", "kind", "number", "entry", "packed"]).to_pylist():
                entry = (row["file"], row["kind"], row["number"])
                encoding, error = checked(entry, row["packed"], o)
                if error:
                    yield pa.RecordBatch.from_pylist([{"file": row["file"], "entry": row["entry"], "error": error}], _LINE_SCHEMA)
                    continue
                held, size = [], 0
                for position, value, preview, characters, oversized in entry_lines(entry, encoding, o.errors, limit):
                    held.append((row["file"], row["entry"], position, value, preview, characters, oversized, encoding, None))
                    size += len(value or "") + len(preview)
                    if len(held) >= ROWS or size >= BYTES:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return dealt.mapInArrow(run, LINES).unionByName(wrong)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LINE_SCHEMA.types, strict=True)], schema=_LINE_SCHEMA)
