"""Lines of plain text files, with their numbers, and with a bound on what a line may hold in memory.

``numbered_lines`` reads with Spark's own text source. A file's lines may lie in several splits, each of which one
task reads; a line's number is its place in the split after the lines of the splits before it, which are counted first.

``bounded_lines`` reads byte ranges in Python tasks, a chunk at a time: a line over the limit is drained to its end
without being held, and comes out as one row without text. Files are opened by pyarrow, which knows local paths, HDFS,
S3 and others by their scheme; where only Spark can open a path, use ``numbered_lines``.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .ingest import irregular
from .shared import stash

PACKED = (".gz", ".zip", ".bz2", ".xz", ".zst")
CHUNK = 1 << 16
PREVIEW = 200


def plain(path: str, follow_symlinks: bool = False) -> str:
    """The path, unless its name is that of a packed file: these go through ``ingest`` or ``archive_lines``. Local paths
    must be files or folders, and no links unless ``follow_symlinks``."""
    if problem := irregular(path, follow_symlinks):
        raise ValueError(f"{path}: {problem}")
    if path.lower().rstrip("/").endswith(PACKED):
        raise ValueError(f"{path} is packed: unpack it with ingest, or read its folder")
    return path


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", follow_symlinks: bool = False) -> DataFrame:
    """file, position (line number from 1, without gaps) and value of every line.

    Splits are counted in one pass; their counts, one row for each split, are summed along each file and joined back.
    Empty files have no lines; a last line end does not begin another line. Packed files are refused.
    """
    codecs.lookup(encoding)  # an unknown one is an error here and not in a task
    lines = spark.read.option("encoding", encoding).text(plain(path, follow_symlinks))
    # ids rise with the rows of a partition without gaps, and a split's rows lie together in one
    rows = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), F.rtrim("value", F.lit("\r")).alias("value")
    )
    counts = rows.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stash(counts.select(F.col("file").alias("_file"), F.col("_split").alias("_s"), "_first", before.alias("_before")))
    joined = rows.join(starts, (F.col("file") == F.col("_file")) & (F.col("_split") == F.col("_s")))
    return joined.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("position"), "value")


class Range(InputPartition):
    """Lines that begin in a byte range of a file."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    local = uri.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(uri) if ":/" in local else (pa.fs.LocalFileSystem(), local)


def range_lines(stream: Any, start: int, end: int, limit: int, encoding: str) -> Iterator[tuple[int, str | None, str, int, bool]]:
    """Offset, text, preview, characters and whether it is over the limit, of the lines that begin in [start, end).

    At most ``limit`` characters and CHUNK bytes of a line are held.
    """
    most = 4 * limit + CHUNK  # bytes that can hold ``limit`` characters
    if start:
        stream.seek(start - 1)  # a line begins at start if the byte before is a line end
    begin, held, size, head, skipping = start, bytearray(), 0, b"", start > 0
    count = codecs.getincrementaldecoder(encoding)("replace")
    characters = 0
    while skipping or begin < end:
        chunk = stream.read(CHUNK)
        if not chunk:
            break
        at = 0
        while at < len(chunk) and (skipping or begin < end):
            stop = chunk.find(b"\n", at)
            piece = chunk[at : stop if stop >= 0 else len(chunk)]
            if not skipping:
                size += len(piece)
                if len(held) <= most:
                    held += piece
                    head = bytes(held[: 4 * PREVIEW])
                    if len(held) > most:  # from here on, characters are only counted
                        characters = len(count.decode(bytes(held)))
                        held = bytearray(held[: most + 1])
                else:
                    characters += len(count.decode(piece))
            at = len(chunk) if stop < 0 else stop + 1
            if stop >= 0:
                if skipping:
                    skipping, begin = False, stream.tell() - len(chunk) + at
                else:
                    yield _line(begin, held, head, characters, most, limit, encoding)
                    begin += size + 1
                held, size, head, characters = bytearray(), 0, b"", 0
                count.reset()
    if size and not skipping and begin < end:  # a last line without an end
        yield _line(begin, held, head, characters, most, limit, encoding)


def _line(begin: int, held: bytearray, head: bytes, characters: int, most: int, limit: int, encoding: str) -> tuple[int, str | None, str, int, bool]:
    preview = head.decode(encoding, "replace").rstrip("\r")[:PREVIEW]
    if len(held) > most:
        return begin, None, preview, characters, True
    text = bytes(held).decode(encoding, "replace").rstrip("\r")
    return begin, text if len(text) <= limit else None, preview, len(text), len(text) > limit


class BoundedLines(DataSource):
    """Options: path (a file or a folder), limit (characters), split (bytes of a range), encoding."""

    @classmethod
    def name(cls) -> str:
        return "bounded_lines"

    def schema(self) -> str:
        return "file string, split bigint, offset bigint, place bigint, value string, preview string, characters bigint, oversized boolean"

    def reader(self, schema: StructType) -> BoundedReader:
        return BoundedReader({k.lower(): v for k, v in dict(self.options).items()})


class BoundedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.limit = options["path"], int(options.get("limit", 1 << 20))
        self.size, self.encoding = int(options.get("split", 64 << 20)), options.get("encoding", "utf-8")
        self.follow = options.get("follow_symlinks", "false") == "true"

    def partitions(self) -> list[Range]:
        files, path = opened(self.path)
        info = files.get_file_info(path)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pa.fs.FileType.File else [f for f in files.get_file_info(pa.fs.FileSelector(path, recursive=True)) if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", "."))]
        scheme = self.path.split(":", 1)[0] + "://" if ":/" in self.path else ""
        for f in found:
            plain(scheme + f.path, self.follow)
        return [Range(scheme + f.path, at, min(at + self.size, f.size)) for f in sorted(found, key=lambda f: f.path) for at in range(0, f.size, self.size)]

    def read(self, part: Range) -> Iterator[tuple]:
        files, path = opened(part.file)
        with files.open_input_file(path) as stream:
            for k, (offset, text, preview, characters, oversized) in enumerate(range_lines(stream, part.start, part.end, self.limit, self.encoding)):
                yield part.file, part.start, offset, k, text, preview, characters, oversized


def bounded_lines(spark: SparkSession, path: str, limit: int = 1 << 20, split: int = 64 << 20, encoding: str = "utf-8", follow_symlinks: bool = False) -> DataFrame:
    """file, position (line number from 1), value, preview, characters and oversized of every line.

    A line over ``limit`` characters has no value, only its first PREVIEW characters and its length. Lines end with LF or
    CR LF. The encoding must write LF as the byte 10, as all but UTF-16 and UTF-32 do. Bytes that do not decode become
    replacement characters. Packed files are refused.
    """
    if "\n".encode(encoding) != b"\n":
        raise ValueError(f"lines of {encoding} cannot be found by bytes: use ingest")
    spark.dataSource.register(BoundedLines)
    options = {"path": plain(path, follow_symlinks), "follow_symlinks": str(follow_symlinks).lower(), "limit": str(limit), "split": str(split), "encoding": encoding}
    lines = spark.read.format("bounded_lines").options(**options).load()
    counts = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stash(counts.select(F.col("file").alias("_file"), F.col("split").alias("_split"), before.alias("_before")))
    joined = lines.join(starts, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    return joined.select("file", (F.col("_before") + F.col("place") + 1).alias("position"), "value", "preview", "characters", "oversized")
