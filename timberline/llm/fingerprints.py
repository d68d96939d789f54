"""Document fingerprints from locally consistent parsing: equal substrings get equal phrase names, wherever they stand.

A text is parsed in levels. On each level

1. runs of an equal symbol become one symbol, named by symbol and length;
2. deterministic coin tossing labels each symbol by how it differs from its left neighbour: twice the place of the lowest
   bit in which the two differ, plus that bit. A few rounds bring labels below 8, and neighbours never have the same;
3. a phrase begins where a label is greater than both its neighbours. Phrases have 2 to some 15 symbols;
4. a phrase is named by a hash of its symbols. Names are the symbols of the next level, until one is left: the root.

A label depends on five symbols to its left at most, so the phrases inside an equal substring are equal but for a few
at its borders, at any offset. No hash decides where a phrase begins or ends, so unequal texts cannot share
boundaries by chance alone.

The fingerprint holds, for each of the first LEVELS levels, the least names of the text's phrases in BINS bins, one byte
each, and the root's name in front: equal texts have equal fingerprints, and the bins estimate which share of the
phrases two texts have in common. Tasks hold some 600 KB of texts at a time; labels and names of a longer text are made
a slice at a time, some 12 bytes of memory for each of its bytes in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .tables import stash, text_key
from .words import CHUNK, mix, span_hashes, texts

#: Bins of each level, from the lowest; phrases of the third have some 16 bytes.
BINS = (32, 32, 128)
LEVELS = len(BINS)
#: Likeness is judged on the highest level that has so many bins in use in both texts.
FILLED = 8
#: Rounds of coin tossing: 128, 14, 8 and 6 labels.
ROUNDS = 4
#: Symbols that are held as several 64-bit numbers at once.
SLICE = 1 << 20
ROOT = 8


def labels_of(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 for symbols of which neighbours differ; ``first`` are the first symbols of texts."""
    now, kind = symbols, symbols.dtype.type
    for _ in range(ROUNDS):
        out = np.empty(len(now), np.uint8)
        for a in range(0, len(now), SLICE):
            here = now[a : a + SLICE]
            before = np.empty_like(here)
            before[1:] = here[:-1]
            before[0] = now[a - 1] if a else 0
            heads = first[np.searchsorted(first, a) : np.searchsorted(first, a + len(here))] - a
            before[heads] = ~here[heads]
            differs = here ^ before
            place = np.bitwise_count((differs & (~differs + kind(1))) - kind(1)).astype(np.uint8)
            out[a : a + SLICE] = 2 * place + ((here >> place.astype(kind)) & kind(1)).astype(np.uint8)
        now, kind = out, np.uint8
    return now


def phrase_starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: at the first symbol of a text and at local maxima of labels, but not at its second symbol."""
    labels = labels_of(symbols, first)
    begins = np.zeros(len(labels), bool)
    begins[1:] = labels[1:] > labels[:-1]
    begins[:-1] &= labels[:-1] > labels[1:]
    ends = np.r_[first[1:], len(labels)] - 1
    begins[ends] = False
    second = first + 1
    begins[second[second < len(labels)]] = False
    begins[first] = True
    return np.flatnonzero(begins)


def names_of(symbols: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """The hash of each phrase, a slice of whole phrases at a time."""
    edges = np.r_[starts, len(symbols)]
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        upto = max(done + 1, int(np.searchsorted(edges, edges[done] + SLICE, side="right")) - 1)
        low = edges[done]
        part = mix(symbols[low : edges[upto]].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        out[done:upto] = span_hashes(part, edges[done:upto] - low, edges[done + 1 : upto + 1] - low, seed)
        done = upto
    return out


def without_runs(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and first symbols of texts once each run of an equal symbol is a single one."""
    new = np.ones(len(symbols), bool)
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[first] = True
    if new.all():
        return symbols, first
    starts = np.flatnonzero(new)
    length = np.diff(np.r_[starts, len(symbols)])
    out = symbols[starts].astype(np.uint64)
    several = length > 1
    out[several] = mix(mix(out[several] + np.uint64(0x632BE59BD9B4E019)) + length[several].astype(np.uint64))
    return out, np.searchsorted(starts, first)


def parsed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The root name of each text (0 for an empty one) and, for each level from the first, phrase names and their text."""
    size = np.diff(offsets)
    roots, levels = np.zeros(len(size), np.uint64), []
    text = np.flatnonzero(size)
    symbols, first = data, offsets[:-1][text].astype(np.int64)
    while len(text):
        symbols, first = without_runs(symbols, first)
        starts = phrase_starts(symbols, first)
        symbols = names_of(symbols, starts, 11 + len(levels))
        first = np.searchsorted(starts, first)
        count = np.diff(np.r_[first, len(symbols)])
        levels.append((symbols, np.repeat(text, count)) if len(levels) < LEVELS else (symbols[:0], text[:0]))
        whole = count == 1
        roots[text[whole]] = symbols[first[whole]]
        left = np.repeat(~whole, count)
        symbols, text = symbols[left], text[~whole]
        first = np.cumsum(count[~whole]) - count[~whole]
    return roots, levels


def fingerprints_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ROOT + sum(BINS) bytes for each text; 0 in a bin stands for no phrase."""
    n = len(offsets) - 1
    roots, levels = parsed(data, offsets)
    out = np.zeros((n, ROOT + sum(BINS)), np.uint8)
    out[:, :ROOT] = roots[:, None].view(np.uint8).reshape(n, 8)[:, ::-1]
    at = ROOT
    for (names, text), bins in zip(levels, BINS):
        least = np.full(n * bins, 2**64 - 1, np.uint64)
        # the low bits choose the bin, all bits, mixed anew, the least
        np.minimum.at(least, text * bins + (names % np.uint64(bins)).astype(np.int64), mix(names ^ np.uint64(0xD6E8FEB86659FD93)))
        used = least != 2**64 - 1
        out[:, at : at + bins] = np.where(used, 1 + least % np.uint64(255), 0).astype(np.uint8).reshape(n, bins)
        at += bins
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated share, 0 to 1, of phrases that two texts have in common among those of either, for rows of
    fingerprints; 1 for equal fingerprints, also of two empty texts."""
    n = len(a)
    out, level = np.zeros(n), np.zeros(n, np.int64)
    shares, at = [], ROOT
    for k, bins in enumerate(BINS):
        x, y = a[:, at : at + bins], b[:, at : at + bins]
        at += bins
        both, either = ((x == y) & (x > 0)).sum(1), ((x > 0) | (y > 0)).sum(1)
        chance = 1 / 255
        shares.append(np.clip((both / np.maximum(either, 1) - chance) / (1 - chance), 0, 1))
        level[np.minimum((x > 0).sum(1), (y > 0).sum(1)) >= FILLED] = k
    out = np.choose(level, shares)
    out[(a == b).all(1)] = 1.0
    return out


def _chunked(buffers: list[bytes]) -> np.ndarray:
    """Fingerprints of texts, some CHUNK bytes at a time."""
    out, first = [np.zeros((0, ROOT + sum(BINS)), np.uint8)], 0
    size = np.cumsum([len(x) for x in buffers])
    while first < len(buffers):
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + CHUNK, side="right")))
        data = np.frombuffer(b"".join(buffers[first:last]), np.uint8)
        out.append(fingerprints_of(data, np.r_[0, size[first:last] - before]))
        first = last
    return np.concatenate(out)


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in rows], pa.string())


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        found = _chunked([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])])
        yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("text"), _hex(found)], ["rest", "text", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its ``fingerprint``, in hex.

    Null texts count as empty; their root is 0 and no bin is in use. Equal texts, repeated rows among them, have equal
    fingerprints. Texts are taken whole. An empty table gives no rows. Other columns stay; one named fingerprint gives way.
    """
    others = [c for c in docs.columns if c not in ("text", "fingerprint")]
    rows = docs.select(F.struct(*others).alias("rest"), "text")
    schema = StructType([*rows.schema, StructField("fingerprint", StringType())])
    return rows.mapInArrow(_fingerprint_batches, schema).select("rest.*", "text", "fingerprint")


#: What the comparison of a document, its edited text and the next document gives.
FOUND = [
    StructField("n_chars", LongType()),
    StructField("edited_sha256", StringType()),
    StructField("fingerprint", StringType()),
    StructField("edited_fingerprint", StringType()),
    StructField("near_edited", DoubleType()),
    StructField("near_next", DoubleType()),
]


def _edited(own: list[bytes], after: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Code points of each text, and the text whose last quarter is replaced by the beginning of the next one."""
    lengths, out = [], []
    for text, other in zip(own, after, strict=True):
        begins = _code_points(text)
        n = len(begins)
        cut = n // 4
        head = text[: int(begins[n - cut])] if cut else text
        # what follows is sought no farther than it can be needed
        tail = other[: 4 * cut + 4]
        starts = _code_points(tail)
        lengths.append(n)
        out.append(head + (tail[: int(starts[cut])] if cut < len(starts) else tail if cut else b""))
    return lengths, out


def _code_points(text: bytes) -> np.ndarray:
    return np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)


def _compared(rest: pa.Array, own: list[bytes], after: list[bytes], rows: np.ndarray, next_rows: np.ndarray) -> list[pa.Array]:
    lengths, edited = _edited(own, after)
    other = _chunked(edited)
    return [
        rest,
        pa.array(lengths, pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
        _hex(rows),
        _hex(other),
        pa.array(likeness(rows, other)),
        pa.array(likeness(rows, next_rows)),
    ]


_NAMES = ["rest", *(f.name for f in FOUND), "part", "edge", "text"]


def _neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares rows in order; the first and the last of a partition also go out with their texts, as edges 0 and 1."""
    held: tuple | None = None
    part = None

    def edge(kind: int) -> pa.RecordBatch:
        rest, text = held[0], held[1]
        return pa.RecordBatch.from_arrays(
            [rest, *(pa.nulls(1, pa.from_numpy_dtype(np.int64) if f.dataType == LongType() else pa.float64() if f.dataType == DoubleType() else pa.string()) for f in FOUND), pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([text], pa.binary())],
            _NAMES,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        for begin in range(0, batch.num_rows, 512):
            piece = batch.slice(begin, 512)
            rest, data_offsets = piece.column("rest"), texts(piece.column("text"))
            data, offsets = data_offsets
            own = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            rows = _chunked(own)
            if held is None:
                part = piece.column("part")[0].as_py()
                held = (rest.slice(0, 1), own[0], rows[:1])
                yield edge(0)
                n = len(own) - 1
                left = rest.slice(0, n), own[:-1], own[1:], rows[:-1], rows[1:]
            else:
                n = len(own)
                left = (
                    pa.concat_arrays([held[0], rest.slice(0, n - 1)]), [held[1], *own[:-1]], own, np.concatenate([held[2], rows[:-1]]), rows
                )
            if n:
                yield pa.RecordBatch.from_arrays(
                    [*_compared(*left), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], _NAMES
                )
            held = (rest.slice(len(own) - 1, 1), own[-1], rows[-1:])
    if held is not None:
        yield edge(1)


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, after = batch.column("text").to_pylist(), batch.column("next").to_pylist()
        yield pa.RecordBatch.from_arrays(_compared(batch.column("rest"), own, after, _chunked(own), _chunked(after)), _NAMES[:7])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` without its text, with its fingerprint and that of its edited text.

    Rows stand in order of doc_id, null first, rows of one doc_id by a digest of their texts; after the last one comes
    the first. The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next row's text. Adds n_chars, edited_sha256, fingerprint, edited_fingerprint, and near_edited and near_next, the
    likeness to the edited text and to the next row.

    Null texts count as empty; a row alone is its own next; texts are taken whole, a very long one is held by one task
    together with those beside it. Repeated rows follow each other. An empty table gives no rows. Other columns stay;
    those named like an added one give way.

    Texts are shuffled once, by ranges of the order, which repeated ids cannot make uneven. The first and last rows of
    the ranges, two for each partition, are compared in a second, small step.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != "text" and c not in {f.name for f in FOUND}]
    order = ["_id", "_digest", "_row"]
    rows = docs.select(F.struct(*others).alias("rest"), "text", F.col("doc_id").alias("_id"), text_key().alias("_digest"), F.monotonically_increasing_id().alias("_row"))
    # a row's number tells repeated rows apart for the ranges alone: they are the same wherever they land
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("rest", "text", F.spark_partition_id().alias("part"))
    rest = StructField("rest", rows.schema["rest"].dataType)
    schema = StructType([rest, *FOUND, StructField("part", IntegerType()), StructField("edge", IntegerType()), StructField("text", BinaryType())])
    found = stash(dealt.mapInArrow(_neighbour_batches, schema))
    firsts = found.filter("edge = 0").select(F.col("part").alias("other"), F.col("text").alias("next"))
    # numbers of partitions that have rows, not what is in them
    used = sorted(r.part for r in found.filter("edge = 0").select("part").collect())
    follows = spark.createDataFrame(list(zip(used, [*used[1:], *used[:1]])), "part int, other int")
    lasts = found.filter("edge = 1").select("rest", "part", "text").join(follows, "part").join(firsts, "other")
    closed = lasts.select("rest", "text", "next").mapInArrow(_pair_batches, StructType([rest, *FOUND]))
    return found.filter("edge is null").select("rest", *(f.name for f in FOUND)).unionByName(closed).select("rest.*", *(f.name for f in FOUND))
