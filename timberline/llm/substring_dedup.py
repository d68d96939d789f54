"""Removes passages that occur more than once anywhere in a corpus, by relative Lempel-Ziv factors.

The reference is the whole corpus. No task can hold it, so it is cut into blocks at content-defined anchors and
indexed by anchor: among the ``window - ANCHOR + 1`` runs of ANCHOR words that a window of ``window`` words holds, the
one with the least hash (the leftmost of equals) is the window's anchor. Equal windows have equal anchors at equal
offsets, so every occurrence of a window is found under its anchor, in whichever block of the reference it is. An
anchor owns a run of consecutive windows; the words that they cover are its block.

1. A pass over the texts emits anchors with a hash of their block. Anchors that occur once in the corpus own no
   repeated window and go. What is left is the index of reference blocks that a document can match.
2. A block that equals another one as a whole is one factor.
3. Where blocks of an anchor differ, one of them, the commonest, is the anchor's indexed reference block. Every other
   one is factored against it: from the anchor, the match is extended to both sides as far as it goes, and a factor
   (place, length) of at least ``window`` words is repeated. All windows of a block hold its anchor, so those that the
   reference block has too are inside the factor.
4. Windows that reach over a factor's boundary can only be repeated in blocks that leave the reference block as well.
   These windows are checked by their hashes.
5. Factors become spans, documents are read once more, and covered words removed.

Windows and blocks are compared by 128 bits of hashes, words in factors by 64. Tasks hold a chunk of texts or a batch of
blocks at a time; nothing goes to the driver. Anchors are summed before the shuffle; an anchor with many different
blocks is dealt into parts of about PART blocks, each with the reference block; joins read plain shuffles and written
tables, which adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .tables import row_key, stash
from .words import Words, chunks, mix, signed, span_hashes

WINDOW = 35
ANCHOR = 8
#: Different blocks of one anchor that are factored in one task, on average, at most.
PART = 500
#: Windows whose anchors are sought at once; a place in a piece has to fit 24 bits.
PIECE = 1 << 23


def anchors_of(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: its word, the first and last window that it owns, and hashes of anchor and block."""
    valid = words.windows(window)
    if not len(valid):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    one, two = words.hashes(1), words.hashes(2)
    grams = np.arange(len(words) - anchor + 1)
    gram = span_hashes(one, grams, grams + anchor, 3)
    width, places = window - anchor + 1, []
    for first in range(0, len(gram) - width + 1, PIECE):  # pieces overlap by what a window spans
        least = gram[first : first + PIECE + width - 1]
        # the high 40 bits decide, then the place in the piece: the leftmost of equals
        least = (least & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(least), dtype=np.uint64)
        have = 1
        while have < width:  # the least of ``have`` grams, widened until it spans a window
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        places.append((least & np.uint64(0xFFFFFF)).astype(np.int64) + first)
    place = np.concatenate(places)[valid]
    doc = words.doc[valid]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[new[1:], len(valid)] - 1
    place, low, high = place[new], valid[new], valid[last]
    block = span_hashes(two, low, high + window, 4)
    block = mix(block ^ ((place - low).astype(np.uint64) << np.uint64(32)) ^ (high - place + window).astype(np.uint64))
    return place, low, high, gram[place], block


def _anchor_batches(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in chunks(batch.column("text")):
                place, low, high, gram, block = anchors_of(words, window, anchor)
                if len(place):
                    doc = words.doc[place]
                    rows = pa.array(doc + first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(rows),
                            batch.column("row_hash").take(rows),
                            pa.array((low - words.first[doc]).astype(np.int32)),
                            pa.array((high - low + 1).astype(np.int32)),
                            pa.array((place - low).astype(np.int32)),
                            pa.array(signed(gram)),
                            pa.array(signed(block)),
                        ],
                        ["doc_id", "row_hash", "low", "n", "shift", "anchor", "block"],
                    )

    return run


def _block_batches(window: int):
    """The word hashes, packed, of the blocks that a row's ``places`` name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            for first, last, words in chunks(batch.column("text")):
                part = places.slice(first, last - first)
                place = part.flatten()
                doc = np.repeat(np.arange(last - first), np.asarray(part.value_lengths().fill_null(0)))
                low = np.asarray(place.field("low")).astype(np.int64) + words.first[doc]
                size = np.asarray(place.field("n")).astype(np.int64) + window - 1
                hashes = words.hashes(1)[_runs(low, size)]
                edges = pa.py_buffer(np.r_[0, np.cumsum(size) * 8].astype(np.int32).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), len(size), [None, edges, pa.py_buffer(hashes.tobytes())])
                rows = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("row_hash").take(rows), place, packed],
                    ["doc_id", "row_hash", "place", "words"],
                )

    return run


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, end to end."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def factors_of(block: np.ndarray, base: np.ndarray, middle: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest match around column ``middle`` of each row with its base row begins, and its length; 0 in
    ``block`` stands for no word."""
    same = (block == base) & (block != 0)
    left = np.cumprod(same[:, :middle][:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    right = np.cumprod(same[:, middle:], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    return middle - left, left + right


def _factor_batches(window: int, anchor: int):
    """Factors (at, length) of blocks, sorted so that the reference block of an anchor and part comes first, and the
    hashes (one, two) of windows that no factor covers."""
    middle, width = window - anchor, 2 * window - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_row: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = base_row is not None
            if held:
                batch = pa.Table.from_batches([base_row, batch]).combine_chunks().to_batches()[0]
            low, n, shift = (batch.column(c).to_numpy().astype(np.int64) for c in ("low", "n", "shift"))
            is_base, alone = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("is_base", "alone"))
            base = np.maximum.accumulate(np.where(is_base, np.arange(len(low)), 0))
            base_row = batch.slice(int(base[-1]), 1)
            size = n + window - 1
            words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64)
            block = np.zeros((len(low), width), np.uint64)
            block[np.repeat(np.arange(len(low)), size), _runs(middle - shift, size)] = words
            begin, length = factors_of(block, block[base], middle)
            other = np.flatnonzero(~is_base & (np.arange(len(low)) >= held))
            long = other[length[other] >= window]
            # a factor is repeated in its block and in the reference block; there, equal ones are named once
            mine = long[alone[long]]
            pairs = np.unique(np.stack([base[long], begin[long], length[long]]), axis=1)
            pairs = pairs[:, alone[pairs[0]]]
            owner, start, count = np.r_[mine, pairs[0]], np.r_[begin[mine], pairs[1]], np.r_[length[mine], pairs[2]]
            yield _rows(batch, owner, low[owner] + start - middle + shift[owner], count, None, None)
            # windows outside factors, by their first column
            covered = np.zeros(len(low), np.int64)
            covered[long] = length[long] - window + 1
            first = middle - shift[other]
            before = np.where(covered[other] > 0, begin[other] - first, n[other])
            after = n[other] - before - covered[other]
            who = np.r_[np.repeat(other, before), np.repeat(other, after)]
            column = np.r_[_runs(first, before), _runs(first + before + covered[other], after)]
            if len(who):
                flat, at = block.ravel(), who * width + column
                one = span_hashes(flat, at, at + window, 5)
                two = span_hashes(mix(flat + np.uint64(7)), at, at + window, 6)
                yield _rows(batch, who, low[who] + column - middle + shift[who], np.full(len(who), window), one, two)

    def _rows(batch, who, at, length, one, two) -> pa.RecordBatch:
        take = pa.array(who)
        none = pa.nulls(len(who), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(take),
                batch.column("row_hash").take(take),
                pa.array(at.astype(np.int32)),
                pa.array(length.astype(np.int32)),
                batch.column("alone").take(take),
                none if one is None else pa.array(signed(one)),
                none if two is None else pa.array(signed(two)),
            ],
            ["doc_id", "row_hash", "at", "length", "alone", "one", "two"],
        )

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, part: int | None = None) -> DataFrame:
    """doc_id, row_hash, spans: places (low, n) of the first words of repeated windows, of rows that have any."""
    rows = docs.select(*row_key(), "text")
    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_hash binary"
    anchors = rows.mapInArrow(
        _anchor_batches(window, anchor), f"{key}, low int, n int, shift int, anchor bigint, block bigint"
    )
    # small sides are written, so that joins read plain shuffles, whose hot partitions adaptive execution splits
    repeated = stash(
        anchors.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("total"), F.min("block").alias("least"), F.max("block").alias("most"))
        .filter("total > 1")
        .select("anchor", (F.col("least") != F.col("most")).alias("mixed"))
    )
    found = stash(anchors.join(repeated, "anchor").withColumn("place", F.xxhash64("doc_id", "row_hash", "low")))
    mixed = found.filter("mixed")
    blocks = stash(mixed.groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("copies"), F.min("place").alias("first")))
    index = stash(
        blocks.groupBy("anchor").agg(
            F.ceil(F.count(F.lit(1)) / (part or PART)).cast("int").alias("parts"), F.min(F.struct(-F.col("copies"), "block"))["block"].alias("base")
        )
    )
    judged = mixed.join(blocks, ["anchor", "block"])
    place = F.struct(
        "low", "n", "shift", "anchor", (F.col("copies") == 1).alias("alone"), (F.col("block") == F.col("base")).alias("is_base"),
        F.pmod(F.xxhash64("block"), "parts").cast("int").alias("part"), "parts",
    )
    named = judged.filter("place = first").join(index, "anchor").groupBy("doc_id", "row_hash").agg(F.collect_list(place).alias("places"))
    pieces = _with_text(rows, named, "inner").mapInArrow(
        _block_batches(window),
        f"{key}, place struct<low: int, n: int, shift: int, anchor: bigint, alone: boolean, is_base: boolean, part: int, parts: int>, words binary",
    ).select("doc_id", "row_hash", "place.*", "words")
    # a reference block goes to each part of its anchor: one row in ``part`` at most
    dealt = pieces.withColumn("part", F.explode(F.when(F.col("is_base"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
    factors = stash(
        dealt.repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part", F.desc("is_base"))
        .select("doc_id", "row_hash", "low", "n", "shift", "alone", "is_base", "words")
        .mapInArrow(_factor_batches(window, anchor), f"{key}, at int, length int, alone boolean, one bigint, two bigint")
    )
    windows = factors.filter("one is not null")
    again = stash(windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"))
    length = (F.col("length") - (window - 1)).alias("n")
    spans = (
        found.filter("not mixed").select("doc_id", "row_hash", "low", "n")
        .unionByName(judged.filter("copies > 1").select("doc_id", "row_hash", "low", "n"))
        .unionByName(factors.filter("one is null").select("doc_id", "row_hash", F.col("at").alias("low"), length))
        .unionByName(windows.filter("alone").join(again, ["one", "two"]).select("doc_id", "row_hash", F.col("at").alias("low"), length))
    )
    return spans.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("low", "n")).alias("spans"))


def _with_text(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    other = found.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), found.columns[-1])
    same = rows["doc_id"].eqNullSafe(other["_id"]) & (rows["row_hash"] == other["_hash"])
    return rows.join(other, same, how).drop("_id", "_hash")


def _keep_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, out = batch.column("spans"), []
            lengths = np.asarray(spans.value_lengths().fill_null(0)).tolist()
            flat = spans.flatten()
            low, n = np.asarray(flat.field("low")), np.asarray(flat.field("n"))
            done = 0
            for text, m in zip(batch.column("text"), lengths, strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                total = len(words)
                if m:
                    edge = np.zeros(total + 1, np.int32)
                    np.add.at(edge, low[done : done + m], 1)
                    np.add.at(edge, low[done : done + m] + n[done : done + m] + window - 1, -1)
                    words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                    done += m
                out.append((total, total - len(words), b" ".join(words)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rest"),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.binary()).cast(pa.string()),
                ],
                ["rest", "n_words", "n_removed", "text"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed and its text without repeated passages (words joined by one
    space).

    A word goes if it is covered by a window of ``window`` consecutive words that also starts elsewhere, in the
    same text or another one; windows are judged on the input alone. Null texts have no words and become empty;
    texts shorter than a window stay whole. Repeated rows repeat each other's windows. Texts of any length are taken
    whole. An empty table gives no rows. Other columns stay; those named n_words or n_removed give way.
    """
    others = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    rows = docs.select(F.struct(*others).alias("rest"), *row_key(), "text")
    schema = StructType(
        [
            StructField("rest", rows.schema["rest"].dataType),
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("text", StringType()),
        ]
    )
    return (
        _with_text(rows, repeated_spans(docs, window, anchor), "left")
        .select("rest", "text", "spans")
        .mapInArrow(_keep_batches(window), schema)
        .select("rest.*", "text", "n_words", "n_removed")
    )
