"""Phrase collocations by HAT-trie counting: hash containers under a shallow trie of words, spilled and merged by prefix.

Each place in a text opens a window of at most four words, which ends with its piece; a phrase's occurrences are the
windows that begin with it. The windows form a trie of words.

1. Words are counted. A word with fewer than LEAST occurrences is in no phrase that matters, so windows end before it.
   Tasks know the frequent words by a Bloom filter of fixed size (FILTER bits); its false hits cost room, not rightness.
2. Tasks count windows in containers, one for each prefix bucket. When BUFFER words are held, all containers are
   spilled: each subtree goes out as one sorted run of different windows with their counts, front-coded by columns.
   First the windows are of two words; then, of up to four, and they end where two words that follow each other are no
   frequent pair, by another such filter: what is below a container that never bursts is not shuffled.
3. Runs are shuffled by bucket, sorted by it, and each bucket's runs are merged in turn. There, containers burst: the
   windows of a phrase are split by their next word only if the phrase has LEAST occurrences, level by level, down to
   four words. A bucket holds some BUCKET windows.
4. The trie's top bursts before the shuffle: a prefix is one word, but a hot word (over a HOT-th of all) does not make a
   prefix alone; the next word is added, up to four. Phrases of hot words alone are counted in several buckets and summed.
5. Counts of parts, scores, containment and ranks are joins and aggregates over the phrases left.

Words are known by 64 bits of a hash of language and word; phrases by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stash
from .words import GAPS, chunks, mix, signed

LEAST = 30
TOP = 2000
LONGEST = 4
#: A candidate goes if a longer one around it has so many hundredths of its occurrences.
SHARE = 80
#: Signs that end a piece, and that end a word.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
ENDS = GAPS | BREAKS
#: Words that a task holds before it spills, and windows of a bucket, on average.
BUFFER = 1 << 20
BUCKET = 500_000
#: Words with more than one in HOT of all occurrences are hot; there are fewer than HOT of them.
HOT = 256
#: Bits of the filter of frequent words, 2 MB.
FILTER = 1 << 24


@lru_cache(4096)
def _language(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def _words(batches: Iterator[pa.RecordBatch], names: bool):
    """For some texts at a time: ids of words, whether a word is its piece's last, and, with ``names``, what gives the
    words at some places."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        seeds = np.array([_language(x) for x in langs], np.uint64)
        for first, _, words in chunks(batch.column("text"), ENDS):
            if not len(words):
                continue
            ids = mix(words.hashes(1, fold=True) ^ seeds[words.doc + first])
            ids[ids == 0] = 1  # 0 stands for no word
            broken = np.r_[0, np.cumsum(BREAKS[words.data])]
            last = np.ones(len(words), bool)
            last[:-1] = (words.doc[1:] != words.doc[:-1]) | (broken[words.start[1:]] > broken[words.end[:-1]])
            yield ids, last, (words, first, langs) if names else None


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, a spill of BUFFER words at a time."""
    held: list[tuple] = []
    size = 0

    def spill() -> pa.RecordBatch:
        ids = np.concatenate([x[0] for x in held])
        where = np.concatenate([np.stack([np.full(len(x[0]), k), x[2]]) for k, x in enumerate(held)], axis=1)
        found, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([x[1] for x in held])).astype(np.int64)
        k, at = where[:, first]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(signed(found)),
                pa.array([held[i][4][j] for i, j in zip(k.tolist(), at.tolist())], pa.string()),
                pa.array([held[i][3][j] for i, j in zip(k.tolist(), at.tolist())], pa.binary()).cast(pa.string()),
                pa.array(counts),
            ],
            ["id", "lang", "word", "n"],
        )

    for ids, _, (words, first, langs) in _words(batches, True):
        found, at, counts = np.unique(ids, return_index=True, return_counts=True)
        text = words.data.tobytes().lower()  # of bytes: A to Z alone
        named = [text[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
        held.append((found, counts, np.arange(len(found)), named, [langs[i + first] for i in words.doc[at].tolist()]))
        size += len(found)
        if size >= BUFFER // 2:
            yield spill()
            held, size = [], 0
    if held:
        yield spill()


def encoded(windows: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: the number of its words and windows, the words' ids, then columns of places among these, each column
    as differences to the row before, and counts."""
    ids, places = np.unique(windows, return_inverse=True)
    kind = np.uint16 if len(ids) <= 1 << 16 else np.uint32
    columns = places.reshape(windows.shape).astype(kind)
    columns[1:, 0] -= columns[:-1, 0].copy()
    wide = np.uint8 if counts.max(initial=0) < 256 else np.uint64
    head = np.array([len(ids), len(windows), np.dtype(kind).itemsize, np.dtype(wide).itemsize], np.uint64)
    return b"".join([head.tobytes(), ids.tobytes(), np.ascontiguousarray(columns.T).tobytes(), counts.astype(wide).tobytes()])


def decoded(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words, windows as places among them, counts."""
    n_ids, n, kind, wide = np.frombuffer(run, np.uint64, 4).tolist()
    at = 32
    ids = np.frombuffer(run, np.uint64, n_ids, at)
    at += 8 * n_ids
    columns = np.frombuffer(run, f"u{kind}", n * LONGEST, at).reshape(LONGEST, n).T.copy()
    columns[:, 0] = np.cumsum(columns[:, 0], dtype=columns.dtype)
    at += kind * n * LONGEST
    return ids, columns, np.frombuffer(run, f"u{wide}", n, at)


def prefix_bucket(windows: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a window's prefix: its first word, and more words as long as all before are hot."""
    hashed = mix(windows[:, 0] + np.uint64(1))
    grows = np.isin(windows[:, 0], hot)
    for k in range(1, LONGEST):
        hashed = np.where(grows, mix(hashed ^ (windows[:, k] + np.uint64(k + 1))), hashed)
        grows &= np.isin(windows[:, k], hot)
    return (hashed % np.uint64(buckets)).astype(np.int64)


def _slots(columns: list[np.ndarray]) -> np.ndarray:
    """The filter's bit of each word, or of each pair of words."""
    key = columns[0]
    for other in columns[1:]:
        key = mix(key + np.uint64(0x9E3779B97F4A7C15)) ^ other
    return key % np.uint64(FILTER)


def _hits(bits: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    slot = _slots(columns)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _mark_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            slot = _slots([c.to_numpy().view(np.uint64) for c in batch.columns])
            at, inverse = np.unique(slot >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (slot & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(signed(bits))], ["at", "bits"])


def filter_of(rows: DataFrame) -> np.ndarray:
    """The filter of all rows of one or two columns of ids; FILTER / 64 rows at most reach the driver."""
    marks = rows.mapInArrow(_mark_batches, "at int, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER // 64, np.uint64)
    bits[marks.column("at").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    return bits


def _window_batches(hot: np.ndarray, bits: np.ndarray, pairs: np.ndarray | None, buckets: int):
    """Sorted runs of windows of two words, or, with the filter of pairs, of three and four."""
    longest, shortest = (2, 2) if pairs is None else (LONGEST, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def spill() -> pa.RecordBatch:
            ids, last = (np.concatenate(x) for x in zip(*held))
            frequent = _hits(bits, [ids])
            # follows[i]: the window may go on from word i to the next
            follows = ~last
            follows[:-1] &= frequent[:-1] & frequent[1:]
            follows[-1] = False
            if pairs is not None:
                at = np.flatnonzero(follows)
                follows[at] = _hits(pairs, [ids[at], ids[at + 1]])
            reach, size = follows.copy(), np.ones(len(ids), np.int8)
            for k in range(1, longest):
                size += reach
                reach[: len(ids) - k] &= follows[k:]
                reach[max(0, len(ids) - k) :] = False
            start = np.flatnonzero(size >= shortest)
            # places of words among all, 0 for no word
            words, place = np.unique(ids, return_inverse=True)
            words = np.r_[np.zeros(1, np.uint64), words]
            windows = np.zeros((len(start), LONGEST), np.int64)
            for k in range(longest):
                there = size[start] > k
                windows[there, k] = place[start[there] + k] + 1
            width = np.int64(max(1, int(len(words)).bit_length()))
            low, high = (windows[:, 2] << width) | windows[:, 3], (windows[:, 0] << width) | windows[:, 1]
            order = np.lexsort((low, high))
            low, high, windows = low[order], high[order], windows[order]
            new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])][: len(order)])
            counts = np.diff(np.r_[new, len(order)])
            windows = words[windows[new]]
            bucket = prefix_bucket(windows, hot, buckets)
            order = np.argsort(bucket, kind="stable")
            windows, counts, bucket = windows[order], counts[order], bucket[order]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
            runs = [encoded(windows[a:b], counts[a:b]) for a, b in zip(edges, np.r_[edges[1:], len(bucket)])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges]), pa.array(runs, pa.binary())], ["bucket", "run"])

        for ids, last, _ in _words(batches, False):
            held.append((ids, last))
            size += len(ids)
            if size >= BUFFER:
                yield spill()
                held, size = [], 0
        if held:
            yield spill()

    return run


def burst(windows: np.ndarray, counts: np.ndarray, is_hot: np.ndarray, least: int, shortest: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of ``shortest`` to four words (as places, 0 for none) with their counts; all windows are as long at least.

    A container is split by the next word if it has ``least`` occurrences or, being of hot words alone, may have more
    elsewhere.
    """
    n = len(is_hot) + 1
    group, hot = windows[:, 0], is_hot[windows[:, 0]]
    for k in range(1, LONGEST):
        keep = windows[:, k] > 0
        windows, counts, group, hot = windows[keep], counts[keep], group[keep], hot[keep]
        if not len(windows):
            return
        found, first, group = np.unique(group * n + windows[:, k], return_index=True, return_inverse=True)
        total = np.bincount(group, counts).astype(np.int64)  # below 2**53 in one bucket
        hot = hot & is_hot[windows[:, k]]
        if k + 1 < shortest:
            continue
        splits = (total >= least) | hot[first]
        phrase = windows[first[splits]].copy()
        phrase[:, k + 1 :] = 0
        yield phrase, total[splits]
        keep = splits[group]
        windows, counts, group, hot = windows[keep], counts[keep], group[keep], hot[keep]


def _merge_batches(hot: np.ndarray, least: int, shortest: int):
    def merged(runs: list[bytes]) -> pa.RecordBatch:
        parts = [decoded(x) for x in runs]
        ids = np.unique(np.concatenate([np.zeros(1, np.uint64), *(p[0] for p in parts)]))  # 0 is the first
        windows = np.concatenate([np.searchsorted(ids, i)[w] for i, w, _ in parts])
        counts = np.concatenate([c.astype(np.int64) for _, _, c in parts])
        found = list(burst(windows, counts, np.isin(ids, hot), least, shortest))
        phrase = np.concatenate([np.zeros((0, LONGEST), np.int64), *(p for p, _ in found)])
        total = np.concatenate([np.zeros(0, np.int64), *(t for _, t in found)])
        return pa.RecordBatch.from_arrays([*(pa.array(signed(ids[phrase[:, k]])) for k in range(LONGEST)), pa.array(total)], ["w1", "w2", "w3", "w4", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, []
        for batch in batches:
            for bucket, x in zip(batch.column("bucket").to_pylist(), batch.column("run")):
                if bucket != now and runs:
                    yield merged(runs)
                    runs = []
                now = bucket
                runs.append(x.as_py())
        if runs:
            yield merged(runs)

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """id, lang, word, n of all words of (lang, text) rows."""
    return docs.mapInArrow(_count_batches, "id bigint, lang string, word string, n bigint").groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, words: DataFrame, total: int, least: int) -> DataFrame:
    """w (ids of two to four words) and a for all phrases with at least ``least`` occurrences. ``words``: id, n of
    those words that have as many."""
    spark = docs.sparkSession
    # fewer than HOT rows, and FILTER / 64 at most
    hot = np.array([r.id for r in words.filter(F.col("n") * HOT > total).select("id").collect()], np.int64).view(np.uint64)
    bits = filter_of(words.select("id"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = max(4 * parts, total // BUCKET)
    names = [f"w{k + 1}" for k in range(LONGEST)]

    def counted(pairs: np.ndarray | None) -> DataFrame:
        runs = docs.mapInArrow(_window_batches(hot, bits, pairs, buckets), "bucket bigint, run binary")
        runs = runs.repartition(parts, "bucket").sortWithinPartitions("bucket")
        found = runs.mapInArrow(_merge_batches(hot, least, 2 if pairs is None else 3), ", ".join(f"{n} bigint" for n in [*names, "a"]))
        # phrases of hot words alone have a row from several buckets
        return stash(found.groupBy(*names).agg(F.sum("a").alias("a")).filter(F.col("a") >= least))

    pairs = counted(None)
    whole = pairs.unionByName(counted(filter_of(pairs.select("w1", "w2"))))
    return whole.select(F.expr("filter(array(w1, w2, w3, w4), w -> w != 0)").alias("w"), "a")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A to Z are lower-cased; texts are split at ``.,;:!?`` and LF to CR into pieces, these at spaces and tabs into words.
    Phrases of two to four words with at least ``least`` occurrences (a) are cut where floor(2000000 * a / (l + r)) is
    least, ties to the first cut; l and r are occurrences of the two parts, n of all words of the language. A phrase
    inside a longer one with at least ``share`` hundredths of its occurrences is dropped.

    Null texts count as empty, null languages as ``und``. Repeated rows count as often as they stand there. Texts
    are taken whole; a task needs some 100 bytes for each byte of a text beyond 600 KB. An empty table gives no rows. Only
    lang and text are read.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = stash(word_counts(docs))
    langs = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = words.filter(F.col("n") >= least)
    phrases = stash(phrase_counts(docs, frequent, total, least))
    counts = stash(phrases.unionByName(frequent.select(F.array("id").alias("w"), F.col("n").alias("a"))))
    sub = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))))")
    around = phrases.filter("size(w) > 2").select(F.explode(sub).alias("w"), F.col("a").alias("longer")).groupBy("w").agg(F.max("longer").alias("longer"))
    kept = phrases.join(around, "w", "left").filter(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {share}").select("w", "a")
    cuts = kept.select("w", "a", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("w", "a", "k", F.expr("slice(w, 1, k)").alias("head"), F.expr("slice(w, k + 1, size(w) - k)").alias("tail"))
    cuts = cuts.join(counts.select(F.col("w").alias("head"), F.col("a").alias("l")), "head").join(counts.select(F.col("w").alias("tail"), F.col("a").alias("r")), "tail")
    # exact: decimals of 38 digits
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cuts.withColumn("score", score).groupBy("w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.join(frequent.select(F.col("id").alias("head"), "lang"), F.col("w")[0] == F.col("head")).select("lang", "w", "a", "cut.score", "cut.l", "cut.r")
    # words are looked up for those that can be among the first, all ties included
    order = [F.desc("score"), F.desc("a")]
    near = stash(scored.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).drop("rank"))
    spelt = near.select("w", F.posexplode("w").alias("k", "id")).join(frequent.select("id", "word"), "id")
    spelt = spelt.groupBy("w").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(k, word))), x -> x.word)"), " ").alias("phrase"))
    ranked = near.join(spelt, "w").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
